import random
from collections import Counter

import plain
import pytest

import corpus_pipeline
from peptora.llm import quality, toxicity
from peptora.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near duplicates", "repeated passages", "packing"]


def pairs(rows, column):
    return [(r["doc_id"], r[column]) for r in rows]


def by_hand(docs, labels):
    """Rows (doc_id, text) after each of the first four stages, all by the plain versions."""
    steps, now = [], docs
    now = [x for x, s in zip(now, plain.toxic_scores(now, pairs(labels, "toxic"))) if s < 0.5]
    steps.append(now)
    now = [x for x, s in zip(now, plain.quality_scores(now, pairs(labels, "quality"))) if s >= quality.ACCEPT]
    steps.append(now)
    now = [now[k] for k in plain.kept_of_copies(now)]
    steps.append(now)
    now = [(i, t) for (i, _), t in zip(now, plain.without_repeats(now))]
    steps.append(now)
    return steps


def check_packed(rows, docs):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == plain.pieces(docs)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in held.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(held) == plain.best_fit_decreasing([r["length"] for r in rows])


def test_run_is_the_plain_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    steps = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], labels.collect())
    step = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        step = stage(spark, step, SMALL).cache()
        assert step.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in step.collect()) == Counter(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in step.collect() if r["text"] is not None)
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), steps[-1])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, repeated rows and ids, copies; labels with nulls and repeats; and no rows at all."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "en", "su"]) for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 5 == 0
        rows.append((i, prose(60) + " !!! %%% %%% %%%" * bad + " stinker indeed" * toxic, "en", "s", None))
        labels.append((i, None if i % 17 == 0 else int(not bad), int(toxic)))
    long = prose(30_000)
    rows += [(300, long, None, None, len(long)), (301, long + " more", "en", "s", 1), (302, None, "en", "s", 0), (303, "", "en", None, 0), (None, prose(70), "en", "s", 9), (None, None, None, None, None)]
    rows += [rows[7], (8, prose(80), "en", "s", 1), (304, prose(40) + " " + " ".join(rows[1][1].split()[:58]), "en", "s", 1)]
    labels += [(3, 0, 1), (None, 1, 1), (999, 1, 0), (5, None, None)]
    folder = tmp_path_factory.mktemp("odd")
    for name, n in (("some", None), ("none", 0)):
        docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        docs, marks = (docs, marks) if n is None else (docs.limit(0), marks)
        docs.repartition(3).write.parquet(f"{folder}/{name}/documents.parquet")
        marks.write.parquet(f"{folder}/{name}/labels.parquet")
    return str(folder), [(r[0], r[1]) for r in rows], [dict(zip(("doc_id", "quality", "toxic"), x)) for x in labels]


def test_odd_rows_go_through_every_stage(spark, odd):
    folder, rows, labels = odd
    steps = by_hand(rows, labels)
    step = spark.read.parquet(f"{folder}/some/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        step = stage(spark, step, f"{folder}/some").cache()
        assert Counter((r["doc_id"], r["text"]) for r in step.collect()) == Counter(want), name
    assert len(steps[0]) < len(rows) and len(steps[3]) > 100
    check_packed(corpus_pipeline.run(spark, f"{folder}/some").collect(), steps[-1])
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_stages_keep_columns_of_any_name(spark, odd):
    folder, _, _ = odd
    docs = spark.read.parquet(f"{folder}/some/documents.parquet")
    names = ["rest", "body", "spans", "label", "score", "predicted", "held_out", "kept", "removed", "n_words", "host", "row", "fp", "target"]
    more = docs.selectExpr("*", *[f"'own {n}' as {n}" for n in names], "named_struct('a b', 5, 'c`d', array(named_struct('e f', 6))) as `odd name`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, f"{folder}/some")
        assert got.schema.fieldNames() == more.schema.fieldNames() and got.schema["odd name"].dataType == more.schema["odd name"].dataType, name
        rows = got.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names) and all(r["odd name"]["a b"] == 5 and r["odd name"]["c`d"][0]["e f"] == 6 for r in rows), name


@pytest.mark.parametrize("operator, scores, column", [(quality.score_documents, plain.quality_scores, "quality"), (toxicity.score_documents, plain.toxic_scores, "toxic")])
def test_scores_are_the_plain_ones(spark, odd, operator, scores, column):
    folder, rows, labels = odd
    got = operator(spark.read.parquet(f"{folder}/some/documents.parquet"), spark.read.parquet(f"{folder}/some/labels.parquet")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    want = sorted(((i, t, s) for (i, t), s in zip(rows, scores(rows, pairs(labels, column)))), key=key)
    for a, b in zip(sorted(((r["doc_id"], r["text"], r["score"]) for r in got), key=key), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-4)
