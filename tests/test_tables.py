import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peptora.operators import assemble as A
from peptora.operators import audit, checks, kernels, learn, metrics, sampling
from peptora.operators.predict import predict
from peptora.sources import files
from peptora.sources import objects as objects_
from peptora.streaming import arrivals


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    write(tmp_path / "a.fasta", ">sp|P1|ONE some text\nACDE\nfg h\n>tr|P2|TWO\n\n>P3.1+x more\nKKK\n")
    write(tmp_path / "b.fasta", ">P4\nAA\n")
    got = {r["acc"]: r for r in files.read_fasta(spark, f"{tmp_path}/*.fasta").collect()}
    assert {k: r["seq"] for k, r in got.items()} == {"P1": "ACDEFGH", "P2": "", "P3.1": "KKK", "P4": "AA"} and got["P1"]["length"] == 7
    assert [r["acc"] for r in files.empty_records(files.read_fasta(spark, str(tmp_path))).collect()] == ["P2"]
    assert "P3.1+x" in {r["acc"] for r in files.read_fasta(spark, f"{tmp_path}/a.fasta", strict_id=False).collect()}


def test_masked_fasta(spark, tmp_path):
    got = files.read_masked_fasta(spark, write(tmp_path / "m.fasta", ">P1\nACxxde\nF\n")).first()
    assert got["label"] == [0, 0, 1, 1, 1, 1, 0]


def test_cache_keeps_the_last(spark, tmp_path):
    schema = "accession string, length int, at long"
    path = str(tmp_path / "cache")
    files.write_json_cache(spark.createDataFrame([("P1", 1, 1), ("P2", 2, 1)], schema), path)
    files.write_json_cache(spark.createDataFrame([("P1", 5, 2)], schema), path, append=True)
    assert {r["accession"]: r["length"] for r in files.read_json_cache(spark, path, schema, "accession", ["at"]).collect()} == {"P1": 5, "P2": 2}


def test_id_lists(spark, tmp_path):
    assert [r["acc"] for r in files.id_list(spark, "P2, P1,P2 ,,P3").collect()] == ["P2", "P1", "P3"]
    assert [r["acc"] for r in files.read_id_file(spark, write(tmp_path / "ids", "# all\nP9\n\nP1 # one\nP9\n")).collect()] == ["P9", "P1"]


def test_tables_round_trip(spark, tmp_path):
    assert files.read_table(spark, write(tmp_path / "t.csv", "a;b\n1;x,y\n")).first()["b"] == "x,y"
    schema = "acc string, gene string, x double, label int"
    df = spark.createDataFrame([("P1", "NA", 0.1 + 0.2, 1), ("P2", None, None, None)], schema)
    files.write_typed(df, str(tmp_path / "typed"), "acc")
    assert sorted(map(tuple, files.read_typed(spark, str(tmp_path / "typed"), schema).collect())) == [("P1", "NA", 0.1 + 0.2, 1), ("P2", None, None, None)]
    with pytest.raises(ValueError):
        files.write_typed(spark.createDataFrame([(None, "a", 1.0, 1)], schema), str(tmp_path / "bad"), "acc")


def test_site_table(spark, tmp_path):
    with gzip.open(tmp_path / "sites.gz", "wt") as f:
        f.write("042026\nnotice\n\nGENE\tACC_ID\tMOD_RSD\tORGANISM\nA\tP1\tS3-p\thuman\nA\tP1\tS5-p\thuman\nB\tP2\tT1-p\tmouse\n")
    sites = files.read_sites(spark, str(tmp_path / "sites.gz"))
    got = A.site_frequency(sites, spark.createDataFrame([("P1", 10), ("P2", 5)], "acc string, n long"), "human")
    assert {r["acc"]: r["value"] for r in got.collect()} == {"P1": 0.2, "P2": 0.0}
    assert files.version_marker(spark, str(tmp_path / "sites.gz")).first()["version"] == "042026"
    with pytest.raises(ValueError):
        files.read_below_banner(spark, str(tmp_path / "sites.gz"), ["NOTHING"])


def test_banners_of_several_files(spark, tmp_path):
    """Each file has its own banner, its own order of columns and columns of its own."""
    (tmp_path / "many").mkdir()
    write(tmp_path / "many" / "a.txt", "banner a\nsecond line\nGENE\tACC\tX\nA\tP1\t1\n\nB\tP2\t\n")
    write(tmp_path / "many" / "b.txt", "ACC\tGENE\tY\nP3\tC\ty\n")
    got = files.read_below_banner(spark, str(tmp_path / "many"), ["GENE", "ACC"])
    assert got.columns == ["GENE", "ACC", "X", "Y"]
    assert sorted(map(tuple, got.collect())) == [("A", "P1", "1", None), ("B", "P2", None, None), ("C", "P3", None, "y")]
    write(tmp_path / "many" / "c.txt", "banner only\n")
    with pytest.raises(ValueError):
        files.read_below_banner(spark, str(tmp_path / "many"), ["GENE", "ACC"])


def test_digest_counts_equal_rows(spark):
    digest = lambda rows: checks.set_digest(spark.createDataFrame(rows, "acc string, seq string"), ["acc", "seq"]).first()["digest"]
    assert digest([("a", "x"), ("b", "y")]) == digest([("b", "y"), ("a", "x")])
    assert len({digest([("a", "x")]), digest([("a", "x")] * 2), digest([("a", "x")] * 3), digest([("b", "x")])}) == 4


def test_search_returns_the_best_model(spark):
    """Rows with a missing feature count, and the models are those of each task's last rung, fitted on all rows."""
    rows = [("t", f"P{k}", float(k % 7), None if k % 5 == 0 else float(k % 3), int(k % 7 > 3)) for k in range(140)]
    df = spark.createDataFrame(rows, "task string, acc string, a double, b double, label int")
    space = {"trees": (3, 5), "depth": (1, 2), "rate": (0.1, 0.3)}
    found = learn.halving_search(df, ["a", "b"], 2, 2, first=2, space=space)
    best = [r["trial"] for r in found.where("kept").orderBy("rung").collect()][-1]
    nodes = learn.tuned_models(df, ["a", "b"], found)
    assert nodes.agg(F.max("tree")).first()[0] + 1 == learn.trial_settings(2, space=space)[best]["trees"]
    scored = learn.tree_scores(df, nodes, ["a", "b"], per_model=True)
    assert scored.count() == 140 and metrics.auc(scored, ["task"]).first()["auc"] == 1.0


def test_tool_outputs(spark, tmp_path):
    states = files.read_states(spark, write(tmp_path / "P1.espritz", "banner\nO\t0.27\nD\t0.81\nO 0.1\nO\t0.2\nword word word\n"))
    assert [(r["pos"], r["state"]) for r in states.orderBy("pos").collect()] == [(0, "O"), (1, "D"), (2, "O"), (3, "O")]
    prion = files.read_prion_output(spark, write(tmp_path / "plaac", "# c\nSEQid\tMW\tNLLR\nsp|P1|X\t1\t0.5\nP2\t1\nP3\t2\tx\n"))
    assert {r["acc"]: r["value"] for r in prion.collect()} == {"P1": 0.5, "P3": None}
    contact = files.read_contact_output(spark, write(tmp_path / "ps", "log\nPScore: -1.5 value >sp|P1|X\nnone\n"))
    assert [(r["acc"], r["value"]) for r in contact.collect()] == [("P1", -1.5)]
    (tmp_path / "coil").mkdir()
    write(tmp_path / "coil" / "P1.out", "raw_cc\tcc\n0.1\t0\n0.9\t1\n")
    assert files.read_coil_outputs(spark, str(tmp_path / "coil")).first()["raw_cc"] == [0.1, 0.9]


def test_lookup_and_dump(spark, tmp_path):
    got = files.read_lookup(spark, write(tmp_path / "l.tsv", "Swiss-Prot ID\tDeepPhase_score\nP1\t0.5\n\t0.1\nP2\tbad\n"), ["Swiss-Prot_ID", "Swiss-Prot ID"], "DeepPhase_score")
    assert [tuple(r) for r in got.collect()] == [("P1", 0.5)]
    dump = files.read_dump(spark, write(tmp_path / "d.json", '{"P1":{"Sequence":"AC","Entry name":"E","Organism":"O","catGRANULE":{"single":"1.5","residue":"1,x"}},"P2":{"Sequence":"A"}}'))
    rows = {r["acc"]: r for r in dump.collect()}
    assert rows["P1"]["residue"] == [1.0, None] and rows["P1"]["error"] == "unreadable number" and rows["P2"]["residue"] is None and rows["P2"]["error"] is None


def test_label_sources(spark, tmp_path):
    lines = files.read_label_lines(spark, write(tmp_path / "a.jsonl", '{"uniprot_id":"P1","organism":"Homo sapiens","aggregated_class":"PS-self x"}\n{"uniprot_id":"P2"}\n'))
    assert sorted(map(tuple, lines.collect())) == [("P1", True, True, False), ("P2", False, False, False)]
    assert [tuple(r) for r in files.read_label_map(spark, write(tmp_path / "m.json", '{"P1":{"organism":"Homo sapiens (Human)"}}')).collect()] == [("P1", True)]
    assert [tuple(r) for r in files.read_label_table(spark, write(tmp_path / "t.csv", "Uniprot ID,Species\nP1,Human\n ,Mouse\n")).collect()] == [("P1", True)]


def test_objects_are_cut_at_their_keys(spark, tmp_path):
    """Ranges of a few bytes; strings that hold braces, quotes, escapes and separators; nested values, nulls and no entries."""
    rng = random.Random(1)
    odd = ["}", "{", '"', "\\", ",", "]", "[", "\n", "é", '\\"', "}}", "a", '": {']

    def value(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind == 0:
            return "".join(rng.choice(odd) for _ in range(rng.randrange(9)))
        return rng.choice([None, 1.5, True, []]) if kind == 1 else {f"k{k}": value(depth - 1) for k in range(rng.randrange(4))} if kind == 2 else [value(depth - 1) for _ in range(3)]

    objects = [{f"P{n}{rng.choice(odd)}{k}": {"s": value(0) if rng.random() < 0.8 else "x", "more": value(3)} for k in range(60)} for n in range(3)]
    objects[1]["null"], objects[2]["last"] = None, None
    want = sorted(((k, None if v is None else None if v["s"] is None else v["s"] if isinstance(v["s"], str) else json.dumps(v["s"])) for o in objects for k, v in o.items()), key=str)
    for n, (o, indent) in enumerate(zip([*objects, {}], (None, 2, 1, None))):
        (tmp_path / f"{n}.json").write_text(json.dumps(o, indent=indent, ensure_ascii=n == 0) + "\n" * n, encoding="utf-8")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("200b", "100m"):
            spark.conf.set(key, size)
            got = objects_.object_entries(spark, str(tmp_path / "*.json"), "struct<s:string>").select("key", "value.s").collect()
            assert sorted((tuple(r) for r in got), key=str) == want
    finally:
        spark.conf.set(key, before)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("P/1", {"seg": {"label": [1.0, 0.0]}})], "acc string, tools map<string,map<string,array<double>>>")
    files.write_residue_json(df, str(tmp_path / "residues"))
    assert (tmp_path / "residues" / "name=P_1").is_dir()
    files.write_lists(spark.createDataFrame([("a", "P2"), ("a", "P1"), ("a", "P2")], "task string, acc string"), str(tmp_path / "lists"), ["task"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lists")).collect()] == ["P1", "P2"]
    path = write(tmp_path / "f.tsv", "a\tb\n1\t2\n3\t4\n")
    row = audit.manifest_row(spark, "f", path, files.read_table(spark, path))
    expected = spark.createDataFrame([("f", 2, 2), ("g", 1, 1)], "name string, row_count long, columns int")
    got = audit.expected_sizes(row, expected).first()
    assert (got["row_count"], got["columns"], got["bytes"], got["verdict"]) == (2, 2, 12, "pass")
    assert audit.expected_sizes(row, expected.where("name = 'g'")).first()["verdict"] == "skip"
    assert audit.expected_sizes(row, expected.selectExpr("name", "row_count + 1 as row_count", "columns")).first()["verdict"] == "fail"
    files.write_csv(spark.createDataFrame([("P1", 0.5), ("P2", None)], "acc string, score double"), str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True).collect())) == [("P1", "0.5"), ("P2", None)]


def test_report_is_one_document_with_equal_bytes(spark, tmp_path):
    checks_ = spark.createDataFrame([("b", "y", "fail", True, "1", "0"), ("a", "x", "pass", False, None, "0"), ("a", "w", "skip", False, None, None)], audit.CHECK)
    text = []
    for k in range(2):
        audit.report(checks_.repartition(k + 1), str(tmp_path / f"r{k}"), {"t": "0.1", "s": "2"}, spark.createDataFrame([(7,)], "n int"))
        (part,) = (tmp_path / f"r{k}").glob("part-*")
        text.append(part.read_bytes())
    assert text[0] == text[1]
    got = spark.read.schema(audit.REPORT).json(str(tmp_path / "r0")).first()
    assert [(c["layer"], c["name"]) for c in got["checks"]] == [("a", "w"), ("a", "x"), ("b", "y")]
    assert tuple(got["summary"]) == (1, 1, 1, 1) and got["thresholds"] == {"s": "2", "t": "0.1"} and got["inputs"] == {"n": "7"}


def test_fasta_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no record"):
        files.read_fasta(spark, write(tmp_path / "none.fasta", "just text\nmore\n"), strict=True)
    with pytest.raises(Exception, match="empty sequence of tr|P2"):
        files.read_fasta(spark, write(tmp_path / "empty.fasta", "\n>sp|P1|A\nACD\n>tr|P2|B\n\n"), strict=True).collect()
    assert files.read_fasta(spark, write(tmp_path / "fine.fasta", "\n>sp|P1|A\nACD\n"), strict=True).first()["seq"] == "ACD"


def test_predict_in_one_plan(spark, tmp_path):
    """A repeated accession, an empty record, letters that are no residue, an imported feature that some lack, and a column that none has."""
    path = write(tmp_path / "p.fasta", ">sp|P2|B x\nKKDDEEGG\n>sp|P1|A\nACDE\nFG\n>P3\n\n>sp|P2|B again\nAAAA\n>P4\nKUDER\n")
    members = spark.createDataFrame([("t", m, f, w, c, s) for m in (0, 1) for f, w, c, s in (("", 0.5 * m, 0.0, 1.0), ("fcr", 1.0, 0.5, 0.5), ("IDR", 2.0, 0.1, 0.1), ("gone", 9.0, 0.0, 1.0))], learn.MEMBERS)
    manifests = spark.createDataFrame([("t", "1"), ("u", "2")], "task string, feature_definitions_version string")
    imported = spark.createDataFrame([("P1", 0.2, 0.9), ("P9", 0.1, 0.1)], "acc string, IDR double, fcr double")
    got = predict(files.read_fasta(spark, path), members, manifests, "t", ["fcr", "IDR", "gone"], imported, "2").orderBy("ord").collect()
    assert [r["acc"] for r in got] == ["P2", "P1", "P4"] and [r["n"] for r in got] == [8, 6, 5] and all(r["stale"] for r in got)
    assert [r["missing"] for r in got] == [["IDR", "gone"], ["gone"], ["IDR", "gone"]]
    assert got[2]["hydropathy"] is None and got[2]["granule"] is None and got[2]["fcr"] == 0.8 and got[0]["granule"] is not None
    chance = lambda fcr, idr: sum(1 / (1 + math.exp(-(0.5 * m + (fcr - 0.5) / 0.5 + (2 * (idr - 0.1) / 0.1 if idr else 0)))) for m in (0, 1)) / 2
    assert [r["score"] for r in got] == pytest.approx([chance(0.75, None), chance(1 / 3, 0.2), chance(0.8, None)])


def test_auc(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.4), ("a", 1, 0.35), ("a", 1, 0.8), ("b", 1, 0.3), ("c", 0, 0.5), ("c", 1, 0.5)], "g string, label int, score double")
    assert {r["g"]: r["auc"] for r in metrics.auc(df, ["g"]).collect()} == {"a": 0.75, "b": None, "c": 0.5}
    assert {r["g"]: r["ap"] for r in metrics.average_precision(df, ["g"]).collect()}["a"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_negative_sets_and_training_rows(spark):
    pool = spark.range(50).select(F.lit("t").alias("task"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("acc"))
    sizes = spark.createDataFrame([("t", 20)], "task string, k long")
    out = pool.limit(20)
    got = sampling.negative_sets(pool, sizes, 3, 42, exclude=out).collect()
    assert len(got) == 60 and not {r["acc"] for r in got} & {r["acc"] for r in out.collect()}
    assert sorted(map(tuple, got)) == sorted(map(tuple, sampling.negative_sets(pool.repartition(7), sizes, 3, 42, exclude=out).collect()))
    labelled = pool.withColumn("label", (F.substring("acc", 2, 3).cast("int") < 10).cast("int"))
    rows = sampling.training_rows(labelled, models=2, n_folds=5).cache()
    assert rows.groupBy("fold", "model", "acc").count().where("count > 1").count() == 0
    assert {r["count"] for r in rows.where("label = 1 and role = 'validate'").groupBy("fold", "model").count().collect()} == {2}


def test_overlap_and_leakage(spark):
    train = spark.createDataFrame([("A", "MSH", 1), ("B", "AAA", 1), ("C", "CCC", 0)], "acc string, seq string, label int")
    test = spark.createDataFrame([("C", "CCC", 0), ("D", "MSH", 0), ("E", "MSH", 1)], "acc string, seq string, label int")
    assert tuple(A.sequence_overlap(train, test).first()) == (2, 3, 1)
    assert A.shared_sequences(train, test).count() == 3
    rows = {r["name"]: r["verdict"] for r in audit.leakage_layer(train, test).collect()}
    assert rows == {"shared accessions": "fail", "shared sequences": "fail", "label conflicts": "fail"}
    checks = audit.leakage_layer(train, test)
    assert audit.exit_code(checks).first()["code"] == 1 and audit.summary(checks).first()["hard_failed"] == 1
    clean = audit.leakage_layer(train, test.where("acc = 'none'"))
    assert audit.exit_code(clean, ("leakage",)).first()["code"] == 0


def test_label_precedence(spark):
    base = spark.createDataFrame([("A", True)], "acc string, self boolean")
    later = spark.createDataFrame([("A", True), ("B", True), ("B", None)], "acc string, partner boolean")
    got = {r["acc"]: tuple(r)[1:] for r in A.label_table([("base", base), ("later", later)], ["self", "partner"]).collect()}
    assert got == {"A": ("base", True, False), "B": ("later", False, True)}


def test_stale_models(spark):
    got = audit.stale_models(spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None)], "task string, feature_definitions_version string"), "2")
    assert {r["task"]: r["stale"] for r in got.collect()} == {"a": False, "b": True, "c": True}


def test_members_learn_and_missing_values_count_as_the_centre(spark):
    rows = spark.createDataFrame([("t", 0, f"P{k}", int(k % 4 == 0), float(k % 4 == 0) + k % 3 * 0.1, None if k % 5 == 0 else 1.0) for k in range(60)], "task string, model int, acc string, label int, x double, y double")
    members = learn.fit_members(rows, ["x", "y"])
    scored = learn.ensemble_scores(rows.drop("model"), members, ["x", "y"], per_model=True)
    assert metrics.auc(scored, ["task"]).first()["auc"] == 1.0
    assert members.count() == 3


def newton(x, y, penalty=1.0):
    """The same optimum for one group in memory."""
    w, x = np.zeros(x.shape[1] + 1), np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def test_groups_are_fitted_as_if_alone(spark):
    """Two keys of a group, missing values, a constant column and one that is missing throughout."""
    rng = np.random.default_rng(5)
    rows = [(t, m, int(rng.random() < 0.4), None if rng.random() < 0.2 else float(rng.normal(m)), 2.0, None) for t in "ab" for m in (0, 1) for _ in range(50)]
    df = spark.createDataFrame(rows, "task string, model int, label int, x double, y double, z double").repartition(5)
    got = {(r["task"], r["model"], r["feature"]): r for r in learn.fit_members(df, ["x", "y", "z"]).collect()}
    assert len(got) == 16
    for t in "ab":
        for m in (0, 1):
            own = [r for r in rows if r[:2] == (t, m)]
            x = np.array([np.nan if r[3] is None else r[3] for r in own])
            x = np.where(np.isnan(x), np.nanmedian(x), x)
            want = newton(np.column_stack([(x - x.mean()) / x.std(), np.zeros((50, 2))]), np.array([r[2] for r in own]))
            assert [got[t, m, f]["weight"] for f in ("x", "y", "z", "")] == pytest.approx(want.tolist(), abs=1e-7)
            assert (got[t, m, "x"]["centre"], got[t, m, "x"]["scale"]) == (pytest.approx(x.mean()), pytest.approx(x.std()))


def test_ranks_by_definition(spark):
    """Values of all signs and sizes, ties, nulls, and a null group."""
    rng = np.random.default_rng(6)
    rows = [(g, None if rng.random() < 0.1 else float(rng.choice([0.0, 1e-300, -1e-300, 1e300, *rng.normal(size=4), *(10.0 ** rng.integers(-5, 5, 4))])), int(rng.random() < 0.5)) for g in ("a", "b", None) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, label int").repartition(4)
    for r in metrics.with_ranks(df, ["g"], "x", "rank").collect():
        own = [x for g, x, _ in rows if g == r["g"] and x is not None]
        below, same = sum(x < r["x"] for x in own) if r["x"] is not None else None, own.count(r["x"])
        assert (r["rank_before"], r["rank"]) == ((below, below + (same + 1) / 2) if r["x"] is not None else (None, None))
    for r in metrics.auc(df, ["g"], score="x").collect():
        own = [(x, y) for g, x, y in rows if g == r["g"] and x is not None]
        pos, neg = [x for x, y in own if y], [x for x, y in own if not y]
        assert r["auc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))


def test_arrivals_once(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    schema = "acc string, seq string, retrieved_at timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, "acc string, seq string, at string").select("acc", "seq", F.to_timestamp("at").alias("retrieved_at")).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        arrivals.score_arrivals(stream, store, str(tmp_path / "checkpoint")).awaitTermination()

    arrive([("P1", "ACDE", "2024-01-01 00:00:00"), ("P1", "ACDE", "2024-01-01 00:01:00"), ("P2", "KUDER", "2024-01-01 00:00:00")])
    arrive([("P2", "KUDER", "2024-03-01 00:00:00"), ("P3", "KK", "2024-03-01 00:00:00")])
    got = {r["acc"]: r["fcr"] for r in spark.read.parquet(store).collect()}
    batch = {r["acc"]: r["fcr"] for r in arrivals.native_features(spark.read.schema(schema).parquet(str(source)).dropDuplicates(["acc"])).collect()}
    assert got == batch and spark.read.parquet(store).count() == 3


def test_arrivals_read_no_store_and_repeat_nothing(spark, tmp_path):
    """A stream's later batches hold what came against keyed state; another stream's rows in the store count too."""
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    schema = "acc string, seq string, retrieved_at timestamp"

    def arrive(rows, checkpoint="one"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        arrivals.score_arrivals(spark.readStream.schema(schema).parquet(str(source)), store, str(tmp_path / checkpoint)).awaitTermination()

    arrive([("P1", "AC", None), ("P2", "DE", None)])
    arrive([("P1", "AC", None), ("P3", "KK", None)])
    assert sorted(r["acc"] for r in spark.read.parquet(store).collect()) == ["P1", "P2", "P3"]
    arrive([("P4", "KR", None)], "two")
    assert sorted(r["acc"] for r in spark.read.parquet(store).collect()) == ["P1", "P2", "P3", "P4"]
    assert spark.read.parquet(store).select("stream").distinct().count() == 2
    assert spark.conf.get(arrivals.STATE, "none") != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "ts timestamp, value double"

    def run(rows):
        rows = spark.createDataFrame(rows, "at string, value double").select(F.to_timestamp("at").alias("ts"), "value")
        rows.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        _, late = arrivals.stream_counts(stream, "ts", "value", out, str(tmp_path / "checkpoint"), delay="30 minutes")
        return late, sorted((str(r["start"])[11:16], r["scored"], r["missing_rows"]) for r in spark.read.parquet(out).collect())

    first = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", None), ("2024-01-01 01:20:00", 2.0), ("2024-01-01 01:40:00", 2.0)]
    assert run(first) == (0, [("00:00", 1, 1)])
    # The first comes for a window that is closed, the second for one that is still open.
    assert run([("2024-01-01 00:59:00", 9.0), ("2024-01-01 01:05:00", 3.0), ("2024-01-01 03:00:00", None)]) == (1, [("00:00", 1, 1), ("01:00", 3, 0)])


def test_memo_computes_what_is_new(spark, tmp_path):
    store, computed = str(tmp_path / "memo"), []

    def compute(rows):
        computed.append(sorted((r["acc"] for r in rows.collect()), key=str))
        return rows.select("acc", F.length("seq").alias("n"))

    ask = lambda accs, version="1": [tuple(r) for r in A.memoised(spark.createDataFrame([(a, "A" * len(str(a)), k) for k, a in enumerate(accs)], "acc string, seq string, ord int"), store, compute, "radius 3", version).select("acc", "n", "cached").collect()]
    assert ask(["bb", "a", "bb"]) == [("bb", 2, False), ("a", 1, False), ("bb", 2, False)]
    assert ask(["ccc", "a"]) == [("ccc", 3, False), ("a", 1, True)]
    assert ask(["a", "ccc", "bb"]) == [("a", 1, True), ("ccc", 3, True), ("bb", 2, True)]
    assert computed == [["a", "bb"], ["ccc"]]
    assert ask(["a"], "2") == [("a", 1, False)]
    # Two runs at a time may both write an accession: the last counts, and rows don't multiply.
    spark.createDataFrame([("a", 77, 9)], "acc string, n int, run long").write.mode("append").parquet(f"{store}/parameters=radius 3/version=1")
    assert ask(["a"]) == [("a", 77, True)]


def test_repeated_cache_keys_and_null_orders(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 2)], "acc string, x int")
    cache = spark.createDataFrame([("a", 5, 1), ("a", 6, 2)], "acc string, value int, stamp int")
    assert sorted((r["acc"], r["value"], r["cached"]) for r in A.resolve_cached(asked, cache, ["acc"], "stamp").collect()) == [("a", 6, True), ("b", None, False)]
    rows = spark.createDataFrame([("k", "x", None), ("m", "y", None), ("m", "z", 3)], "key string, v string, at int")
    assert sorted(tuple(r) for r in A.first_occurrences(rows, "key", "at").collect()) == [("k", "x", None), ("m", "z", 3)]


def test_quantiles_by_definition(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, 0.0, -3.5, 1e300, 1e-300, float(rng.randrange(9)), rng.random()])) for g in ("p", "q", None) for _ in range(200)] + [("one", 4.0), ("none", None)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in metrics.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    assert set(got) == {"p", "q", None, "one"}
    for g, (n, q) in got.items():
        own = sorted(x for h, x in rows if h == g and x is not None)
        assert n == len(own)
        for s, x in zip(shares, q):
            at = s * (n - 1)
            low, high = own[int(at)], own[-int(-at // 1)]
            assert x == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_search_finds_what_each_trial_has_alone(spark):
    rng = random.Random(2)
    rows = [(t, f"{t}{k}", int(rng.random() < 0.4), rng.random(), rng.choice([None, 1.0, 2.0])) for t in ("s", "p") for k in range(80)]
    rows = [(t, a, y, x + y * 0.4, z) for t, a, y, x, z in rows]
    df = spark.createDataFrame(rows, "task string, acc string, label int, x double, z double")
    space = {"trees": (2, 6), "depth": (1, 3), "rate": (0.05, 0.3), "least": (1, 3)}
    many = {(r["task"], r["rung"], r["trial"]): r["auc"] for r in learn.halving_search(df, ["x", "z"], 3, 3, first=2, space=space).collect()}
    kept = [r for r in learn.halving_search(df, ["x", "z"], 3, 3, first=2, space=space).collect() if r["kept"]]
    assert [r["rung"] for r in kept if r["task"] == "s"] == [0, 0, 1]
    assert learn.trial_settings(5, space=space)[:2] == learn.trial_settings(2, space=space)
    alone = {(r["task"], r["rung"], r["trial"]): r["auc"] for r in learn.halving_search(df, ["x", "z"], 1, 3, first=2, space=space).collect()}
    assert alone["s", 0, 0] == pytest.approx(many["s", 0, 0]) and many["s", 0, 0] > 0.6


def test_surrogate_stands_in_for_the_score(spark):
    rng = random.Random(3)
    seqs = [(f"P{k}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY"[: rng.choice([8, 20])]) for _ in range(rng.randrange(60, 300)))) for k in range(240)]
    df = spark.createDataFrame(seqs, "acc string, seq string")
    rows = kernels.feature_map(df).join(learn.protein_scores(df).select("acc", "score"), "acc").cache()
    train, test = rows.where("acc < 'P3'"), rows.where("acc >= 'P3'")
    model = learn.surrogate(train)
    got = metrics.agreement(learn.surrogate_scores(model, test).withColumn("g", F.lit(1)).select("g", F.col("prediction").alias("a"), F.col("score").alias("b")), ["g"]).first()
    assert got["n"] > 70 and got["spearman"] > 0.9
    routed = {r["acc"]: r["score"] for r in learn.routed_scores(df, "surrogate", model=model).collect()}
    assert routed == {r["acc"]: pytest.approx(r["prediction"]) for r in learn.surrogate_scores(model, rows).collect()}
    raw = [learn.routed_scores(df, r, False).orderBy("acc").first()["score"] for r in ("surrogate", "paper")]
    assert raw[0] == raw[1]
    with pytest.raises(ValueError):
        learn.routed_scores(df, "surrogate")
