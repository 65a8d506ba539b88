"""Summaries taken in batches against those of the residue table, which SQL and plain Python hold elsewhere."""

import random

import pytest
from pyspark.sql import functions as F

from peptora.functions.tables import HYDROPATHY10, prion_ratio
from peptora.operators import batches
from peptora.operators import residues as R
from peptora.plans import registry

RUN = lambda t: F.col("last") - F.col("first")
MINUS = {a: -v for a, v in HYDROPATHY10.items()}

#: Of each query: the summary in batches, and the same from the residue table.
PAIRS = {
    "d06_profile_statistics": (batches.profile_statistics, lambda t: R.profile_statistics(R.profile(t))),
    "e14_papa": (batches.prion_propensity_peak, R.prion_propensity_peak),
    "e16_core_domains": (lambda s, **k: batches.core_domains(s, MINUS, 20, **k), lambda t: R.core_domains(R.fold_index(t), F.col("fi") < 0, R.valued(MINUS), 20)),
    "d05_window_summaries": (batches.window_summaries, R.window_summaries),
    "e21_spread_average": (batches.spread_average_peaks, lambda t: R.own(R.spread_average(R.residue_scores(t), "score")).groupBy("acc").agg(*[F.max(f"avg_{w}").alias(f"high_{w}") for w in (20, 40, 60)])),
    "e10_prion_like": (lambda s, **k: batches.best_window(s, prion_ratio(), 60, shorter=False, **k), lambda t: R.best_window(t, R.valued(prion_ratio()), 60, shorter=False)),
    "e09_best_window": (lambda s, **k: batches.best_window(s, {"N": 1, "Q": 1}, 80, shorter=True, **k), lambda t: R.best_window(t, F.col("aa").isin("N", "Q").cast("long"), 80, shorter=True)),
    "e15_longest_run": (lambda s, **k: batches.run_summary(s, "DEKR", **k), lambda t: R.runs(t, F.col("aa").isin("D", "E", "K", "R")).groupBy("acc").agg(F.max("size").alias("longest"), F.count("*").alias("stretches"))),
    "e20_top_neighbourhood": (batches.top_neighbourhood, lambda t: R.top_neighbourhood(R.residue_scores(t), "score")),
    "e13_disordered_runs": (batches.disorder_summary, lambda t: R.disordered_runs(t).groupBy("acc").agg(F.count("*").alias("stretches"), F.sum(RUN(t)).alias("residues"), F.max(RUN(t)).alias("longest"), F.min("first").alias("first"))),
    "j10_aligned_profile": (batches.aligned_profile_summary, lambda t: R.aligned_profile(R.profile(t), R.own(R.residue_scores(t)).groupBy("acc").agg(F.avg("score").alias("single"))).groupBy("acc").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))),
}


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    kinds = ["DEKR", "AILV", "NQ", "P", "ACDEFGHIKLMNPQRSTVWY", "ACDEFGHIKLMNPQRSTVWYX"]
    sizes = [*range(1, 9), 19, 20, 21, 40, 41, 42, 49, 50, 51, 52, 59, 60, 61, 79, 80, 81, 149, 150, 151, 300, 700]
    seqs = [(f"P{n}", "".join(rng.choice(rng.choice(kinds)) for _ in range(n))) for n in sizes]
    seqs += [("low", "DDDDDDDK" * 60), ("prion", "QNQNQNSPPSPYG" * 20), ("é", "É" + "KD" * 90), ("null", None), ("none", "")]
    return spark.createDataFrame(seqs, "acc string, seq string").repartition(3).cache()


def near(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(round(r[c], 8) + 0.0 if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", PAIRS)
def test_batches_equal_the_residue_table(made, name):
    of, table = PAIRS[name]
    want = near(table(R.residues(made)))
    assert want[1]
    # Whole sequences; and those over 100 letters by the table, with a bound that says which may be over.
    assert near(of(made)) == want
    assert near(of(made.withColumn("_most", F.coalesce(F.octet_length("seq") + 3, F.lit(0))), long=100)) == want


def test_groups_of_any_size_give_the_same(made, monkeypatch):
    want = {name: near(of(made)) for name, (of, _) in PAIRS.items() if name[:3] in ("e14", "e16", "d06")}
    monkeypatch.setattr(batches, "TOGETHER", 1)
    assert all(near(PAIRS[name][0](made)) == w for name, w in want.items())
    assert list(batches.groups(["AA", None, "", "AAAA", "A", "A", "A"], 3, 3)) == [[0, 4], [5, 6]]


def test_one_sequence_an_accession(spark):
    twice = spark.createDataFrame([("A", "ACDE" * 9), ("A", "ACDE" * 9)], "acc string, seq string")
    with pytest.raises(Exception, match="several sequences of accession A"):
        batches.run_summary(twice, "DEKR").collect()
    with pytest.raises(Exception, match="no accession"):
        batches.run_summary(spark.createDataFrame([(None, "ACDE")], "acc string, seq string"), "DEKR").collect()


@pytest.mark.parametrize("name", PAIRS)
def test_queries_make_no_row_a_residue(spark, tmp_path, name):
    """Failed by memory, disk or time: the residue table of all texts was sorted. Only texts of over a million letters make residue rows."""
    rows = [(k, "MKKLLPPTAILQQNNSDE" * k, "en", "s", 18 * k) for k in range(1, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert got.count() > 0
    exploded = [int(n) for n in _rows_of_generate(got)]
    assert sum(exploded) == 0


def _rows_of_generate(df):
    """Rows that each posexplode made when the plan ran."""
    df.foreach(lambda r: None)
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if p.nodeName() == "Generate" and "posexplode" in p.toString().split("\n")[0]:
            out.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return out


def test_residue_rows_are_counted(made):
    """The count above sees the rows of the residue table."""
    assert sum(map(int, _rows_of_generate(R.residues(made.where("length(seq) = 300"))))) == 300
