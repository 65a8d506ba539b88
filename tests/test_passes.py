"""How often a query makes the rows that it reads several times."""

import pytest
from pyspark.sql import functions as F

from peptora.operators import kernels, metrics
from peptora.plans import registry


def test_agreement_makes_its_rows_once(spark, tmp_path):
    """Failed by time: each rank and quantile made them anew, and a filter once more."""
    log = str(tmp_path / "made")

    @F.udf("double")
    def seen(x):
        with open(log, "a") as f:
            f.write("x")
        return None if x == 7 else float(x * x % 11)

    rows = spark.range(30).select((F.col("id") % 2).alias("g"), seen("id").alias("a"), F.col("id").cast("double").alias("b"))
    got = {r["g"]: r for r in metrics.agreement(rows, ["g"]).collect()}
    assert len(open(log).read()) == 30
    assert got[0]["n"] == 15 and got[1]["n"] == 14
    want = sorted(abs(k * k % 11 - k) for k in range(0, 30, 2))
    assert got[0]["median"] == pytest.approx(want[7]) and got[0]["mean"] == pytest.approx(sum(want) / 15)


def test_surrogate_route_maps_each_text_once(spark, tmp_path, monkeypatch):
    """Failed by time: the fit mapped its texts with each pass, and scoring mapped all of them again."""
    log, of = str(tmp_path / "mapped"), kernels.features_of

    def seen(seq):
        with open(log, "a") as f:
            f.write("x")
        return of(seq)

    rows = [(k, "MKKLLPPTAILQQNNSDE" * (k % 5 + 1) + "ACDEFGHIKL"[: k % 7], "en", "s", 0) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(kernels, "feature_map", lambda s: kernels.over_sequences(s, "features array<double>", lambda x: (seen(x),)))
    got = registry.QUERIES["j11_surrogate_route"](spark, str(tmp_path))
    assert got.where("score is not null").count() == 60
    assert len(open(log).read()) == 60
