"""Validation layers as tables of check rows, and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.operators.assemble import compare_to_targets, sequence_overlap

CHECK = "layer string, name string, verdict string, hard boolean, measured string, threshold string"


def leakage_layer(train: DataFrame, test: DataFrame) -> DataFrame:
    """Check rows for shared accessions (hard), shared sequences and label conflicts. Tables: acc, seq, label."""
    shared = train.select("acc").distinct().join(test.select("acc").distinct(), "acc", "left_semi").agg(F.count("*").alias("n"))
    overlap = sequence_overlap(train, test).selectExpr("stack(2, 'shared sequences', sequences, 'label conflicts', conflicts) as (name, n)")
    rows = shared.select(F.lit("shared accessions").alias("name"), "n", F.lit(True).alias("hard")).unionByName(overlap.withColumn("hard", F.lit(False)))
    return rows.select(F.lit("leakage").alias("layer"), "name", F.when(F.col("n") == 0, "pass").otherwise("fail").alias("verdict"), "hard", F.col("n").cast("string").alias("measured"), F.lit("0").alias("threshold"))


def metric_layer(measured: DataFrame, targets: DataFrame, tolerance: float, layer: str = "auc") -> DataFrame:
    """Check rows of (name, value) against (name, target)."""
    got = compare_to_targets(measured, targets, tolerance)
    return got.select(F.lit(layer).alias("layer"), "name", "verdict", F.lit(False).alias("hard"), F.col("value").cast("string").alias("measured"), F.col("target").cast("string").alias("threshold"))


def consistency_layer(manifests: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Check rows of manifest fields (one row a manifest, columns as text) against expected values; a missing field is a skip."""
    fields = [f for f in expected]
    have = manifests.select("task", *[(F.col(f).cast("string") if f in manifests.columns else F.lit(None).cast("string")).alias(f) for f in fields])
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = have.selectExpr("task", f"stack({len(fields)}, {pairs}) as (field, measured)")
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("field")]
    verdict = F.when(F.col("measured").isNull(), "skip").when(F.col("measured") == want, "pass").otherwise("fail")
    return long.select(F.lit("consistency").alias("layer"), F.concat_ws(".", "task", "field").alias("name"), verdict.alias("verdict"), F.lit(True).alias("hard"), "measured", want.alias("threshold"))


def stale_models(manifests: DataFrame, version: str) -> DataFrame:
    """task, stale: made under other feature definitions, or under none that is known."""
    return manifests.select("task", F.coalesce(F.col("feature_definitions_version") != version, F.lit(True)).alias("stale"))


def summary(checks: DataFrame) -> DataFrame:
    """passed, failed, skipped, hard_failed."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    return checks.agg(of("pass").alias("passed"), of("fail").alias("failed"), of("skip").alias("skipped"), F.count_if((F.col("verdict") == "fail") & F.col("hard")).alias("hard_failed"))


def exit_code(checks: DataFrame, strict_layers: tuple[str, ...] = ()) -> DataFrame:
    """code: 1 for a hard failure, or any failure in a layer that is held strictly; else 0."""
    bad = (F.col("verdict") == "fail") & (F.col("hard") | F.col("layer").isin(*strict_layers))
    return checks.agg(F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("code"))


REPORT = f"checks array<struct<{CHECK.replace(' ', ':').replace(',:', ',')}>>, summary struct<passed:long,failed:long,skipped:long,hard_failed:long>, thresholds map<string,string>, inputs map<string,string>"


def report(checks: DataFrame, path: str, thresholds: Mapping[str, str] | None = None, inputs: DataFrame | None = None) -> None:
    """One JSON document of the schema REPORT: checks in order, their summary, thresholds, and inputs (one row, columns as text).

    There are as many checks as layers have names, whatever the tables' size, and no clock values, so that
    equal results give equal bytes.
    """
    rows = checks.agg(F.array_sort(F.collect_list(F.struct("layer", "name", "verdict", "hard", "measured", "threshold"))).alias("checks"))
    given = F.create_map(*[F.lit(str(x)) for kv in sorted((thresholds or {}).items()) for x in kv]) if thresholds else F.create_map().cast("map<string,string>")
    out = rows.crossJoin(summary(checks).select(F.struct("passed", "failed", "skipped", "hard_failed").alias("summary"))).withColumn("thresholds", given)
    if inputs is None:
        out = out.withColumn("inputs", F.create_map().cast("map<string,string>"))
    else:
        out = out.crossJoin(inputs.limit(1).select(F.create_map(*[x for c in inputs.columns for x in (F.lit(c), F.col(c).cast("string"))]).alias("inputs")))
    out.coalesce(1).write.mode("overwrite").json(path)


def manifest_row(spark: SparkSession, name: str, path: str, table: DataFrame) -> DataFrame:
    """name, row_count, columns, bytes, digest of a written table: rows are counted in ``table``, read from ``path``.

    The digest is that of the files' own digests in order, so it tells any change of a byte.
    """
    got = spark.read.format("binaryFile").load(path).select(F.col("length"), F.sha2("content", 256).alias("digest"))
    sizes = got.agg(F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"))
    return table.agg(F.lit(name).alias("name"), F.count("*").alias("row_count"), F.lit(len(table.columns)).alias("columns")).crossJoin(sizes)


def expected_sizes(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """The manifest's rows with a verdict against expected (name, row_count, columns); a table that isn't expected is a skip."""
    want = expected.select("name", F.col("row_count").alias("_rows"), F.col("columns").alias("_columns"))
    same = (F.col("row_count") == F.col("_rows")) & (F.col("columns") == F.col("_columns"))
    return manifest.join(want, "name", "left").withColumn("verdict", F.when(F.col("_rows").isNull(), "skip").when(same, "pass").otherwise("fail")).drop("_rows", "_columns")
