"""JSON objects of any size: one object keyed by accession, cut at its top-level keys by many tasks.

A file is read in ranges, each in pieces that end at a closing brace. Whether a piece begins inside a
string, and how deep, hangs on all pieces before it; both are sums, so a range adds up its own pieces,
the ranges' sums are added in order, and every piece then knows where it stands. Pieces between two
ends of top-level values are one entry, parsed by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptora.sources.shared import written


def _count(text: str, letter: str) -> F.Column:
    return F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(letter), F.lit("")))


def object_entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """key, value (of the type ``kind``) of each entry of the JSON object, or objects, in the files under ``path``.

    Entries come in no order; a key that repeats comes each time. Values that don't fit ``kind`` are null, as are JSON nulls. Strings may
    hold braces, quotes and escapes. An entry is held by one task, a file never.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))
    bare = pieces.withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))
    strings = lambda c: F.regexp_replace(c, r'"[^"]*("|\z)', "")
    bare = bare.withColumns({"_out": strings(F.col("_bare")), "_in": strings(F.regexp_replace("_bare", r'^[^"]*("|\z)', ""))})
    deeper = lambda c: _count(c, "{") + _count(c, "[") - _count(c, "]")
    pieces = written(bare.select("file", "range", "at", "value", _count("_bare", '"').alias("quotes"), deeper("_out").alias("outside"), deeper("_in").alias("inside")), "pieces")
    order = Window.partitionBy("file", "range").orderBy("at")
    ranges = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def placed(rows: DataFrame, of: str, name: str) -> DataFrame:
        """``name``: the sum of ``of`` over all pieces of the file before."""
        sums = rows.groupBy("file", "range").agg(F.sum(of).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(ranges), F.lit(0))).drop("_sum")
        return rows.withColumn(name, before(of)).join(sums, ["file", "range"]).withColumn(name, F.col(name) + F.col("_start")).drop("_start")

    rows = placed(pieces.drop("value"), "quotes", "_quotes")
    opened = F.when(F.col("_quotes") % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
    closes = ((F.col("_quotes") + F.col("quotes")) % 2 == 0).cast("int")
    rows = rows.select("file", "range", "at", opened.alias("opened"), closes.alias("closes")).withColumn("step", F.col("opened") - F.col("closes"))
    rows = placed(rows, "step", "depth")
    ends = ((F.col("closes") == 1) & (F.col("depth") + F.col("step") == 1)).cast("int")
    rows = placed(rows.select("file", "range", "at", "opened", "depth", ends.alias("ends")), "ends", "entry").where("depth >= 1 or opened > 0")
    entries = rows.join(pieces.select("file", "range", "at", "value"), ["file", "range", "at"])
    entries = entries.groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("range", "at", "value"))).alias("pieces"), F.max("ends").alias("ended"))
    text = F.concat(F.regexp_replace(F.array_join("pieces.value", "}"), r"^[\s,{]+", ""), F.when(F.col("ended") == 1, "}").otherwise(""))
    return entries.select(text.alias("text")).where("text != ''").select(F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{kind}>")).alias("key", "value"))


def write_objects(rows: DataFrame, path: str) -> None:
    """Each task's rows (key, and value as JSON text) as one JSON object in a file."""
    import json

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = False
        for b in batches:
            lines = [f"{json.dumps(k)}: {v}" for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if lines:
                lines = [("," if began or k else "{") + x for k, x in enumerate(lines)]
                began = True
                yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
        if began:
            yield pa.RecordBatch.from_arrays([pa.array(["}"])], ["value"])

    rows.select("key", "value").mapInArrow(run, "value string").write.text(path)
