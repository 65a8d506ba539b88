"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of an Arrow batch: texts are long, and a task's batches stand in memory on both sides.
BATCH = 500


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may do without:
    there the driver is the executor, and a temporary folder is set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark then drops an execution's shuffle files when it ends, not when the driver's next collection comes.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor never repeats what stands before it, a table
    read twice is computed once, and the shuffle files of the write go when it is done.
    The tables hold derived, narrow rows, not texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/peptora-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/peptora-" in f}:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(conf).delete(path, True)


def bodies(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text's UTF-8 bytes (null text: empty), then the named columns."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"), *more)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_one(names: list[str]) -> Column:
    """The named columns as one struct ``rest`` of numbered fields, so that no name meets an operator's own."""
    return F.struct(F.lit(0).alias("n"), *(quoted(c).alias(f"c{k}") for k, c in enumerate(names))).alias("rest")


def apart(names: list[str]) -> list[Column]:
    """What as_one took, by its own names again."""
    return [F.col("rest")[f"c{k}"].alias(c) for k, c in enumerate(names)]


def ranked(df: DataFrame, keys: list[str], name: str, number: str) -> DataFrame:
    """``df`` in a global sort by ``keys``, with dense integers from 0 in that order: a written table.

    A row's number is its place in its sorted partition, after all rows of the partitions before;
    only the sizes of the partitions meet in one task.
    """
    place = F.monotonically_increasing_id()
    kept = materialise(df.orderBy(*keys).select("*", place.alias("_place")), name)
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many rows as the sort has partitions.
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    return kept.withColumn("_part", part).join(starts, "_part").withColumn(number, F.col("_start") + at).drop("_part", "_start", "_place")


def with_rest(df: DataFrame, more: str) -> T.StructType:
    """The type of ``rest`` in ``df``, whatever its fields are called, and further fields."""
    return T.StructType([df.schema["rest"], *T.StructType.fromDDL(more).fields])


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that operators neither read nor replace them."""
    return docs.select(as_one([c for c in docs.columns if c not in ("doc_id", "text")]), "doc_id", "text")


def unpacked(df: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """What ``packed`` took, in the order of ``columns``; ``instead`` has new values for some."""
    others = [c for c in columns if c not in ("doc_id", "text")]
    held = {c: F.col("rest")[f"c{k}"] for k, c in enumerate(others)} | {c: F.col(c) for c in ("doc_id", "text")} | instead
    return df.select(*(held[c].alias(c) for c in columns))


#: Bits of a bitmap, as a power of two: 8 MB whatever the data's size.
MAP_BITS = 26


def slots(key: np.ndarray) -> np.ndarray:
    """Places of 64-bit keys in a bitmap."""
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP_BITS)


def bitmap(keys: DataFrame) -> np.ndarray:
    """One bit a slot for the 64-bit keys of a table's one column: at most 2^MAP_BITS / 64 numbers come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = slots(b.column(0).to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["at", "bit"])

    rows = keys.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = slots(key)
    return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
