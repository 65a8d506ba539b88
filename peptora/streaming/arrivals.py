"""Features of arriving records, and counts over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peptora.functions import sequence as S


STATE = "spark.sql.streaming.stateStore.providerClass"


def native_features(records: DataFrame) -> DataFrame:
    """acc, n, fcr, hydropathy of (acc, seq): stateless, so the same for a stream and a table."""
    s = F.col("seq")
    return records.select("acc", F.length(s).cast("long").alias("n"), S.charged_fraction(s).alias("fcr"), S.hydropathy(s).alias("hydropathy"))


def score_arrivals(records: DataFrame, store: str, checkpoint: str, features: Callable[[DataFrame], DataFrame] = native_features) -> StreamingQuery:
    """Append the features of accessions that the Parquet store lacks, each once.

    Records: acc, seq, retrieved_at. Which accessions came is keyed state, kept by RocksDB beside the checkpoint, so a batch reads
    nothing of the store however large it is; only a stream's first batch is held against what the store had before. Each
    batch has a folder of its own under the stream's, which a batch that is run again replaces.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if number == 0 and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            had = spark.read.parquet(store).where(F.col("stream") != stream)
            batch = batch.join(had.select("acc"), "acc", "left_anti")
        features(batch).write.mode("overwrite").parquet(f"{store}/stream={stream}/batch={number}")

    spark = records.sparkSession
    before = spark.conf.get(STATE, None)
    spark.conf.set(STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return records.dropDuplicates(["acc"]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE) if before is None else spark.conf.set(STATE, before)


def window_counts(records: DataFrame, time: str, missing: str, size: str = "1 hour", delay: str | None = None) -> DataFrame:
    """start, scored, missing_rows in tumbling windows; ``delay`` sets a watermark for a stream."""
    if delay:
        records = records.withWatermark(time, delay)
    got = records.groupBy(F.window(time, size)).agg(F.count(missing).alias("scored"), F.count_if(F.col(missing).isNull()).alias("missing_rows"))
    return got.select(F.col("window.start").alias("start"), "scored", "missing_rows")


def stream_counts(records: DataFrame, time: str, missing: str, out: str, checkpoint: str, size: str = "1 hour", delay: str = "1 hour") -> tuple[StreamingQuery, int]:
    """Run ``window_counts`` of a stream to the end of what is there, appending each window to ``out`` once it is closed.

    A window is closed when a row ``delay`` behind its end was seen; rows that come for it later are dropped, and counted: the
    query that ran, and how many late rows there were. Windows that are still open wait in the checkpoint for the next run.
    """
    counts = window_counts(records, time, missing, size, delay)
    query = counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return query, late


def fasta_stream(spark: SparkSession, path: str) -> DataFrame:
    """acc, seq, retrieved_at of FASTA files as they arrive."""
    raw = spark.readStream.option("lineSep", "\n>").format("text").load(path).select("value", F.col("_metadata.file_modification_time").alias("retrieved_at"))
    text = F.regexp_replace("value", "^>", "")
    return raw.where(F.trim("value") != "").select(S.accession(F.regexp_extract(text, r"^([^\n]*)", 1)).alias("acc"), S.normalised(F.regexp_replace(text, r"^[^\n]*", "")).alias("seq"), "retrieved_at")
