"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A document is a sparse vector over 2^BITS hashed unigrams and bigrams of its letter runs,
digit runs and symbol runs, damped by a square root and scaled to length one. The proximal FTRL updates
(per-coordinate rates, L1 and L2) run over shards of a bounded, documented sample of labelled
rows, one task to a shard; the shards' weights are averaged. A score is the logistic of a
sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import apart, as_one, table, with_rest
from peptora.llm.labelled import fold, sample

BITS = 18
SHARDS = 2
#: Labelled rows learnt from: at most so many, classes as they come.
MOST = 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 2.0, 1.0, 1e-4, 1e-4
MODULUS, HELD, ACCEPT = 4, 2, 0.7
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x00-\x20]+")


def features(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and values; the vector has length one. No token: no slot."""
    tokens = TOKEN.findall(body)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]
    slots, n = np.unique(np.concatenate([one, two * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(64 - BITS), return_counts=True)
    values = np.sqrt(n)
    return slots.astype(np.int64), values / np.sqrt((values**2).sum())


class Leader:
    """Proximal FTRL for the logistic loss; the last slot is the intercept, which isn't shrunk."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.l1 = np.full(size + 1, L1)
        self.l1[-1] = 0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-(w @ x))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """slot, weight (those that aren't zero) from rows of doc_id, text, label."""

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))],
                ["shard", "doc_id", "label", "slots", "values"],
            )

    def fit(shard: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort([xxhash.xxh3_64_intdigest(str(d)) for d in shard.doc_id])
        data = [(shard.slots.iloc[k], shard["values"].iloc[k].astype(float), shard.label.iloc[k]) for k in order]
        model = Leader()
        for _ in range(EPOCHS):
            for x in data:
                model.learn(*x)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "weight": w[at]})

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    sparse = rows.select(shard.alias("shard"), "doc_id", F.col("text").cast("binary"), "label").mapInArrow(vectors, "shard int, doc_id long, label int, slots array<int>, values array<float>")
    fitted = sparse.groupBy("shard").applyInPandas(fit, "slot long, weight double")
    return fitted.groupBy("slot").agg((F.sum("weight") / shards).alias("weight"))


def model(rows: DataFrame) -> np.ndarray:
    """The weights as one array: 2^BITS slots and the intercept, whatever the corpus."""
    w = np.zeros((1 << BITS) + 1, np.float32)
    got = train(rows).toPandas()
    w[got.slot.to_numpy(int)] = got.weight
    return w


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", accept: float = ACCEPT, most: int = MOST) -> DataFrame:
    """``docs`` and held_out, score, predicted; columns of those names are replaced.

    Null and empty texts get the intercept's score. A null doc_id is not held out. Without
    labels of both classes every score is the intercept's or 0.5. An empty table gives none.
    """
    spark = docs.sparkSession
    w = spark.sparkContext.broadcast(model(sample(docs, labels, label, MODULUS, HELD, most, by_class=False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = w.value
        for b in batches:
            z = np.empty(b.num_rows)
            for k, x in enumerate(b.column(1)):
                slots, values = features(x.as_py())
                z[k] = weights[slots] @ values + weights[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], ["rest", "score"])

    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    packed = docs.select(as_one(names), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    scored = packed.mapInArrow(run, with_rest(packed, "score double")).select(*apart(names), "score")
    held = F.coalesce(fold(MODULUS) == HELD, F.lit(False))
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= accept).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
