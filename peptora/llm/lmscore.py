"""Cross-entropy difference: how much better a target model reads a document than a background model.

Both models are bigram models over all words of the corpus, counted in one pass: the background over
every document, the target over the documents marked as such. They are matched in all but
their counts: the same vocabulary, words and pairs, and additive smoothing,

    P(word | before) = (count(before, word) + ADD) / (count(before) + ADD * (words + 1)),

which sums to one over the vocabulary and a word outside of it. A document's loss by a model is
then a sum over its distinct pairs and words, so counts are looked up by key, and no row needs a
pair and its words at once. Keys are 64-bit hashes.

A document is never judged by itself: where it was counted, its own occurrences are taken off both
models, so that a target document and another of the same text score alike.

Counts grow with the corpus and stay in Spark tables. A key that occurs once needs no row: whoever
asks for it is its one place. The HOT_WORDS and HOT most frequent words and pairs are
broadcast, all other keys are joined; none of those is frequent enough to fill a task. Keys are
counted and asked for in PASSES shares, one after the other, which bounds what stands on disk at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import bitmap, discard, marked, materialise, table

ADD = 0.01
#: Broadcast words and pairs.
HOT_WORDS, HOT = 1 << 18, 1 << 20
PASSES = 2
#: A key's share is told by the bits above these.
SHARE = 40
#: Tokens that are worked on at a time, those whose counts a task holds, and rows of a batch.
AT_ONCE, FLUSH, BATCH = 500_000, 4_000_000, 100_000
#: Keys are even: the lowest bit tells marked occurrences while they are counted.
EVEN = np.uint64((1 << 64) - 2)


def slices(batches: Iterable[pa.RecordBatch], body: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the hashes of all their words on end, and how many words each row has."""
    for b in batches:
        words: list[bytes] = []
        sizes: list[int] = []
        for k, x in enumerate(b.column(body)):
            own = x.as_py().lower().split()
            words += own
            sizes.append(len(own))
            if len(words) >= AT_ONCE or k == b.num_rows - 1:
                ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                yield b.slice(k + 1 - len(sizes), len(sizes)), ids & EVEN, np.array(sizes)
                words, sizes = [], []


def keys_of(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the word before each word (0: the start of the text), of the pair that the two make, and of the texts' last words."""
    ends = np.cumsum(sizes)[sizes > 0]
    before = np.zeros_like(ids)
    before[1:] = ids[:-1]
    before[ends - sizes[sizes > 0]] = 0
    x = (before ^ (ids << np.uint64(21) | ids >> np.uint64(43))) * np.uint64(0x9E3779B97F4A7C15)
    return before, (x ^ x >> np.uint64(29)) & EVEN, ids[ends - 1]


def of_share(keys: np.ndarray, this: int, of: int) -> np.ndarray:
    return (keys >> np.uint64(SHARE)) % np.uint64(of) == np.uint64(this)


def marked_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """body and target, whether doc_id is among ``marks``. A bitmap tells most that aren't; only the others are shuffled to the exact join."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(marks.select(F.xxhash64("doc_id").alias("key"))))

    def kept(maybe: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array((marked(bits.value, b.column(2).to_numpy().view(np.uint64)) & b.column(0).is_valid().to_numpy(zero_copy_only=False)) == maybe))

        return docs.select("doc_id", "body", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "doc_id long, body binary, key long")

    # Both sides may be large, so neither is broadcast at any size.
    asked = kept(True).drop("key").join(marks.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left").select("body", F.coalesce("target", F.lit(False)).alias("target"))
    return asked.union(kept(False).select("body", F.lit(False).alias("target")))


def counts(docs: DataFrame, this: int = 0, of: int = 1) -> DataFrame:
    """kind (0: a word that stands before another; 1: a pair), key, background, target, of one share of the keys.

    A document's last word stands before none and counts zero, for the vocabulary. Partial counts
    leave a task whenever they grow long.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            before, pair, last = (np.concatenate(x) for x in zip(*held))
            for kind, keys, zeros in ((0, before, np.unique(last)), (1, pair, last[:0])):
                keys.sort()
                key = keys & EVEN
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                every = np.diff(np.append(start, len(key)))
                marked = np.add.reduceat((keys & np.uint64(1)).astype(np.int64), start) if len(key) else every
                key = key[start]
                zeros = zeros[~np.isin(zeros, key)]
                none = np.zeros(len(zeros), np.int64)
                cols = [pa.array(c.view(np.int64)) for c in (np.append(key, zeros), np.append(every, none), np.append(marked, none))]
                kinds = pa.array(np.full(len(cols[0]), kind, np.int8))
                for k in range(0, len(kinds), BATCH):
                    yield pa.RecordBatch.from_arrays([c.slice(k, BATCH) for c in (kinds, *cols)], ["kind", "key", "background", "target"])

        for b, ids, sizes in slices(batches, 0):
            before, pair, last = keys_of(ids, sizes)
            mark = np.repeat(b.column(1).to_numpy(zero_copy_only=False), sizes).astype(np.uint64)
            held.append(tuple((k | m)[of_share(k, this, of)] for k, m in ((before, mark), (pair, mark), (last, np.uint64(0)))))
            size += len(ids)
            if size > FLUSH:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    partial = docs.select("body", "target").mapInArrow(run, "kind byte, key long, background long, target long")
    # Tasks have added up already, so rows are dealt out as they are.
    return partial.repartition("key").groupBy("kind", "key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Hot:
    """The most frequent keys of a kind and their counts, found by one look at the place that a key's first bits name.

    Where several keys have one place the most frequent stands there, and the others are joined like any other key.
    """

    def __init__(self, found: DataFrame, kind: int, hot: int):
        # At most ``hot`` rows, whatever the corpus.
        got = found.where(F.col("kind") == kind).orderBy(F.desc("background"), "key").limit(hot).select("key", "background", "target").toArrow()
        key, *counts_ = (c.to_numpy()[::-1] for c in got.columns)
        self.key = np.append(key, 1).view(np.uint64)  # no key is odd
        self.background, self.target = (np.append(x, 0) for x in counts_)
        bits = max(2, len(self.key).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.at = np.full(1 << bits, len(key), np.int32)
        self.at[(self.key[:-1] >> self.shift).astype(np.int64)] = np.arange(len(key))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the counts, and whether the key is there."""
        at = self.at[(keys >> self.shift).astype(np.int64)]
        return at, self.key[at] == keys


def distinct_keys(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct keys: key, document, and how often it has it."""
    if not len(key):
        return key, doc, doc
    order = np.argsort(key ^ doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key, doc = key[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    return key[start], doc[start], np.diff(np.append(start, len(key)))


HEAD = "struct<tokens:long,background:double,outside:double,inside:double>"


def asked_keys(docs: DataFrame, shared, room: float, this: int = 0, of: int = 1) -> DataFrame:
    """doc_id, row, key, n of each document's distinct words before others (n is negative: minus how often) and pairs, of one
    share of the keys, that aren't ``shared``; and a row with a head (its key is odd) of tokens and the sums that need no asking.

    The target's sums are taken both as of a document of the background only (``outside``) and as of one of the target (``inside``).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, sizes in slices(batches, 2):
            before, pair, _ = keys_of(ids, sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.zeros((3, len(sizes)))
            keys, docs_, times = [], [], []
            for key, hot, sign, more in zip((before, pair), shared.value, (-1, 1), (room, ADD)):
                own = of_share(key, this, of)
                key, at_doc, n = distinct_keys(key[own], doc[own])
                at, hit = hot.find(key)
                there, of_doc, m = at[hit], at_doc[hit], n[hit]
                for k, left in enumerate((hot.background[there] - m, hot.target[there], np.maximum(hot.target[there] - m, 0))):
                    sums[k] -= np.bincount(of_doc, weights=sign * m * np.log(left + more), minlength=len(sizes))
                keys.append(key[~hit])
                docs_.append(at_doc[~hit])
                times.append(sign * n[~hit])
            row = b.column(1).to_numpy(zero_copy_only=False)
            at_doc = np.concatenate([np.arange(len(sizes)), *docs_])
            key = np.concatenate([row.view(np.uint64) | np.uint64(1), *keys])
            n = np.concatenate([np.zeros(len(sizes), np.int64), *times])
            heads = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *map(pa.array, sums)], ["tokens", "background", "outside", "inside"])
            rare = len(key) - len(sizes)
            head = heads.take(pa.array(np.append(np.arange(len(sizes)), np.zeros(rare, np.int64)), mask=np.arange(len(key)) >= len(sizes)))
            doc_id = b.column(0).take(pa.array(at_doc))
            for k in range(0, len(key), BATCH):
                now = slice(k, k + BATCH)
                yield pa.RecordBatch.from_arrays([doc_id.slice(k, BATCH), pa.array(row[at_doc[now]]), pa.array(key[now].view(np.int64)), pa.array(n[now]), head.slice(k, BATCH)], ["doc_id", "row", "key", "n", "head"])

    return docs.select("doc_id", "row", "body").mapInArrow(run, f"doc_id long, row long, key long, n long, head {HEAD}")


def score_documents(docs: DataFrame, target_ids: DataFrame, hot: int = HOT, passes: int = PASSES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (target minus background; lower: more like the target).

    ``target_ids`` holds the doc_ids of the target documents; a null doc_id is never one. A document's own words are left
    out of both models, not those of its copies. Null and empty texts have no token, and losses and difference 0. Without
    target documents the target model is the even one. Repeated rows are counted and scored each. An empty table gives none.
    """
    spark = docs.sparkSession
    marks = target_ids.select("doc_id").where("doc_id is not null").distinct()
    text = F.coalesce("text", F.lit(""))
    body = docs.select("doc_id", F.xxhash64(text).alias("row"), text.cast("binary").alias("body"))
    texts = marked_texts(body, marks)
    tables = [materialise(counts(texts, k, passes).where("kind = 0 or background > 1"), "counts") for k in range(passes)]
    found = functools.reduce(DataFrame.union, tables)
    room = ADD * (found.where("kind = 0 and key != 0").count() + 1)
    shared = spark.sparkContext.broadcast([Hot(found, 0, min(hot, HOT_WORDS)), Hot(found, 1, hot)])

    def loss(count: Column) -> Column:
        """Of all of a document's places of the key, by what the model has besides."""
        more = F.when(F.col("n") < 0, room).otherwise(ADD)
        return F.when(F.col("head").isNull(), -F.col("n") * F.log(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)) + more))

    own = F.abs("n")
    total = lambda name, count: F.sum(F.coalesce(f"head.{name}", loss(count))).alias(name)

    def sums_of(share: int) -> DataFrame:
        table_ = found.where(F.shiftrightunsigned("key", SHARE) % passes == share).select("key", F.col("background").alias("b"), F.col("target").alias("t"))
        joined = asked_keys(body, shared, room, share, passes).join(table_, "key", "left")
        b, t = F.col("b"), F.col("t")
        return joined.groupBy("doc_id", "row").agg(F.max("head.tokens").alias("tokens"), F.count("head").alias("rows"), total("background", b - own), total("outside", t), total("inside", t - own))

    shares = functools.reduce(DataFrame.union, [materialise(sums_of(k), "sums") for k in range(passes)])
    discard(*tables)
    sums = shares.groupBy("doc_id", "row").agg(*(F.max(c).alias(c) for c in ("tokens", "rows")), *(F.sum(c).alias(c) for c in ("background", "outside", "inside")))
    # Rows of one doc_id and text add up, and each has its share.
    mean = lambda c: F.when(F.col("tokens") > 0, c / (F.col("tokens") * F.col("rows"))).otherwise(0.0)
    scored = sums.join(marks.withColumn("target", F.lit(True)), "doc_id", "left").select(
        "doc_id", F.col("tokens").alias("n_tokens"), mean(F.when(F.col("target"), F.col("inside")).otherwise(F.col("outside"))).alias("target_loss"),
        mean(F.col("background")).alias("background_loss"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    )
    return scored.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("difference"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return score_documents(table(spark, sf_dir, "documents"), good)
