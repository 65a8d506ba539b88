"""Near copies at a similarity: texts link where LEAST or more of their five-word shingles are shared.

The measure is the exact Jaccard index of the two sets of shingles. Candidates come from two sides:
SimHash fingerprints of the same shingles, linked by anchors as in ``simhash``, and, as few pairs at
the bound are within their 4 bits, texts that share one of BANDS keys of ROWS minima each. A pair
at the bound misses all keys with a probability of (1 - LEAST^ROWS)^BANDS = 2e-6, and closer pairs
still less. Every candidate is checked on the sets themselves, so no link is wrong.

Texts that candidates connect form a cluster, and each cluster's texts travel once. A cluster
yields a spanning forest of its links, never all pairs; the forests are joined into components.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptora.llm.common import bound_batches, discard, materialise, quoted, shuffle_width
from peptora.llm.simhash import components, links, majority

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 25, 4
#: Bits in which SimHash fingerprints of candidates differ at most.
BITS = 4
#: Column of the row hash, which no column of a corpus is called.
ROW = "__peptora_row"
#: No more texts of a cluster than this are held by one task: larger clusters are dealt out by pairs of parts.
GROUP = 1 << 9


@functools.cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions whose minima are taken."""
    x = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
    return x[0] | np.uint32(1), x[1]


def shingles(body: bytes) -> tuple[int, np.ndarray]:
    """A text's fingerprint (of its words in order; no words: 0) and the sorted hashes of its distinct shingles.

    Fewer words than WIDTH: the whole sequence is the one shingle.
    """
    words = body.lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = ends[min(WIDTH, len(words)) - 1 :]
    return xxhash.xxh3_64_intdigest(joined), np.unique(np.array([xxhash.xxh3_64_intdigest(joined[s : e - 1]) for s, e in zip([0, *ends], last)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of ROWS minima each."""
    a, b = multipliers()
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[None, at : at + 512] * a + b).min(axis=1))
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard index of LEAST or more."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= LEAST


def forest(keys: np.ndarray, sims: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links of one cluster by place: what a visited text reaches leaves the rest, so dense clusters end early."""
    rest, queue = np.arange(len(sets)), []
    while len(rest):
        if queue:
            x = queue.pop()
        else:
            x, rest = rest[0], rest[1:]
        met = np.flatnonzero((keys[rest] == keys[x]).any(axis=1) | (np.bitwise_count(sims[rest] ^ sims[x]) <= BITS))
        hit = np.array([k for k in met if alike(sets[x], sets[rest[k]])], np.int64)
        yield from ((x, y) for y in rest[hit])
        queue.extend(rest[hit])
        rest = np.delete(rest, hit)


def signatures(docs: DataFrame) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, fp, sim (the SimHash) and the keys; without words: fingerprint 0, no keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, keys = [], [], []
            for x in b.column(2):
                fp, hashes = shingles(x.as_py())
                fps.append(fp)
                sims.append(majority([hashes]))
                keys.append(bands(hashes).view(np.int64) if len(hashes) else [])
            fps, sims = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in (fps, sims))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, sims, pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "fp", "sim", "keys"])

    return docs.mapInArrow(run, "row long, doc_id long, fp long, sim long, keys array<long>")


def candidates(distinct: DataFrame) -> DataFrame:
    """From fp, sim, keys of distinct texts: (a, b) such that whatever may link is connected.

    Least fingerprints are written before they are joined back, so that a key of very many texts can be split.
    """
    keyed = distinct.select("fp", F.explode("keys").alias("key"))
    least = materialise(keyed.groupBy("key").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    shared = keyed.join(least, "key").where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    first = materialise(distinct.where("size(keys) > 0").groupBy("sim").agg(F.min("fp").alias("least")), "least")
    same = distinct.join(first, "sim").where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    near = links(first.select(F.col("sim").alias("fp")), BITS).join(first.select(F.col("sim").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("sim").alias("b"), F.col("least").alias("y")), "b")
    got = materialise(shared.union(same).union(near.select("x", "y")).distinct(), "candidates")
    discard(least, first)
    return got


def checked(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """From cluster, fp, sim, keys, body: (a, b) such that the components of these links are those of all links."""
    size = texts.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > group)
    parts = F.ceil(F.col("size") / (group // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.when(F.col("size").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)))
    met = texts.join(size, "cluster", "left").withColumn("pair", F.explode(pairs)).select("cluster", "pair", "fp", "sim", "keys", "body")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            fps, sims, keys, sets = zip(*held.values())
            got = list(forest(np.stack(keys), np.array(sims).view(np.uint64), sets)) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([fps[x] for x, _ in got], pa.int64()), pa.array([fps[y] for _, y in got], pa.int64())], ["a", "b"])

        at, held = None, {}
        for b in batches:
            for cluster, pair, fp, sim, keys, body in zip(*b.columns):
                now = (cluster.as_py(), pair.as_py())
                if held and now != at:
                    yield found()
                    held = {}
                at = now
                if fp.as_py() not in held:  # else a repeated row
                    held[fp.as_py()] = (fp.as_py(), sim.as_py(), np.array(keys.as_py(), np.int64), shingles(body.as_py())[1])
        if held:
            yield found()

    return met.repartition(shuffle_width(texts.sparkSession), "cluster", "pair").sortWithinPartitions("cluster", "pair", "fp").mapInArrow(meet, "a long, b long")


def members(edges: DataFrame, name: str) -> DataFrame:
    """fp and ``name``, the least fp that it reaches, of every linked fp."""
    reach = components(edges)
    return reach.select(F.col("node").alias("fp"), F.col("root").alias(name)).union(reach.select("root", "root").distinct())


def one_of_each(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id (null last), fingerprint and row hash.

    Texts without words are copies of each other. Rows that repeat a doc_id with unlinked texts stay each;
    a null doc_id takes part like any other. An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    row = F.xxhash64("doc_id", "text")
    body = F.coalesce("text", F.lit("")).cast("binary").alias("body")
    signed = materialise(signatures(docs.select(row.alias("row"), "doc_id", body)), "signatures")
    distinct = materialise(signed.groupBy("fp").agg(F.min("row").alias("row"), F.first("sim").alias("sim"), F.first("keys").alias("keys")), "distinct")
    connected = candidates(distinct)
    clusters = members(connected, "cluster")
    discard(connected)  # components has written its own table of it
    texts = docs.select(row.alias("row"), body).join(distinct.join(clusters, "fp"), "row").select("cluster", "fp", "sim", "keys", "body")
    root = members(checked(texts, group), "root")
    every = signed.select("fp", "doc_id", "row").join(root, "fp", "left").select(F.coalesce("root", "fp").alias("root"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "row").alias("x"))
    stays = every.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.row").alias(ROW))
    return docs.withColumn(ROW, row).join(stays, ROW, "left_semi").dropDuplicates([ROW]).select(*map(quoted, docs.columns))
