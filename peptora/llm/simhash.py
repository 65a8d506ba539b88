"""SimHash near-duplicate groups by anchor-point covering.

A fingerprint has 64 bits and two link at ``threshold`` (4) or fewer differing bits. The
bits are dealt to sections; by the pigeonhole principle some choice of sections differs in
at most ``t`` bits in total (halves: one of 2 in at most 2; thirds: 2 of 3 in at most 2).
For every choice a perfect code supplies the anchors: each word of the section is within the
covering radius of exactly one codeword. Two fingerprints ``t`` apart have a point midway,
within ``t/2`` of both, so if each is replicated to every anchor within the covering radius
plus its ``t/2`` share of the threshold, both reach the midpoint's anchor. Replicas meet
per anchor and are compared over all 64 bits there, so the links found are exact and complete.

Anchor groups yield a spanning forest of their links, never all pairs, and the forests are
joined into components by star contraction over Spark tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import bodies, discard, materialise, shuffle_width, table

#: Distinct fingerprints from which the longer anchors of ``thirds`` pay.
MANY = 1 << 25
#: No anchor group larger than this is held by one task: larger ones are dealt out by pairs of parts.
GROUP = 1 << 18
SHINGLES_AT_ONCE = 1 << 16


def simhash64(body: bytes, width: int = 4, seed: int = 42) -> int:
    """Fingerprint of a text: bit i is set where over half the shingle hashes have it set.

    No words: 0. Fewer words than ``width``: the whole sequence is the one shingle.
    """
    words = body.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    parts = (zip(starts[at : min(n, at + SHINGLES_AT_ONCE)], last[at : at + SHINGLES_AT_ONCE]) for at in range(0, n, SHINGLES_AT_ONCE))
    return majority(np.array([xxhash.xxh64_intdigest(joined[s : e - 1], seed) for s, e in part], np.uint64) for part in parts)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes, which come in parts."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). Null text: as an empty one, fingerprint 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash64(x.as_py(), width, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return bodies(docs).mapInArrow(run, "doc_id long, fp long")


class PerfectCode:
    """Binary perfect code on ``n`` bits: ``home`` maps words to their only codeword within the radius."""

    def __init__(self, n: int):
        self.n = n
        if n == 1:  # the code of both words, radius 0
            self.flip, self.tables = np.zeros(1, np.uint64), []
            return
        r = n.bit_length()
        if n != (1 << r) - 1:
            raise ValueError("a Hamming code has 2^r - 1 bits")
        #: Bit i has the parity column i + 1, so a syndrome s > 0 names the bit s - 1 to flip.
        self.flip = np.array([0, *(1 << i for i in range(n))], np.uint64)
        byte = np.arange(256)
        self.tables = []
        for low in range(0, n, 8):
            s = np.zeros(256, np.int64)
            for i in range(low, min(n, low + 8)):
                s ^= np.where(byte >> (i - low) & 1, i + 1, 0)
            self.tables.append(s)

    def home(self, words: np.ndarray) -> np.ndarray:
        if not self.tables:
            return words
        syndrome = np.zeros(len(words), np.int64)
        for k, t in enumerate(self.tables):
            syndrome ^= t[((words >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)]
        return words ^ self.flip[syndrome]


def split_bits(n: int) -> list[int]:
    """``n`` as lengths of perfect codes, longest first."""
    out = []
    while n:
        k = 1 if n < 3 else (1 << (n + 1).bit_length() - 1) - 1
        out.append(k)
        n -= k
    return out


class Anchors:
    """The sections, their codes, and the anchors that a fingerprint is replicated to."""

    def __init__(self, scheme: str = "halves", threshold: int = 4):
        widths, choose = {"halves": ([32, 32], 1), "thirds": ([21, 21, 22], 2)}[scheme]
        blocks = np.split(np.arange(64), np.cumsum(widths)[:-1])
        #: Of any threshold bits spread over the sections, the luckiest choice holds at most so many.
        self.t = max(sum(sorted(x)[:choose]) for x in self._spreads(threshold, len(blocks)))
        self.choices = [np.concatenate(c) for c in combinations(blocks, choose)]

    @staticmethod
    def _spreads(total: int, parts: int) -> Iterator[tuple[int, ...]]:
        if parts == 1:
            yield (total,)
            return
        for k in range(total + 1):
            for rest in Anchors._spreads(total - k, parts - 1):
                yield (k, *rest)

    def _homes(self, words: np.ndarray, widths: list[int]) -> np.ndarray:
        out, at = np.zeros(len(words), np.uint64), 0
        for w in widths:
            mask = np.uint64((1 << w) - 1)
            out |= PerfectCode(w).home(words >> np.uint64(at) & mask) << np.uint64(at)
            at += w
        return out

    def replicas(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchor key, index of the fingerprint), each pair once."""
        for number, bits in enumerate(self.choices):
            words = np.zeros(len(fps), np.uint64)
            for k, b in enumerate(bits):
                words |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
            share, widths = (self.t + 1) // 2, split_bits(len(bits))
            keys = []
            for weight in range(share + 1):
                for places in combinations(range(len(bits)), weight):
                    keys.append(self._homes(words ^ np.uint64(sum(1 << p for p in places)), widths))
            got = np.sort(np.stack(keys, axis=1), axis=1)
            new = np.ones(got.shape, bool)
            new[:, 1:] = got[:, 1:] != got[:, :-1]
            row, _ = np.nonzero(new)
            yield got[new] | np.uint64(number << 60), row


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b: each linked value and the smallest value it reaches."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _walk(fps: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forest of one group: what a visited member reaches leaves the rest, so dense groups end early."""
    links, rest, queue = [], fps, []
    while len(rest):
        if queue:
            x = queue.pop()
        else:
            x, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ x) <= threshold
        if near.any():
            hit = rest[near]
            links.append((np.full(len(hit), x), hit))
            queue.extend(hit)
            rest = rest[~near]
    return links


def _group(fps: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As _walk; in a large group members meet where one of threshold + 1 sections is equal, which every link has.

    A group's members are alike in their anchor's bits, so each section takes every so-manieth bit of all.
    """
    if len(fps) <= 4096:
        return _walk(fps, threshold)
    links = []
    for k in range(threshold + 1):
        part = fps & np.uint64(sum(1 << i for i in range(k, 64, threshold + 1)))
        order = np.argsort(part, kind="stable")
        for run in np.split(fps[order], np.flatnonzero(np.diff(part[order])) + 1):
            if len(run) > 1:
                links += _walk(run, threshold)
    return links


def link_groups(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole groups in key order: linked fingerprints and the root of each, over all these groups."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    start, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(keys)]]))
    links = []
    few = np.repeat((size > 1) & (size <= 48), size)
    for d in range(1, 48):
        i = np.flatnonzero(few[:-d] & (keys[d:] == keys[:-d])) if d < len(keys) else []
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= threshold]
        links.append((fps[i], fps[i + d]))
    for s, n in zip(start[size > 48], size[size > 48]):
        links += _group(fps[s : s + n], threshold)
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    nodes, roots = _roots(*(np.concatenate(x) for x in zip(*links)))
    other = nodes != roots
    return nodes[other], roots[other]


def links(distinct: DataFrame, threshold: int = 4, scheme: str | None = None, group: int = GROUP) -> DataFrame:
    """From distinct fp: (a, b) such that the components of these links are those of all links."""
    spark = distinct.sparkSession
    count = distinct.count()
    anchors = Anchors(scheme or ("thirds" if count > MANY else "halves"), threshold)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 8192):
                fps = every[at : at + 8192]
                for key, row in anchors.replicas(fps):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[row].view(np.int64))], ["anchor", "fp"])

    met = distinct.select("fp").mapInArrow(spread, "anchor long, fp long").withColumn("pair", F.lit(0))
    if count > group:  # else no group can be larger
        large = met.groupBy("anchor").count().where(F.col("count") > group)
        parts = F.ceil(F.col("count") / (group // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        met = met.join(large, "anchor", "left").withColumn(
            "pairs",
            F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(
                F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
            ),
        )
        met = met.select("anchor", "fp", F.explode("pairs").alias("pair"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray) -> pa.RecordBatch:
            low = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0])) if len(rows) else []
            rows = rows[low]
            change = np.ones(len(rows), bool)
            change[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            a, b = link_groups(np.cumsum(change), np.ascontiguousarray(rows[:, 2]).view(np.uint64), threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held, size = [], 0
        for b in batches:
            held.append(np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1))
            size += b.num_rows
            if size < 500_000:
                continue
            rows = np.concatenate(held)
            whole = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            end = whole[-1] + 1 if len(whole) else 0  # the last group may go on
            if end:
                yield found(rows[:end])
            held, size = [rows[end:]], len(rows) - end
        if size:
            yield found(np.concatenate(held))

    width = shuffle_width(spark)
    return (
        met.select("anchor", "pair", "fp").repartition(width, "anchor", "pair").sortWithinPartitions("anchor", "pair")
        .mapInArrow(meet, "a long, b long").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b): every linked value and the smallest value it reaches, (node, root).

    Large-star and small-star in turn; minima are aggregated before they are joined back, so
    a centre with very many neighbours is never gathered in one place. Each round is written
    to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        # Least neighbours are written before they are joined back: a join of plain tables is split at a centre with very many neighbours.
        first = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(first, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "links")
        second = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(second, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        before, edges = edges, materialise(small.select("x.a", F.col("x.m").alias("b")).where("a != b").distinct(), "links")
        discard(before, first, large, second)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, threshold: int = 4, width: int = 4, seed: int = 42, scheme: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null or empty text: fingerprint zero, linked like any other. Repeated rows give repeated
    rows. A null doc_id keeps its row and never becomes a component_id unless it is alone.
    An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    fps = materialise(fingerprints(docs, width, seed), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("own")), "distinct")
    reach = components(links(distinct, threshold, scheme))
    member = reach.unionByName(reach.select(F.col("root").alias("node"), "root").distinct())
    named = member.join(distinct, member.node == distinct.fp).select("fp", "root", "own")
    named = named.join(named.groupBy("root").agg(F.min("own").alias("least")), "root").select("fp", "least")
    every = materialise(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "own").alias("component_id")), "components")
    return fps.join(every, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
