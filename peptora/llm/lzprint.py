"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each is the longest run that is a phrase already,
plus one code point. The set of phrases is hashed, and its minima under HASHES hash functions
are the fingerprint; two fingerprints agree on about the share of phrases that their texts
have in common, which is what makes one compress the other.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import shuffle_width, table

HASHES = 128
#: Bits of a code point.
CODE_BITS = 21


class Parse:
    """LZ78 phrases of a text, fed in parts: a trie walked by one lookup a code point.

    Nodes are numbered in the order of their phrases; a step from a node is the sum of its number
    (above the bits of a code point) and the code point. The empty phrase is node 0.
    """

    def __init__(self) -> None:
        self.steps: dict[int, int] = {}
        self.node, self.start, self.at = 0, 0, 0

    def fork(self) -> Parse:
        out = Parse()
        out.steps, out.node, out.start, out.at = dict(self.steps), self.node, self.start, self.at
        return out

    def feed(self, codes: list[int]) -> list[int]:
        """Ends (in all that was fed so far) of the new phrases; what is left of the last one stays open."""
        steps, node, ends = self.steps, self.node, []
        get, put = steps.get, ends.append
        size = len(steps)
        for at, code in enumerate(codes, self.at + 1):
            key = node + code
            node = get(key)
            if node is None:
                size += 1
                steps[key] = size << CODE_BITS
                node = 0
                put(at)
        self.node = node
        self.at += len(codes)
        return ends


@functools.cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands, drawn from the golden ratio's multiples by a mixing step."""
    x = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:HASHES, None] | np.uint32(1), x[HASHES:, None]


def mixed(x: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of each 64-bit number."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


class Spans:
    """Hashes of spans of a text: a polynomial over its code points, modulo 2^64, then mixed."""

    BASE = 0x9E3779B97F4A7C15
    BACK = pow(BASE, -1, 1 << 64)

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.back = self._powers(self.BACK, n + 1)
        # Code points are mixed first, so that the low bits of the sums hang on all of their bits.
        x = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ x >> np.uint64(32)) * self._powers(self.BASE, n), dtype=np.uint64)])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of HASHES functions; no phrase: all ones."""
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    a, b = multipliers()
    for at in range(0, len(hashes), 512):
        out = np.minimum(out, (hashes[None, at : at + 512] * a + b).min(axis=1))
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minimum: of many phrases the top ones are all zero."""
    return (least & np.uint32(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _minima_of(spans: Spans, parse: Parse, codes: list[int]) -> np.ndarray:
    """Minima over the phrases that the given code points end."""
    ends = np.array(parse.feed(codes), np.int64)
    if not len(ends):
        return minima(np.zeros(0, np.uint32))
    starts = np.concatenate([[parse.start], ends[:-1]])
    parse.start = int(ends[-1])
    return minima(spans.of(starts, ends))


def fingerprint_pair(text: str, donor: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited text, and the latter.

    The part before the edit is parsed and hashed once: minima of a union are the least of minima.
    """
    n = len(text)
    keep = n - n // 2
    edited = text[:keep] + donor[: n // 2]
    codes, other = code_points(text), code_points(edited)
    spans, parse = Spans(codes), Parse()
    shared = _minima_of(spans, parse, codes[:keep].tolist())
    fork = parse.fork()
    own = _minima_of(spans, parse, codes[keep:].tolist())
    new = _minima_of(Spans(other), fork, other[keep:].tolist())
    return signature(np.minimum(shared, own)), signature(np.minimum(shared, new)), edited


def fingerprint(text: str) -> np.ndarray:
    codes = code_points(text)
    return signature(_minima_of(Spans(codes), Parse(), codes.tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (hex) of every whole text. Null text: as an empty one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t).tobytes().hex() for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(run, last, doc_id, text) with rows in doc_id order, each run of neighbours whole in one task.

    Runs are cut at quantiles of doc_id. The first document of a run also closes the run
    before it (last = 1), and the very first one closes the last run, so that every document
    stands before its successor. What goes through the driver is one doc_id for each cut.
    """
    cuts = [int(c) for c in docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)] if parts > 1 else []
    cuts = np.array(sorted(set(cuts)), np.int64)

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, b.column(0).to_numpy())), b.column(0)], ["run", "doc_id"])

    first = docs.select("doc_id").mapInArrow(runs, "run long, doc_id long").groupBy("run").agg(F.min("doc_id").alias("doc_id")).orderBy("run").collect()
    # As many numbers as runs; a first document closes the run before.
    closes, closed = np.array([r["doc_id"] for r in first], np.int64), np.roll(np.array([r["run"] for r in first], np.int64), 1)
    held = docs.sparkSession.sparkContext.broadcast((cuts, closes, closed))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, closes, closed = held.value
        names = ["run", "last", "doc_id", "text"]
        for b in batches:
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, ids)), pa.array(np.zeros(len(ids), np.int32)), *b.columns], names)
            at = np.minimum(np.searchsorted(closes, ids), len(closes) - 1)
            also = np.flatnonzero(closes[at] == ids)
            if len(also):
                yield pa.RecordBatch.from_arrays([pa.array(closed[at[also]]), pa.array(np.ones(len(also), np.int32)), *b.take(pa.array(also)).columns], names)

    dealt = docs.mapInArrow(deal, "run long, last int, doc_id long, text string").withColumn("run", F.col("run").cast("int"))
    return dealt.repartitionById(parts, F.col("run")).sortWithinPartitions("run", "last", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """SCHEMA: every document against its edited text and the next document by doc_id.

    Null text: empty. Rows with a null doc_id have no place in the order and are left out.
    Rows that repeat a doc_id follow one another by text; a single document is its own next.
    An empty table gives none.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = in_order(docs, parts or shuffle_width(docs.sparkSession))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        """Each document with its successor, which closes the run or not."""
        held = None
        for b in batches:
            for k in range(b.num_rows):
                now = tuple(b.column(c)[k].as_py() for c in range(4))
                if held and held[0] == now[0]:
                    if held[1]:
                        continue  # a repeat of the closing row
                    yield held, now
                held = now

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        waiting = None  # (doc_id, n, edited sha, signature, edited signature) that lacks the next signature

        def put(w, nxt):
            out.append((w[0], w[1], w[2], w[3].tobytes().hex(), w[4].tobytes().hex(), likeness(w[3], w[4]), likeness(w[3], nxt)))

        for (_, _, doc, text), (_, last, _, after) in pairs(batches):
            own, other, edited = fingerprint_pair(text, after)
            if waiting:
                put(waiting, own)
            waiting = (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other)
            if last:
                put(waiting, fingerprint(after))
                waiting = None
            if len(out) >= 1000:
                yield _batch(out)
                out.clear()
        if out:
            yield _batch(out)

    return ordered.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
