"""Removal of repeated token windows: Rabin-Karp hashes of every fixed-length window, counted in Spark.

Rolling hashes give every window's value. A window's rarest-looking inner gram (the least
hash of its k-grams) names it: equal windows have equal names, and neighbouring windows
mostly share theirs, so a document is a short list of runs of windows with one name. A name
that occurs in one document only rules its windows out; this loses no repeat, as a repeated
window carries its name to every place. What remains is counted in two steps: whole runs by
the hash of all they span, then, where runs of one name differ, the single windows. Repeated
windows merge into maximal removal intervals.

All hashes that decide a removal are pairs of 64-bit polynomial hashes over 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import apart, as_one, bodies, discard, materialise, table, with_rest

GRAM = 8
#: Odd multipliers of the two polynomial hashes, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


class Rolling:
    """Prefix sums of one polynomial hash over a document's word hashes."""

    def __init__(self, words: np.ndarray, which: int):
        self.back = self._powers(INVERSES[which], len(words) + 1)
        power = self._powers(BASES[which], len(words))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one name: name, first window, end, two hashes of the words they span."""
    if len(words) < window:
        return tuple(np.zeros(0, np.uint64) for _ in range(5))
    h = word_hashes(words)
    one, two = Rolling(h, 0), Rolling(h, 1)
    gram = min(GRAM, window)
    name = sliding_min(mixed(one.windows(gram)), window - gram + 1)
    start = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
    end = np.append(start[1:], len(name))
    return name[start], start, end, one.of(start, end + window - 1), two.of(start, end + window - 1)


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind, copy=False)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def content_key(body: bytes) -> int:
    """Key of a document's word sequence, which tells rows of one doc_id apart."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(body.split()))).astype(np.int64))


def window_runs(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, content, name, first, last (excluded), h1, h2: a row for each run of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = [x.as_py() for x in b.column(1)]
            got = [runs_of(x.split(), window) for x in body]
            n = [len(g[0]) for g in got]
            if not sum(n):
                continue
            cols = [np.concatenate([g[k] for g in got]) for k in range(5)]
            keys = np.fromiter(map(content_key, body), np.int64, len(body))
            at = np.repeat(np.arange(len(body)), n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(keys[at]), pa.array(_signed(cols[0])), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(_signed(cols[3])), pa.array(_signed(cols[4]))],
                ["doc_id", "content", "name", "first", "last", "h1", "h2"],
            )

    return bodies(docs.where("doc_id is not null")).mapInArrow(run, "doc_id long, content long, name long, first int, last int, h1 long, h2 long")


def stretches(at: np.ndarray, one: np.ndarray, two: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of windows ``at`` with hashes ``one`` and ``two``: first word, end and hashes of each stretch that equal windows cover.

    A line said over and over has few windows of its own and they lie close, so it is a row for each of them, not one a place.
    """
    order = np.lexsort((at, two, one))
    at, one, two = at[order], one[order], two[order]
    start = np.concatenate([[0], np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (np.diff(at) > window)) + 1])
    return at[start], at[np.append(start[1:], len(at)) - 1] + window, one[start], two[start]


def _single_windows(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """doc_id, content, first, last, h1, h2 for each stretch of equal windows of the given runs, hashed from the texts."""
    asked = runs.groupBy("doc_id").agg(F.collect_list(F.struct("content", "first", "last")).alias("runs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, found = [], [], []
            for doc, body, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                body = body.as_py()
                key = content_key(body)
                at = [np.arange(r["first"], r["last"]) for r in asked.as_py() if r["content"] == key]
                if not at:
                    continue
                at = np.unique(np.concatenate(at))
                h = word_hashes(body.split())
                got = stretches(at, Rolling(h, 0).of(at, at + window), Rolling(h, 1).of(at, at + window), window)
                ids.append(np.full(len(got[0]), doc))
                keys.append(np.full(len(got[0]), key))
                found.append(got)
            if ids:
                first, last, one, two = (np.concatenate(x) for x in zip(*found))
                cols = [np.concatenate(ids), np.concatenate(keys), first.astype(np.int32), last.astype(np.int32), _signed(one), _signed(two)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["doc_id", "content", "first", "last", "h1", "h2"])

    return bodies(docs).join(asked, "doc_id").mapInArrow(run, "doc_id long, content long, first int, last int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, content, first, last: word spans covered by windows that a smaller doc_id has too.

    A window may occur in a large part of all documents. What is aggregated by it is written before
    it is joined back: a join of plain tables is split where a key is too large, one behind an aggregate isn't.
    What is joined back has one row a key, so no join gives more rows than the runs or windows that it judges.
    """
    runs = materialise(window_runs(docs, window), "runs")
    common = materialise(runs.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name"), "common")
    shared = materialise(runs.join(common, "name"), "shared")
    discard(runs, common)
    spans = materialise(shared.groupBy("name", "h1", "h2").agg(F.min("doc_id").alias("least")), "spans")
    names = materialise(spans.groupBy("name").agg(F.count("*").alias("forms")), "names")
    judged = materialise(shared.join(spans, ["name", "h1", "h2"]).join(names, "name"), "judged")
    discard(shared, spans, names)
    whole = judged.where("doc_id > least").select("doc_id", "content", "first", (F.col("last") + window - 1).alias("last"))
    open_ = judged.where("doc_id = least and forms > 1")
    single = materialise(_single_windows(docs, open_, window), "windows")
    least = materialise(single.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "least")
    part = single.join(least, ["h1", "h2"]).where("doc_id > least").select("doc_id", "content", "first", "last")
    return whole.union(part)


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals: overlapping or touching spans become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with n_words, removed (maximal word intervals) and kept (the other words, joined by a space).

    Null text: no words, kept ''. Texts under ``window`` words lose nothing, nor do rows with a
    null doc_id. Rows that repeat a doc_id are judged each by its own words, and never against
    one another. An empty table gives none. Columns of those three names are replaced.
    """
    gone = repeated_spans(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("content", "first", "last")).alias("spans"))
    names = [c for c in docs.columns if c not in ("n_words", "removed", "kept")]
    rest = as_one(names)
    body = docs.select(rest, "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for body, spans in zip(b.column(1), b.column(2)):
                body = body.as_py()
                words = body.split()
                n.append(len(words))
                cut = []
                if spans.is_valid:
                    key = content_key(body)
                    cut = merge_spans((s["first"], s["last"]) for s in spans.as_py() if s["content"] == key)
                at, left = 0, []
                for s, e in cut:
                    left += words[at:s]
                    at = e
                kept.append(b" ".join(left + words[at:] if cut else words))
                removed.append([{"first": s, "last": e} for s, e in cut])
            removed = pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), removed, pa.array(kept, pa.binary()).cast(pa.string())], ["rest", "n_words", "removed", "kept"])

    joined = body.join(gone, "doc_id", "left").select("rest", "body", "spans")
    got = joined.mapInArrow(run, with_rest(body, "n_words long, removed array<struct<first:int,last:int>>, kept string"))
    return got.select(*apart(names), "n_words", "removed", "kept")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return got.select("doc_id", "n_words", n.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
