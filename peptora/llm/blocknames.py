"""Exact duplicates by deterministic block naming: one collision-free integer for each document.

A normalised text is a row of fixed-size blocks. Blocks that occur more than once are sorted and
named by their rank; then adjacent pairs of names are sorted and named in turn, level by level,
until one name is left of each document. Two documents are equal if and only if they end on the
same level with the same name, as every name stands for one content only.

Blocks are sorted by a 128-bit hash first, so that narrow rows can be sorted and joined; the
contents under a hash are compared in Spark, and where two differ all hashes are taken anew with
the next seed. A block or pair that occurs once in the corpus gets no name: its document has no
equal, and takes no part in later levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import apart, as_one, bodies, discard, materialise, quoted, ranked, table

BLOCK = 1024
SPACES = b" \t\n\x0b\x0c\r"
#: Stands for the missing right name of an odd last one; ranks are never negative.
NONE = -1


def blocks_of(body: bytes, size: int) -> list[bytes]:
    """The text's bytes without white space, cut every ``size``; an empty text is one empty block."""
    text = body.translate(None, SPACES)
    return [text[k : k + size] for k in range(0, max(len(text), 1), size)]


def _keys(blocks: list[bytes], seed: int, bits: int) -> np.ndarray:
    """Two signed 64-bit halves of each block's hash; ``bits`` of either are used."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b, seed) for b in blocks), ">u8").reshape(-1, 2)
    return (both & np.uint64((1 << bits) - 1)).astype(np.uint64).view(np.int64)


def block_keys(docs: DataFrame, row: Column, size: int, seed: int, bits: int) -> DataFrame:
    """row, doc_id, n_chars, tie, sha and the keys of the blocks (one, two): a narrow row for each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [blocks_of(x.as_py(), size) for x in b.column(1)]
            keys = _keys([x for doc in blocks for x in doc], seed, bits) if blocks else np.zeros((0, 2), np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype(np.int32))
            one, two = (pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(keys[:, k]))) for k in (0, 1))
            sha = pa.array([hashlib.sha256(b"".join(x)).digest() for x in blocks], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), sha, one, two], ["doc_id", "row", "n_chars", "tie", "sha", "one", "two"])

    text = F.coalesce("text", F.lit(""))
    rows = bodies(docs, row.alias("row"), F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("tie"))
    return rows.mapInArrow(run, "doc_id long, row long, n_chars long, tie long, sha binary, one array<long>, two array<long>")


def shared_blocks(docs: DataFrame, size: int, seed: int, bits: int) -> DataFrame:
    """one, two, forms, n: keys that occur more than once, and how many contents are under each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [x for body in b.column(1) for x in blocks_of(body.as_py(), size)]
            if blocks:
                keys = _keys(blocks, seed, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(blocks, pa.binary())], ["one", "two", "block"])

    contents = bodies(docs).mapInArrow(run, "one long, two long, block binary").groupBy("one", "two", "block").agg(F.count("*").alias("n"))
    return contents.groupBy("one", "two").agg(F.count("*").alias("forms"), F.sum("n").alias("n")).where("n > 1")


def _whole(found: DataFrame) -> DataFrame:
    """row, names: the names in order, of rows all of whose ``n`` places have one."""
    places = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return found.groupBy("row", "n").agg(places.alias("places")).where("size(places) = n").select("row", F.col("places.name").alias("names"))


def identities(keys: DataFrame, shared: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """row, level, name for rows that may have an equal: equal documents and no others share (level, name). Then the tables that this reads."""
    names = ranked(shared.select("one", "two"), ["one", "two"], "block-names", "name")
    places = keys.select("row", F.size("one").alias("n"), F.posexplode(F.arrays_zip("one", "two")).alias("pos", "key")).select("row", "n", "pos", "key.*")
    open_ = materialise(_whole(places.join(names, ["one", "two"])), "names-0")
    tables, done = [open_], []
    for level in count():
        done.append(open_.where("size(names) = 1").select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        open_ = open_.where("size(names) > 1")
        if open_.isEmpty():
            break
        n = F.ceil(F.size("names") / 2).cast("int")
        pair = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("names", 2 * k).alias("a"), F.coalesce(F.get("names", 2 * k + 1), F.lit(NONE)).alias("b")))
        pairs = open_.select("row", n.alias("n"), F.posexplode(pair).alias("pos", "pair")).select("row", "n", "pos", "pair.*")
        names = ranked(pairs.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").select("a", "b"), ["a", "b"], "pair-names", "name")
        open_ = materialise(_whole(pairs.join(names, ["a", "b"])), f"names-{level + 1}")
        tables.append(open_)
    ident = done[0]
    for more in done[1:]:
        ident = ident.union(more)
    return ident, tables


def exact_groups(docs: DataFrame, row: str | None = None, size: int = BLOCK, bits: int = 64) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, sha: for each row of ``docs`` which row stays for its text.

    Texts are equal if they are the same bytes without white space (space, tab, line ends, form
    feeds). The row with the most code points stays, then the smallest doc_id, null last, then the
    least hash of the text, then the first written; so of equal rows one stays. Null text counts as
    empty, and empty texts and those of white space alone are equal. Long texts have more blocks and
    levels, about log2(length / size). An empty table gives none. ``row`` names a column of unique
    numbers; without it rows are numbered as they are written. Other columns of ``docs`` aren't read.
    """
    for seed in count():
        shared = materialise(shared_blocks(docs, size, seed, bits), "shared-blocks")
        if shared.where("forms > 1").isEmpty():
            break
        discard(shared)
    keys = materialise(block_keys(docs, F.monotonically_increasing_id() if row is None else quoted(row), size, seed, bits), "block-keys")
    ident, tables = identities(keys, shared)
    # Written before they are joined by a hot name: a join of plain tables is split where a key is too large.
    known = materialise(keys.drop("one", "two").join(ident, "row", "left"), "identities")
    discard(keys, shared, *tables)
    best = F.min(F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie", "row")).alias("best")
    groups = materialise(known.where("name is not null").groupBy("level", "name").agg(F.count("*").alias("group_size"), best), "groups")
    among = known.join(groups, ["level", "name"]).select("row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    alone = known.where("name is null").select("row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return among.union(alone)


def drop_copies(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are; see exact_groups for which and for odd rows."""
    names = [c for c in docs.columns if c != "text"]
    whole = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", as_one(names)), "rows")
    kept = exact_groups(whole, "row", size).where("kept").select("row")
    return whole.join(kept, "row", "left_semi").select(*apart(names), "text").select(list(map(quoted, docs.columns)))


def op11_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size
      FROM d WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM r
"""
