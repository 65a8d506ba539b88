"""Best-fit packing of token sequences, planned over the histogram of lengths.

Pieces of a document are counted by length. Best-fit decreasing runs over these counts (at
most ``capacity`` of them, whatever the corpus), not over documents: a step puts many equal
pieces into many equal sequences. Its rows say which ranks of a length go to which sequences
and where. Pieces then take their slots by a join on length and rank; the rank comes from
row numbers within salted parts of a length plus the parts' counts. A length has as many parts
as its pieces fill, so that even the full pieces of a huge corpus are spread over tasks.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptora.llm.common import bodies, materialise, table

CAPACITY = 2048
#: Pieces of a length that one task ranks at most, and parts that FEW pieces each are dealt to anyway.
SHARE, FEW, PARTS = 1_000_000, 512, 1024
BLOCK = 1 << 19
#: Stands between words that are encoded together; alone it has one id.
MARK = "\0"
PLAN = "length int, first_rank long, last_rank long, first_sequence long, place int, each int"


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The tokenizer parts letters from marks anyway, so they are remembered apart where ASCII stands on both sides.
WORDS = re.compile(rb"[a-z]+(?=[.,!?;:%$&#*()\s]|\Z)|[.,!?;:%$&#*()]+(?=[a-z\s]|\Z)|\S+")


class WordEncoder:
    """Token ids of whole texts.

    A tokenizer that lower-cases, never joins across ASCII white space, drops it, and parts letters from
    marks is asked word by word: each distinct word is encoded once while it stays in the memo, which is
    emptied when it holds ``most`` words. Texts go through in blocks that end at white space. Any other
    tokenizer, which probes tell, gets the texts whole.
    """

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.by_word = self._parts_words()
        self._empty()

    def _parts_words(self) -> bool:
        ids = lambda *texts: [k for t in texts for k in self.tokenizer.encode(t, add_special_tokens=False).ids]
        return (
            ids("The CAT sat ÉTÉ") == ids("the cat sat ÉTÉ") and ids("the cat 12") == ids("the", "cat", "12") and ids(" the\t\n cat\r\n") == ids("the", "cat")
            and ids("cat,") == ids("cat", ",") and ids("cat.the") == ids("cat", ".", "the") and ids("the!!") == ids("the", "!!")
        )

    def whole(self, body: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(body.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ends = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words on end, and how many each has.

        Words go to the tokenizer in one string, with a mark of one id between them; a word that
        holds the mark's character, or any if the mark has more ids, goes alone.
        """
        if self.mark is None or any(MARK.encode() in w for w in words):
            got = [self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]
            sizes = np.fromiter(map(len, got), np.int64, len(words))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes
        text = f" {MARK} ".encode().join(words).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.mark)
        edges = np.concatenate([[-1], at, [len(ids)]])
        return np.delete(ids, at), np.diff(edges) - 1

    def _learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            flat, sizes = self._ids(part)
            at, n = len(self.number), len(part)
            used = int(self.ends[at])
            while at + n >= len(self.ends):
                self.ends = np.append(self.ends, np.zeros_like(self.ends))
            while used + len(flat) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.ends[at + 1 : at + n + 1] = used + np.cumsum(sizes)
            self.flat[used : used + len(flat)] = flat
            self.number.update(zip(part, range(at, at + n)))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, and where each word's end."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        which = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        late = np.flatnonzero(which < 0)
        if len(late):
            new = list(dict.fromkeys(map(words.__getitem__, late.tolist())))
            if len(self.number) + len(new) > self.most and self.number:
                self._empty()
                return self._words(words)
            self._learn(new)
            which[late] = np.fromiter((self.number[words[k]] for k in late.tolist()), np.int64, len(late))
        start = self.ends[which]
        size = self.ends[which + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])], ends

    @staticmethod
    def lowered(body: bytes) -> bytes:
        """A-Z lower-cased, so that fewer words differ; not where a special token's name might come out of it."""
        return body if b"<|" in body else body.lower()

    def encode(self, body: bytes) -> np.ndarray:
        if not self.by_word:
            return self.whole(body)
        body = self.lowered(body)
        if len(body) <= BLOCK:
            return self._words(WORDS.findall(body))[0]
        out, at = [], 0
        while at < len(body):
            end = at + BLOCK
            while end < len(body) and body[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            out.append(self._words(WORDS.findall(body[at:end]))[0])
            at = end
        return np.concatenate(out)

    def encode_all(self, bodies: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text; short texts go through together, up to BLOCK bytes of them."""
        if not self.by_word:
            yield from map(self.whole, bodies)
            return
        words: list[bytes] = []
        bounds, size = [0], 0

        def held() -> Iterator[np.ndarray]:
            nonlocal bounds, size
            ids, ends = self._words(words)
            edges = np.concatenate([[0], ends])[bounds].tolist()
            for s, e in zip(edges, edges[1:]):
                yield ids[s:e]
            words.clear()
            bounds, size = [0], 0

        for body in bodies:
            if len(body) > BLOCK:
                yield from held()
                yield self.encode(body)
                continue
            words += WORDS.findall(self.lowered(body))
            bounds.append(len(words))
            size += len(body)
            if size > BLOCK:
                yield from held()
        yield from held()


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and ``end_id``, cut at ``capacity``.

    Null or empty text: ``end_id`` alone. Other columns are left out.
    """
    path = vocabulary or public_vocabulary()
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not Path(path).exists():
            raise FileNotFoundError(f"no tokenizer file at {path}")
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, ids in enumerate(encoder(path).encode_all(x.as_py() for x in b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return bodies(docs).mapInArrow(run, schema)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of PLAN.

    Ranks first_rank to last_rank (excluded) of a length take the sequences from
    first_sequence on, ``each`` to a sequence, the first of them at ``place``.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (first sequence, how many)
    plan, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = next((r for r in range(length, capacity) if room[r]), capacity)
            each = free // length  # a sequence that took one is the tightest for the next
            asked = -(-left // each)
            if free == capacity:
                first, n = made, asked
                made += asked
            else:
                first, n = room[free].pop()
                if n > asked:
                    room[free].append((first + asked, n - asked))
                    n = asked
            took = min(left, n * each)
            plan.append((length, rank, rank + took, first, capacity - free, each))
            full, odd = divmod(took, each)
            if full and free - each * length:
                room[free - each * length].append((first, full))
            if odd and free - odd * length:
                room[free - odd * length].append((first + full, 1))
            rank += took
            left -= took
    return plan


def pack(found: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """The given pieces and sequence_id, offset. ``found`` is read several times: pass a written table.

    Every piece gets a slot, repeated rows each their own; no sequence holds over ``capacity``
    and none has gaps. An empty table gives none.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    # At most capacity rows, whatever the corpus.
    lengths = spark.createDataFrame([(k, max(-(-n // share), min(n // FEW, PARTS))) for k, n in sorted(counts.items())], "length int, _parts long")
    dealt = found.join(F.broadcast(lengths), "length").withColumn("_salt", F.expr("pmod(xxhash64(doc_id, piece, start), _parts)"))
    parts = dealt.groupBy("length", "_salt").count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    )
    plan = spark.createDataFrame(plan_slots(counts, capacity), PLAN)
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(parts.drop("count"), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    plan = plan.withColumnRenamed("length", "_length")
    slot = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("last_rank"))
    at = F.col("_rank") - F.col("first_rank")
    # The plan has a few rows a length.
    return ranked.join(F.broadcast(plan), slot).select(
        *found.columns, (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + at % F.col("each") * F.col("length")).cast("long").alias("offset")
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    return pack(materialise(pieces(docs), "pieces")).withColumn("length", F.col("length").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
