"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's segmentation is the best path through its pieces. A piece costs its score, and a step
from one piece to the next may be forbidden (minus infinity):

- unigram model: scores are the file's, and every step is free;
- BPE model: scores are zero, and a step from a to b is free only if merging the text of a and b
  gives a and b again. Merging a text by rank gives the one path whose steps are all free.

Long texts are cut into chunks anywhere. The state at a border is the piece that is the last to
start before it. A chunk is a matrix of best path values from entry to exit state; matrices
combine associatively under (max, +), here in blocks and then over blocks. From the values of
the blocks' entry states the best path's states are followed back over blocks, then over the
chunks of each block, and every chunk is traced on its own between its two states. The ids are
those of one pass over the whole text (of a unigram model: a path of the same value).

Spaces are written as U+2581, one is put before the text, and a character without a piece
becomes its UTF-8 bytes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import apart, as_one, materialise, table, with_rest

SPACE = "▁"
NONE = -math.inf
#: Characters from which a text is scanned in chunks, of a chunk, and chunks of a block.
GIANT, CHUNK, BLOCK = 1 << 15, 1 << 14, 64
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,!?;:%$&#*|"
UNKNOWN_PENALTY = 10.0
#: Words and steps that a worker remembers.
MEMO = 400_000
#: Characters up to which symbols are merged in a list, not a heap.
LIST = 48
#: Texts of an Arrow batch that are answered together.
PART = 256


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceModel:
    """Pieces with ids and scores, and the best segmentation of a text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        p = self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(p.serialized_model_proto())
        kind = proto.trainer_spec
        if kind.model_type not in (kind.UNIGRAM, kind.BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self.unigram = kind.model_type == kind.UNIGRAM
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [b""] * p.get_piece_size()
        self.byte_ids = [0] * 256
        for k in range(p.get_piece_size()):
            piece = p.id_to_piece(k)
            if p.is_byte(k):
                self.byte_ids[int(piece[3:-1], 16)] = k
                self.bytes[k] = bytes([int(piece[3:-1], 16)])
            elif not (p.is_control(k) or p.is_unknown(k)):
                self.id[piece], self.score[piece] = k, p.get_score(k)
                self.bytes[k] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.id))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY if self.unigram else 0.0
        #: The higher score merges first; equal ones in the order of ids.
        self.rank = {w: k for k, w in enumerate(sorted(self.id, key=lambda w: (-self.score[w], self.id[w])))}
        if not self.unigram:
            self.score = {w: 0.0 for w in self.id if self.merged(w) == [w]}
        begun = {w[:k] for w in self.score for k in range(1, len(w))}
        #: Pieces of a path and their beginnings: score (of a mere beginning: none), and whether a longer piece begins so.
        self.known = {w: (self.score.get(w, NONE), w in begun) for w in begun | self.score.keys()}
        # Where no piece crosses, texts may be cut: before a space behind another character, around
        # line ends, and between Latin letters and marks.
        if any(SPACE in w.lstrip(SPACE) for w in self.id):
            raise ValueError("a piece crosses a border between words")
        self.alone = "".join(c for c in "\n\t" if not any(c in w for w in self.id if len(w) > 1))
        marks = re.escape(MARKS)
        mixed = re.compile(f"[{LATIN}][{marks}]|[{marks}][{LATIN}]")
        end = rf" {self.alone}]|\Z)"
        apart = "" if any(map(mixed.search, self.id)) else f" *[{LATIN}]+(?=[{marks}{end}| *[{marks}]+(?=[{LATIN}{end}|"
        self.words = re.compile(f"{apart} *[^ {self.alone}]+| +" + f"|[{self.alone}]" * bool(self.alone))
        self.memo: dict[str, bytes] = {}
        self.steps: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Neighbours merged while any two make a piece, the first of the best rank each time."""
        rank, none = self.rank.get, len(self.rank)
        s = list(text)
        if len(s) > LIST:
            return self._merged_long(s)
        ranks = [rank(a + b, none) for a, b in zip(s, s[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            new = s[k] = s[k] + s.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = rank(s[k - 1] + new, none)
            if k < len(ranks):
                ranks[k] = rank(new + s[k + 1], none)
        return s

    def _merged_long(self, s: list[str]) -> list[str]:
        """As merged, by a heap of (rank, place); a symbol that went is empty."""
        rank, n = self.rank.get, len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a + b) for k, (a, b) in enumerate(zip(s, s[1:])) if (r := rank(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, made = heapq.heappop(heap)
            j = after[k]
            if not s[k] or j >= n or s[k] + s[j] != made:
                continue
            s[k], s[j] = made, ""
            after[k] = i = after[j]
            if i < n:
                before[i] = k
                if (r := rank(made + s[i])) is not None:
                    heapq.heappush(heap, (r, k, made + s[i]))
            if (i := before[k]) >= 0 and (r := rank(s[i] + made)) is not None:
                heapq.heappush(heap, (r, i, s[i] + made))
        return [x for x in s if x]

    def free(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a (an empty one: the start of the text)."""
        if self.unigram or not a:
            return True
        got = self.steps.get((a, b))
        if got is None:
            if len(self.steps) >= MEMO:
                self.steps.clear()
            got = self.steps[a, b] = self.merged(a + b) == [a, b]
        return got

    def pieces_at(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """Ends and scores of the pieces that start at a place; a character without a piece is one of its own."""
        single = False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            found = self.known.get(text[at:end])
            if found is None:
                break
            if found[0] > NONE:
                single |= end == at + 1
                yield end, found[0]
            if not found[1]:
                break
        if not single:
            yield at + 1, self.unknown

    def forward(self, text: str, start: int, at: int, stop: int) -> tuple[list[float], list[int]]:
        """From a piece text[start:at]: the best value at each place before ``stop`` and beyond, and where its last piece starts."""
        best, last = [NONE] * (len(text) + 1), [-1] * (len(text) + 1)
        best[at], last[at] = 0.0, start
        for here in range(at, stop):
            value = best[here]
            if value == NONE:
                continue
            before = text[last[here] : here]
            for end, score in self.pieces_at(text, here):
                if value + score > best[end] and self.free(before, text[here:end]):
                    best[end], last[end] = value + score, here
        return best, last

    def states(self, text: str, border: int, end: int | None = None) -> list[tuple[int, int]]:
        """The pieces that start before a border and end at it or later (``end``: there only), by place."""
        if not border:
            return [(0, 0)]
        found = ((s, e) for s in range(max(0, border - self.longest), border) for e, _ in self.pieces_at(text, s))
        return [(s, e) for s, e in found if (e >= border if end is None else e == end)]

    def is_cut(self, text: str, k: int) -> bool:
        """No piece crosses such a place, and every step over it is free."""
        return (text[k] == SPACE and text[k - 1] != SPACE) or text[k] in self.alone

    def reach(self, text: str, entry: tuple[int, int], border: int, exits: list[tuple[int, int]]) -> list[float]:
        """Best values from a piece to each of the pieces at a border."""
        if entry[1] >= border:
            return [0.0 if x == entry else NONE for x in exits]
        best, last = self.forward(text, *entry, border)
        return [best[s] + self.known.get(text[s:e], (self.unknown,))[0] if best[s] > NONE and self.free(text[last[s] : s], text[s:e]) else NONE for s, e in exits]

    def cuts(self, text: str, first: int, border: int) -> tuple[int, int]:
        """First and last cut of a chunk; -1, -1 if there is none."""
        low = next((k for k in range(max(1, first), border) if self.is_cut(text, k)), -1)
        return low, next((k for k in range(border - 1, low - 1, -1) if self.is_cut(text, k)), -1) if low >= 0 else -1

    def matrix(self, text: str, first: int, border: int, final: bool) -> np.ndarray:
        """Best values from the states at ``first`` to those at ``border`` (``final``: the end of the text)."""
        entries, exits = self.states(text, first), self.states(text, border, len(text) if final else None)
        low, high = self.cuts(text, first, border)
        if low < 0:
            return np.array([self.reach(text, x, border, exits) for x in entries])
        # Between the cuts a path hangs on neither border.
        rest = np.array(self.reach(text[high:], (0, 0), border - high, [(s - high, e - high) if s >= high else (-1, -1) for s, e in exits]))
        rest += self.stretch_score(text[low:high])
        return np.array([self.forward(text[:low], *x, low)[0][low] for x in entries])[:, None] + rest

    def trace(self, text: str, entry: tuple[int, int], end: tuple[int, int]) -> list[int]:
        """Ids of the best path from piece ``entry`` (left out) to piece ``end``."""
        if entry == end:
            return []
        _, last = self.forward(text, *entry, end[0] + 1)
        ends, at = [end], end[0]
        while at > entry[1]:
            ends.append((last[at], at))
            at = last[at]
        return [k for s, e in reversed(ends) for k in self.ids_of(text[s:e])]

    def between(self, text: str, first: int, border: int, final: bool, entry: int, end: int) -> bytes:
        """Ids (as bytes of an int array) of a chunk's pieces from one state to another."""
        a, z = self.states(text, first)[entry], self.states(text, border, len(text) if final else None)[end]
        low, high = self.cuts(text, first, border)
        if low < 0 or a[1] >= border:
            return array("i", self.trace(text, a, z)).tobytes()
        head = []
        if a[1] < low:
            start = self.forward(text[:low], *a, low)[1][low]
            head = self.trace(text[:low], a, (start, low))
        return array("i", head).tobytes() + self.stretch(text[low:high].replace(SPACE, " ")) + array("i", self.trace(text[high:], (0, 0), (z[0] - high, z[1] - high))).tobytes()

    def ids_of(self, piece: str) -> list[int]:
        k = self.id.get(piece)
        return [self.byte_ids[b] for b in piece.encode()] if k is None else [k]

    def segment(self, text: str) -> list[str]:
        """Pieces of a stretch between cuts, in one pass."""
        if not self.unigram:
            return self.merged(text)
        last, at, out = self.forward(text, 0, 0, len(text))[1], len(text), []
        while at:
            out.append(text[last[at] : at])
            at = last[at]
        return out[::-1]

    def word(self, w: str) -> bytes:
        """Ids of a stretch between cuts, remembered if short."""
        ids = array("i")
        for x in self.segment(w.replace(" ", SPACE)):
            k = self.id.get(x)
            if k is None:
                ids.extend(self.ids_of(x))
            else:
                ids.append(k)
        got = ids.tobytes()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(w) <= 64:
            self.memo[w] = got
        return got

    def stretch(self, text: str) -> bytes:
        """Ids of a text between cuts, spaces not yet escaped."""
        get = self.memo.get
        return b"".join([get(w) or self.word(w) for w in self.words.findall(text)])

    def stretch_score(self, text: str) -> float:
        if not self.unigram:
            return 0.0
        return sum(self.score.get(x, self.unknown) for w in self.words.findall(text.replace(SPACE, " ")) for x in self.segment(w.replace(" ", SPACE)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text in one pass, word by word."""
        return np.frombuffer(self.stretch(" " + text.replace(SPACE, " ")) if text else b"", np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space put before it goes. Bytes that are no UTF-8 become U+FFFD."""
        body = b"".join(map(self.bytes.__getitem__, ids))
        return body.removeprefix(b" ").decode("utf-8", "replace")


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def chain(vector: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A vector, or a matrix by rows, times a matrix under (max, +)."""
    return (vector[..., :, None] + matrix).max(axis=-2)


def path_of(matrices: list[np.ndarray], entry: int, end: int | None) -> list[int]:
    """States of the best path from ``entry`` through the matrices (``end`` None: to the best state): one more than matrices."""
    values = [np.where(np.arange(len(matrices[0])) == entry, 0.0, NONE)]
    for m in matrices:
        values.append(chain(values[-1], m))
    states = [int(values[-1].argmax()) if end is None else end]
    for v, m in zip(values[-2::-1], matrices[::-1]):
        states.append(int((v + m[:, states[-1]]).argmax()))
    return states[::-1]


def scan_chunks(texts: DataFrame, path: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Of (key, text), keys distinct: (key, ids), by the parallel scan."""
    around = model(path).longest

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with what stands up to a piece's length around them."""
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                text = escaped(text.as_py())
                n = max(1, -(-len(text) // chunk))
                for k in range(0, n, 64):
                    part = range(k, min(n, k + 64))
                    low = [max(0, j * chunk - around) for j in part]
                    cols = [
                        pa.array([key.as_py()] * len(part)), pa.array([j // block for j in part], pa.int32()), pa.array(part, pa.int32()), pa.array([j * chunk - x for j, x in zip(part, low)], pa.int32()),
                        pa.array([min(len(text), (j + 1) * chunk) - x for j, x in zip(part, low)], pa.int32()), pa.array([j == n - 1 for j in part]), pa.array([text[x : (j + 1) * chunk + around] for j, x in zip(part, low)], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "block", "chunk", "first", "border", "final", "part"])

    chunks = materialise(texts.mapInArrow(cut, "key string, block int, chunk int, first int, border int, final boolean, part string"), "chunks")

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model(path).matrix(t, f, z, last) for f, z, last, t in zip(*(c.to_pylist() for c in b.columns[3:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(m) for m in got], pa.int32()), pa.array([m.ravel() for m in got], pa.list_(pa.float64()))], ["key", "block", "chunk", "rows", "matrix"])

    step = materialise(chunks.mapInArrow(matrices, "key string, block int, chunk int, rows int, matrix array<double>"), "matrices")

    def read(rows: pd.DataFrame) -> list[np.ndarray]:
        return [np.asarray(m, float).reshape(n, -1) for n, m in zip(rows.rows, rows.matrix)]

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        m = functools.reduce(chain, read(rows.sort_values("chunk")))
        return pd.DataFrame({"key": [rows.key.iloc[0]], "block": [rows.block.iloc[0]], "rows": [len(m)], "matrix": [m.ravel()]})

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        states = path_of(read(rows), 0, None)
        return pd.DataFrame({"key": rows.key, "block": rows.block, "enters": states[:-1], "leaves": states[1:]})

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        states = path_of(read(rows), int(rows.enters.iloc[0]), int(rows.leaves.iloc[0]))
        return pd.DataFrame({"key": rows.key, "chunk": rows.chunk, "entry": states[:-1], "end": states[1:]})

    blocks = step.groupBy("key", "block").applyInPandas(product, "key string, block int, rows int, matrix array<double>")
    ways = blocks.groupBy("key").applyInPandas(along, "key string, block int, enters int, leaves int")
    ways = step.join(ways, ["key", "block"]).groupBy("key", "block").applyInPandas(within, "key string, chunk int, entry int, end int")

    def traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(model(path).between(t, f, z, last, entry, end), np.int32) for f, z, last, t, entry, end in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(got, pa.list_(pa.int32()))], ["key", "chunk", "ids"])

    pieces = chunks.join(ways, ["key", "chunk"]).select("key", "chunk", "first", "border", "final", "part", "entry", "end").mapInArrow(traced, "key string, chunk int, ids array<int>")
    whole = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("all"))
    return whole.select("key", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, PART):
        yield batch.slice(k, PART)


IDS = "ids array<int>"
SUMMARY = "n_ids long, ids_crc32 long, decoded_sha256 string"


def id_columns(every: Iterable[np.ndarray], path: str, summary: bool) -> list[pa.Array]:
    """The columns of IDS, or of SUMMARY."""
    if not summary:
        return [pa.array(list(every), pa.list_(pa.int32()))]
    n, crc, sha = [], [], []
    for ids in every:
        n.append(len(ids))
        crc.append(zlib.crc32(ids.astype("<i4", copy=False).tobytes()))
        sha.append(hashlib.sha256(model(path).decode(ids.tolist()).encode()).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())]


def encode(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK, summary: bool = False) -> DataFrame:
    """``docs`` without text, and ids (array<int>); a column of that name is replaced.

    ``summary``: instead of ids their number, the crc32 of them as little-endian 32-bit numbers, and the
    sha256 of the text that they decode to. Null and empty texts have no ids. Texts over ``giant``
    characters go through the scan, equal ones once; repeated rows stay. An empty table gives none.
    """
    path = path or public_model()
    made = SUMMARY if summary else IDS
    names = [f.split()[0] for f in made.split(", ")]
    rest = [c for c in docs.columns if c != "text" and c not in names]
    packed = docs.select(as_one(rest), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                cols = id_columns((model(path).encode(t.as_py()) for t in part.column(1)), path, summary)
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["rest", *names])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                ids = (x.values.to_numpy(zero_copy_only=False) for x in part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *id_columns(ids, path, True)], ["key", *names])

    short = packed.where(F.length("text") <= giant).mapInArrow(run, with_rest(packed, made))
    long = packed.where(F.length("text") > giant).withColumn("key", F.sha2("text", 256))
    found = scan_chunks(long.groupBy("key").agg(F.first("text").alias("text")), path, chunk)
    if summary:
        found = found.mapInArrow(summed, f"key string, {made}")
    every = short.unionByName(long.drop("text").join(found, "key").drop("key"))
    return every.select(*apart(rest), *names)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ids replaced by text. Null ids: null text. A U+2581 that was in a text is a space now."""
    path = path or public_model()
    rest = [c for c in encoded.columns if c not in ("text", "ids")]
    packed = encoded.select(as_one(rest), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                text = [model(path).decode(x.as_py()) if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], ["rest", "text"])

    return packed.mapInArrow(run, with_rest(packed, "text string")).select(*apart(rest), "text")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded: counts and digests of the ids, and whether the text came back."""
    docs = table(spark, sf_dir, "documents")
    text = F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    docs = docs.select("doc_id", "text", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
    got = encode(docs, summary=True)
    return got.select("doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip"))
