"""Phrases that stand together more often than their parts: Apriori candidates counted by double-array tries.

1. Words are counted by language. A phrase that occurs often enough has only words and parts that do.
2. Candidates: pairs of frequent words, then triples of candidate pairs, are counted by 32-bit keys
   of their words. Keys may collide, which only adds: no frequent phrase is missed. Which words and
   pairs to look at is told by bitmaps of fixed size, which may only let more through.
3. The candidates, sorted and cut into shards of bounded size, become double-array tries, each
   broadcast in turn. In the tasks numpy advances the states of all text positions at once, word by
   word, and counts the accepting ones; the counts of tasks and shards are summed. These are exact.
4. Scores of cuts are exact in whole decimal numbers.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptora.llm.common import bitmap, bound_batches, discard, marked, materialise, ranked, table

#: Bytes of text that a task takes at once; longer texts are cut between two pieces.
CHUNK = 8 << 20
#: Rows that a task hands over at once.
BATCH = 100_000
#: Candidates of one trie: bounds what is broadcast and what the driver holds.
SHARD = 1 << 19
#: A word's number is spelled in digits of so many bits, so that no state has more than 64 children.
DIGIT = 6

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = re.compile(rb"[.,;:!?\x0a-\x0d]")
#: 0 in a word, 1 between words, 2 between pieces.
KIND = bytes(2 if END.match(bytes([b])) else int(b in b" \t") for b in range(256))

Chunk = tuple[str, list[bytes]]


def chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[Chunk]:
    """Texts of one language together, about ``most`` bytes at a time."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for b in batches:
        for lang, body in zip(b.column(0).to_pylist(), b.column(1)):
            body = body.as_py()
            while body:
                # Phrases don't cross the end of a piece, so a text may be cut there.
                cut = END.search(body, most) if len(body) > most else None
                part, body = (body[: cut.end()], body[cut.end() :]) if cut else (body, b"")
                held[lang].append(part)
                size[lang] += len(part)
                if size[lang] >= most or sum(size.values()) >= 2 * most:
                    full = max(size, key=size.get)
                    del size[full]
                    yield full, held.pop(full)
    yield from held.items()


class Words:
    """The words of a chunk as numbers into their sorted-out dictionary, and where two neighbours are of one piece."""

    def __init__(self, bodies: list[bytes]):
        data = b"\n".join(bodies).translate(LOWER)
        bytes_ = np.frombuffer(data, np.uint8)
        kind = np.frombuffer(data.translate(KIND), np.uint8)
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        # Without what stands between them, words lie end to end, as Arrow wants them.
        at = np.cumsum(inside, dtype=np.int32)
        flat = bytes_[inside]
        ends = np.append(at[starts] - 1, len(flat)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
        self.number = words.indices.to_numpy().astype(np.int64)
        self.dictionary = words.dictionary
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.joined = piece[1:] == piece[:-1]

    def keys(self, lang: str) -> np.ndarray:
        """32-bit keys of the dictionary's words in this language."""
        seed = lang_key(lang)
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) & 0xFFFFFFFF for w in self.dictionary.to_pylist()), np.uint64, len(self.dictionary))


def lang_key(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


def _over(docs: DataFrame, each: Callable[[str, Words], dict[str, pa.Array]], schema: str, most: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, bodies in chunks(batches, most):
            out = each(lang, Words(bodies))
            for k in range(0, len(out["f"]) if out else 0, BATCH):
                yield pa.RecordBatch.from_arrays([c.slice(k, BATCH) for c in out.values()], list(out))

    return docs.mapInArrow(run, schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """lang (null: und) and the text's bytes (null: empty)."""
    bound_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))


def word_counts(texts: DataFrame, most: int = CHUNK) -> DataFrame:
    """lang, phrase, f of every word."""

    def each(lang: str, words: Words) -> dict[str, pa.Array]:
        n = len(words.dictionary)
        f = np.bincount(words.number, minlength=n)
        return {"lang": pa.array([lang] * n, pa.string()), "phrase": words.dictionary.cast(pa.large_string()).cast(pa.string()), "f": pa.array(f.astype(np.int64))} if n else {}

    return _over(texts, each, "lang string, phrase string, f long", most).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def pair_key(ab: np.ndarray, lang: np.ndarray) -> np.ndarray:
    x = ab ^ lang * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def pair_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ab, lc = (c.to_numpy().view(np.uint64) for c in b.columns)
        yield pa.RecordBatch.from_arrays([pa.array(pair_key(ab, lc >> np.uint64(32)).view(np.int64))], ["key"])


def _rows(lang: np.uint64, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> dict[str, pa.Array]:
    signed = lambda x: pa.array(x.astype(np.uint64, copy=False).view(np.int64))
    return {"ab": signed(a << np.uint64(32) | b), "lc": signed(lang << np.uint64(32) | c), "f": pa.array(n.astype(np.int64))}


def pair_keys(texts: DataFrame, frequent: np.ndarray, least: int, most: int = CHUNK) -> DataFrame:
    """ab, lc, f of pairs of frequent words by their keys, where f is ``least`` at least. Colliding pairs are one.

    Tasks have added up by chunks already, so rows are dealt out as they are and no map of all of a task's pairs is held.
    """
    bits = texts.sparkSession.sparkContext.broadcast(frequent)

    def each(lang: str, words: Words) -> dict[str, pa.Array]:
        key, code = words.keys(lang), np.uint64(lang_key(lang))
        good = marked(bits.value, code << np.uint64(32) | key)[words.number]
        at = np.flatnonzero(words.joined & good[:-1] & good[1:])
        n = np.int64(len(key))
        pair, f = _counted(words.number[at] * n + words.number[at + 1])
        a, b = key[pair // n] if len(pair) else key[:0], key[pair % n] if len(pair) else key[:0]
        return _rows(code, a, b, np.zeros_like(a), f)

    return _over(texts, each, "ab long, lc long, f long", most).repartition("ab", "lc").groupBy("ab", "lc").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def triple_keys(texts: DataFrame, frequent: np.ndarray, pairs: np.ndarray, least: int, most: int = CHUNK) -> DataFrame:
    """The same for triples both of whose pairs are candidates."""
    bits, pair_bits = texts.sparkSession.sparkContext.broadcast(frequent), texts.sparkSession.sparkContext.broadcast(pairs)

    def each(lang: str, words: Words) -> dict[str, pa.Array]:
        key, code = words.keys(lang), np.uint64(lang_key(lang))
        good = marked(bits.value, code << np.uint64(32) | key)[words.number]
        at = np.flatnonzero(words.joined & good[:-1] & good[1:])
        n = np.int64(len(key))
        pair, which = np.unique(words.number[at] * n + words.number[at + 1], return_inverse=True)
        if not len(pair):
            return {}
        candidate = marked(pair_bits.value, pair_key(key[pair // n] << np.uint64(32) | key[pair % n], np.array([code])))
        of = np.full(len(words.number), -1, np.int64)
        of[at] = np.where(candidate[which], which, -1)
        both = np.flatnonzero((of[:-1] >= 0) & (of[1:] >= 0))
        triple, f = _counted(of[both] * len(pair) + of[both + 1])
        left, right = pair[triple // len(pair)], pair[triple % len(pair)]
        return _rows(code, key[left // n], key[right // n], key[right % n], f)

    return _over(texts, each, "ab long, lc long, f long", most).repartition("ab", "lc").groupBy("ab", "lc").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _keyed(words: DataFrame) -> DataFrame:
    """``words`` (lang, phrase) with lang_key, word_key and their 64-bit key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.fromiter(map(lang_key, b.column(0).to_pylist()), np.int64, b.num_rows)
            word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), int(k)) & 0xFFFFFFFF for w, k in zip(b.column(1).to_pylist(), lang)), np.int64, b.num_rows)
            both = (lang.view(np.uint64) << np.uint64(32) | word.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(word), pa.array(both)], ["lang", "word", "lang_key", "word_key", "key"])

    return words.select("lang", "phrase").mapInArrow(run, "lang string, word string, lang_key long, word_key long, key long")


def _spelled(keys: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """lang, a, b, c of the phrases that candidate keys may stand for."""
    low, high = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF), lambda c: F.shiftrightunsigned(c, 32)
    out = keys.select(high("lc").alias("lang_key"), high("ab").alias("ka"), low("ab").alias("kb"), low("lc").alias("kc"))
    for k, name in enumerate("abc"[:n]):
        side = words.select("lang_key", F.col("word_key").alias(f"k{name}"), F.col("word").alias(name), *(["lang"] if not k else [F.col("lang").alias("l")]))
        out = out.join(side, ["lang_key", f"k{name}"])
        out = out.where("l = lang").drop("l") if k else out
    return out.select("lang", "a", "b", F.col("c") if n == 3 else F.lit(None).cast("string").alias("c"))


class Trie:
    """A double-array trie: state s has the child base[s] + digit if check of that is s; accept tells which entry ends there."""

    def __init__(self, columns: list[np.ndarray], digits: int):
        """columns: symbols of each entry, the i-th in the i-th column; -1 behind its end."""
        self.digits = digits
        node, parents, marks = np.zeros(len(columns[0]), np.int64), [], []
        self.nodes = 1
        for symbols in columns:
            on = np.flatnonzero(symbols >= 0)
            for digit in self.spelled(symbols[on]):
                edge, which = np.unique(node[on] << DIGIT | digit, return_inverse=True)
                node[on] = self.nodes + which
                parents.append(edge >> DIGIT)
                marks.append(edge & (1 << DIGIT) - 1)
                self.nodes += len(edge)
        self._place(np.concatenate(parents), np.concatenate(marks))
        self.accept = np.full(len(self.base), -1, np.int32)
        self.accept[self.slot[node]] = np.arange(len(node))
        del self.slot

    def spelled(self, symbols: np.ndarray) -> list[np.ndarray]:
        return [symbols >> DIGIT * k & (1 << DIGIT) - 1 for k in range(self.digits)]

    def _place(self, parent: np.ndarray, mark: np.ndarray) -> None:
        """Find each node's base: states with many children draw places until all are free, those with one take what is left over."""
        width = 1 << DIGIT
        size = int(1.5 * self.nodes) + 4 * width
        rng, free = np.random.default_rng(7), np.ones(size, bool)
        free[:width] = False
        base, owner = np.zeros(self.nodes, np.int64), np.full(size, -1, np.int64)
        children = np.bincount(parent, minlength=self.nodes)
        top = width
        while top > 1:
            own = np.flatnonzero((children[parent] <= top) & (children[parent] > top // 2))
            while len(own):
                who = parent[own]
                base[who] = rng.integers(width, size - width, self.nodes)[who]
                at = base[who] + mark[own]
                owner[at] = who
                bad = np.zeros(self.nodes, bool)
                bad[who[~free[at] | (owner[at] != who)]] = True
                free[at[~bad[who]]] = False
                own = own[bad[who]]
            top //= 2
        own = np.flatnonzero(children[parent] == 1)
        base[parent[own]] = np.flatnonzero(free)[: len(own)] - mark[own]
        self.slot = np.zeros(self.nodes, np.int64)
        # Nodes are numbered as their edges stand, after the root.
        self.slot[1:] = base[parent] + mark
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.base[self.slot] = base
        self.check[self.slot[1:]] = self.slot[parent]

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after a symbol each; -1 where there is none. Both hold numbers from 0."""
        out = np.full(len(states), -1, np.int64)
        on = np.arange(len(states))
        for digit in self.spelled(symbols):
            to = self.base[states] + digit[on]
            good = self.check[to] == states
            on, states = on[good], to[good].astype(np.int64)
        out[on] = states
        return out


def trie_of(entries: pa.Table) -> tuple[Trie, list[str], pa.Array]:
    """The trie of a shard's entries (lang, a, b, c), its languages, and its words: symbols are places in these."""
    langs = entries["lang"].combine_chunks().dictionary_encode()
    words = pa.concat_arrays([x for c in "abc" for x in entries[c].cast(pa.large_binary()).chunks]).dictionary_encode()
    symbols = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(3, -1)
    most = max(len(words.dictionary), len(langs.dictionary), 2)
    trie = Trie([langs.indices.to_numpy().astype(np.int64), *symbols], -(-(most - 1).bit_length() // DIGIT))
    return trie, langs.dictionary.to_pylist(), words.dictionary


def trie_counts(trie: Trie, langs: list[str], alphabet: pa.Array, lang: str, words: Words) -> np.ndarray:
    """How often each entry of the trie occurs in a chunk."""
    n = int(trie.accept.max()) + 1
    if lang not in langs or not len(words.number):
        return np.zeros(n, np.int64)
    symbol = pc.index_in(words.dictionary, value_set=alphabet).fill_null(-1).to_numpy().astype(np.int64)
    known = np.flatnonzero(symbol >= 0)
    root = trie.advance(np.zeros(1, np.int64), np.array([langs.index(lang)]))
    state = np.full(len(symbol), -1, np.int64)
    state[known] = trie.advance(np.repeat(root, len(known)), symbol[known])
    states, symbols = state[words.number], symbol[words.number]
    at = np.flatnonzero(states >= 0)
    counts = np.zeros(n, np.int64)
    for step in (1, 2):
        at = at[at + step < len(symbols)]
        at = at[words.joined[at + step - 1] & (symbols[at + step] >= 0)]
        states[at] = trie.advance(states[at], symbols[at + step])
        at = at[states[at] >= 0]
        found = trie.accept[states[at]]
        counts += np.bincount(found[found >= 0], minlength=n)
    return counts


def counted_by_tries(texts: DataFrame, candidates: DataFrame, shard: int = SHARD, most: int = CHUNK) -> DataFrame:
    """number, f of each of the ``candidates`` (lang, a, b, c and number from 0, dense): one pass over the texts a shard."""
    spark = texts.sparkSession
    shards = (candidates.agg(F.max("number")).first()[0] or 0) // shard + 1
    out = []
    for k in range(shards):
        first = k * shard
        entries = candidates.where((F.col("number") >= first) & (F.col("number") < first + shard)).orderBy("number").select("lang", "a", "b", "c").toArrow()
        if not entries.num_rows:
            break
        held = spark.sparkContext.broadcast(trie_of(entries))

        def run(batches: Iterable[pa.RecordBatch], held=held, first=first) -> Iterator[pa.RecordBatch]:
            trie, langs, alphabet = held.value
            total = np.zeros(int(trie.accept.max()) + 1, np.int64)
            for lang, bodies in chunks(batches, most):
                total += trie_counts(trie, langs, alphabet, lang, Words(bodies))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(total[at])], ["number", "f"])

        out.append(materialise(texts.mapInArrow(run, "number long, f long").groupBy("number").agg(F.sum("f").alias("f")), "trie-counts"))
        held.unpersist()
    if not out:
        return spark.createDataFrame([], "number long, f long")
    got = out[0]
    for more in out[1:]:
        got = got.union(more)
    return got


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, shard: int = SHARD, most: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of all phrases of up to ``longest`` words that occur ``least`` times; and lang, n of all words."""
    if longest not in (2, 3):
        raise ValueError("phrases have 2 or 3 words at most")
    texts = texts_of(docs)
    words = materialise(word_counts(texts, most), "words")
    totals = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = materialise(words.where(F.col("f") >= least), "frequent")
    discard(words)
    keyed = materialise(_keyed(frequent), "keyed")
    good = bitmap(keyed.select("key"))
    keys = materialise(pair_keys(texts, good, least, most), "pair-keys")
    found = _spelled(keys, keyed, 2)
    if longest == 3:
        pairs = bitmap(keys.select("ab", "lc").mapInArrow(pair_hashes, "key long"))
        triples = materialise(triple_keys(texts, good, pairs, least, most), "triple-keys")
        found = found.union(_spelled(triples, keyed, 3))
    candidates = ranked(found, ["lang", "a", "b", "c"], "candidates", "number")
    counts = counted_by_tries(texts, candidates, shard, most).where(F.col("f") >= least)
    joined = candidates.join(counts, "number").select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.when(F.col("c").isNull(), 2).otherwise(3).alias("words"), "f")
    return materialise(joined.union(frequent.select("lang", "phrase", F.lit(1), "f")), "phrases"), totals


def cut_score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly: decimals of 38 digits hold the products of counts up to 10^16."""
    wide = lambda x: x.cast("decimal(19,0)")
    above = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000, shard: int = SHARD, most: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language (None: all, ranked).

    Texts are lower-cased (A to Z) and cut into pieces at punctuation and line ends, these into words at spaces and tabs. A
    phrase is 2 to ``longest`` words of a piece that occur together ``least`` times, overlaps included. Its score is that of the
    cut that scores least (ties: the first cut); a phrase goes if it lies inside a longer one that occurs in ``share`` percent of
    its places. Null texts are empty, a null language is ``und``. Repeated rows count each time. Long texts are cut between
    pieces and counted whole. An empty table gives none. Ties in score: more frequent first, then by the phrase's bytes.
    """
    counts, totals = phrase_counts(docs, longest, least, shard, most)
    longer = counts.where("words > 1")
    parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    cuts = longer.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    left = parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))
    within = longer.where("words = 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a")))
    kept = materialise(kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "collocations")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = kept
    if top is not None:
        # The first of each share of phrases, then the first of these: no task sees all phrases of a language.
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        rows = kept.withColumn("_part", part).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_at") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = rows.withColumn("rank", rank.cast("long"))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, w, len(w) AS size, unnest(range(1, len(w) + 1)) AS i FROM split
), spans AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM grams, (VALUES (1), (2), (3)) AS t(m) WHERE i + m - 1 <= size
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM spans GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), cands AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cands) AS c
  JOIN counts AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') JOIN counts AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.m], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts
), within AS (
  SELECT lang, inner_, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS inner_ FROM cands WHERE m = 3) GROUP BY ALL
), ranks AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score::BIGINT AS score
  FROM best AS b JOIN totals ON totals.lang = b.lang LEFT JOIN within AS w ON w.lang = b.lang AND w.inner_ = b.phrase
  WHERE nth = 1 AND (most IS NULL OR 100 * most < 50 * a)
)
SELECT * FROM ranks WHERE rank <= 2000
"""
