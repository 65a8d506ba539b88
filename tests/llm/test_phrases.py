import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peptora.llm import phrases

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, a struct<`a b`: int>"


def plain(rows, longest=3, least=10, share=50, top=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    found = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    out = {}
    for (lang, w), a in found.items():
        if any(100 * f >= share * a for (g, v), f in found.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        score, _, l, r = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, got in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(got)[:top], 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = ["the", "of", "New", "York", "é", "日本", "a\x0bb", "x-y", " ", "<|end|>"] + [f"w{k}" for k in range(30)]
    def text(n):
        return "".join(rng.choice(vocabulary[: rng.choice([4, 12, 40])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(n))

    out = [(text(rng.choice([1, 20, 60])), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(300)]
    out += [(None, "en"), ("", "en"), (" .,\t", None), ("a a a a " * 50, "fr"), (text(6000), "en"), ("new york city. " * 12, "es"), ("w" * 30_000, "en")]
    return out + out[:20]


@pytest.mark.parametrize(("shard", "most", "top", "longest"), [(1 << 19, 1 << 24, 2000, 3), (50, 300, 7, 3), (1 << 19, 4000, 2000, 2)])
def test_collocations_equal_plain_counts(spark, rows, shard, most, top, longest):
    docs = spark.createDataFrame([(i, t, g, 0, "", (1,)) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.collocations(docs, longest, top=top, shard=shard, most=most)
    want = plain(rows, longest, top=top)
    assert len(want) > 30
    assert sorted(map(tuple, got.collect())) == want


def test_colliding_keys_only_add_candidates(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases.Words, "keys", lambda self, lang: np.full(len(self.dictionary), 5, np.uint64))
    words = phrases.Words([b"a b c. a b"])
    assert len(words.keys("en")) == 3
    texts = phrases.texts_of(spark.createDataFrame([(1, "a b. c d. " * 6, "en", 0, "", (1,))], SCHEMA))
    every = np.full(1 << phrases.MAP_BITS - 6, ~np.uint64(0))
    assert {r["f"] for r in phrases.pair_keys(texts, every, 10).collect()} <= {12, 6}


def test_trie_finds_its_entries_and_nothing_else():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    entries = sorted({(rng.choice(["de", "en"]), rng.choice(words[:200]), rng.choice(words), rng.choice([None, *words[:50]])) for _ in range(4000)}, key=str)
    trie, langs, alphabet = phrases.trie_of(pa.table({c: pa.array([e[k] for e in entries], pa.string()) for k, c in enumerate(["lang", "a", "b", "c"])}))
    text = [w for e in rng.sample(entries, 500) for w in e[1:] if w] + [rng.choice(words) for _ in range(3000)]
    got = phrases.trie_counts(trie, langs, alphabet, "en", phrases.Words([" ".join(text).encode()]))
    seen = Counter(tuple(text[i : i + m]) for m in (2, 3) for i in range(len(text) - m + 1))
    assert got.tolist() == [seen[tuple(w for w in e[1:] if w)] if e[0] == "en" else 0 for e in entries]
    assert trie.nodes < len(trie.base)


def test_scores_pass_64_bits_exactly(spark):
    a, l, r = 3 * 10**12 + 7, 10**13 + 3, 5 * 10**12 + 11
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases.cut_score(*map(F.col, "alr"))).first()[0]
    assert got == 1_000_000 * a * a // (l * r)


def test_empty_and_wordless_tables(spark):
    assert not phrases.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert not phrases.collocations(spark.createDataFrame([(1, " . ", "en", 0, "", (1,)), (2, None, None, 0, "", None)], SCHEMA)).collect()
