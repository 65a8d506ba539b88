import random
from itertools import combinations

import pytest

import corpus_pipeline
from peptora.llm import resemblance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    """Rows kept: union-find over all pairs, least (doc_id, null last) of each component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i, j in combinations(range(len(rows)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            root[find(j)] = find(i)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k])
    return groups.values()


@pytest.fixture(scope="module")
def rows():
    """Texts with copies in which words are replaced, from far above to far below the bound, and chains of edits."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = [None, "", " \n", "one two", "One  two", "one three"]
    for n in (40, 120, 400):
        for edits in (1, 2, 3, 4, 6, 8):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(3):
                for k in rng.sample(range(n), max(1, edits * n // 300)):
                    base[k] = word()
                out.append(" ".join(base))
    return list(enumerate(out))


@pytest.mark.parametrize("group", [resemblance.GROUP, 4])
def test_stage_keeps_one_of_texts_with_jaccard_of_0_8(spark, rows, group):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    want = {min(i for i, _ in g) for g in brute(rows)}
    assert {r["doc_id"] for r in resemblance.one_of_each(docs, group).collect()} == want
    if group > 4:
        assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()} == want
    assert corpus_pipeline.keep_one_of_each(spark, docs.limit(0), "").count() == 0


def test_candidates_at_the_bound():
    """Pairs with an index just above 0.8 share a key; the expected miss is 2e-6 a pair."""
    rng = random.Random(4)
    for _ in range(400):
        both = rng.sample(range(1 << 60), 180)
        a, b = (resemblance.np.array(sorted(x), resemblance.np.uint64) for x in (both[:162], both[:144] + both[162:]))
        assert resemblance.alike(a, b) and (resemblance.bands(a) == resemblance.bands(b)).any()


def test_rows_with_null_and_repeated_ids(spark):
    """A null doc_id takes part; a repeated doc_id with unlinked texts keeps a row of each, equal rows one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, c), (None, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (1, "b"), (None, "c")], key=str)
