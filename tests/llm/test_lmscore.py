import math
import random
import re
from collections import Counter

import pytest

from peptora.llm import lmscore


def plain(rows, good):
    """Counts over all rows in dictionaries, less the row's own; the formula word by word."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() for _, t in rows]
    pair, before = {"b": Counter(), "t": Counter()}, {"b": Counter(), "t": Counter()}
    for (i, _), ws in zip(rows, words):
        for c in "bt" if i is not None and i in good else "b":
            pair[c].update(zip([None, *ws], ws))
            before[c].update([None, *ws][: len(ws)])
    size = len({w for ws in words for w in ws}) + 1
    out = []
    for (i, _), ws in zip(rows, words):
        own_pair, own_before = Counter(zip([None, *ws], ws)), Counter([None, *ws][: len(ws)])
        inside = {"b": 1, "t": i is not None and i in good}
        loss = {c: -sum(math.log((pair[c][p] - inside[c] * own_pair[p] + lmscore.ADD) / (before[c][p[0]] - inside[c] * own_before[p[0]] + lmscore.ADD * size)) for p in zip([None, *ws], ws)) / max(len(ws), 1) for c in "bt"}
        out.append((-1 if i is None else i, len(ws), loss["t"], loss["b"], loss["t"] - loss["b"]))
    return sorted(out)


def scored(spark, rows, good, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lmscore.score_documents(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), **more).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)


def alike(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("hot, passes", [(lmscore.HOT, 1), (100, 2), (0, 3)])
def test_every_word_and_pair_counts(spark, hot, passes):
    """Many kinds of words and pairs; repeated texts, rows and ids, a null id, and empty and null texts among them."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(60_000) if rng.random() < 0.6 else int(rng.paretovariate(0.5)) % 60_000}" for _ in range(900)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, texts[4]), (500, ""), (501, None), (502, texts[6]), (503, "Ünïcode A a A"), (504, "one")]
    good = {*range(0, 120, 3), 503, 999}
    alike(scored(spark, rows, [*good, 0, None], hot=hot, passes=passes), plain(rows, good))


def test_equal_words_and_ties(spark):
    """25,000 words of one frequency: none is left out, and the target is told apart."""
    words = [f"w{k}" for k in range(25_000)]
    rows = [(k, " ".join(words[k * 2500 : (k + 1) * 2500])) for k in range(10)]
    got = scored(spark, rows, [0, 1], hot=50)
    alike(got, plain(rows, {0, 1}))


def test_being_in_the_target_leaves_the_own_score(spark):
    """A document scores by the other documents, in the target or not; one of the target's kind scores lower than others."""
    rng = random.Random(4)
    kinds = [[f"{c}{k}" for k in range(8)] for c in "gb"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(200))) for i in range(40)]
    good = set(range(0, 20, 2))
    got, more = (scored(spark, rows, g) for g in (good, {*good, 30}))
    assert got[30] == pytest.approx(more[30], abs=1e-12)
    inside, like, unlike = ([r[4] for r in got if k(r[0])] for k in (lambda i: i in good, lambda i: i % 2 == 0 and i not in good, lambda i: i % 2))
    assert max(inside + like) < min(unlike)
    assert sum(inside) / len(inside) == pytest.approx(sum(like) / len(like), abs=0.2)


def test_no_target_and_no_rows(spark):
    alike(scored(spark, [(1, "a b a"), (2, "")], []), plain([(1, "a b a"), (2, "")], set()))
    assert lmscore.score_documents(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_probabilities_sum_to_one():
    size, n = 7, Counter({"a": 3, "b": 1})
    every = [(n[w] + lmscore.ADD) / (n.total() + lmscore.ADD * (size + 1)) for w in ["a", "b", *range(size - 2), "unknown"]]
    assert sum(every) == pytest.approx(1)
