import random

import numpy as np
import pytest

from peptora.llm import lzprint


def phrases(text: str) -> set[str]:
    """The parse by its definition."""
    found, now = set(), ""
    for c in text:
        now += c
        if now not in found:
            found.add(now)
            now = ""
    return found


def plain_fingerprint(text: str) -> np.ndarray:
    """Every phrase hashed alone by whole-number arithmetic, and each function's minimum sought over all of them."""
    low = [(1 << 32) - 1] * lzprint.HASHES
    a, b = lzprint.multipliers()
    for p in phrases(text):
        total = 0
        for k, c in enumerate(p):
            x = ord(c) * 0xD6E8FEB86659FD93 % (1 << 64)
            total += (x ^ x >> 32) * pow(lzprint.Spans.BASE, k, 1 << 64)
        h = int(lzprint.mixed(np.array([total % (1 << 64)], np.uint64))[0])
        low = [min(x, (h * int(i) + int(j)) % (1 << 32)) for x, i, j in zip(low, a[:, 0], b[:, 0])]
    return np.array([x & 0xFFFF for x in low])


TEXTS = ["", "a", "aaaaaaaaaaaaaaaa", "abab" * 40, "Grüße, 世界! \U0001f600\U0001f600 " * 9, "the cat sat on the mat and the dog sat on the log " * 3, "\0\0\x01\n\t" * 5]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("donor", ["", "zz", "the cat ate the dog " * 20])
def test_pairs_against_the_plain_parse(text, donor):
    own, other, edited = lzprint.fingerprint_pair(text, donor)
    n = len(text)
    assert edited == text[: n - n // 2] + donor[: n // 2]
    assert (own == plain_fingerprint(text)).all() and (other == plain_fingerprint(edited)).all()
    assert (own == lzprint.fingerprint(text)).all()


def test_phrases_of_a_fed_parse():
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(5000))
    parse, ends = lzprint.Parse(), []
    for at in range(0, len(text), 700):
        ends += parse.feed([ord(c) for c in text[at : at + 700]])
    assert {text[s:e] for s, e in zip([0, *ends], ends)} == phrases(text)


def test_likeness_of_long_texts_is_the_share_of_phrases():
    """1 MB: 128 minima are within 0.15 (over three deviations) of the Jaccard index of the phrase sets."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = lambda: " ".join(rng.choice(words) for _ in range(160_000))
    a, b = long(), long()
    assert len(a) > 1_000_000
    found = [(phrases(t), lzprint.fingerprint(t)) for t in (a, b, a[: len(a) // 2] + b[: len(a) // 2])]
    for x, y in ((0, 1), (0, 2)):
        true = len(found[x][0] & found[y][0]) / len(found[x][0] | found[y][0])
        assert abs(lzprint.likeness(found[x][1], found[y][1]) - true) < 0.15
