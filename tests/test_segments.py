"""Trimmed segments of many sequences at once against the search along one sequence."""

import random
import time

from peptora.operators import kernels

ALL = "ACDEFGHIKLMNPQRSTVWY"


def test_segments_of_many_sequences_equal_each_alone(monkeypatch):
    rng = random.Random(3)
    seqs = ["A" * 300, "A" * 12, "A" * 11, "A", "X" * 30, "AX" * 40, "QN" * 60 + ALL * 5 + "S" * 40]
    seqs += ["".join(rng.choice(rng.choice(["AG", "QNS", ALL, ALL + "X"])) * rng.choice([1, 1, 2, 5]) for _ in range(rng.choice([10, 60, 150]))) for _ in range(30)]
    want = [[list(x) for x in kernels.merged_segments(s)] for s in seqs]
    assert sum(map(len, want)) > 50
    assert kernels.merged_segments_of(seqs) == want
    assert [kernels.merged_segments_of([s])[0] for s in seqs] == want
    assert kernels.merged_segments_of([]) == []
    # Stretches over WALK are trimmed one by one.
    monkeypatch.setattr(kernels, "WALK", 20)
    assert kernels.merged_segments_of(seqs) == want


def test_texts_take_microseconds_a_letter():
    """Failed by time: some 60 microseconds a letter when each stretch was trimmed by itself."""
    rng = random.Random(4)
    words = ["".join(rng.choice("ETAOINSHRDLCMFGYPWK") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    seqs = ["".join(rng.choices(words, k=400)).replace("O", "") for _ in range(100)]
    seqs = ["".join(c for c in s if c in ALL) for s in seqs]
    began = time.process_time()
    assert sum(map(len, kernels.merged_segments_of(seqs))) > 100
    assert (time.process_time() - began) / sum(map(len, seqs)) < 2e-5
