import math
import random

import numpy as np
import proteins
import pytest
from pyspark.sql import functions as F

from peptora.functions import sequence as S
from peptora.functions.tables import HYDROPATHY10, prion_ratio
from peptora.operators import checks, kernels, states
from peptora.operators import residues as R
from peptora.operators.charge import charge_decoration


def table(spark, rows, schema="acc string, seq string"):
    return spark.createDataFrame(rows, schema)


PROTEINS = [("A", "MKKLLPPTAILQQNNSDE" * 7), ("B", "GGGGGGGGGGGGGGSSSSSSSSSSSSSSAAAAAAAAAAAAAA" * 3), ("C", "ACDE"), ("D", "QNQNQNQNQNQNQNQNQNQN" * 4)]


def test_native_values(spark):
    got = table(spark, [("1", "ACDE"), ("2", "KUDER"), ("3", "")]).select("acc", S.charged_fraction(F.col("seq")).alias("fcr"), S.hydropathy(F.col("seq")).alias("h"), S.unsupported(F.col("seq")).alias("u")).orderBy("acc").collect()
    assert got[0]["fcr"] == 0.5 and got[0]["h"] == pytest.approx(0.425)
    assert got[1]["fcr"] == 0.8 and got[1]["h"] is None and got[1]["u"] == ["U"]
    assert got[2]["fcr"] is None and got[2]["h"] is None


def test_thresholds_and_spans(spark):
    got = table(spark, [("a", [0.1, 0.8199]), ("b", [0.82]), ("c", [0.8201, 0.0])], "acc string, x array<double>").select(S.binary_coil(F.col("x"), 0.82).alias("v")).collect()
    assert [r["v"] for r in got] == [0.0, 1.0, 1.0]
    row = spark.range(1).select(S.profile_span(F.lit(1270)).alias("a"), S.profile_span(F.lit(10)).alias("b"), S.suffix_span(F.lit(1270), F.lit(1267)).alias("c"), S.suffix_span(F.lit(10), F.lit(11)).alias("d")).first()
    assert (row["a"][0], row["a"][-1], len(row["a"])) == (24, 1243, 1220) and row["b"] == []
    assert (row["c"][0], row["c"][-1]) == (3, 1269) and row["d"] == []


def test_strength(spark):
    got = table(spark, [("a", -1.0), ("a", 0.0), ("a", 0.5), ("a", 1.5), ("b", -1.0), ("b", 0.0)], "acc string, v double").groupBy("acc").agg(R.strength(F.col("v")).alias("s")).orderBy("acc").collect()
    assert [r["s"] for r in got] == [1.0, 0.0]


def test_window_path_and_kernel_agree(spark):
    df = table(spark, PROTEINS)
    features = {r["acc"]: np.array(r["features"]) for r in kernels.feature_map(df).collect()}
    wide = {r["acc"]: r for r in R.window_summaries(R.residues(df), (7,)).collect()}
    for acc, _ in PROTEINS:
        assert len(features[acc]) == 181
        assert features[acc][30:36] == pytest.approx([wide[acc][f"{n}7_mean"] for n in ("rc", "rn", "dc", "dn", "pfg", "prg")])


def plain_entropy(w):
    w = [c for c in w if c in "ACDEFGHIKLMNPQRSTVWY"]
    return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) if w else 0.0


def test_entropies_and_low_complexity_by_definition(spark, monkeypatch):
    """Window by window, over block borders, with letters that don't count and a text under the window."""
    rng = np.random.default_rng(4)
    every = [*PROTEINS, ("X", "XXXXXXXXXXXXXXXXAXX"), ("S", "ACD"), ("E", ""), ("N", None), ("R", "".join(rng.choice(list("ACDXY"), 300))), ("L", "A" * 20 + "ACDEFGHIKLMNPQRSTVWY" * 3 + "QQNQQQNQQQQNQ" + "ACDEFGHIKLMNPQRSTVWY")]
    monkeypatch.setattr(kernels, "STRETCH", 50)
    summary = {r["acc"]: r for r in kernels.entropy_summary(table(spark, every)).collect()}
    spans = {}
    for r in kernels.low_complexity(table(spark, every)).collect():
        spans.setdefault(r["acc"], set()).add((r["first"], r["last"]))
    for acc, seq in every:
        want = [plain_entropy(seq[k : k + 12]) for k in range(len(seq or "") - 11)]
        if seq:
            assert kernels.entropies(kernels.codes(seq)) == pytest.approx(want, abs=1e-9)
            assert summary[acc]["size"] == len(want) and (not want or summary[acc]["low"] == pytest.approx(min(want), abs=1e-9))
        covered, k = set(), 0
        while k < len(want):
            e = k
            while e < len(want) and want[e] <= 2.5 + 1e-9:
                e += 1
            if e > k and min(want[k:e]) <= 2.2 + 1e-9:
                covered |= set(range(k, e + 11))
            k = max(e, k + 1)
        assert {x for s, e in spans.get(acc, ()) for x in range(s, e)} == covered


def test_feature_quantiles_are_linear():
    seq = dict(PROTEINS)["A"] * 3
    x = kernels.codes(seq)
    scale = np.array([kernels.SCALES100[a][0] for a in kernels.RESIDUES]) / 100
    m = np.array([scale[x[max(0, k - 7) : k + 8]].mean() for k in range(len(x))])
    got = kernels.features_of(seq)[30:60].reshape(5, 6)[:, 0]
    assert got == pytest.approx([m.mean(), *np.quantile(m, [0.25, 0.5, 0.75]), m.std()])


def test_one_sequence_an_accession(spark):
    with pytest.raises(Exception, match="several sequences of accession A"):
        R.residue_scores(R.residues(table(spark, [("A", "ACDE" * 9), ("A", "ACDE" * 9)]))).collect()
    with pytest.raises(Exception, match="no accession"):
        R.residue_scores(R.residues(table(spark, [(None, "ACDE")]))).collect()
    # A score is a row's own, so nothing is asked of other rows.
    assert R.protein_scores(table(spark, [("A", "ACDE" * 9), ("A", "ACDE" * 9), (None, "ACDE")])).count() == 3


def test_chunks_of_a_sequence_give_what_it_gives_whole(spark):
    """Chunks of 150 residues with halos: windows, runs, cores and stretches over their borders are as in the whole sequence."""
    rng = random.Random(12)
    seqs = [(f"P{n}", "".join(rng.choice(rng.choice(["DEKR", "AILV", "ACDEFGHIKLMNPQRSTVWYX"])) for _ in range(n))) for n in (1, 149, 150, 151, 300, 1000)] + [("long", "DDDDDDDK" * 200), ("é", "É" + "KD" * 300)]
    df = table(spark, seqs)
    charge = R.valued({"K": 1, "R": 1, "D": -1, "E": -1})
    what = {
        "score": lambda t: R.own(R.residue_scores(t)).select("acc", "pos", "score"),
        "profile": R.profile,
        "fold": lambda t: R.own(R.fold_index(t)).select("acc", "pos", "fi"),
        "best": lambda t: R.best_window(t, charge, 60, shorter=True),
        "stretch": lambda t: R.best_subarray(t, charge),
        "runs": lambda t: R.runs(t, F.col("aa").isin("D", "E", "K", "R")),
        "disordered": R.disordered_runs,
        "core": lambda t: R.core_domains(R.fold_index(t), F.col("fi") < 0, -R.valued(HYDROPATHY10), 20),
        "peak": R.prion_propensity_peak,
        "near": lambda t: R.top_neighbourhood(R.residue_scores(t), "score"),
        "spread": lambda t: R.own(R.spread_average(R.residue_scores(t), "score")).select("acc", "pos", "avg_20", "avg_60"),
        "grams": lambda t: R.letter_counts(t, 3),
        "exposure": R.exposure,
    }
    close = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    for name, f in what.items():
        whole, parts = (sorted((close(r) for r in f(R.residues(df, chunk=c)).collect()), key=str) for c in (None, 150))
        assert parts == whole and whole, name


def test_best_windows(spark):
    got = {r["acc"]: r for r in R.best_window(R.residues(table(spark, PROTEINS)), F.col("aa").isin("N", "Q").cast("long"), 8, shorter=False).collect()}
    for acc, seq in PROTEINS:
        sums = [sum(c in "NQ" for c in seq[k : k + 8]) for k in range(len(seq) - 7)]
        assert (got[acc]["best"], got[acc]["first"] if sums else None) == (max(sums, default=None), sums.index(max(sums)) if sums else None)


def test_charge_decoration(spark):
    got = {r["acc"]: r["scd"] for r in charge_decoration(table(spark, [*PROTEINS, ("E", ""), ("F", None)])).collect()}
    for acc, seq in PROTEINS:
        q = [(c in "KR") - (c in "DE") for c in seq]
        want = sum(q[i] * q[j] * math.sqrt(j - i) for i in range(len(q)) for j in range(i + 1, len(q))) / len(q)
        assert got[acc] == pytest.approx(want, abs=1e-9)
    assert got["E"] is None and got["F"] is None


def test_hidden_states_by_enumeration(spark):
    seq = "QNQNMK"
    path, score, best, posterior, _, _ = kernels.decode_states(seq)
    e = np.exp(kernels.emissions()[:, kernels.codes(seq)])
    move, start = np.array([[0.999, 0.001], [0.02, 0.98]]), [0.9524, 0.0476]
    total, top, inside = 0.0, (0.0, None), np.zeros(len(seq))
    for k in range(2 ** len(seq)):
        states = [k >> j & 1 for j in range(len(seq))]
        p = start[states[0]] * e[states[0], 0]
        for j in range(1, len(seq)):
            p *= move[states[j - 1], states[j]] * e[states[j], j]
        total += p
        top = max(top, (p, states))
        inside += p * np.array(states)
    none = e[0].prod()
    assert score == pytest.approx(math.log(total / none)) and best == pytest.approx(math.log(top[0] / none)) and path == top[1]
    assert posterior == pytest.approx(inside / total)


@pytest.mark.parametrize("places", [1, 300, 1 << 21])
def test_hidden_states_in_step_are_those_alone(monkeypatch, places):
    rng = np.random.default_rng(7)
    seqs = ["".join(rng.choice(list("QNSGYAVLKX"), n)) + "QNQNQN" * (n % 5) for n in rng.integers(1, 60, 70)]
    monkeypatch.setattr(kernels, "PLACES", places)
    monkeypatch.setattr(kernels, "TOGETHER", 2)
    for seq, got in zip(seqs, kernels.decode_all(seqs), strict=True):
        want = kernels.decode_states(seq)
        assert got[0] == want[0] and got[4] == want[4]
        for k in (1, 2, 3, 5):
            assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("chunk", [1, 7, 50, 1 << 16])
def test_hidden_states_by_chunks_are_those_of_the_whole(spark, chunk):
    """Repeated and null accessions, one letter, chunks that end with the sequence or one letter after, and characters of several bytes."""
    rng = np.random.default_rng(11)
    seqs = ["".join(rng.choice(list("QNSGYAVLKX"), n)) + "QNQNQN" * (n % 4) for n in (1, 2, 7, 8, 9, 50, 51, 52, 150)] + ["Q", "éQNQNQNQNQNQNQNQNé" * 4, "LVKLQ" * 30]
    rows = [(f"P{k}", s) for k, s in enumerate(seqs)] + [("P3", seqs[4]), (None, seqs[5]), ("E", ""), ("N", None)]
    df = spark.createDataFrame(rows, "acc string, seq string").repartition(3)
    plain = {(a, s): kernels.decode_states(s) for a, s in rows if s}
    parts = {}
    of = dict(rows[: len(seqs)])
    once = spark.createDataFrame([*of.items(), ("E", ""), ("N", None)], "acc string, seq string").repartition(3)
    for r in sorted(states.hidden_state_parts(once, chunk).collect(), key=lambda r: r["start"]):
        path, posterior = parts.setdefault(r["acc"], ([], []))
        assert r["start"] == len(path)
        path += r["path"]
        posterior += r["posterior"]
    assert set(parts) == set(of)
    for acc, (path, posterior) in parts.items():
        want = plain[acc, of[acc]]
        assert path == want[0] and posterior == pytest.approx(want[3], abs=1e-9)
    key = lambda r: tuple((x is None, x or 0) for x in r[1:])
    got = sorted(map(tuple, states.hidden_state_summary(df, chunk).collect()), key=lambda r: (str(r[0]), key(r)))
    want = sorted(((a, *((plain[a, s][k] for k in (1, 2, 4, 5)) if s else (None,) * 4)) for a, s in rows), key=lambda r: (str(r[0]), key(r)))
    assert [(r[0], r[3]) for r in got] == [(r[0], r[3]) for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g[1] is None and w[1] is None) or [g[1], g[2], g[4]] == pytest.approx([w[1], w[2], w[4]], abs=1e-9)


def test_hidden_states_without_rows(spark):
    none = spark.createDataFrame([], "acc string, seq string")
    assert states.hidden_state_summary(none).count() == 0 and states.hidden_state_parts(none).count() == 0


def test_spread_average_fills_from_the_nearest(spark):
    df = R.residues(table(spark, [("A", "AILV" * 6)])).withColumn("v", R.valued(HYDROPATHY10).cast("double"))
    rows = R.spread_average(df, "v", (20,)).orderBy("pos").collect()
    assert rows[0]["avg_20"] == rows[10]["avg_20"] and rows[-1]["avg_20"] == rows[14]["avg_20"]


def test_peak_needs_a_disordered_stretch(spark):
    got = {r["acc"]: r for r in R.prion_propensity_peak(R.residues(table(spark, PROTEINS))).collect()}
    assert got["C"]["papa"] is None and got["D"]["papa"] is not None


def test_peak_by_hand(spark):
    """All prolines but the first of each three are out; a run of one residue has its own propensity, here D's and S's."""
    odds = {"D": 0.27887323, "S": 1.1432927}
    got = {r["acc"]: r for r in R.prion_propensity_peak(R.residues(table(spark, [("D", "D" * 90), ("DS", "DS" * 45)]))).collect()}
    assert got["D"]["papa"] == pytest.approx(math.log(odds["D"])) and got["D"]["at"] == 20
    # 41 residues hold 21 of one kind and 20 of the other; smoothed again they swap in turn.
    one, two = ((k * math.log(odds["D"]) + (41 - k) * math.log(odds["S"])) / 41 for k in (20, 21))
    assert min(one, two) < got["DS"]["papa"] < max(one, two)


def test_mean_of_window_means_by_definition(spark):
    """Every length about the ends' width, unknown letters among them, against the windows themselves."""
    scale = {a: 3 * k - 20 for k, a in enumerate("ACDEFGHIKLMNPQRSTVWY")}
    rng = random.Random(8)
    for radius in (1, 3):
        rows = [(f"P{n}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYXUZ") for _ in range(n))) for n in (*range(1, 32), 500)]
        got = {r["acc"]: r["m"] for r in table(spark, [*rows, ("none", ""), ("null", None)]).select("acc", S.mean_of_window_means(F.col("seq"), scale, radius).alias("m")).collect()}
        assert got.pop("none") is None and got.pop("null") is None
        for acc, seq in rows:
            windows = [seq[max(0, k - radius) : k + radius + 1] for k in range(len(seq))]
            assert got[acc] == pytest.approx(sum(sum(scale.get(a, 0) for a in w) / len(w) for w in windows) / len(windows), abs=1e-12)


def test_score_needs_no_shuffle(spark):
    plan = R.protein_scores(table(spark, PROTEINS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_errors_stand_beside_scores(spark):
    got = {r["acc"]: r for r in R.batch_scores(table(spark, [("A", "ACDEFG" * 5), ("B", ""), ("C", "AXA"), ("D", None)])).collect()}
    assert got["A"]["score"] is not None and got["A"]["error"] is None
    twice = R.batch_scores(table(spark, [("A", "ACDEFG" * 5), ("A", "KKKEEE" * 5), ("A", "ACDEFG" * 5), (None, "ACDEFG" * 5)])).collect()
    assert [r["score"] == pytest.approx(got["A"]["score"]) for r in sorted(twice, key=lambda r: r["seq"])] == [True, True, True, False]
    assert [got[k]["error"] for k in "BCD"] == ["empty sequence", "unsupported residues", "empty sequence"] and got["C"]["score"] is None


def test_checks_reject(spark):
    df = table(spark, PROTEINS)
    with pytest.raises(ValueError, match="missing columns: x"):
        checks.require_columns(df, ["acc", "x"])
    with pytest.raises(ValueError, match="unknown features"):
        checks.select_features(df, ["nothing"])
    assert checks.with_model_columns(df, ["acc", "IDR"]).columns == ["acc", "seq", "IDR"]
    assert checks.select_features(df, "all").columns[0] == "acc"


def test_published_values(spark):
    df = table(spark, [(acc, seq) for acc, (seq, _) in proteins.PROTEINS.items()]).cache()
    native = {r["acc"]: r for r in df.select("acc", S.charged_fraction(F.col("seq")).alias("fcr"), S.hydropathy(F.col("seq")).alias("h")).collect()}
    prion = {r["acc"]: r["best"] for r in R.best_window(R.residues(df), R.valued(prion_ratio()), 60, shorter=False).collect()}
    trimmed = {r["acc"]: r["share"] for r in kernels.exact_low_complexity(df).collect()}
    for acc, (_, (hydropathy, fcr, low, nllr)) in proteins.PROTEINS.items():
        assert native[acc]["h"] == (None if hydropathy is None else pytest.approx(hydropathy, abs=1e-12))
        assert native[acc]["fcr"] == pytest.approx(fcr, abs=1e-12)
        assert trimmed[acc] == pytest.approx(low, abs=1e-12)
        assert prion[acc] is None if nllr is None else prion[acc] / 60 == pytest.approx(nllr, abs=6e-4)
    scores = {route: {r["acc"]: r["score"] for r in R.protein_scores(df, route).collect()} for route in ("legacy", "paper")}
    assert scores["legacy"]["Q08211"] == pytest.approx(proteins.GRANULE["legacy"], abs=1e-9)
    assert scores["paper"]["Q08211"] == pytest.approx(proteins.GRANULE["paper"], abs=1e-5)
