"""Toxicity by class-conditional Kneser-Ney models.

Words, word pairs and word beginnings are counted by class over a bounded, documented sample
of labelled rows. A class's probability of a word after another is the discounted share of
the pair, backing off to that of the word, then to that of words that begin alike, then to
continuation counts (before how many different words it stands) that both classes share. The
discount is Kneser-Ney's for a telling expression, which one class uses RATIO times as often
as the other, in more documents than chance allows. Any other, rare or used by both, is
discounted altogether, so that it is judged by the shared counts and speaks for neither class. The test is a
Chernoff bound on the documents of a class, corrected for the number of expressions.

A document's evidence is the difference of its mean log-likelihoods per word. Rows of
the sample that were kept out of the counts set the threshold, the score's middle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptora.llm.common import apart, as_one, discard, materialise, table, with_rest
from peptora.llm.labelled import fold, sample

MODULUS, HELD = 5, 0
#: Of the folds that may be learnt from, the one that sets the threshold.
TUNING = 1
#: Labelled rows learnt from: at most so many of either class.
PER_CLASS = 10_000
DISCOUNT = 0.75
RISK = 0.001
RATIO = 4.0
#: Minima of a text's five-word hashes; texts of the sample that share one are near copies.
MINIMA = 8
BEGINNINGS = (6, 5, 4)
#: Words whose value a worker remembers.
MEMO = 100_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def unrepeated(rows: DataFrame) -> DataFrame:
    """``rows`` without near copies of a smaller doc_id, which would count as so many witnesses."""

    def minima(text: str) -> list[int]:
        words = words_of(text)
        h = np.array([xxhash.xxh3_64_intdigest(" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))], np.uint64)
        turns = np.arange(1, 2 * MINIMA, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        return [int(x) for x in np.min((h[None, :] ^ h[None, :] >> np.uint64(29)) * turns[:, None], axis=1).view(np.int64)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([minima(t.as_py()) for t in b.column(1)], pa.list_(pa.int64()))], ["doc_id", "minima"])

    marks = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, minima array<long>").select("doc_id", F.posexplode("minima").alias("at", "mark"))
    first = F.min("doc_id").over(Window.partitionBy("at", "mark"))
    copies = marks.withColumn("first", first).where("doc_id > first").select("doc_id").distinct()
    return rows.join(copies, "doc_id", "left_anti")


def counts(rows: DataFrame) -> DataFrame:
    """expression (a word, two words, or a beginning and ``*``), n and documents by class: n0, n1, d0, d1."""

    def expressions(words: list[str]) -> Counter:
        found = Counter(words)
        begun: Counter = Counter()
        for w, n in found.items():
            for k in BEGINNINGS:
                if len(w) > k:
                    begun[w[:k] + "*"] += n
        return found + begun + Counter(map(" ".join, zip(words, words[1:])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, list[int]] = {}
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                for e, n in expressions(words_of(text.as_py())).items():
                    s = sums.setdefault(e, [0, 0, 0, 0])
                    s[label] += n
                    s[2 + label] += 1
            cols = list(zip(*sums.values())) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["expression", "n0", "n1", "d0", "d1"])

    partial = rows.select("text", "label").mapInArrow(run, "expression string, n0 long, n1 long, d0 long, d1 long")
    return partial.groupBy("expression").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")))


class Memo(dict):
    """A word's log-ratio; the first MEMO of them are remembered."""

    def __init__(self, ratio: dict[str, float], plain: float):
        super().__init__()
        self.ratio, self.plain = ratio, plain

    def __missing__(self, word: str) -> float:
        if word in self.ratio:
            x = self.ratio[word]
        else:
            x = next((self.ratio[word[:k] + "*"] for k in BEGINNINGS if len(word) > k and word[:k] + "*" in self.ratio), self.plain)
        if len(self) < MEMO:
            self[word] = x
        return x


class Model:
    """What scoring needs: the log-ratio of each telling expression, and that of all others.

    ``heads`` are the first words of telling pairs, with the log-ratio of what they leave to backing off.
    """

    def __init__(self, ratio: dict[str, float], heads: dict[str, float], plain: float):
        self.ratio, self.heads, self.plain = ratio, heads, plain
        self.threshold, self.scale = 0.0, 1.0
        self.memo: Memo | None = None

    def evidence(self, text: str) -> float:
        """Toxic minus ordinary mean log-likelihood per word; no word: 0."""
        words = words_of(text)
        if not words:
            return 0.0
        if self.memo is None:
            self.memo = Memo(self.ratio, self.plain)
        total = sum(map(self.memo.__getitem__, words))
        if self.heads:
            for k, h in enumerate(words[:-1]):
                if h in self.heads:
                    pair = f"{h} {words[k + 1]}"
                    total += self.ratio[pair] - self.memo[words[k + 1]] if pair in self.ratio else self.heads[h]
        return total / len(words)

    def score(self, text: str) -> float:
        x = max(-500.0, min(500.0, (self.evidence(text) - self.threshold) / self.scale))
        return 1 / (1 + math.exp(-x))


def telling(found: DataFrame, d0: int, d1: int) -> DataFrame:
    """The expressions in which the classes differ; d0 and d1: documents of either class."""
    share = d1 / (d0 + d1)
    both = F.col("d0") + F.col("d1")
    q = F.col("d1") / both
    bent = F.when(q > 0, q * F.log(q / share)).otherwise(0.0) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    times = (F.col("d1") + 0.5) * d0 / ((F.col("d0") + 0.5) * d1)
    return found.where((both * bent > math.log(max(found.count(), 1) / RISK)) & ((times >= RATIO) | (times <= 1 / RATIO)))


def residues(kept: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """Counts of words and beginnings without those of what is more specific, which speaks first.

    A beginning stays only if what is left of it still differs by RATIO.
    """
    out = {e: n for e, n in kept.items() if not e.endswith("*")}
    for e in sorted((e for e in kept if e.endswith("*")), key=len, reverse=True):
        under = [n for x, n in out.items() if x.rstrip("*").startswith(e[:-1]) and len(x) > len(e[:-1])]
        left = tuple(max(kept[e][c] - sum(n[c] for n in under), 0.0) for c in (0, 1))
        if sum(left) >= 5 and max(left) >= RATIO * min(left):
            out[e] = left
    return out


def fit(rows: DataFrame) -> Model:
    """The model from rows of doc_id, text, label. Without both classes nothing tells, and every score is below 0.5."""
    found = materialise(counts(rows), "expressions")
    try:
        return fit_counts(rows, found)
    finally:
        discard(found)


def fit_counts(rows: DataFrame, found: DataFrame) -> Model:
    """As fit, from the counted expressions; everything is collected when it returns."""
    docs = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not docs.get(0) or not docs.get(1):
        return Model({}, {}, 0.0)
    single, pairs = found.where("instr(expression, ' ') = 0 and instr(expression, '*') = 0"), found.where("instr(expression, ' ') > 0")
    size = single.agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    if not size[0] or not size[1]:
        return Model({}, {}, 0.0)
    n, kinds, types = (float(size[0]), float(size[1])), float(size[2]), float(pairs.count())
    after = pairs.groupBy(F.substring_index("expression", " ", -1).alias("expression")).agg(F.count("*").alias("kinds"))
    # What tells is a small part of a bounded sample's expressions.
    kept = telling(found, docs[0], docs[1]).join(after, "expression", "left").select("expression", "n0", "n1", F.coalesce("kinds", F.lit(0)).alias("kinds")).collect()
    seen = {r["expression"]: (float(r["n0"]), float(r["n1"])) for r in kept}
    shared = {r["expression"]: (r["kinds"] + 1) / (types + kinds + 1) for r in kept}
    words = residues({e: x for e, x in seen.items() if " " not in e})
    own = {e: tuple(max(x[c] - DISCOUNT, 0.0) / n[c] for c in (0, 1)) for e, x in words.items()}
    free = [max(1 - sum(p[c] for p in own.values()), 1e-9) for c in (0, 1)]  # goes to the shared counts
    chance = {e: tuple(p[c] + free[c] * shared[e] for c in (0, 1)) for e, p in own.items()}
    ratio = {e: math.log(p[1] / p[0]) for e, p in chance.items()}
    plain = math.log(free[1] / free[0])
    known = Memo(ratio, plain)
    told = [e for e in seen if " " in e and all(known[w] == plain for w in e.split(" "))]
    firsts = sorted({e.split(" ")[0] for e in told})
    heads: dict[str, float] = {}
    if firsts:
        asked = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in firsts], "expression string"))
        of = {r["expression"]: (r["n0"], r["n1"]) for r in single.join(asked, "expression").collect()}
        left = {h: [1.0, 1.0] for h in firsts}
        for e in told:
            h = e.split(" ")[0]
            for c in (0, 1):
                left[h][c] -= max(seen[e][c] - DISCOUNT, 0.0) / max(of[h][c], 1)
        left = {h: [max(x, 1e-9) for x in p] for h, p in left.items()}
        heads = {h: math.log(p[1] / p[0]) for h, p in left.items()}
        for e in told:
            h = e.split(" ")[0]
            p = [max(seen[e][c] - DISCOUNT, 0.0) / max(of[h][c], 1) + left[h][c] * free[c] * shared[e] for c in (0, 1)]
            ratio[e] = math.log(p[1] / p[0])
    return Model(ratio, heads, plain)


def tune(model: Model, x: np.ndarray, label: np.ndarray) -> None:
    """The threshold with the fewest errors, in the middle of its gap, and a scale by what lies above it."""
    order = np.argsort(x, kind="stable")
    x, label = x[order], label[order]
    wrong = np.concatenate([[0], np.cumsum(label == 1)]) + np.concatenate([np.cumsum((label == 0)[::-1])[::-1], [0]])
    gap = np.concatenate([[True], x[1:] > x[:-1], [True]])
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    k = min(np.flatnonzero(gap), key=lambda k: (wrong[k], k))
    model.threshold = float((edges[k] + edges[k + 1]) / 2)
    above = x[x > model.threshold]
    model.scale = max(1e-4, float(np.median(above) - model.threshold) / 4 if len(above) else 1e-4)


def train(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> Model:
    every = materialise(sample(docs, labels, label, MODULUS, HELD, per_class, by_class=True), "labelled")
    rows = materialise(unrepeated(every), "labelled")
    discard(every)
    tuning = fold(MODULUS) == TUNING
    model = fit(rows.where(~tuning))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t.as_py()) for t in b.column(0)], pa.float64()), b.column(1)], ["x", "label"])

    got = rows.where(tuning).select("text", "label").mapInArrow(run, "x double, label int").toPandas()
    if got.label.nunique() == 2:
        tune(model, got.x.to_numpy(), got.label.to_numpy())
    else:
        model.threshold = max(model.plain, 0.0) + 1e-4
    discard(rows)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` and held_out, score, predicted; columns of those names are replaced.

    Null and empty texts have no evidence for either class. A null doc_id is not held out.
    Labels of one class only, or none: every text is predicted 0. An empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t.as_py()) for t in b.column(1)], pa.float64())], ["rest", "score"])

    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    packed = docs.select(as_one(names), F.coalesce("text", F.lit("")).alias("text"))
    scored = packed.mapInArrow(run, with_rest(packed, "score double")).select(*apart(names), "score")
    held = F.coalesce(fold(MODULUS) == HELD, F.lit(False))
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
