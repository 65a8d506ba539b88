"""Summaries of windows over whole sequences, taken in Arrow batches: the same as those of the residue table.

A row for each residue costs some hundred times the residue. Where only a summary of a sequence is wanted, Spark deals out
sequences, and the functions below lay those of a batch end to end and slide over all of them at once. Sums are whole
numbers, so they are exact and come out the same in any batch: published values that aren't whole are counted in units of 2^-BITS.

Sequences of more than LONG letters don't come here but go by the residue table, whose chunks are dealt out (``residues``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peptora.functions.tables import FOLD_C, FOLD_H, FOLD_R, FOLD_WINDOW, HYDROPATHY10, granule10000
from peptora.operators.kernels import bound_batches

#: Letters that a sequence may have here, and letters (few: what fits a CPU's cache) and sequences that are laid end to end.
LONG, TOGETHER, ROWS = 1 << 20, 15_000, 1 << 11
#: Parts of a unit that values are counted in; sums may pass 64 bits, but not differences of two that are a window apart.
BITS = 50
#: Window means of the granule score over up to seven residues are whole numbers of these parts.
SCORE_UNIT = 420 * 10000
CHARGE = {"D": -1, "E": -1, "K": 1, "R": 1}

KINDS = {"long": pa.int64(), "double": pa.float64()}


class Laid:
    """Sequences end to end. Of each letter: its place ``pos``, its sequence's number ``row`` and length ``n``, and where that begins and ends."""

    def __init__(self, seqs: list[str]):
        self.x = np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)
        self.size = np.array(list(map(len, seqs)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(len(seqs)), self.size)
        self.at = np.arange(len(self.x))
        self.low = self.start[self.row]
        self.n = self.size[self.row]
        self.high = self.low + self.n
        self.pos = self.at - self.low
        self.bounds: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def values(self, scale: Mapping[str, int]) -> np.ndarray:
        """Whole values of the letters; those without one count 0."""
        table = np.zeros(256, np.int64)
        for a, v in scale.items():
            table[ord(a)] = v
        return table[self.x]

    def any_of(self, letters: str) -> np.ndarray:
        return self.values(dict.fromkeys(letters, 1)) == 1

    def window(self, before: int, behind: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last (excluded) letter of the windows, cut at the sequences' ends."""
        if (before, behind) not in self.bounds:
            self.bounds[before, behind] = np.maximum(self.at - before, self.low), np.minimum(self.at + behind + 1, self.high)
        return self.bounds[before, behind]

    def sums(self, v: np.ndarray, before: int, behind: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(v, dtype=np.int64)])
        first, last = self.window(before, behind)
        return upto[last] - upto[first]

    def width(self, radius: int) -> np.ndarray:
        first, last = self.window(radius, radius)
        return last - first

    def most(self, v: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sequence the greatest value at the places ``where``, the earliest place that has it, and whether there is any."""
        held = np.where(where, v, np.iinfo(np.int64).min if v.dtype.kind == "i" else -np.inf)
        best = np.maximum.reduceat(held, self.start)
        first = np.minimum.reduceat(np.where(where & (held == best[self.row]), self.pos, np.iinfo(np.int64).max), self.start)
        return best, first, np.logical_or.reduceat(where, self.start)

    def total(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.start)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (excluded) letter, counted over all sequences, of the stretches where ``inside`` holds."""
        before = np.concatenate([[False], inside[:-1]]) & (self.pos > 0)
        behind = np.concatenate([inside[1:], [False]]) & (self.pos < self.n - 1)
        return self.at[inside & ~before], self.at[inside & ~behind] + 1

    def scores(self) -> np.ndarray:
        """``residue_scores`` in parts of SCORE_UNIT."""
        return self.sums(self.values(granule10000()), 3, 3) * 420 // self.width(3)

    def fold_index(self) -> np.ndarray:
        r = FOLD_WINDOW // 2
        w = self.width(r)
        return FOLD_H * (self.sums(self.values(HYDROPATHY10), r, r) / w / 90.0 + 0.5) + FOLD_R * np.abs(self.sums(self.values(CHARGE), r, r) / w) + FOLD_C


def units(scale: Mapping[str, float]) -> dict[str, int]:
    return {a: round(v * 2**BITS) for a, v in scale.items()}


def nulled(v: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(v, mask=~there)


def groups(seqs: list[str | None], most: int, together: int) -> Iterator[list[int]]:
    """The numbers of the sequences that are laid end to end; null, empty and longer ones are in none."""
    held, letters = [], 0
    for k, s in enumerate(seqs):
        if not s or len(s) > most:
            continue
        if held and (letters + len(s) > together or len(held) == ROWS):
            yield held
            held, letters = [], 0
        held.append(k)
        letters += len(s)
    if held:
        yield held


def summaries(sequences: DataFrame, schema: str, of: Callable[[Laid], list], longer: Callable[[DataFrame], DataFrame], long: int | None = None, together: int | None = None) -> DataFrame:
    """acc and the columns of ``schema`` that ``of`` gives for sequences laid end to end, a value each; of longer sequences, what ``longer`` gives.

    An accession names one sequence, as in the residue table: repeated and null ones fail. Null and empty sequences have no row.
    If ``sequences`` has a column _most that bounds their length, only those above are measured for being longer.
    """
    from peptora.operators.residues import residues

    long, together = LONG if long is None else long, together or TOGETHER
    bound_batches(sequences)
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    kinds = [KINDS[t] for _, t in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column(1).to_pylist()
            for part in groups(seqs, long, together):
                columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in of(Laid([seqs[k] for k in part]))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), *(c.cast(k) for c, k in zip(columns, kinds))], ["acc", *(n for n, _ in fields)])

    kind = sequences.schema["acc"].dataType.simpleString()
    got = sequences.select("acc", "seq").mapInArrow(run, f"acc {kind}, {schema}")
    few = sequences.where(F.col("_most") > long) if "_most" in sequences.columns else sequences
    got = got.unionByName(longer(residues(few.where(F.length("seq") > long))).select("acc", *[F.col(n).cast(t) for n, t in fields]))
    wrong = F.when(F.col("acc").isNull(), F.raise_error(F.lit("a sequence has no accession"))).when(
        F.count("*").over(Window.partitionBy("acc")) > 1, F.raise_error(F.concat(F.lit("several sequences of accession "), F.col("acc").cast("string")))
    )
    return got.withColumn("_wrong", wrong).where("_wrong is null").drop("_wrong")


def quantiles(ordered: np.ndarray, first: np.ndarray, size: np.ndarray, points: tuple[float, ...], value: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Linear quantiles of the stretches of ``ordered`` from ``first`` on; ``value`` makes a number of what stands there."""
    out = []
    for p in points:
        place = p * (size - 1)
        low = np.floor(place).astype(np.int64)
        a, b = value(ordered[first + low]), value(ordered[first + np.minimum(low + 1, size - 1)])
        out.append(a + (b - a) * (place - low))
    return out


def profile_values(s: Laid, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which places ``residues.profile`` has, the values there in whole parts, and how many parts a unit has."""
    inside = (s.pos >= radius - 1) & (s.pos <= s.n - radius - 2)
    # The first place's window is cut by one residue.
    whole, cut = 2 * radius + 1, 2 * radius
    v = s.sums(s.scores(), radius, radius)[inside]
    return inside, np.where(s.pos[inside] < radius, v * whole, v * cut), SCORE_UNIT * whole * cut


def profile_statistics(sequences: DataFrame, points: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95), radius: int = 25, long: int | None = None) -> DataFrame:
    """``residues.profile_statistics`` of the profile: acc, mean, sd, quantiles, low, high, positive, strength; sequences without a profile have no row."""
    from peptora.operators import residues as R

    names = ["mean", "sd", *(f"q{round(100 * p):02d}" for p in points), "low", "high", "positive", "strength"]

    def of(s: Laid) -> list:
        inside, v, unit = profile_values(s, radius)
        row = s.row[inside]
        size = np.bincount(row, minlength=len(s.size))
        there = size > 0
        c, first = size[there], (np.cumsum(size) - size)[there]
        if not len(row):
            return [nulled(np.zeros(len(size)), there)] * len(names)
        x = v / unit
        mean = np.add.reduceat(x, first) / c
        sd = np.sqrt(np.add.reduceat((x - np.repeat(mean, c)) ** 2, first) / c)
        up = np.add.reduceat((v > 0).astype(np.int64), first)
        strength = np.add.reduceat(np.where(v > 0, x, 0.0), first) / np.maximum(up, 1)
        ordered = np.sort(row << 40 | v)
        number = lambda k: (k & (1 << 40) - 1) / unit
        got = [mean, sd, *quantiles(ordered, first, c, points, number), number(ordered[first]), number(ordered[first + c - 1]), up / c, strength]
        return [nulled(_spread(x, there), there) for x in got]

    got = summaries(sequences, ", ".join(f"{n} double" for n in names), of, lambda t: R.profile_statistics(R.profile(t, radius)), long)
    return got.where("mean is not null")


def _spread(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    out = np.zeros(len(there), x.dtype)
    out[there] = x
    return out


def aligned_profile_summary(sequences: DataFrame, radius: int = 25, long: int | None = None) -> DataFrame:
    """acc, low, high, mean of the profile shifted to the protein's mean residue score; sequences without a profile have no row."""
    from peptora.operators import residues as R

    def of(s: Laid) -> list:
        inside, v, unit = profile_values(s, radius)
        size = np.bincount(s.row[inside], minlength=len(s.size))
        there = size > 0
        if not there.any():
            return [nulled(np.zeros(len(size)), there)] * 3
        c, first = size[there], (np.cumsum(size) - size)[there]
        x = v / unit
        mean = np.add.reduceat(x, first) / c
        shift = (s.total(s.scores()) / SCORE_UNIT / s.size)[there] - mean
        return [nulled(_spread(a + shift, there), there) for a in (np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), mean)]

    def longer(t: DataFrame) -> DataFrame:
        got = R.aligned_profile(R.profile(t, radius), R.own(R.residue_scores(t)).groupBy("acc").agg(F.avg("score").alias("single")))
        return got.groupBy("acc").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))

    return summaries(sequences, "low double, high double, mean double", of, longer, long).where("mean is not null")


def best_window(sequences: DataFrame, scale: Mapping[str, float], length: int, shorter: bool, long: int | None = None) -> DataFrame:
    """``residues.best_window`` for a table of values: acc, n, best, first, last."""
    from peptora.operators import residues as R

    whole = all(isinstance(v, int) for v in scale.values())
    counted = scale if whole else units(scale)

    def of(s: Laid) -> list:
        fits = s.pos + length <= s.n
        fits = fits | ((s.n < length) & (s.pos == 0)) if shorter else fits
        best, first, there = s.most(s.sums(s.values(counted), 0, length - 1), fits)
        return [s.size, nulled(best if whole else best / 2**BITS, there), nulled(first, there), np.where(there, np.minimum(np.where(there, first, 0) + length, s.size), s.size)]

    kind = "long" if whole else "double"
    return summaries(sequences, f"n long, best {kind}, first long, last long", of, lambda t: R.best_window(t, R.valued(scale), length, shorter), long)


def spread_average_peaks(sequences: DataFrame, widths: tuple[int, ...] = (20, 40, 60), long: int | None = None) -> DataFrame:
    """acc and high_<w>: the greatest of the means of ``residues.spread_average`` over residue scores, null where no window fits.

    What fills the ends is one of the means, so the greatest is that of the means which fit.
    """
    from peptora.operators import residues as R

    def of(s: Laid) -> list:
        scores, out = s.scores(), []
        for w in widths:
            best, _, there = s.most(s.sums(scores, w // 2, w - w // 2 - 1), (s.pos >= w // 2) & (s.pos + (w - w // 2) <= s.n))
            out.append(nulled(best / w / SCORE_UNIT, there))
        return out

    longer = lambda t: R.own(R.spread_average(R.residue_scores(t), "score", widths)).groupBy("acc").agg(*[F.max(f"avg_{w}").alias(f"high_{w}") for w in widths])
    return summaries(sequences, ", ".join(f"high_{w} double" for w in widths), of, longer, long)


def top_neighbourhood(sequences: DataFrame, top: int = 60, spread: int = 5, long: int | None = None) -> DataFrame:
    """``residues.top_neighbourhood`` of the residue scores: acc, top_mean, n_near."""
    from peptora.operators import residues as R

    def of(s: Laid) -> list:
        scores = s.scores()
        cut = np.sort(s.row << 40 | scores)[s.start + s.size - np.minimum(s.size, top)] & (1 << 40) - 1
        near = s.sums(scores >= cut[s.row], spread, spread) > 0
        count = s.total(near.astype(np.int64))
        return [s.total(np.where(near, scores, 0)) / count / SCORE_UNIT, count]

    return summaries(sequences, "top_mean double, n_near long", of, lambda t: R.top_neighbourhood(R.residue_scores(t), "score", top, spread), long)


def _per_row(s: Laid, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the stretches of each sequence: how many, their residues, the longest, and the first place."""
    row = s.row[first]
    count = np.bincount(row, minlength=len(s.size))
    there = count > 0
    if not len(row):
        return count, count, count, count
    begin = (np.cumsum(count) - count)[there]
    size = last - first
    return count, *(_spread(x, there) for x in (np.add.reduceat(size, begin), np.maximum.reduceat(size, begin), np.minimum.reduceat(first - s.start[row], begin)))


def run_summary(sequences: DataFrame, letters: str, long: int | None = None) -> DataFrame:
    """acc, longest, stretches of ``residues.runs`` of these letters; sequences without any have no row."""
    from peptora.operators import residues as R

    def of(s: Laid) -> list:
        count, _, longest, _ = _per_row(s, *s.runs(s.any_of(letters)))
        return [longest, count]

    longer = lambda t: R.runs(t, F.col("aa").isin(*letters)).groupBy("acc").agg(F.max("size").alias("longest"), F.count("*").alias("stretches"))
    return summaries(sequences, "longest long, stretches long", of, longer, long).where("stretches > 0")


def disorder_summary(sequences: DataFrame, least: int = 5, long: int | None = None) -> DataFrame:
    """acc, stretches, residues, longest, first of ``residues.disordered_runs``; sequences without any have no row."""
    from peptora.operators import residues as R

    def of(s: Laid) -> list:
        h = np.minimum((FOLD_WINDOW - 1) // 2, s.size // 2)
        end = h[s.row]
        first, last = s.runs((s.pos >= end) & (s.pos < s.n - end) & (s.fold_index() < 0))
        low, size, h = (x[s.row[first]] for x in (s.start, s.size, h))
        # Those that begin or end the span reach to the terminus.
        first, last = np.where(first - low == h, low, first), np.where(last - low == size - h, low + size, last)
        kept = last - first >= least
        return list(_per_row(s, first[kept], last[kept]))

    def longer(t: DataFrame) -> DataFrame:
        size = F.col("last") - F.col("first")
        return R.disordered_runs(t, least).groupBy("acc").agg(F.count("*").alias("stretches"), F.sum(size).alias("residues"), F.max(size).alias("longest"), F.min("first").alias("first"))

    return summaries(sequences, "stretches long, residues long, longest long, first long", of, longer, long).where("stretches > 0")


def core_domains(sequences: DataFrame, scale: Mapping[str, int], length: int = 60, long: int | None = None) -> DataFrame:
    """``residues.core_domains`` where the fold index is negative; sequences without a core have no row."""
    from peptora.operators import residues as R

    def of(s: Laid) -> list:
        inside, v = s.fold_index() < 0, s.values(scale)
        holds = (s.sums(inside, 0, length - 1) == length) & (s.pos + length <= s.n)
        best, at, there = s.most(s.sums(v, 0, length - 1), holds)
        first, last = s.runs(inside)
        if not there.any():
            return [nulled(np.zeros(len(there), np.int64), there)] * 5
        own = np.searchsorted(first, (s.start + np.where(there, at, 0))[there], "right") - 1
        upto = np.concatenate([[0], np.cumsum(v)])
        domain, a, b = upto[last[own]] - upto[first[own]], first[own] - s.start[there], last[own] - s.start[there]
        return [nulled(np.where(there, best, 0), there), nulled(np.where(there, at, 0), there), *(nulled(_spread(x, there), there) for x in (domain, a, b))]

    longer = lambda t: R.core_domains(R.fold_index(t), F.col("fi") < 0, R.valued(scale), length)
    return summaries(sequences, "core long, core_first long, domain long, domain_first long, domain_last long", of, longer, long).where("core is not null")


def prion_propensity_peak(sequences: DataFrame, window: int = 41, long: int | None = None) -> DataFrame:
    """``residues.prion_propensity_peak``: acc, papa, at."""
    from peptora.functions.tables import prion_propensity
    from peptora.operators import residues as R

    h, scale = (window - 1) // 2, units(prion_propensity())

    def smoothed(s: Laid, v: np.ndarray, h: int) -> np.ndarray:
        """``residues.sliding_average``, weighted."""
        half = np.minimum(h, s.n - 1)
        k = 1 + np.minimum(s.pos, half) + np.minimum(s.n - 1 - s.pos, half)
        return s.sums(np.rint(k * v * 2.0**46).astype(np.int64), h, h) / s.sums(k, h, h) / 2.0**46

    def of(s: Laid) -> list:
        p, back = s.any_of("P"), lambda x, k: np.concatenate([np.zeros(min(k, len(x)), bool), x[:-k]]) & (s.pos >= k)
        once = np.where(p & (back(p, 1) | back(p, 2)), 0, s.values(scale))
        x = s.sums(once, h, h) / 2**BITS / s.width(h)
        peak = smoothed(s, x, h)
        best, at, there = s.most(peak, (s.pos >= h) & (s.pos < s.n - h) & (smoothed(s, s.fold_index(), FOLD_WINDOW // 2) < 0))
        return [nulled(best, there), nulled(at, there)]

    return summaries(sequences, "papa double, at long", of, lambda t: R.prion_propensity_peak(t, window), long)


def window_summaries(sequences: DataFrame, radii: tuple[int, ...] = (3, 7, 13, 25), long: int | None = None) -> DataFrame:
    """``residues.window_summaries``: acc and, for each radius and scale, mean, quartiles and deviation of the window means."""
    from peptora.functions.tables import SCALE_NAMES, SCALES100
    from peptora.operators import residues as R

    points = (0.25, 0.5, 0.75)
    names = [f"{n}{r}_{x}" for r in radii for n in SCALE_NAMES for x in ("mean", "q25", "q50", "q75", "sd")]

    def of(s: Laid) -> list:
        upto = [np.concatenate([[0], np.cumsum(s.values({a: row[k] for a, row in SCALES100.items()}), dtype=np.int64)]).astype(np.int32) for k in range(len(SCALE_NAMES))]
        out = []
        for r in radii:
            # Windows that aren't cut are whole numbers over one width; the others' means are placed between these, in 128ths of one (they are 1 / w apart at least).
            w, inner = 2 * r + 1, np.flatnonzero((s.pos >= r) & (s.pos < s.n - r))
            ends = np.flatnonzero((s.pos < r) | (s.pos >= s.n - r))
            key = (s.row[inner] << 20).astype(np.int32)
            rows, (a, b) = s.row[ends], s.window(r, r)
            a, b = a[ends], b[ends]
            cut = b - a
            count = np.bincount(s.row[inner], minlength=len(s.size))
            begun = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[begun]
            end_count = np.bincount(rows, minlength=len(s.size))
            end_row = np.flatnonzero(end_count)
            end_begin = (np.cumsum(end_count) - end_count)[end_row]
            for u in upto:
                v = (u[w:] - u[:-w])[inner - r] if len(inner) else np.zeros(0, np.int32)
                e = u[b] - u[a]
                x = e / cut
                total, square = np.zeros(len(s.size)), np.zeros(len(s.size))
                if len(begin):
                    total[begun] = np.add.reduceat(v, begin, dtype=np.int64) / w
                total[end_row] += np.add.reduceat(x, end_begin)
                mean = total / s.size
                # About a whole number near the mean sums of squares are exact, and the mean takes little off them.
                near = np.rint(mean * w).astype(np.int64)
                if len(begin):
                    d = v - np.repeat(near[begun], count[begun])
                    square[begun] = np.add.reduceat(d * d, begin) / w**2
                square[end_row] += np.add.reduceat((x - near[rows] / w) ** 2, end_begin)
                square = np.maximum(square / s.size - (mean - near / w) ** 2, 0.0)
                placed = (rows << 20) + np.rint(x * (w * 128)).astype(np.int64)
                ordered = np.sort(np.concatenate([key + (v << 7), placed.astype(np.int32)]))
                by = np.argsort(placed)
                known, exact = placed[by], x[by]

                def number(k: np.ndarray, known=known, exact=exact, w=w) -> np.ndarray:
                    at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                    return np.where(known[at] == k, exact[at], ((k & (1 << 20) - 1) >> 7) / w) / 100.0

                out += [mean / 100.0, *quantiles(ordered, s.start, s.size, points, number), np.sqrt(square) / 100.0]
        return out

    return summaries(sequences, ", ".join(f"{n} double" for n in names), of, lambda t: R.window_summaries(t, radii), long, 1 << 17)
