"""What a window frame can't express: recurrences along a sequence, on whole sequences in Arrow batches.

Spark deals out proteins; each function below handles one protein and holds nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptora.functions.tables import HMM_ENTER, HMM_KEEP, HMM_LEAVE, HMM_START, HMM_STAY, PRION, RESIDUES, SCALES100, SEG_HIGH, SEG_LOW, SEG_TRIM, SEG_WINDOW, UNKNOWN_FREQUENCY, YEAST, granule10000

CODE = np.full(256, 20, np.int64)
for _k, _a in enumerate(RESIDUES):
    CODE[ord(_a)] = _k


def codes(seq: str) -> np.ndarray:
    """0 to 19 for the residues, 20 for anything else."""
    return CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


#: Sequences of an Arrow batch: they may be long, and a batch stands in memory on both sides.
BATCH = 500


def bound_batches(df: DataFrame) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))


def over_sequences(sequences: DataFrame, schema: str, row: Callable[[str], tuple]) -> DataFrame:
    """acc and what ``row`` makes of each sequence. A null or empty one gives nulls."""
    return over_batches(sequences, schema, lambda seqs: list(map(row, seqs)))


def over_batches(sequences: DataFrame, schema: str, rows: Callable[[list[str]], list[tuple]]) -> DataFrame:
    """As over_sequences for what ``rows`` makes of several sequences at once, one row each."""
    bound_batches(sequences)
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column(1).to_pylist()
            made = iter(rows([s for s in seqs if s]))
            got = [next(made) if s else (None,) * len(fields) for s in seqs]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in got], kinds[t]) for k, (_, t) in enumerate(fields))], ["acc", *(n for n, _ in fields)])

    return sequences.select("acc", "seq").mapInArrow(run, f"acc string, {schema}")


# Low-complexity segments with trimming


#: Windows whose letters are counted at a time.
STRETCH = 1 << 20


def entropies(x: np.ndarray, length: int = SEG_WINDOW) -> np.ndarray:
    """Bits of the residues in each window; other letters don't count, and a window of them has none.

    Of T residues counted c each the entropy is log2 T - sum of c log2 c / T. Counts are differences
    of prefix counts, letter by letter, and the products come from a table.
    """
    if len(x) > STRETCH + length:
        return np.concatenate([entropies(x[k : k + STRETCH + length - 1], length) for k in range(0, len(x) - length + 1, STRETCH)])
    n = max(0, len(x) - length + 1)
    products = np.arange(length + 1) * np.log2(np.maximum(np.arange(length + 1), 1))
    total, summed = np.zeros(n, np.int64), np.zeros(n)
    for k in range(20 if n else 0):
        upto = np.concatenate([[0], np.cumsum(x == k, dtype=np.int64)])
        count = upto[length:] - upto[:n]
        total += count
        summed += products[count]
    some = np.maximum(total, 1)
    return np.log2(some) - summed / some


def entropy_summary(sequences: DataFrame, length: int = SEG_WINDOW) -> DataFrame:
    """acc, size (windows), and the least and the mean entropy of them; a sequence under ``length`` has none."""

    def row(seq: str) -> tuple:
        h = entropies(codes(seq), length)
        return (len(h), float(h.min()), float(h.mean())) if len(h) else (0, None, None)

    return over_sequences(sequences, "size long, low double, mean double", row)


def low_complexity(sequences: DataFrame, length: int = SEG_WINDOW, low: float = SEG_LOW, high: float = SEG_HIGH) -> DataFrame:
    """acc, n, first, last: runs of windows up to ``high`` bits that hold one up to ``low``, with their residues, overlaps merged."""

    def row(seq: str) -> tuple:
        h = entropies(codes(seq), length)
        # An entropy is a sum of shares; a margin under any gap between its values keeps the comparison free of rounding.
        edge = np.diff(np.concatenate([[0], (h <= high + 1e-9).astype(np.int8), [0]]))
        out: list[list[int]] = []
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if h[s:e].min() > low + 1e-9:
                continue
            # The windows s to e - 1 cover the residues up to e + length - 2.
            if out and s <= out[-1][1]:
                out[-1][1] = e + length - 1
            else:
                out.append([s, e + length - 1])
        return len(seq), out

    got = over_sequences(sequences, "n long, spans array<array<int>>", row).select("acc", "n", F.explode("spans").alias("span"))
    return got.select("acc", "n", F.col("span")[0].cast("long").alias("first"), F.col("span")[1].cast("long").alias("last"))


LOG = np.log(np.maximum(np.arange(21), 1))
LOG_FACTORIAL = np.cumsum(LOG)


def log_probability(counts: np.ndarray, length: int, factorial: np.ndarray) -> np.ndarray:
    """ln of the chance of each composition (20 x windows): its arrangements and the ways to name it, over all strings."""
    ordered = np.sort(np.ascontiguousarray(counts.T, np.int32), axis=1)
    alike, same = np.zeros(len(ordered)), np.ones(len(ordered), np.int64)
    for k in range(1, 20):  # groups of residues with one count, zeros included, may trade names: n ones give n!
        same = np.where(ordered[:, k] == ordered[:, k - 1], same + 1, 1)
        alike -= LOG[same]
    return LOG_FACTORIAL[20] + alike + factorial[length] - factorial[counts].sum(axis=0) - length * math.log(20)


def least_likely(x: np.ndarray) -> tuple[int, int]:
    """The stretch of ``x`` whose composition is least likely; longer ones first, then the earliest."""
    n = len(x)
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    sums = np.zeros((21, n + 1), np.int64)
    sums[x, np.arange(1, n + 1)] = 1
    sums = np.cumsum(sums, axis=1)[:20]
    best, span = 1.0, (0, n)
    for length in range(n, max(1, n - SEG_TRIM), -1):
        p = log_probability(sums[:, length:] - sums[:, : n - length + 1], length, factorial)
        # Equal compositions give equal values only up to the last digit: a margin keeps the earliest.
        k = int(np.flatnonzero(p <= p.min() + 1e-11)[0])
        if p[k] < best - 1e-11:
            best, span = float(p[k]), (k, k + length)
    return span


def segments(x: np.ndarray, offset: int = 0) -> list[tuple[int, int]]:
    """Low-complexity segments (first, last excluded) before merging.

    Each trigger window grows to its run of windows up to SEG_HIGH bits; of the residues they
    cover the least likely stretch stays. What the trim cut off on the left, if the trigger
    was there, is searched on its own.
    """
    down = (SEG_WINDOW + 1) // 2 - 1
    up = SEG_WINDOW - down
    if len(x) < SEG_WINDOW:
        return []
    h = np.full(len(x), np.inf)
    h[down : len(x) - up + 1] = entropies(x)
    low, high = h <= SEG_LOW + 1e-9, h <= SEG_HIGH + 1e-9
    found, at, floor, end = [], down, down, len(x) - up
    while at <= end:
        if not low[at]:
            at += 1
            continue
        lo = at
        while lo - 1 >= floor and high[lo - 1]:
            lo -= 1
        hi = at
        while hi + 1 <= end and high[hi + 1]:
            hi += 1
        left, right = lo - down, hi + up
        s, e = least_likely(x[left:right])
        s, e = left + s, left + e
        if at + up - 1 < s:
            found += segments(x[left:s], offset + left)
        found.append((offset + s, offset + e))
        at = min(hi, e - 1 + down)
        floor = at + 1
        at += 1
    return found


def merged_segments(seq: str) -> list[tuple[int, int]]:
    """Segments in order, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(segments(codes(seq))):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: Stretches of more residues are trimmed one by one; walkers that step together, and counts that they hold.
WALK, WALKERS, HELD = 2048, 1 << 14, 1 << 22
LN = np.log(np.maximum(np.arange(WALK + 22), 1))
#: With more digits, as sums of a thousand residues pass those that are told apart.
FACTORIAL = np.cumsum(np.log(np.maximum(np.arange(WALK + 22), 1).astype(np.longdouble)))


def least_likely_of(x: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``least_likely`` of many stretches of ``n`` residues: first and last (excluded) in ``x``.

    From each place that may be first a walker takes the residues that any stretch from there has, and then one after the
    other. With a residue that it has met c times, the arrangements and the ways to name the composition change by three logarithms.
    """
    count, base = len(first), max(0, n - SEG_TRIM)
    begin = (first[None, :] + np.arange(n - base)[:, None]).ravel()
    kind = np.int8 if n < 120 else np.int16
    counts, alike = np.zeros((len(begin), 21), kind), np.zeros((len(begin), n + 2), kind)
    by_residue, by_count = np.arange(len(begin)) * 21, np.arange(len(begin)) * (n + 2)
    before = np.zeros(1, np.longdouble)
    if base:
        inside = x[first[None, :] + np.arange(n)[:, None]]
        for k in range(20):
            upto = np.concatenate([np.zeros((1, count), np.int64), np.cumsum(inside == k, axis=0)])
            counts[:, k] = (upto[base:n] - upto[: n - base]).ravel()
        for k in range(20):  # how many residues have been met so often
            alike.ravel()[by_count + counts[:, k]] += 1
        before = FACTORIAL[20] - FACTORIAL[alike].sum(axis=1) - FACTORIAL[counts[:, :20]].sum(axis=1)
    else:
        alike[:, 0] = 20
    counts, alike = counts.ravel(), alike.ravel()
    q = np.zeros(len(begin))
    least, at = np.full((n + 1, count), np.inf), np.zeros((n + 1, count), np.int64)
    for length in range(base + 1, n + 1):
        there = (n - length + 1) * count
        letter = x[begin[:there] + length - 1]
        k = by_residue[:there] + letter
        c = counts[k]
        counts[k] = c + 1
        j = by_count[:there] + c
        here, more = alike[j], alike[j + 1]
        step = LN[here] - LN[more + 1] - LN[c + 1]
        known = letter < 20
        if known.all():
            alike[j] = here - 1
            alike[j + 1] = more + 1
        else:
            step[~known] = 0.0
            alike[j[known]] = here[known] - 1
            alike[j[known] + 1] = more[known] + 1
        q[:there] += step
        p = (q[:there] + (before[:there] + (FACTORIAL[length] - length * np.log(np.longdouble(20)))).astype(float)).reshape(-1, count)
        at[length] = (p <= p.min(axis=0) + 1e-11).argmax(axis=0)
        least[length] = p[at[length], np.arange(count)]
    best, start, size = np.ones(count), np.zeros(count, np.int64), np.full(count, n)
    for length in range(n, max(1, base), -1):
        better = least[length] < best - 1e-11
        best, start, size = np.where(better, least[length], best), np.where(better, at[length], start), np.where(better, length, size)
    return first + start, first + start + size


def trimmed(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``least_likely`` of stretches of any lengths; those of one length step together."""
    s, e = first.copy(), last.copy()
    size = last - first
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        n = int(size[own[0]])
        if n > WALK:
            for k in own.tolist():
                a, b = least_likely(x[first[k] : last[k]])
                s[k], e[k] = first[k] + a, first[k] + b
            continue
        step = max(1, min(WALKERS, HELD // n) // min(n, SEG_TRIM))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            s[part], e[part] = least_likely_of(x, first[part], n)
    return s, e


def segments_of(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``segments`` of sequences that stand in ``x``: first and last (excluded), before merging, in no order.

    A trigger grows within its run of windows up to SEG_HIGH bits and is sought anew behind what was found, in the run or
    behind it, so no run has to do with another: the next trigger of every run is taken at once.
    """
    out_s, out_e = [], []
    while len(start):
        # What is searched, end to end; windows that reach over a border count as none.
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        back = (start - begin)[row]  # from a place here to that in x
        y = x[np.arange(len(row)) + back]
        h = np.full(len(y) + 1, np.inf)
        if len(y) >= SEG_WINDOW:
            w = np.arange(len(y) - SEG_WINDOW + 1)
            h[w] = np.where(row[w] == row[w + SEG_WINDOW - 1], entropies(y), np.inf)
        low, high = h <= SEG_LOW + 1e-9, h <= SEG_HIGH + 1e-9
        # A run ends at its sequence's last window: the next sequence's first one stands SEG_WINDOW places behind.
        edge = np.diff(np.concatenate([[0], high.astype(np.int8)]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        following = np.minimum.accumulate(np.where(low, np.arange(len(h)), len(h))[::-1])[::-1]
        more_s, more_n = [], []
        while len(a):
            trigger = following[a]
            some = trigger <= b
            a, b, trigger = a[some], b[some], trigger[some]
            if not len(a):
                break
            s, e = trimmed(y, a, b + SEG_WINDOW)
            out_s.append(s + back[a])
            out_e.append(e + back[a])
            left = trigger + SEG_WINDOW - 1 < s
            more_s.append((a + back[a])[left])
            more_n.append((s - a)[left])
            a = np.minimum(b, e - 1) + 1
            some = a <= b
            a, b = a[some], b[some]
        start, size = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (more_s, more_n))
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_s, out_e))


def merged_segments_of(seqs: list[str]) -> list[list[list[int]]]:
    """``merged_segments`` of many sequences at once."""
    size = np.array(list(map(len, seqs)), np.int64)
    start = np.cumsum(size) - size
    s, e = segments_of(codes("".join(seqs)), start, size)
    order = np.lexsort((e, s))
    s, e = s[order], e[order]
    reach = np.maximum.accumulate(e) if len(e) else e
    new = np.ones(len(s), bool)
    new[1:] = s[1:] >= reach[:-1]
    begun = np.flatnonzero(new)
    s, e = s[begun], (reach[np.append(begun[1:], len(reach)) - 1] if len(begun) else e[:0])
    row = np.searchsorted(start, s, "right") - 1
    found = np.stack([s - start[row], e - start[row]], axis=1).tolist() if len(s) else []
    cuts = np.searchsorted(row, np.arange(len(seqs) + 1)).tolist()
    return [found[cuts[k] : cuts[k + 1]] for k in range(len(seqs))]


def exact_low_complexity(sequences: DataFrame) -> DataFrame:
    """acc, segments, covered, share: low complexity with minimum-probability trimming."""

    def rows(seqs: list[str]) -> list[tuple]:
        out, at = [], 0
        while at < len(seqs):
            part, letters = [], 0
            while at < len(seqs) and (not part or letters + len(seqs[at]) <= STRETCH):
                part.append(seqs[at])
                letters += len(seqs[at])
                at += 1
            for seq, found in zip(part, merged_segments_of(part)):
                n = sum(e - s for s, e in found)
                out.append((found, n, n / len(seq)))
        return out

    return over_batches(sequences, "segments array<array<int>>, covered long, share double", rows)


# The two-state model of prion-like stretches


def emissions() -> np.ndarray:
    """ln of each state's letter frequencies: proteome and prion-like, the unknown letter last."""
    out = []
    for f in (YEAST, PRION):
        total = sum(f) + 2 * UNKNOWN_FREQUENCY
        out.append([math.log(x / total) for x in (*f, UNKNOWN_FREQUENCY)])
    return np.array(out)


def decode_states(seq: str) -> tuple:
    """Viterbi path (0 on ties), score and Viterbi score against the one-state model, prion posteriors."""
    e = emissions()[:, codes(seq)]
    n = e.shape[1]
    move = np.log(np.array([[HMM_STAY, HMM_ENTER], [HMM_LEAVE, HMM_KEEP]]))
    v = np.log(np.array(HMM_START)) + e[:, 0]
    f = v.copy()
    back = np.zeros((n, 2), np.int8)
    forward = np.empty((n, 2))
    forward[0] = f
    (m00, m01), (m10, m11) = move.tolist()
    v0, v1 = v.tolist()
    f0, f1 = f.tolist()
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    steps = e.T.tolist()
    for k in range(1, n):
        e0, e1 = steps[k]
        a, b = v0 + m00, v1 + m10
        c, d = v0 + m01, v1 + m11
        back[k] = (b > a, d > c)
        v0, v1 = max(a, b) + e0, max(c, d) + e1
        f0, f1 = add(f0 + m00, f1 + m10) + e0, add(f0 + m01, f1 + m11) + e1
        forward[k] = (f0, f1)
    total, none = add(f0, f1), float(e[0].sum())
    path = np.zeros(n, np.int32)
    path[-1] = int(v1 > v0)
    for k in range(n - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    posterior = np.empty(n)
    b0 = b1 = 0.0
    for k in range(n - 1, -1, -1):
        posterior[k] = math.exp(forward[k, 1] + b1 - total)
        e0, e1 = steps[k]
        b0, b1 = add(m00 + e0 + b0, m01 + e1 + b1), add(m10 + e0 + b0, m11 + e1 + b1)
    return path.tolist(), total - none, max(v0, v1) - none, posterior.tolist(), int(path.sum()), float(posterior.max())


#: Sequences of like length that step together: so many at least, and so many places with their padding at most.
TOGETHER, PLACES = 16, 1 << 21


def decode_together(seqs: list[str]) -> list[tuple]:
    """decode_states of sequences sorted by length, all of them a place further with each step."""
    n = np.array(list(map(len, seqs)))
    size, width = int(n[-1]), len(seqs)
    x = np.full((size, width), 20)
    for k, s in enumerate(seqs):
        x[: n[k], k] = codes(s)
    e0, e1 = emissions()[:, x]
    first = np.searchsorted(n, np.arange(size), "right")  # those from here on have this place
    (m00, m01), (m10, m11) = np.log(np.array([[HMM_STAY, HMM_ENTER], [HMM_LEAVE, HMM_KEEP]])).tolist()
    v0, v1 = (math.log(p) + e[0] for p, e in zip(HMM_START, (e0, e1)))
    f0, f1 = v0.copy(), v1.copy()
    back = np.zeros((2, size, width), bool)
    forward0, forward1 = np.empty((2, size, width))
    forward0[0], forward1[0] = f0, f1
    for k in range(1, size):
        now = slice(first[k], None)
        a, b, c, d = v0[now] + m00, v1[now] + m10, v0[now] + m01, v1[now] + m11
        back[0, k, now], back[1, k, now] = b > a, d > c
        v0[now], v1[now] = np.maximum(a, b) + e0[k, now], np.maximum(c, d) + e1[k, now]
        g0 = np.logaddexp(f0[now] + m00, f1[now] + m10) + e0[k, now]
        f1[now] = np.logaddexp(f0[now] + m01, f1[now] + m11) + e1[k, now]
        f0[now] = g0
        forward0[k, now], forward1[k, now] = f0[now], f1[now]
    total = np.logaddexp(f0, f1)
    none = np.where(np.arange(size)[:, None] < n, e0, 0.0).sum(axis=0)
    state, path, posterior = (v1 > v0).astype(np.int64), np.zeros((size, width), np.int32), np.zeros((size, width))
    b0, b1, at = np.zeros(width), np.zeros(width), np.arange(width)
    for k in range(size - 1, -1, -1):
        now = slice(first[k], None)
        path[k, now] = state[now]
        state[now] = back[state[now], k, at[now]]
        posterior[k, now] = np.exp(forward1[k, now] + b1[now] - total[now])
        c, d = e0[k, now] + b0[now], e1[k, now] + b1[now]
        b0[now], b1[now] = np.logaddexp(m00 + c, m01 + d), np.logaddexp(m10 + c, m11 + d)
    best = np.maximum(v0, v1)
    return [
        (path[: n[k], k].tolist(), float(total[k] - none[k]), float(best[k] - none[k]), posterior[: n[k], k].tolist(), int(path[: n[k], k].sum()), float(posterior[: n[k], k].max()))
        for k in range(width)
    ]


def decode_all(seqs: list[str]) -> list[tuple]:
    """decode_states of each sequence; those of like length step together."""
    order = sorted(range(len(seqs)), key=lambda k: len(seqs[k]))
    out: list[tuple] = [()] * len(seqs)
    held: list[int] = []
    for k in [*order, None]:
        if held and (k is None or (len(held) + 1) * len(seqs[k]) > PLACES):
            part = [seqs[j] for j in held]
            for j, row in zip(held, decode_together(part) if len(held) >= TOGETHER else map(decode_states, part)):
                out[j] = row
            held = []
        if k is not None:
            held.append(k)
    return out


def hidden_states(sequences: DataFrame) -> DataFrame:
    """acc, path, score, viterbi_score, posterior, prion_residues, high_posterior."""
    return over_batches(sequences, "path array<int>, score double, viterbi_score double, posterior array<double>, prion_residues long, high_posterior double", decode_all)


def hidden_state_summary(sequences: DataFrame) -> DataFrame:
    """As hidden_states without the arrays, which then never leave the worker."""
    return over_batches(sequences, "score double, viterbi_score double, prion_residues long, high_posterior double", lambda seqs: [(s, v, n, h) for _, s, v, _, n, h in decode_all(seqs)])


# The 181 columns of the surrogate


QUARTILES, POINTS = (0.25, 0.5, 0.75), (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def _window_means(sums: np.ndarray, radius: int) -> np.ndarray:
    """Means of the windows around each place, from the prefix sums of rows of values."""
    n = sums.shape[1] - 1
    at = np.arange(n)
    low, high = np.maximum(0, at - radius), np.minimum(n, at + radius + 1)
    return (sums[:, high] - sums[:, low]) / (high - low)


def _quantiles(ordered: np.ndarray, points: tuple[float, ...]) -> np.ndarray:
    """Linear quantiles of sorted rows, one row a point."""
    at = np.array(points) * (ordered.shape[1] - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, ordered.shape[1] - 1)
    return (ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (at - low)).T


def features_of(seq: str) -> np.ndarray:
    """Window summaries at four radii, profile statistics at three, composition, length and its logarithm.

    One prefix sum over the scales serves all radii, and each row of means is sorted once.
    """
    x = codes(seq)
    n = len(x)
    scales = np.array([SCALES100[a] for a in RESIDUES] + [(0,) * 6], float).T / 100
    fused = np.array([granule10000()[a] for a in RESIDUES] + [0], float) / 10000
    upto = lambda v: np.concatenate([np.zeros((len(v), 1)), np.cumsum(v, axis=1)], axis=1)
    sums, parts = upto(scales[:, x]), []
    for radius in (3, 7, 13, 25):
        m = _window_means(sums, radius)
        mean, sd = m.mean(axis=1), m.std(axis=1)
        m.sort(axis=1)
        parts += [mean, *_quantiles(m, QUARTILES), sd]
    g = upto(_window_means(upto(fused[x][None, :]), 3))
    for radius in (3, 12, 25):
        if n <= 2 * radius:
            parts.append(np.zeros(13))
            continue
        p = np.sort(_window_means(g, radius)[:, radius - 1 : n - radius - 1], axis=1)
        up = p[p > 0]
        parts.append(np.array([p.mean(), p.std(), *_quantiles(p, POINTS)[:, 0], p[0, 0], p[0, -1], (p > 0).mean(), up.mean() if len(up) else 0.0]))
    parts.append(np.bincount(x, minlength=21)[:20] / n)
    parts.append(np.array([n, math.log(n)]))
    return np.concatenate(parts)


def feature_map(sequences: DataFrame) -> DataFrame:
    """acc, features (181 doubles)."""
    return over_sequences(sequences, "features array<double>", lambda s: (features_of(s),))
