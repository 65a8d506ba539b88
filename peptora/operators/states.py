"""The two-state model on sequences of any length: an associative scan of transfer matrices.

A stretch of letters takes the two states before it to the two states at its end. What that costs is a
2 x 2 matrix, under (max, +) for the best path and under (log-sum, +) for all paths, and the matrices of
neighbouring stretches multiply to that of both. So chunks of a sequence are worked on apart:

1. each chunk's two matrices, in parallel;
2. by sequence, over the chunks in order, the sums that enter each chunk, and backwards the state at its
   end and what follows it. A row's text has 2 GB at most, so that is some 32,000 small rows at the default;
3. each chunk's path and posteriors from what enters and follows it, in parallel.

Within a chunk the same is done once more with blocks of about its square root, whose letters step together.
The first letter has a start instead of a move, and stands before the first chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptora.functions.tables import HMM_ENTER, HMM_KEEP, HMM_LEAVE, HMM_START, HMM_STAY
from peptora.operators import kernels
from peptora.sources.shared import written

#: Letters of a chunk; sequences that are no longer are decoded whole.
CHUNK = 1 << 16
#: From state (first axis) to state.
MOVE = np.log(np.array([[HMM_STAY, HMM_ENTER], [HMM_LEAVE, HMM_KEEP]]))
#: Against the one-state model, which all paths are compared with: sums stay small, and so do their errors.
EMIT = kernels.emissions() - kernels.emissions()[0]


def blocks(seq: str) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (state, place in the block, block) of a stretch, and which places have a letter."""
    steps = max(1, int(np.sqrt(len(seq))))
    width = -(-len(seq) // steps)
    x = np.full(steps * width, 20)
    x[: len(seq)] = kernels.codes(seq)
    return EMIT[:, x.reshape(width, steps).T], (np.arange(steps * width) < len(seq)).reshape(width, steps).T


def transfers(e: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's matrices (from, to, block): of the best path and of all paths."""
    best = np.repeat(np.where(np.eye(2) > 0, 0.0, -np.inf)[:, :, None], e.shape[2], axis=2)
    every = best.copy()
    for k, there in enumerate(real):
        step = lambda m, add: add(m[:, 0, None] + MOVE[0][:, None], m[:, 1, None] + MOVE[1][:, None]) + e[:, k]  # noqa: B023, E731
        best, every = np.where(there, step(best, np.maximum), best), np.where(there, step(every, np.logaddexp), every)
    return best, every


class Borders:
    """What enters each of the blocks (v: best path, f: all paths), what follows it (b), and the state at its end."""

    def __init__(self, best: np.ndarray, every: np.ndarray, v: np.ndarray, f: np.ndarray, b: np.ndarray, state: int | None = None):
        """b: what follows the last block; state: at its end (None: the better one, 0 on ties)."""
        width = best.shape[2]
        self.v, self.f, self.b = np.empty((3, 2, width))
        self.state = np.empty(width, np.int64)
        for k in range(width):
            self.v[:, k], self.f[:, k] = v, f
            v, f = (v[:, None] + best[:, :, k]).max(axis=0), np.logaddexp(*(f[:, None] + every[:, :, k]))
        self.last_v, self.last_f = v, f
        state = int(v[1] > v[0]) if state is None else state
        for k in range(width - 1, -1, -1):
            self.b[:, k], self.state[k] = b, state
            came = self.v[:, k] + best[:, state, k]
            state, b = int(came[1] > came[0]), np.logaddexp(*(every[:, :, k] + b).T)
        # Of the letter before the first block.
        self.first_b, self.first_state = b, state


def product(best: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of all blocks as one stretch."""
    while best.shape[2] > 1:
        even = best.shape[2] // 2 * 2
        pairs = [(m[:, :, 0:even:2], m[:, :, 1:even:2], m[:, :, even:]) for m in (best, every)]
        best, every = (np.concatenate([add(a[:, 0, None] + b[None, 0], a[:, 1, None] + b[None, 1]), odd], axis=2) for add, (a, b, odd) in zip((np.maximum, np.logaddexp), pairs))
    return best[:, :, 0], every[:, :, 0]


def decode_part(seq: str, v: np.ndarray, f: np.ndarray, b: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """Path and prion posteriors of a stretch between two borders."""
    e, real = blocks(seq)
    at = Borders(*transfers(e, real), v, f, b, state)
    steps, width = real.shape
    back, forward = np.zeros((steps, 2, width), np.int8), np.empty((steps, 2, width))
    v, f = at.v, at.f
    for k, there in enumerate(real):
        came = v[:, None] + MOVE[:, :, None]
        back[k] = came[1] > came[0]
        v, f = np.where(there, came.max(axis=0) + e[:, k], v), np.where(there, np.logaddexp(*(f[:, None] + MOVE[:, :, None])) + e[:, k], f)
        forward[k] = f
    path, posterior = np.zeros((steps, width), np.int32), np.zeros((steps, width))
    state, after, block = at.state, at.b, np.arange(width)
    for k in range(steps - 1, -1, -1):
        both = forward[k] + after
        path[k], posterior[k] = state, np.exp(both[1] - np.logaddexp(*both))
        state = np.where(real[k], back[k][state, block], state)
        after = np.where(real[k], np.logaddexp(*(MOVE.T[:, :, None] + (e[:, k] + after)[:, None])), after)
    return path.T.ravel()[: len(seq)], posterior.T.ravel()[: len(seq)]


BORDERS = "row long, at long, v array<double>, f array<double>, b array<double>, state long, score double, viterbi_score double, first_state long, first_posterior double"


def _parts(sequences: DataFrame, chunk: int) -> DataFrame:
    """row, acc, at, first, part: the letters from ``at`` on, all but the first letter of a sequence, as a written table."""
    n = F.length("seq")
    rows = sequences.select("acc", "seq", F.monotonically_increasing_id().alias("row"))
    each = rows.select("row", "acc", "seq", F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(chunk))).alias("at"))
    # Of letters of one byte a part is found at once; characters must be counted from the beginning.
    part = F.when(F.octet_length("seq") == n, F.substring(F.col("seq").cast("binary"), F.col("at") + 1, F.lit(chunk)).cast("string")).otherwise(F.substring("seq", F.col("at") + 1, F.lit(chunk)))
    dealt = each.select("row", "acc", F.col("at").cast("long").alias("at"), F.substring("seq", 1, 1).alias("first"), part.alias("part"))
    return written(dealt.repartition(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "at"), "state-parts")


def _matrices(parts: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, every = [], []
            for seq in batch.column(3).to_pylist():
                e, real = blocks(seq)
                b, m = product(*transfers(e, real)) if seq else (np.where(np.eye(2) > 0, 0.0, -np.inf),) * 2
                best.append(b.ravel().tolist())
                every.append(m.ravel().tolist())
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, doubles), pa.array(every, doubles)], ["row", "at", "first", "best", "every"])

    return parts.select("row", "at", "first", "part").mapInArrow(run, "row long, at long, first string, best array<double>, every array<double>")


def _borders(rows: pd.DataFrame) -> pd.DataFrame:
    """One sequence's chunks in order."""
    rows = rows.sort_values("at")
    best, every = (np.stack([np.reshape(x, (2, 2)) for x in rows[c]], axis=2) for c in ("best", "every"))
    start = np.log(np.array(HMM_START)) + EMIT[:, kernels.codes(rows["first"].iloc[0])][:, 0]
    got = Borders(best, every, start, start, np.zeros(2))
    first = start + got.first_b
    return pd.DataFrame(
        {
            "row": rows["row"].to_numpy(), "at": rows["at"].to_numpy(), "v": got.v.T.tolist(), "f": got.f.T.tolist(), "b": got.b.T.tolist(), "state": got.state,
            "score": float(np.logaddexp(*got.last_f)), "viterbi_score": float(got.last_v.max()), "first_state": got.first_state, "first_posterior": float(np.exp(first[1] - np.logaddexp(*first))),
        }
    )


def _bordered(sequences: DataFrame, chunk: int) -> DataFrame:
    """The parts with their borders. Null and empty sequences have none."""
    kernels.bound_batches(sequences)
    parts = _parts(sequences.where(F.length("seq") > 0), chunk)
    borders = written(_matrices(parts).groupBy("row").applyInPandas(_borders, BORDERS), "state-borders")
    return parts.join(borders, ["row", "at"]).select("row", "acc", "at", "part", *[c for c in borders.columns if c not in ("row", "at")])


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for r in batch.to_pylist():
        path, posterior = decode_part(r["part"], np.array(r["v"]), np.array(r["f"]), np.array(r["b"]), r["state"]) if r["part"] else (np.zeros(0, np.int32), np.zeros(0))
        if r["at"] == 1:
            path, posterior = np.append(np.int32(r["first_state"]), path), np.append(r["first_posterior"], posterior)
        yield r, path, posterior


def hidden_state_parts(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """acc, start, path, posterior: the states and posteriors of each stretch of about ``chunk`` letters, from place ``start`` on.

    Accessions may repeat or be null: each row is a sequence. Null and empty sequences have no stretch. Ties of paths go to
    state 0; paths whose sums differ by no more than rounding may be told either way.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, path, posterior in _decoded(batch):
                start = r["at"] if r["at"] > 1 else 0
                yield pa.RecordBatch.from_arrays([pa.array([r["acc"]], pa.string()), pa.array([start], pa.int64()), pa.array([path.tolist()], pa.list_(pa.int32())), pa.array([posterior.tolist()], pa.list_(pa.float64()))], ["acc", "start", "path", "posterior"])

    return _bordered(sequences, chunk).mapInArrow(run, "acc string, start long, path array<int>, posterior array<double>")


def hidden_state_summary(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """acc, score, viterbi_score, prion_residues, high_posterior of every row.

    Sequences of up to ``chunk`` letters are decoded whole, longer ones by chunks. Null and empty sequences have nulls.
    """
    long = F.coalesce(F.length("seq"), F.lit(0)) > chunk

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(int(path.sum()), float(posterior.max())) for _, path, posterior in _decoded(batch)]
            named = {c: batch.column(batch.schema.get_field_index(c)) for c in ("row", "acc", "score", "viterbi_score")}
            yield pa.RecordBatch.from_arrays([*named.values(), pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.float64())], [*named, "n", "high"])

    parts = _bordered(sequences.where(long), chunk).mapInArrow(run, "row long, acc string, score double, viterbi_score double, n long, high double")
    summed = parts.groupBy("row", "acc", "score", "viterbi_score").agg(F.sum("n").alias("prion_residues"), F.max("high").alias("high_posterior")).drop("row")
    return kernels.hidden_state_summary(sequences.where(~long)).unionByName(summed)
