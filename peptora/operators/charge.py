"""Sequence charge decoration: sum over charged pairs i < j of q_i q_j sqrt(j - i), by length.

Written as a pair join this has the square of a protein's charges as rows. The sum only
depends on how often each distance occurs with which product, which is the autocorrelation of
the charges; one transform a protein gives it, without any pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptora.operators.kernels import bound_batches


def charge_decoration(sequences: DataFrame) -> DataFrame:
    """acc, scd. Null and empty sequences: null."""

    def scd(seq: str | None) -> float | None:
        if not seq:
            return None
        letters = np.frombuffer(seq.encode(), np.uint8)
        q = np.isin(letters, list(b"KR")).astype(float) - np.isin(letters, list(b"DE"))
        n = len(q)
        size = 1 << (2 * n - 1).bit_length()
        spectrum = np.abs(np.fft.rfft(q, size)) ** 2
        at_distance = np.rint(np.fft.irfft(spectrum, size)[1:n])  # whole numbers: products of -1, 0 and 1
        return float(at_distance @ np.sqrt(np.arange(1, n))) / n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scd(s.as_py()) for s in b.column(1)], pa.float64())], ["acc", "scd"])

    bound_batches(sequences)
    return sequences.select(F.col("acc").cast("string"), "seq").mapInArrow(run, "acc string, scd double")
