"""Labelled rows for the classifiers: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32 of doc_id's decimal text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, by_class: bool) -> DataFrame:
    """doc_id, text, label of at most ``most`` rows (``by_class``: of either class) outside the held fold.

    The rows with the least hash of doc_id are taken, so the choice doesn't follow how rows
    are dealt. Labels other than 0 and 1, null doc_ids and labels without a document are left
    out; a doc_id that is labelled twice counts once, by its greater label.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold(modulus) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    least = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = least(known.where("label = 0")).union(least(known.where("label = 1"))) if by_class else least(known)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 x most rows of two numbers are broadcast.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
