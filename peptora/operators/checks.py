"""Selections, contracts and counts over feature and training tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptora.functions import sequence as S

#: What a feature is computed from, by name; only the asked ones are built.
BUILDERS = {
    "length": lambda s: F.length(s).cast("long"),
    "fcr": S.charged_fraction,
    "hydropathy": S.hydropathy,
    "ncpr": lambda s: S.charge_metrics(s)["ncpr"],
    "aromatic": lambda s: S.charge_metrics(s)["aromatic"],
    "glycine": lambda s: S.fraction_of(s, "G"),
}


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def select_features(sequences: DataFrame, names: Sequence[str] | str, column: str = "seq") -> DataFrame:
    """acc and the named features (``all``: every one there is)."""
    names = list(BUILDERS) if names == "all" else list(names)
    unknown = [n for n in names if n not in BUILDERS]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return sequences.select("acc", *[BUILDERS[n](F.col(column)).alias(n) for n in names])


def select_and_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Exactly these columns; what can't be read as its type, and empty text, is null."""
    require_columns(df, list(types))
    pick = lambda c, t: F.nullif(F.col(c), F.lit("")) if t == "string" else F.col(c).try_cast(t)
    return df.select(*[pick(c, t).alias(c) for c, t in types.items()])


def contract_violations(df: DataFrame, tasks: Sequence[str], key: str = "acc") -> DataFrame:
    """violation, n: one pass over (task, label, key)."""
    found = {
        "label not 0 or 1": F.count_if(~F.col("label").isin(0, 1)),
        "unknown task": F.count_if(~F.col("task").isin(*tasks)),
        "repeated key": F.count("*") - F.count_distinct("task", key),
        "missing key": F.count_if(F.col(key).isNull() | (F.col(key) == "")),
    }
    row = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(found.values())])
    stack = ", ".join(f"'{name}', c{k}" for k, name in enumerate(found))
    return row.selectExpr(f"stack({len(found)}, {stack}) as (violation, n)")


def task_frame(df: DataFrame, task: str, allowed: Sequence[str] = ("SaPS", "PdPS", "hSaPS", "hPdPS")) -> DataFrame:
    if task not in allowed:
        raise ValueError(f"unknown task: {task}")
    return df.where(F.col("task") == task)


def split_classes(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Positive and negative rows with the features as doubles."""
    typed = df.withColumns({f: F.col(f).cast("double") for f in features})
    return typed.where("label = 1"), typed.where("label = 0")


def missing_features(df: DataFrame, names: Sequence[str], key: str = "acc") -> DataFrame:
    """key, missing: the absent features of each row that lacks any."""
    absent = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    return df.select(key, absent.alias("missing")).where(F.size("missing") > 0)


def with_model_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All of a model's columns in its order, the absent ones null."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, missing: nulls of each column, in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") as (name, missing)")


def duplicate_audit(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("keys"), (F.count("*") - F.count_distinct(key)).alias("surplus"))


def class_balance(df: DataFrame, by: Sequence[str], ratio: int = 2) -> DataFrame:
    """positives, negatives, pos_weight and the negatives that each of the ensemble's models gets."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    got = df.groupBy(*by).agg(pos.alias("positives"), neg.alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return got.withColumn("pos_weight", F.when(p > 0, n.cast("double") / p)).withColumn("negatives_per_model", F.least(ratio * p, n))


def value_sets(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def dump_statistics(df: DataFrame, score: str, array: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("entries"), F.count(score).alias("with_score"), F.count(array).alias("with_array"), F.sum(F.size(array).cast("long")).alias("array_values"),
        F.count_if(F.col(array).isNull() | (F.size(array) <= 0)).alias("errors"),
    )


def preview(df: DataFrame, key: str, most: int) -> DataFrame:
    """total, preview: how many there are, and the first keys."""
    first = df.select(key).orderBy(key).limit(most).agg(F.sort_array(F.collect_list(key)).alias("preview"))
    return df.agg(F.count("*").alias("total")).join(first)


def first_rows(df: DataFrame, by: Sequence[str], order: str, most: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_rank") <= most).drop("_rank")


def search(df: DataFrame, column: str, word: str, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows whose column holds the word, whatever its case, and one row more if there is more."""
    if len(word) < 2:
        raise ValueError("a search needs two characters or more")
    return df.where(F.contains(F.lower(column), F.lit(word.lower()))).orderBy(order).offset(offset).limit(limit + 1)


def batch_get(df: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Rows of the asked keys in any case; an absent one has found = false."""
    wanted = asked.select(F.upper(key).alias("_key")).distinct()
    have = df.withColumn("_key", F.upper(key)).withColumn("found", F.lit(True))
    return wanted.join(have, "_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def in_all(df: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """Keys that occur in each of ``n`` groups."""
    return df.groupBy(key).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") == n).select(key)


def set_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n and an order-free digest of the rows: the sum of 60 bits of each row's SHA-256, so that equal rows count each."""
    row = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"))
