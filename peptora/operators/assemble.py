"""Joins that put feature tables together, caches, overlaps and label sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_matrix(native: DataFrame, imported: DataFrame, key: str = "acc") -> DataFrame:
    """All native rows with the imported columns; where both have a column the native one stays."""
    extra = [c for c in imported.columns if c == key or c not in native.columns]
    return native.join(imported.select(extra), key, "left")


def merge_feature(features: DataFrame, scalar: DataFrame | None, name: str, key: str = "acc") -> DataFrame:
    """Adds one feature from (key, value); without a table the column is null."""
    if scalar is None:
        return features.withColumn(name, F.lit(None).cast("double"))
    return features.drop(name).join(scalar.select(key, F.col("value").alias(name)), key, "left")


def recomputed_matrix(base: DataFrame, computed: Mapping[str, DataFrame], imported: DataFrame, choice: Mapping[str, str], key: str = "acc") -> DataFrame:
    """One row a key; each feature from its computed table or from the imported one, as chosen.

    All tables are joined on one key, so they share its partitioning.
    """
    out = base.select(key).distinct()
    for name, source in choice.items():
        table = computed[name] if source == "computed" else imported.select(key, F.col(name).alias("value"))
        out = merge_feature(out, table, name, key)
    return out


def without_match(left: DataFrame, right: DataFrame, key: str = "acc") -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.join(right, key, "left_anti").select(key).distinct()


def training_join(split: DataFrame, features: DataFrame) -> DataFrame:
    """On the accession, and on the task too where the features have one."""
    return split.join(features, ["acc", "task"] if "task" in features.columns else ["acc"])


def site_frequency(sites: DataFrame, sequences: DataFrame, organism: str) -> DataFrame:
    """acc, value: sites of the organism by residue; 0 without a site. Sites: acc, organism. Sequences: acc, n."""
    counted = sites.where(F.col("organism") == organism).groupBy("acc").agg(F.count("*").alias("sites"))
    return sequences.select("acc", "n").join(counted, "acc", "left").select("acc", (F.coalesce("sites", F.lit(0)).cast("double") / F.col("n")).alias("value"))


def lookup(features: DataFrame, scores: DataFrame, key: str = "acc") -> DataFrame:
    """Adds value and hit from (key, value); the join strategy follows the table's size."""
    return features.join(scores.select(key, "value").withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def label_table(sources: Sequence[tuple[str, DataFrame]], flags: Sequence[str]) -> DataFrame:
    """acc, source and flags: the first source that knows an accession decides; an absent flag is false."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.select("acc", *[(F.coalesce(F.col(f), F.lit(False)) if f in df.columns else F.lit(False)).alias(f) for f in flags]).withColumns({"source": F.lit(name), "_rank": F.lit(rank)})
        rows = part if rows is None else rows.unionByName(part)
    # The least row by rank, aggregated before the shuffle; flags of one source's repeats are joined by or.
    best = rows.groupBy("acc").agg(F.min("_rank").alias("_rank"))
    return rows.join(best, ["acc", "_rank"]).groupBy("acc", "source").agg(*[F.bool_or(f).alias(f) for f in flags])


def background_negatives(features: DataFrame, positives: DataFrame, needed: str | None = None) -> DataFrame:
    """Accessions with features that are in no positive set; ``needed``: and have this feature."""
    pool = features if needed is None else features.where(F.col(needed).isNotNull())
    return pool.join(positives, "acc", "left_anti").select("acc").distinct()


def shared_sequences(train: DataFrame, test: DataFrame) -> DataFrame:
    """sequence_hash, train_acc, test_acc, train_label, test_label: every pair of rows with one sequence in both parts."""
    hashed = lambda df, side: df.select(F.sha2("seq", 256).alias("sequence_hash"), F.col("acc").alias(f"{side}_acc"), F.col("label").alias(f"{side}_label"))
    return hashed(train, "train").join(hashed(test, "test"), "sequence_hash")


def sequence_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """sequences, pairs, conflicts of shared sequences, from counts a sequence: pairs are not listed.

    A conflict is a sequence that is positive in training and negative in the test part.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.sha2("seq", 256).alias("h")).agg(F.count("*").alias(f"{name}_rows"), F.max(F.col("label") == 1).alias(f"{name}_pos"), F.max(F.col("label") == 0).alias(f"{name}_neg"))

    both = side(train, "train").join(side(test, "test"), "h")
    return both.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(F.col("train_rows") * F.col("test_rows")), F.lit(0)).alias("pairs"), F.count_if(F.col("train_pos") & F.col("test_neg")).alias("conflicts"))


def usable_rows(split: DataFrame, features: DataFrame, names: Sequence[str], order: str) -> DataFrame:
    """Joined rows with any feature, the first of each accession."""
    got = split.join(features, "acc", "left").where(F.coalesce(*names).isNotNull())
    return got.withColumn("_rank", F.row_number().over(Window.partitionBy("acc").orderBy(order))).where("_rank = 1").drop("_rank")


def last_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a null order comes last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), F.col(order))).alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def resolve_cached(asked: DataFrame, cache: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """``asked`` with the cached columns and cached = whether a row for the same keys exists. Of repeated keys the last by ``order`` counts, or any."""
    rest = [c for c in cache.columns if c not in keys]
    if rest:
        last = F.max_by(F.struct(*rest), order) if order else F.max(F.struct(*rest))
        cache = cache.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    else:
        cache = cache.distinct()
    return asked.join(cache.withColumn("cached", F.lit(True)), list(keys), "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def memoised(asked: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame], parameters: str, version: str) -> DataFrame:
    """``asked`` (acc, ... and ord, its place) with the columns that ``compute`` gives for acc, and cached; in order of ord.

    The store keeps one row for each (acc, parameters, version): what it has is joined, only accessions that it lacks are
    computed, each once, and written back as a run of its own. Of accessions that several runs wrote (two at a time may)
    the last run counts. Only the folder of these parameters and this version is read. A null acc is computed each time.
    """
    spark = asked.sparkSession
    folder = f"{store}/parameters={parameters}/version={version}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    have = spark.read.parquet(folder) if there else None
    run = (have.agg(F.max("run")).first()[0] or 0) + 1 if there else 1
    once = asked.dropDuplicates(["acc"])
    missed = once.join(have.select("acc"), "acc", "left_anti") if there else once
    if not missed.isEmpty():
        compute(missed).withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(folder)
    have = spark.read.parquet(folder) if there or path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else compute(missed).withColumn("run", F.lit(run).cast("long"))
    last = F.max_by(F.struct(*[c for c in have.columns if c != "acc"]), "run").alias("_last")
    have = have.groupBy(F.col("acc").alias("_acc")).agg(last)
    got = asked.join(have, F.col("acc").eqNullSafe(F.col("_acc")), "left").withColumn("cached", F.coalesce(F.col("_last.run") < run, F.lit(False)))
    made = [c for c in have.schema["_last"].dataType.names if c != "run" and c not in asked.columns]
    return got.select(*asked.columns, *[F.col(f"_last.{c}").alias(c) for c in made], "cached").orderBy("ord")


def sheets_to_splits(sheets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(sheet, acc, …) to task, split, label, acc, sheet: one sheet may feed several tasks, so rows multiply."""
    return sheets.where("acc is not null and trim(acc) != ''").join(catalogue, "sheet")


def sheets_with_features(sheets: Mapping[str, DataFrame], catalogue: DataFrame) -> DataFrame:
    """As sheets_to_splits over tables whose columns differ: an absent one is null."""
    rows = None
    for name, df in sheets.items():
        part = df.withColumn("sheet", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return sheets_to_splits(rows, catalogue)


def compare_to_targets(measured: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """name, value, target, verdict: pass or fail by absolute difference, skip where either is missing."""
    got = targets.join(measured, "name", "left")
    near = F.abs(F.col("value") - F.col("target")) <= tolerance
    return got.withColumn("verdict", F.when(near.isNull(), "skip").when(near, "pass").otherwise("fail"))
