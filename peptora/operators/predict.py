"""One plan from sequences to scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptora.functions import sequence as S
from peptora.operators.assemble import feature_matrix
from peptora.operators.audit import stale_models
from peptora.operators.checks import with_model_columns
from peptora.operators.learn import ensemble_scores
from peptora.operators.residues import protein_scores
from peptora.sources.shared import written


def computed_features(records: DataFrame, route: str = "paper") -> DataFrame:
    """acc, n, fcr, hydropathy, granule of (acc, seq): hydropathy and granule are null where a letter is no residue."""
    s = F.col("seq")
    native = records.where("seq != ''").select("acc", F.length(s).cast("long").alias("n"), S.charged_fraction(s).alias("fcr"), S.hydropathy(s).alias("hydropathy"))
    scored = protein_scores(records.where(F.coalesce(S.is_standard(s), F.lit(False))), route).select("acc", F.col("score").alias("granule"))
    return native.join(scored, "acc", "left")


def predict(records: DataFrame, members: DataFrame, manifests: DataFrame, task: str, model_columns: Sequence[str], imported: DataFrame | None = None, version: str = "1", route: str = "paper") -> DataFrame:
    """acc, the features, missing (names of the model's absent ones), score and stale, a row a record.

    Of a repeated accession the first record in file order counts; a record without residues has
    no row. The model's own columns win: those that neither computed nor imported features have are
    missing for all. Null where no member of the task's ensemble is given. Rows carry ``ord``, the record's place, to sort by.
    """
    first = records.where("seq != ''").withColumn("ord", F.monotonically_increasing_id()).groupBy("acc").agg(F.min_by(F.struct("seq", "ord"), "ord").alias("r"))
    once = written(first.select("acc", "r.seq", "r.ord"), "records")
    have = computed_features(once, route)
    if imported is not None:
        have = feature_matrix(have, imported)
    have = with_model_columns(have, model_columns).join(once.select("acc", "ord"), "acc").withColumn("task", F.lit(task))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in model_columns]))
    scored = ensemble_scores(have, members.where(F.col("task") == task), model_columns)
    stale = stale_models(manifests.where(F.col("task") == task), version)
    return have.withColumn("missing", missing).join(scored, ["task", "acc"], "left").join(F.broadcast(stale.limit(1)), "task", "left")
