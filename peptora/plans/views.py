"""Protein-like views of the given tables: whole texts stand in for sequences, and SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.functions.sequence import letters
from peptora.operators.residues import residues
from peptora.functions.tables import HYDROPATHY10, RESIDUES, granule10000, prion_ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, bound: bool = False) -> DataFrame:
    """acc, raw (all letters), seq (those of the 20 residues), organism, source, doc_id; ``bound``: also _most, which no seq is longer than.

    Each is one replacement over the text, and a search that ends at the first residue tells which texts have any.
    """
    either = RESIDUES + RESIDUES.lower()
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(f"[{either}]"))
    more = [F.octet_length(text).alias("_most")] if bound else []
    return docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"), letters(text).alias("raw"), F.upper(F.regexp_replace(text, f"[^{either}]+", "")).alias("seq"), F.col("lang").alias("organism"), "source", "doc_id", *more)


def residue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues(sequences(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acc, task, label: quality stands for SaPS, toxic for PdPS."""
    found = table(spark, sf_dir, "labels").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"), F.expr("stack(2, 'SaPS', quality, 'PdPS', toxic) as (task, label)"))
    return found.where("label is not null").select("acc", "task", F.col("label").cast("int").alias("label"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acc and five plain features: n, fcr, hydropathy, ncpr, glycine; hydropathy is null where a letter is no residue."""
    from peptora.functions import sequence as S

    s, raw = F.col("seq"), F.col("raw")
    return sequences(spark, sf_dir).select("acc", "organism", F.length(s).cast("long").alias("n"), S.charged_fraction(s).alias("fcr"), S.hydropathy(raw).alias("hydropathy"), S.charge_metrics(s)["ncpr"].alias("ncpr"), S.fraction_of(s, "G").alias("glycine"))


SEQ = """v_seq AS (
  SELECT 'D' || doc_id AS acc, raw, regexp_replace(raw, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq, lang AS organism, source, doc_id
  FROM (SELECT *, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS raw FROM documents)
  WHERE regexp_replace(raw, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') <> '')"""


def _values(name: str, scale: dict) -> str:
    rows = ", ".join(f"('{a}', {v!r})" if isinstance(v, int) else f"('{a}', CAST({v!r} AS DOUBLE))" for a, v in scale.items())
    return f"{name}(aa, v) AS (VALUES {rows})"


RES = f"""{SEQ},
{_values("t_granule", granule10000())},
{_values("t_hydro", HYDROPATHY10)},
{_values("t_prion", prion_ratio())},
v_res0 AS (SELECT acc, length(seq) AS n, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS aa FROM v_seq),
v_res AS (
  SELECT r.acc, r.n, r.pos, r.aa, g.v AS granule, h.v AS hydro, p.v AS prion,
         CASE WHEN r.aa IN ('K', 'R') THEN 1 WHEN r.aa IN ('D', 'E') THEN -1 ELSE 0 END AS charge
  FROM v_res0 r JOIN t_granule g USING (aa) JOIN t_hydro h USING (aa) JOIN t_prion p USING (aa)),
v_w AS (
  SELECT *, least(pos, 3) + least(n - 1 - pos, 3) + 1 AS w,
         CAST(sum(granule) OVER (PARTITION BY acc ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS DOUBLE) / (least(pos, 3) + least(n - 1 - pos, 3) + 1) / 10000.0::DOUBLE AS score
  FROM v_res)"""

FEAT = f"""{SEQ},
v_feat AS (
  SELECT acc, organism, length(seq) AS n,
         length(regexp_replace(seq, '[^DEKR]', '', 'g'))::DOUBLE / length(seq) AS fcr,
         CASE WHEN regexp_full_match(raw, '[ACDEFGHIKLMNPQRSTVWY]+') THEN ((
           {" + ".join(f"{v} * length(regexp_replace(raw, '[^{a}]', '', 'g'))" for a, v in HYDROPATHY10.items())})::DOUBLE / 10.0::DOUBLE / length(raw) + 4.5::DOUBLE) / 9.0::DOUBLE END AS hydropathy,
         (length(regexp_replace(seq, '[^KR]', '', 'g')) - length(regexp_replace(seq, '[^DE]', '', 'g')))::DOUBLE / length(seq) AS ncpr,
         length(regexp_replace(seq, '[^G]', '', 'g'))::DOUBLE / length(seq) AS glycine
  FROM v_seq)"""

LABEL = """v_label AS (
  SELECT 'D' || doc_id AS acc, 'SaPS' AS task, quality AS label FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT 'D' || doc_id, 'PdPS', toxic FROM labels WHERE toxic IS NOT NULL)"""
