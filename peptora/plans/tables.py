"""Queries of joins, caches, labels, sampling, metrics, audits and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.functions import sequence as S
from peptora.functions.tables import NORMALISATION
from peptora.operators import assemble as A
from peptora.operators import audit, boost, checks, kernels, learn, metrics, sampling
from peptora.operators import residues as R
from peptora.plans.views import FEAT, LABEL, RES, SEQ, features, labels, sequences, table
from peptora.sources import files
from peptora.sources.shared import new_path, written
from peptora.streaming import arrivals

QUERIES: dict = {}
SQL: dict[str, str] = {}
D = "::DOUBLE"
PLAIN = ["n", "fcr", "ncpr", "glycine"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("acc"), F.col("p_retailprice").alias("value"))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("acc"), F.col("event_type").alias("organism"))


LOOKUP = "v_lookup AS (SELECT 'D' || p_partkey AS acc, p_retailprice AS value FROM part)"
SITES = "v_site AS (SELECT 'D' || user_id AS acc, event_type AS organism FROM events)"


@query("a04_last_record", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_record(spark: SparkSession, d: str) -> DataFrame:
    return A.last_of_each(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", r6("value").alias("value"))


CATALOGUE = [("en", "SaPS", "train", 1), ("de", "PdPS", "train", 1), ("fr", "SaPS", "train", 0), ("fr", "PdPS", "train", 0), ("es", "SaPS", "test", 1), ("es", "PdPS", "test", 1)]
CATALOGUE_SQL = "cat(sheet, task, split, label) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {e})" for a, b, c, e in CATALOGUE) + ")"


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "sheet string, task string, split string, label int")


@query("a10_sheets", f"WITH {CATALOGUE_SQL} SELECT 'D' || doc_id AS acc, sheet, task, split, label FROM documents JOIN cat ON lang = sheet")
def sheets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"), F.col("lang").alias("sheet"))
    return A.sheets_to_splits(rows, _catalogue(spark)).select("acc", "sheet", "task", "split", F.col("label").cast("int").alias("label"))


@query("a11_feature_sheets", f"""
WITH {CATALOGUE_SQL}, s AS (SELECT 'en' AS sheet, 'S' || s_suppkey AS acc, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'fr', 'C' || c_custkey, c_acctbal, c_mktsegment FROM customer)
SELECT acc, sheet, task, round(balance, 6) AS balance, segment FROM s JOIN cat USING (sheet)""")
def feature_sheets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("acc"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("acc"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return A.sheets_with_features({"en": s, "fr": c}, _catalogue(spark)).select("acc", "sheet", "task", r6("balance").alias("balance"), "segment")


@query("a17_label_sources", "SELECT 'D' || doc_id AS acc, lang = 'en' AS human, quality = 1 AS self, toxic = 1 AS partner FROM labels JOIN documents USING (doc_id)")
def label_sources(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return got.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"), files.species_is(F.col("lang"), "en").alias("human"), (F.col("quality") == 1).alias("self"), (F.col("toxic") == 1).alias("partner"))


@query("a25_sealed_lists", f"WITH {LABEL} SELECT DISTINCT task, label, acc FROM v_label ORDER BY task, label, acc")
def sealed_lists(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).select("task", "label", "acc").distinct().orderBy("task", "label", "acc")


@query("a27_cache_report", f"WITH {LABEL} SELECT 'D' || doc_id AS acc, CASE WHEN 'D' || doc_id IN (SELECT acc FROM v_label) THEN 'cached' ELSE 'not cached' END AS status FROM documents")
def cache_report(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"))
    return files.cache_report(asked, labels(spark, d))


@query("c01_feature_matrix", f"WITH {FEAT}, {LOOKUP} SELECT f.acc, n, round(fcr, 6) AS fcr, round(value, 6) AS value FROM v_feat f LEFT JOIN v_lookup USING (acc)")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    imported = _lookup(spark, d).withColumn("n", F.lit(-1))
    return A.feature_matrix(features(spark, d), imported).select("acc", "n", r6("fcr").alias("fcr"), r6("value").alias("value"))


@query("c02_split_sequences", f"WITH {SEQ}, {LABEL} SELECT task, label, count(*) AS row_count, count(seq) AS found, count(*) - count(seq) AS missing, sum(length(seq))::BIGINT AS residues FROM v_label LEFT JOIN v_seq USING (acc) GROUP BY task, label")
def split_sequences(spark: SparkSession, d: str) -> DataFrame:
    got = labels(spark, d).join(sequences(spark, d).select("acc", "seq"), "acc", "left")
    return got.groupBy("task", "label").agg(F.count("*").alias("row_count"), F.count("seq").alias("found"), (F.count("*") - F.count("seq")).alias("missing"), F.sum(F.length("seq").cast("long")).alias("residues"))


@query("c03_merge_feature", f"WITH {FEAT}, {LOOKUP} SELECT f.acc, round(value, 6) AS deep, CAST(NULL AS DOUBLE) AS none FROM v_feat f LEFT JOIN v_lookup USING (acc)")
def merge_feature(spark: SparkSession, d: str) -> DataFrame:
    got = A.merge_feature(features(spark, d).select("acc"), _lookup(spark, d), "deep")
    return A.merge_feature(got, None, "none").select("acc", r6("deep").alias("deep"), "none")


@query("c04_recomputed_matrix", f"""
WITH {FEAT}, {LOOKUP}, {SITES}, s AS (SELECT acc, count(*) FILTER (WHERE organism = 'click'){D} AS sites FROM v_site GROUP BY acc)
SELECT f.acc, round(glycine, 6) AS glycine, round(ncpr, 6) AS ncpr, round(coalesce(sites, 0) / n, 6) AS phos, round(value, 6) AS deep FROM v_feat f LEFT JOIN s USING (acc) LEFT JOIN v_lookup USING (acc)""")
def recomputed_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    of = lambda c: f.select("acc", F.col(c).alias("value"))
    got = A.recomputed_matrix(f, {"glycine": of("glycine"), "ncpr": of("ncpr"), "phos": A.site_frequency(_sites(spark, d), f, "click")}, _lookup(spark, d).withColumnRenamed("value", "deep"), {"glycine": "computed", "ncpr": "computed", "phos": "computed", "deep": "imported"})
    return got.select("acc", *[r6(c).alias(c) for c in ("glycine", "ncpr", "phos", "deep")])


@query("c05_training_join", f"WITH {FEAT}, {LABEL} SELECT task, label, count(*) AS row_count, round(avg(fcr), 6) AS fcr FROM v_label JOIN v_feat USING (acc) GROUP BY task, label")
def training_join(spark: SparkSession, d: str) -> DataFrame:
    return A.training_join(labels(spark, d), features(spark, d)).groupBy("task", "label").agg(F.count("*").alias("row_count"), r6(F.avg("fcr")).alias("fcr"))


@query("c06_site_frequency", f"WITH {FEAT}, {SITES}, s AS (SELECT acc, count(*) AS sites FROM v_site WHERE organism = 'purchase' GROUP BY acc) SELECT f.acc, round(coalesce(sites, 0){D} / n, 6) AS value FROM v_feat f LEFT JOIN s USING (acc)")
def site_frequency(spark: SparkSession, d: str) -> DataFrame:
    return A.site_frequency(_sites(spark, d), features(spark, d), "purchase").withColumn("value", r6("value"))


@query("c07_lookup", f"WITH {SEQ}, {LOOKUP} SELECT s.acc, round(value, 6) AS value, value IS NOT NULL AS hit FROM v_seq s LEFT JOIN v_lookup USING (acc)")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    return A.lookup(sequences(spark, d).select("acc"), _lookup(spark, d)).select("acc", r6("value").alias("value"), "hit")


@query("c09_label_precedence", f"""
WITH base AS (SELECT 'D' || doc_id AS acc, quality = 1 AS self, toxic = 1 AS partner FROM labels WHERE quality = 1),
second AS (SELECT 'D' || doc_id AS acc, FALSE AS self, toxic = 1 AS partner FROM labels),
third AS (SELECT 'D' || doc_id AS acc FROM documents)
SELECT acc, 'base' AS source, self, partner FROM base UNION ALL SELECT acc, 'second', self, partner FROM second WHERE acc NOT IN (SELECT acc FROM base)
UNION ALL SELECT acc, 'third', FALSE, FALSE FROM third WHERE acc NOT IN (SELECT acc FROM base) AND acc NOT IN (SELECT acc FROM second)""")
def label_precedence(spark: SparkSession, d: str) -> DataFrame:
    acc = F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc")
    found = table(spark, d, "labels")
    base = found.where("quality = 1").select(acc, (F.col("quality") == 1).alias("self"), (F.col("toxic") == 1).alias("partner"))
    return A.label_table([("base", base), ("second", found.select(acc, (F.col("toxic") == 1).alias("partner"))), ("third", table(spark, d, "documents").select(acc))], ["self", "partner"]).select("acc", "source", "self", "partner")


@query("c10_background_negatives", f"WITH {SEQ}, {LABEL}, {LOOKUP} SELECT acc FROM v_seq JOIN v_lookup USING (acc) WHERE acc NOT IN (SELECT acc FROM v_label WHERE label = 1)")
def background_negatives(spark: SparkSession, d: str) -> DataFrame:
    pool = A.merge_feature(sequences(spark, d).select("acc"), _lookup(spark, d), "deep")
    return A.background_negatives(pool, labels(spark, d).where("label = 1"), "deep")


PARTS = f"""{LABEL}, v_part AS (SELECT acc, seq, label, task, source FROM v_label JOIN v_seq USING (acc))"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    got = labels(spark, d).join(sequences(spark, d), "acc")
    return got.where("task = 'SaPS'"), got.where("task = 'PdPS'")


@query("c11_shared_accessions", f"WITH {LABEL} SELECT DISTINCT acc FROM v_label WHERE task = 'SaPS' AND label = 1 AND acc IN (SELECT acc FROM v_label WHERE task = 'PdPS' AND label = 0)")
def shared_accessions(spark: SparkSession, d: str) -> DataFrame:
    v = labels(spark, d)
    return v.where("task = 'SaPS' and label = 1").join(v.where("task = 'PdPS' and label = 0"), "acc", "left_semi").select("acc").distinct()


@query("c12_sequence_overlap", f"""
WITH {SEQ}, {PARTS}, p AS (SELECT a.seq, a.label AS la, b.label AS lb FROM v_part a JOIN v_part b USING (seq) WHERE a.task = 'SaPS' AND b.task = 'PdPS')
SELECT count(DISTINCT seq) AS sequences, count(*) AS pairs, count(DISTINCT seq) FILTER (WHERE conflict) AS conflicts FROM p JOIN (SELECT seq, bool_or(la = 1) AND bool_or(lb = 0) AS conflict FROM p GROUP BY seq) USING (seq)""")
def sequence_overlap(spark: SparkSession, d: str) -> DataFrame:
    return A.sequence_overlap(*_parts(spark, d))


@query("c13_prediction_table", f"WITH {FEAT} SELECT acc, n, round(1 / (1 + exp(-(fcr * 2 - 1))), 6) AS score FROM v_feat")
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    scores = f.select("acc", (1 / (1 + F.exp(-(F.col("fcr") * 2 - 1)))).alias("score"))
    return A.feature_matrix(scores, f).select("acc", "n", r6("score").alias("score"))


@query("c14_usable_rows", f"WITH {LABEL}, {LOOKUP} SELECT acc, task, round(value, 6) AS value FROM v_label JOIN v_lookup USING (acc) QUALIFY row_number() OVER (PARTITION BY acc ORDER BY task) = 1")
def usable_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.usable_rows(labels(spark, d), _lookup(spark, d), ["value"], "task").select("acc", "task", r6("value").alias("value"))


@query("c16_cached", "SELECT e.event_id, e.user_id, e.event_type, c.ck IS NOT NULL AS cached FROM events e LEFT JOIN (SELECT DISTINCT c_custkey AS ck, 'view' AS kind FROM customer) c ON e.user_id = ck AND e.event_type = kind")
def cached(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("event_type")).distinct()
    return A.resolve_cached(table(spark, d, "events").select("event_id", "user_id", "event_type"), have, ["user_id", "event_type"])


SCORED = f"""{FEAT}, {LABEL}, v_scored AS (SELECT task, acc, label, round(fcr, 3) AS score, glycine FROM v_label JOIN v_feat USING (acc))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).join(features(spark, d), "acc").select("task", "acc", "label", F.round("fcr", 3).alias("score"), "glycine")


AUC = f"""SELECT {{by}}, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0{D}) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {{by}} ORDER BY score) + (count(*) OVER (PARTITION BY {{by}}, score) - 1) / 2.0{D} AS r FROM {{rows}}) GROUP BY {{by}}"""


@query("d10_auc", f"WITH {SCORED} {AUC.format(by='task', rows='v_scored')}")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(_scored(spark, d), ["task"]).withColumn("auc", r6("auc"))


@query("d11_average_precision", f"""
WITH {SCORED}, t AS (SELECT task, score, count(*) FILTER (WHERE label = 1) AS p, count(*) AS c FROM v_scored GROUP BY task, score),
q AS (SELECT task, p, sum(p) OVER w{D} / sum(c) OVER w AS prec FROM t WINDOW w AS (PARTITION BY task ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT task, round(sum(p * prec) / sum(p), 6) AS ap FROM q GROUP BY task""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, d), ["task"]).withColumn("ap", r6("ap"))


FOLDS = f"""{SCORED}, v_fold AS (SELECT *, ntile(5) OVER (PARTITION BY task, label ORDER BY sha256('42:' || acc), acc) - 1 AS fold FROM v_scored)"""


@query("d12_fold_auc", f"WITH {FOLDS}, a AS ({AUC.format(by='task, fold', rows='v_fold')}) SELECT task, round(avg(auc), 5) AS auc, count(auc) AS folds FROM a GROUP BY task")
def fold_auc(spark: SparkSession, d: str) -> DataFrame:
    got = sampling.folds(_scored(spark, d), ["task", "label"], 5, 42)
    return metrics.fold_means(metrics.auc(got, ["task", "fold"]).withColumn("auc", r6("auc"))).withColumn("auc", F.round("auc", 5))


@query("d13_agreement", f"""
WITH {FEAT}, a AS (SELECT organism, fcr AS a, glycine AS b, abs(fcr - glycine) AS x, rank() OVER (PARTITION BY organism ORDER BY fcr) + (count(*) OVER (PARTITION BY organism, fcr) - 1) / 2.0{D} AS ra,
  rank() OVER (PARTITION BY organism ORDER BY glycine) + (count(*) OVER (PARTITION BY organism, glycine) - 1) / 2.0{D} AS rb FROM v_feat)
SELECT organism, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(1 - avg((b - a) * (b - a)) / var_pop(b), 4) AS r2, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.9), 6) AS q90 FROM a GROUP BY organism""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.agreement(features(spark, d).select("organism", F.col("fcr").alias("a"), F.col("glycine").alias("b")), ["organism"])
    return got.select("organism", "n", *[r6(c).alias(c) for c in ("pearson", "spearman", "median", "mean", "q90")], F.round("r2", 4).alias("r2"))


@query("d14_coverage", f"WITH {SEQ}, {LOOKUP} SELECT organism, count(*) AS archived, count(value) AS scored, round(count(value){D} / count(*), 6) AS share FROM v_seq LEFT JOIN v_lookup USING (acc) GROUP BY organism")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    got = A.lookup(sequences(spark, d).select("acc", "organism"), _lookup(spark, d))
    return metrics.coverage(got, "organism", "value").withColumn("share", r6("share"))


@query("d20_set_digest", f"WITH {SEQ} SELECT count(*) AS n, sum(('0x' || substr(sha256(acc || chr(9) || seq), 1, 15))::HUGEINT)::VARCHAR AS digest FROM v_seq")
def set_digest(spark: SparkSession, d: str) -> DataFrame:
    return checks.set_digest(sequences(spark, d), ["acc", "seq"])


@query("e23_negative_sets", f"""
WITH {LABEL}, k AS (SELECT task, least(2 * count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) AS k FROM v_label GROUP BY task)
SELECT task, model, acc FROM (SELECT task, acc, unnest(range(10)) AS model FROM v_label WHERE label = 0) JOIN k USING (task) QUALIFY row_number() OVER (PARTITION BY task, model ORDER BY sha256('42:' || model || ':' || acc), acc) <= k""")
def negative_sets(spark: SparkSession, d: str) -> DataFrame:
    v = labels(spark, d)
    sizes = checks.class_balance(v, ["task"]).select("task", F.col("negatives_per_model").alias("k"))
    return sampling.negative_sets(v.where("label = 0").select("task", "acc"), sizes, 10, 42).withColumn("model", F.col("model").cast("long"))


@query("e24_folds", f"WITH {LABEL} SELECT task, label, acc, ntile(5) OVER (PARTITION BY task, label ORDER BY sha256('42:' || acc), acc) - 1 AS fold FROM v_label")
def folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(labels(spark, d), ["task", "label"], 5, 42).select("task", F.col("label").cast("long").alias("label"), "acc", F.col("fold").cast("long").alias("fold"))


@query("e25_holdout", f"""
WITH {LABEL} SELECT task, label, acc, CASE WHEN row_number() OVER (PARTITION BY task, label ORDER BY sha256('42:' || acc), acc) <= greatest(1, round_even(count(*) OVER (PARTITION BY task, label) * 0.2{D}, 0)) THEN 'test' ELSE 'train' END AS part FROM v_label""")
def holdout(spark: SparkSession, d: str) -> DataFrame:
    return sampling.holdout(labels(spark, d), ["task", "label"], 0.2, 42).select("task", F.col("label").cast("long").alias("label"), "acc", "part")


@query("e26_organism_rank", f"WITH {FEAT} SELECT acc, organism, round(percent_rank() OVER (PARTITION BY organism ORDER BY fcr), 6) AS rnk FROM v_feat")
def organism_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percent_rank(features(spark, d).select("acc", "organism", "fcr"), ["organism"], "fcr", "rnk").select("acc", "organism", r6("rnk").alias("rnk"))


@query("e27_first_occurrence", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return A.first_occurrences(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("f04_batch_get", "WITH a AS (SELECT DISTINCT upper(n_name) AS k FROM nation) SELECT k, r_regionkey, r_regionkey IS NOT NULL AS found FROM a LEFT JOIN region ON upper(r_name) = k")
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    return checks.batch_get(have, "name", table(spark, d, "nation").select(F.lower("n_name").alias("name"))).select(F.col("_key").alias("k"), "r_regionkey", "found")


@query("c16_memo", f"WITH {FEAT} SELECT acc, n, round(fcr, 6) AS fcr, acc IN (SELECT acc FROM v_feat WHERE organism = 'en') AS cached FROM v_feat")
def memo(spark: SparkSession, d: str) -> DataFrame:
    """Records whose English ones were computed by a run before: only the others are computed now, and a third run computes nothing."""
    def compute(rows: DataFrame) -> DataFrame:
        return rows.select("acc", F.length("seq").cast("long").alias("n"), S.charged_fraction(F.col("seq")).alias("fcr"))

    store, asked = new_path(spark, "memo"), sequences(spark, d).select("acc", "seq", "organism", F.col("doc_id").alias("ord"))
    A.memoised(asked.where("organism = 'en'"), store, compute, "native", "1")
    return A.memoised(asked, store, compute, "native", "1").select("acc", "n", r6("fcr").alias("fcr"), "cached")


@query("h02_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(value) AS scored, count(*) FILTER (WHERE value IS NULL) AS missing_rows FROM events GROUP BY 1")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return arrivals.window_counts(table(spark, d, "events"), "ts", "value")


MEMBERS = [(m, f, w + 0.1 * m, c, s) for m in range(3) for f, w, c, s in (("", 0.2, 0.0, 1.0), ("fcr", 1.5, 0.2, 0.05), ("glycine", -0.7, 0.03, 0.01))]


@query("j05_ensemble", f"""
WITH {FEAT}, m(model, f, w, c, s) AS (VALUES {", ".join(f"({m}, '{f}', {w!r}{D}, {c!r}{D}, {s!r}{D})" for m, f, w, c, s in MEMBERS)})
SELECT acc, round(avg(1 / (1 + exp(-z))), 6) AS score FROM (SELECT acc, model, sum(CASE f WHEN '' THEN w WHEN 'fcr' THEN w * (fcr - c) / s ELSE w * (glycine - c) / s END) AS z FROM v_feat CROSS JOIN m GROUP BY acc, model) GROUP BY acc""")
def ensemble(spark: SparkSession, d: str) -> DataFrame:
    members = spark.createDataFrame([("SaPS", *m) for m in MEMBERS], learn.MEMBERS)
    rows = features(spark, d).withColumn("task", F.lit("SaPS"))
    return learn.ensemble_scores(rows, members, ["fcr", "glycine"]).select("acc", r6("score").alias("score"))


@query("j13_task_splits", f"""
WITH {LABEL}, pos AS (SELECT DISTINCT acc, 1 AS label FROM v_label WHERE task = 'SaPS' AND label = 1), neg AS (SELECT 'D' || doc_id AS acc, 0 AS label FROM documents WHERE 'D' || doc_id NOT IN (SELECT acc FROM pos)),
al AS (SELECT * FROM pos UNION ALL SELECT * FROM neg)
SELECT acc, label, 'SaPS' AS task, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || acc), acc) <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.2{D})) THEN 'test' ELSE 'train' END AS part FROM al""")
def task_splits(spark: SparkSession, d: str) -> DataFrame:
    flags = labels(spark, d).where("task = 'SaPS'").select("acc", (F.col("label") == 1).alias("self"))
    pool = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"))
    return learn.task_splits(flags, pool, "SaPS", "self").select("acc", F.col("label").cast("long").alias("label"), "task", "part")


@query("j15_leakage_layer", f"""
WITH {SEQ}, {PARTS}, a AS (SELECT * FROM v_part WHERE task = 'SaPS'), b AS (SELECT * FROM v_part WHERE task = 'PdPS'),
o AS (SELECT seq, bool_or(a.label = 1) AND bool_or(b.label = 0) AS conflict FROM a JOIN b USING (seq) GROUP BY seq),
r AS (SELECT 'shared accessions' AS name, (SELECT count(DISTINCT acc) FROM a WHERE acc IN (SELECT acc FROM b)) AS n, TRUE AS hard
  UNION ALL SELECT 'shared sequences', (SELECT count(*) FROM o), FALSE UNION ALL SELECT 'label conflicts', (SELECT count(*) FROM o WHERE conflict), FALSE)
SELECT 'leakage' AS layer, name, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS verdict, hard, n::VARCHAR AS measured, '0' AS threshold FROM r""")
def leakage_layer(spark: SparkSession, d: str) -> DataFrame:
    return audit.leakage_layer(*_parts(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).join(features(spark, d).select("acc", *PLAIN), "acc")


@query("j01_j02_single_model")
def single_model(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).where("task = 'SaPS'")
    return learn.apply(learn.train(rows, PLAIN), rows, PLAIN).select("acc", "label", r6("score").alias("score"))


@query("j03_cross_validation")
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    return learn.cross_validate(_labelled(spark, d), PLAIN).withColumn("auc", r6("auc"))


@query("j04_final_ensemble")
def final_ensemble(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    sizes = checks.class_balance(rows, ["task"]).select("task", F.col("negatives_per_model").alias("k"))
    negatives = sampling.negative_sets(rows.where("label = 0").select("task", "acc"), sizes, 10, 42)
    return boost.tree_scores(rows, learn.final_ensemble(rows, negatives, PLAIN), PLAIN).withColumn("score", r6("score"))


@query("j06_tuned_search")
def tuned_search(spark: SparkSession, d: str) -> DataFrame:
    """The reference's 100 trials of boosted models for every task, in stratified folds; see halving_search for the budgets."""
    return learn.halving_search(_labelled(spark, d), PLAIN).withColumns({c: r6(c) for c in ("auc", "rate", "ridge", "gamma", "lasso")})


#: Two trees of two models: task, model, then as in boost.NODES.
NODES = [
    (m, *node)
    for m in range(2)
    for node in [
        (-1, 0, None, None, None, None, None, -0.5 + m),
        (0, 0, "fcr", 0.25, True, 1, 2, 0.0), (0, 1, "hydropathy", 0.45, False, 3, 4, 0.0), (0, 2, None, None, None, None, None, 0.4), (0, 3, None, None, None, None, None, -0.6), (0, 4, None, None, None, None, None, 0.1 + m),
        (1, 0, "hydropathy", 0.42, True, 1, 2, 0.0), (1, 1, None, None, None, None, None, 0.2), (1, 2, "n", 900.0, True, 5, 6, 0.0), (1, 5, None, None, None, None, None, -0.3 * m), (1, 6, None, None, None, None, None, 0.7),
    ]
]
_sql = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else f"{x!r}{D}" if isinstance(x, float) else str(x)


@query("j02_tree_scores", f"""
WITH RECURSIVE {FEAT}, t(model, tree, node, feature, cut, missing_left, lft, rgt, value) AS (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in NODES)}),
x AS (SELECT acc, 'n' AS feature, n::DOUBLE AS v FROM v_feat UNION ALL SELECT acc, 'fcr', fcr FROM v_feat UNION ALL SELECT acc, 'hydropathy', hydropathy FROM v_feat),
walk AS (
  SELECT acc, model, tree, node FROM v_feat CROSS JOIN t WHERE node = 0
  UNION ALL
  SELECT w.acc, w.model, w.tree, CASE WHEN x.v IS NULL THEN CASE WHEN t.missing_left THEN t.lft ELSE t.rgt END WHEN x.v <= t.cut THEN t.lft ELSE t.rgt END
  FROM walk AS w JOIN t ON t.model = w.model AND t.tree = w.tree AND t.node = w.node AND t.feature IS NOT NULL JOIN x ON x.acc = w.acc AND x.feature = t.feature)
SELECT acc, round(avg(1 / (1 + exp(-z))), 6) AS score FROM (
  SELECT w.acc, w.model, sum(t.value) AS z FROM walk AS w JOIN t ON t.model = w.model AND t.tree = w.tree AND t.node = w.node AND t.feature IS NULL GROUP BY w.acc, w.model) GROUP BY acc""")
def tree_scores(spark: SparkSession, d: str) -> DataFrame:
    nodes = spark.createDataFrame([("SaPS", *n) for n in NODES], "task string, model int, " + boost.NODES)
    rows = features(spark, d).withColumn("task", F.lit("SaPS"))
    return boost.tree_scores(rows, nodes, ["n", "fcr", "hydropathy"]).select("acc", r6("score").alias("score"))


def _surrogate_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and a held-out fifth, with the granule score of each text."""
    rows = R.protein_scores(sequences(spark, d)).select("acc", "score").join(sequences(spark, d).select("acc", "seq"), "acc")
    rows = written(sampling.holdout(rows.withColumn("all", F.lit(1)), ["all"], 0.2, 42).drop("all"), "surrogate")
    return rows.where("part = 'train'"), rows.where("part = 'test'")


def _mapped(rows: DataFrame) -> DataFrame:
    return kernels.feature_map(rows.select("acc", "seq")).join(rows.select("acc", "score"), "acc")


@query("j08_surrogate")
def surrogate(spark: SparkSession, d: str) -> DataFrame:
    """The granule score from 181 features by boosted trees, for the texts held out."""
    train, test = _surrogate_parts(spark, d)
    return learn.surrogate_scores(learn.surrogate(_mapped(train)), _mapped(test)).select("acc", r6("score").alias("score"), r6("prediction").alias("prediction"))


@query("j11_surrogate_route")
def surrogate_route(spark: SparkSession, d: str) -> DataFrame:
    """Every text by the surrogate that was fitted on four fifths of them; the fit reads its rows several times, so the features are a table."""
    s = sequences(spark, d).select("acc", "seq")
    parts = sampling.holdout(R.protein_scores(s).select("acc", "score", F.lit(1).alias("all")), ["all"], 0.2, 42)
    mapped = written(kernels.feature_map(s), "features")
    train = written(mapped.join(parts.where("part = 'train'").select("acc", "score"), "acc"), "surrogate")
    return learn.routed_scores(mapped, "surrogate", model=learn.surrogate(train)).withColumn("score", r6("score"))


HELD = f"v_rank AS (SELECT acc, row_number() OVER (ORDER BY sha256('42:' || acc), acc) AS r, count(*) OVER () AS n_all FROM v_seq)"


@query("j09_linear_control", f"""
WITH {RES}, {HELD}, s AS (SELECT acc, (avg(score) + 0.25 * ln(n{D}) - {NORMALISATION['paper'][0]!r}) / {NORMALISATION['paper'][1]!r} AS score FROM v_w GROUP BY acc, n)
SELECT acc, round(score, 4) AS score, round(score, 4) AS prediction FROM s JOIN v_rank USING (acc) WHERE r <= greatest(1, round_even(n_all * 0.2{D}, 0))""")
def linear_control(spark: SparkSession, d: str) -> DataFrame:
    """Least squares over the seven columns: the formula is linear in them, so the fit finds it again and SQL has its values."""
    train, test = (rows.withColumns(learn.control_columns(F.col("seq"))) for rows in _surrogate_parts(spark, d))
    got = learn.linear_control(train, test, list(learn.control_columns(F.col("seq"))))
    return got.select("acc", F.round("score", 4).alias("score"), F.round("prediction", 4).alias("prediction"))


@query("j14_evaluation")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    members = learn.fit_members(rows.withColumn("model", F.lit(0)), PLAIN)
    scored = learn.ensemble_scores(rows, members, PLAIN, per_model=True)
    return learn.evaluation(scored, rows, PLAIN).withColumns({"auc": r6("auc"), "ap": r6("ap")})


@query("j16_consistency", f"""
WITH {LABEL}, m AS (SELECT task, count(*)::VARCHAR AS n_rows, max(label)::VARCHAR AS top FROM v_label GROUP BY task), x AS (SELECT task, 'n_rows' AS field, n_rows AS measured, '399' AS threshold FROM m UNION ALL SELECT task, 'top', top, '1' FROM m UNION ALL SELECT task, 'seed', NULL, '42' FROM m)
SELECT 'consistency' AS layer, task || '.' || field AS name, CASE WHEN measured IS NULL THEN 'skip' WHEN measured = threshold THEN 'pass' ELSE 'fail' END AS verdict, TRUE AS hard, measured, threshold FROM x""")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    manifests = labels(spark, d).groupBy("task").agg(F.count("*").alias("n_rows"), F.max("label").alias("top"))
    return audit.consistency_layer(manifests, {"n_rows": "399", "top": "1", "seed": "42"})


@query("d19_summary", f"""
WITH {SCORED}, a AS ({AUC.format(by='task', rows='v_scored')}), v AS (SELECT CASE WHEN abs(auc - 0.5) <= 0.2 THEN 'pass' ELSE 'fail' END AS verdict FROM a UNION ALL SELECT 'skip')
SELECT count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail') AS failed, count(*) FILTER (WHERE verdict = 'skip') AS skipped, 0::BIGINT AS hard_failed FROM v""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    measured = metrics.auc(_scored(spark, d), ["task"]).select(F.col("task").alias("name"), F.col("auc").alias("value"))
    targets = spark.createDataFrame([("SaPS", 0.5), ("PdPS", 0.5), ("hSaPS", 0.5)], "name string, target double")
    return audit.summary(audit.metric_layer(measured, targets, 0.2))


@query("j17_recomputed_metrics", f"""
WITH {SCORED}, a AS ({AUC.format(by='task', rows='v_scored')}), k AS (SELECT task, label, rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0{D} AS r FROM v_scored),
b AS (SELECT task, (sum(r) FILTER (label = 1) - p * (p + 1) / 2.0{D}) / (p * (count(*) - p)) AS auc FROM k JOIN (SELECT task, count(*) FILTER (label = 1) AS p FROM k GROUP BY task) USING (task) GROUP BY task, p)
SELECT task AS name, a.auc AS measured, round(b.auc, 6) AS recorded, CASE WHEN abs(a.auc - round(b.auc, 6)) <= 1e-9 THEN 'pass' ELSE 'fail' END AS verdict FROM a JOIN b USING (task)""")
def recomputed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AUC by rank sums against AUC by distinct thresholds, to 1e-9, with both values."""
    scored = _scored(spark, d)
    ranked = metrics.with_ranks(scored, ["task"], "score", "r").groupBy("task").agg(F.sum(F.when(F.col("label") == 1, F.col("r"))).alias("s"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    recorded = ranked.select(F.col("task").alias("name"), ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("target"))
    measured = metrics.auc(scored, ["task"]).select(F.col("task").alias("name"), F.col("auc").alias("value"))
    rows = audit.metric_layer(measured, recorded, 1e-9, "recomputed")
    return rows.select("name", r6(F.col("measured").cast("double")).alias("measured"), r6(F.col("threshold").cast("double")).alias("recorded"), "verdict")
