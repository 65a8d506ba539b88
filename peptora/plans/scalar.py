"""Queries of the whole-sequence expressions, checks on columns, sets, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptora.functions import sequence as S
from peptora.functions.tables import COIL_THRESHOLD, HYDROPATHY10, RESIDUES
from peptora.operators import checks
from peptora.plans.views import FEAT, LABEL, SEQ, features, labels, sequences, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
D = "::DOUBLE"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


HEADER = "CASE WHEN lang = 'en' THEN 'sp|D' || doc_id || '|' || source || ' text' WHEN lang = 'de' THEN 'tr|D' || doc_id || '|' || source WHEN lang = 'fr' THEN 'D' || doc_id || '.1+x more' ELSE 'D' || doc_id END"


@query("a02_accession", f"""
SELECT doc_id, CASE WHEN starts_with(h, 'sp|') OR starts_with(h, 'tr|') THEN split_part(h, '|', 2) ELSE regexp_extract(h, '^([A-Za-z0-9_.\\-]+)', 1) END AS strict_id,
       CASE WHEN starts_with(h, 'sp|') OR starts_with(h, 'tr|') THEN split_part(h, '|', 2) ELSE regexp_extract(h, '^(\\S+)', 1) END AS token_id
FROM (SELECT doc_id, {HEADER} AS h FROM documents)""")
def accessions(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.expr(HEADER).alias("h"))
    return h.select("doc_id", S.accession(F.col("h")).alias("strict_id"), S.accession(F.col("h"), strict=False).alias("token_id"))


@query("a03_normalise", """
SELECT doc_id, length(s) AS n, sha256(s) AS sequence_hash FROM (
  SELECT doc_id, upper(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z\\s]', '', 'g'), '\\s', '', 'g')) AS s FROM documents)""")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    s = S.normalised(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z\s]", ""))
    return table(spark, d, "documents").select("doc_id", F.length(s).cast("long").alias("n"), F.sha2(s, 256).alias("sequence_hash"))


@query("b01_b02_native", f"WITH {FEAT} SELECT acc, n, round(fcr, 6) AS fcr, round(hydropathy, 6) AS hydropathy FROM v_feat")
def native(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("acc", "n", r6("fcr").alias("fcr"), r6("hydropathy").alias("hydropathy"))


@query("b03_unsupported", f"""
WITH {SEQ} SELECT acc, string_agg(c, ',' ORDER BY c) AS letters FROM (
  SELECT DISTINCT acc, unnest(string_split(regexp_replace(raw, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), '')) AS c FROM v_seq) WHERE c <> '' GROUP BY acc""")
def unsupported(spark: SparkSession, d: str) -> DataFrame:
    bad = S.unsupported(F.col("raw"))
    return sequences(spark, d).withColumn("bad", bad).where(F.size("bad") > 0).select("acc", F.array_join("bad", ",").alias("letters"))


@query("b04_degrading", f"WITH {FEAT} SELECT organism, count(*) AS n, count(*) FILTER (WHERE hydropathy IS NULL) AS no_hydropathy, count(*) FILTER (WHERE fcr IS NULL) AS no_fcr FROM v_feat GROUP BY organism")
def degrading(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy("organism").agg(F.count("*").alias("n"), F.count_if(F.col("hydropathy").isNull()).alias("no_hydropathy"), F.count_if(F.col("fcr").isNull()).alias("no_fcr"))


@query("b05_charge_metrics", f"""
WITH {SEQ} SELECT acc, round(ncpr, 6) AS ncpr, round(abs(ncpr), 6) AS mean_net_charge, round(length(regexp_replace(seq, '[^FWY]', '', 'g')){D} / length(seq), 6) AS aromatic
FROM (SELECT *, (length(regexp_replace(seq, '[^KR]', '', 'g')) - length(regexp_replace(seq, '[^DE]', '', 'g'))){D} / length(seq) AS ncpr FROM v_seq)""")
def charge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("acc", *[r6(c).alias(k) for k, c in S.charge_metrics(F.col("seq")).items()])


@query("b06_charge_positions", f"""
WITH {SEQ}, r AS (SELECT acc, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS aa FROM v_seq)
SELECT acc, count(*) FILTER (WHERE aa IN ('D', 'E', 'K', 'R')) AS charged, count(*) FILTER (WHERE aa IN ('K', 'R')) AS n_positive, count(*) FILTER (WHERE aa IN ('D', 'E')) AS n_negative,
       coalesce(sum(pos) FILTER (WHERE aa IN ('K', 'R')), 0)::BIGINT AS positive_sum, coalesce(max(pos) FILTER (WHERE aa IN ('D', 'E')), -1)::BIGINT AS last_negative
FROM r GROUP BY acc""")
def charge_positions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    got = sequences(spark, d).select("acc", S.charge_labels(s).alias("label"), S.positions_of(s, "KR").alias("pos"), S.positions_of(s, "DE").alias("neg"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select(
        "acc", total("label").alias("charged"), F.size("pos").cast("long").alias("n_positive"), F.size("neg").cast("long").alias("n_negative"),
        total("pos").alias("positive_sum"), F.coalesce(F.array_max("neg"), F.lit(-1)).cast("long").alias("last_negative"),
    )


@query("b07_coil", f"SELECT vec_id, (list_max(embedding){D} >= {COIL_THRESHOLD}{D}){D} AS coil FROM embeddings")
def coil(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", S.binary_coil(F.col("embedding").cast("array<double>"), COIL_THRESHOLD).alias("coil"))


@query("b08_length_filters", f"""
WITH {SEQ} SELECT organism, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(raw, '[{RESIDUES}]+') AND length(raw) >= 60) AS surrogate, count(*) FILTER (WHERE length(raw) >= 20) AS coil,
  count(*) FILTER (WHERE length(raw) >= 140 AND NOT regexp_matches(raw, '[XBUZ]')) AS contacts, count(*) FILTER (WHERE length(raw) < 20) AS skipped FROM v_seq GROUP BY organism""")
def length_filters(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return sequences(spark, d).groupBy("organism").agg(
        F.count("*").alias("n"), F.count_if(S.is_standard(raw) & (F.length(raw) >= 60)).alias("surrogate"), F.count_if(F.length(raw) >= 20).alias("coil"),
        F.count_if((F.length(raw) >= 140) & ~raw.rlike("[XBUZ]")).alias("contacts"), F.count_if(F.length(raw) < 20).alias("skipped"),
    )


@query("b09_spans", f"""
WITH {SEQ} SELECT acc, greatest(length(seq) - 50, 0) AS n_profile, CASE WHEN length(seq) > 50 THEN 24 END AS first, CASE WHEN length(seq) > 50 THEN length(seq) - 27 END AS last,
  CASE WHEN length(seq) BETWEEN 1 AND length(raw) THEN length(raw) - length(seq) END AS suffix_first FROM v_seq""")
def spans(spark: SparkSession, d: str) -> DataFrame:
    span, suffix = S.profile_span(F.length("seq")), S.suffix_span(F.length("raw"), F.length("seq"))
    got = sequences(spark, d).select("acc", span.alias("span"), suffix.alias("suffix"))
    return got.select("acc", F.size("span").cast("long").alias("n_profile"), F.array_min("span").cast("long").alias("first"), F.array_max("span").cast("long").alias("last"), F.array_min("suffix").cast("long").alias("suffix_first"))


@query("b11_select_cast", """
SELECT event_id, try_cast(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS number, nullif(event_type, '') AS kind, value FROM events WHERE event_type IN ('purchase', 'click', 'view', 'login')""")
def select_cast(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "events").where(F.col("event_type").isin("purchase", "click", "view", "login")).withColumn("number", F.regexp_extract("props", "[0-9]+", 0)).withColumn("kind", F.col("event_type"))
    return checks.select_and_cast(got, {"event_id": "bigint", "number": "double", "kind": "string", "value": "double"})


@query("b12_contract", f"""
WITH {LABEL} SELECT 'label not 0 or 1' AS violation, count(*) FILTER (WHERE label NOT IN (0, 1)) AS n FROM v_label
UNION ALL SELECT 'unknown task', count(*) FILTER (WHERE task NOT IN ('SaPS', 'PdPS')) FROM v_label
UNION ALL SELECT 'repeated key', count(*) - count(DISTINCT (task, acc)) FROM v_label
UNION ALL SELECT 'missing key', count(*) FILTER (WHERE acc IS NULL OR acc = '') FROM v_label""")
def contract(spark: SparkSession, d: str) -> DataFrame:
    return checks.contract_violations(labels(spark, d), ["SaPS", "PdPS"])


@query("b13_task_frame", f"WITH {LABEL} SELECT acc, label FROM v_label WHERE task = 'PdPS'")
def task_frame(spark: SparkSession, d: str) -> DataFrame:
    return checks.task_frame(labels(spark, d), "PdPS").select("acc", F.col("label").cast("long").alias("label"))


@query("b14_split", f"""
WITH {LABEL}, {FEAT} SELECT task, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS side, count(*) AS n, round(avg(fcr), 6) AS fcr FROM v_label JOIN v_feat USING (acc) GROUP BY ALL""")
def split(spark: SparkSession, d: str) -> DataFrame:
    pos, neg = checks.split_classes(labels(spark, d).join(features(spark, d), "acc"), ["fcr"])
    both = pos.withColumn("side", F.lit("positive")).unionByName(neg.withColumn("side", F.lit("negative")))
    return both.groupBy("task", "side").agg(F.count("*").alias("n"), r6(F.avg("fcr")).alias("fcr"))


@query("b15_missing_report", f"""
WITH {FEAT} SELECT acc, concat_ws(',', CASE WHEN hydropathy IS NULL THEN 'hydropathy' END, CASE WHEN glycine = 0 THEN 'glycine' END) AS missing FROM v_feat WHERE hydropathy IS NULL OR glycine = 0""")
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    got = features(spark, d).withColumn("glycine", F.when(F.col("glycine") != 0, F.col("glycine")))
    return checks.missing_features(got, ["hydropathy", "glycine"]).select("acc", F.array_join("missing", ",").alias("missing"))


@query("b17_vocabulary", f"WITH {FEAT} SELECT acc, round(ncpr, 6) AS ncpr, round(glycine, 6) AS glycine FROM v_feat")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return checks.select_features(sequences(spark, d), ["ncpr", "glycine"]).select("acc", r6("ncpr").alias("ncpr"), r6("glycine").alias("glycine"))


@query("b18_species", "SELECT doc_id, lang = 'en' AS exact, contains(lang, 'e') AS held, coalesce(trim(lang) IN ('en', 'English'), false) AS named FROM documents")
def species(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents")
    return got.select("doc_id", (F.col("lang") == "en").alias("exact"), F.contains(F.col("lang"), F.lit("e")).alias("held"), F.coalesce(F.trim("lang").isin("en", "English"), F.lit(False)).alias("named"))


@query("d01_composition", f"WITH {SEQ} SELECT acc, " + ", ".join(f"round(length(regexp_replace(seq, '[^{a}]', '', 'g')){D} / length(seq), 6) AS {a.lower()}" for a in RESIDUES) + " FROM v_seq")
def composition(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("acc", *[r6(c).alias(a.lower()) for a, c in S.composition(F.col("seq")).items()])


@query("d15_missing_counts", """
SELECT 'text' AS name, count(*) FILTER (WHERE text IS NULL) AS missing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM documents
UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL) FROM documents""")
def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.missing_counts(table(spark, d, "documents"), ["text", "lang", "source", "n_chars"])


@query("d16_duplicates", "SELECT count(*) AS row_count, count(DISTINCT text) AS keys, count(*) - count(DISTINCT text) AS surplus FROM documents")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_audit(table(spark, d, "documents"), "text")


@query("d17_balance", f"""
WITH {LABEL} SELECT task, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives,
  round(count(*) FILTER (WHERE label = 0){D} / nullif(count(*) FILTER (WHERE label = 1), 0), 6) AS pos_weight, least(2 * count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) AS negatives_per_model FROM v_label GROUP BY task""")
def balance(spark: SparkSession, d: str) -> DataFrame:
    return checks.class_balance(labels(spark, d), ["task"]).withColumn("pos_weight", r6("pos_weight"))


@query("d18_label_sets", f"WITH {LABEL} SELECT acc, string_agg(DISTINCT task || label, ',' ORDER BY task || label) AS labels FROM v_label GROUP BY acc")
def label_sets(spark: SparkSession, d: str) -> DataFrame:
    return checks.value_sets(labels(spark, d).withColumn("v", F.concat("task", F.col("label").cast("string"))), "acc", "v").select("acc", F.array_join("values", ",").alias("labels"))


@query("d21_dump_statistics", "SELECT count(*) AS entries, count(label) AS with_score, count(embedding) AS with_array, sum(len(embedding))::BIGINT AS array_values, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) = 0) AS errors FROM embeddings")
def dump_statistics(spark: SparkSession, d: str) -> DataFrame:
    return checks.dump_statistics(table(spark, d, "embeddings"), "label", "embedding")


@query("f01_sorted_lists", "SELECT DISTINCT source, lang FROM documents ORDER BY 1, 2")
def sorted_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", "lang").distinct().orderBy("source", "lang")


@query("f02_preview", f"""
WITH {FEAT}, bad AS (SELECT acc FROM v_feat WHERE hydropathy IS NULL) SELECT (SELECT count(*) FROM bad) AS total, (SELECT string_agg(acc, ',' ORDER BY acc) FROM (SELECT acc FROM bad ORDER BY acc LIMIT 20)) AS preview""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return checks.preview(features(spark, d).where("hydropathy is null"), "acc", 20).select("total", F.array_join("preview", ",").alias("preview"))


@query("f03_first_negatives", f"WITH {LABEL} SELECT task, acc FROM v_label WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY task ORDER BY CAST(substr(acc, 2) AS BIGINT)) <= 25")
def first_negatives(spark: SparkSession, d: str) -> DataFrame:
    got = labels(spark, d).where("label = 0").withColumn("ord", F.substring("acc", 2, 20).cast("long"))
    return checks.first_rows(got, ["task"], "ord", 25).select("task", "acc")


@query("f04_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar') ORDER BY p_partkey LIMIT 11 OFFSET 5")
def search(spark: SparkSession, d: str) -> DataFrame:
    return checks.search(table(spark, d, "part"), "p_name", "AR", "p_partkey", 10, 5).select("p_partkey", "p_name")


@query("g01_union", "SELECT o_orderkey AS k, 'o' AS side FROM orders UNION ALL SELECT l_orderkey, 'l' FROM lineitem")
def union(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("o").alias("side"))
    return o.unionByName(table(spark, d, "lineitem").select(F.lit("l").alias("side"), F.col("l_orderkey").alias("k")))


@query("g02_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("g02_in_all_tasks", f"WITH {LABEL} SELECT acc FROM v_label WHERE label = 1 GROUP BY acc HAVING count(DISTINCT task) = 2")
def in_all_tasks(spark: SparkSession, d: str) -> DataFrame:
    return checks.in_all(labels(spark, d).where("label = 1"), "acc", "task", 2)


@query("g03_except", "SELECT 'D' || doc_id AS acc FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def except_(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    return got.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"))


@query("g04_subset", "SELECT (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier) WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS outside")
def subset(spark: SparkSession, d: str) -> DataFrame:
    inside = table(spark, d, "customer").select(F.col("c_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").select("s_nationkey").distinct().join(inside, "s_nationkey", "left_anti").agg(F.count("*").alias("outside"))


@query("g05_multiset_union", f"WITH {LABEL} SELECT acc, count(*) AS n FROM (SELECT acc FROM v_label WHERE label = 0 UNION ALL SELECT acc FROM v_label WHERE task = 'SaPS') GROUP BY acc")
def multiset_union(spark: SparkSession, d: str) -> DataFrame:
    v = labels(spark, d)
    return v.where("label = 0").select("acc").union(v.where("task = 'SaPS'").select("acc")).groupBy("acc").agg(F.count("*").alias("n"))


@query("s01_strings", "SELECT p_partkey, upper(trim(p_name)) AS name, replace(p_type, ' ', '_') AS kind, string_split(p_type, ' ')[1] AS first, starts_with(p_brand, 'Brand#1') AS one, regexp_extract(p_brand, '([0-9]+)$', 1) AS number FROM part")
def strings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"), F.split("p_type", " ")[0].alias("first"), F.startswith("p_brand", F.lit("Brand#1")).alias("one"), F.regexp_extract("p_brand", "([0-9]+)$", 1).alias("number"))


@query("s02_math", "SELECT event_id, round(ln(1 + abs(value)), 6) AS log, round(sqrt(abs(value)), 6) AS root, greatest(value, 1.0) AS high, least(value, 1.0) AS low FROM events")
def math_(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r6(F.log(1 + F.abs(v))).alias("log"), r6(F.sqrt(F.abs(v))).alias("root"), F.greatest(v, F.lit(1.0)).alias("high"), F.least(v, F.lit(1.0)).alias("low"))


@query("s03_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def hash_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("s04_arrays", f"SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_max(embedding){D}, 6) AS high, round(list_sum(list_transform(embedding[1:8], lambda x: x{D} * 2)), 4) AS head FROM embeddings")
def arrays(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    head = F.aggregate(F.transform(F.slice(e, 1, 8), lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), r6(F.array_max(e).cast("double")).alias("high"), F.round(head, 4).alias("head"))


@query("s05_json", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.map_values(m)[0].alias("first_value"), F.size(F.map_keys(m)).cast("long").alias("n_keys"))


@query("s06_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, year(ts) AS y, date_trunc('day', ts)::DATE AS day FROM events")
def dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.year("ts").cast("long").alias("y"), F.to_date("ts").alias("day"))
