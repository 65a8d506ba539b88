"""Queries of sources, sinks and streams: the given tables written in a source's format and read back by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.functions.sequence import accession
from peptora.functions.tables import HYDROPATHY10, NORMALISATION
from peptora.operators import audit, checks, metrics
from peptora.operators.predict import predict
from peptora.plans.tables import AUC, MEMBERS, SCORED, _lookup, _scored
from peptora.plans.views import FEAT, LABEL, RES, SEQ, features, labels, sequences, table
from peptora.operators.learn import MEMBERS as MEMBER_SCHEMA
from peptora.sources import files
from peptora.sources.objects import write_objects
from peptora.sources.shared import new_path
from peptora.streaming import arrivals

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


def r6(c) -> Column:
    return F.round(c, 6)


def write_lines(df: DataFrame, path: str, **options: str) -> str:
    df.write.options(**options).text(path)
    return path


def fasta_lines(df: DataFrame, seq: Column) -> DataFrame:
    """Records with 60 letters a line."""
    return df.select(F.concat(F.lit(">sp|"), "acc", F.lit("|TEXT of "), F.coalesce("organism", F.lit("")), F.lit("\n"), F.regexp_replace(seq, "(.{60})", "$1\n")).alias("value"))


@query("a01_fasta", f"WITH {SEQ} SELECT acc, length(seq) AS length, sha256(seq) AS sequence_hash FROM v_seq")
def fasta(spark: SparkSession, d: str) -> DataFrame:
    path = write_lines(fasta_lines(sequences(spark, d), F.col("seq")), new_path(spark, "fasta"))
    return files.read_fasta(spark, path, strict=True).select("acc", F.col("length").cast("long").alias("length"), "sequence_hash")


@query("a05_cache_write", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def cache_write(spark: SparkSession, d: str) -> DataFrame:
    """A cache written anew with a part of the records, appended with the others, and read: the last record of each key."""
    events, path = table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), new_path(spark, "cache")
    files.write_json_cache(events.where("event_type != 'click'"), path)
    files.write_json_cache(events.where("event_type = 'click' or event_type is null"), path, append=True)
    got = files.read_json_cache(spark, path, events.schema, "user_id", ["event_id"])
    return got.select("user_id", "event_id", "event_type", r6("value").alias("value"))


@query("a06_id_list", f"WITH {LABEL} SELECT DISTINCT acc FROM v_label")
def id_list(spark: SparkSession, d: str) -> DataFrame:
    """Accessions with comments behind them, comment lines and blank lines between."""
    lines = labels(spark, d).select(F.explode(F.array(F.concat(F.lit("# "), "task"), F.concat(F.lit(" "), "acc", F.lit(" # "), "task"), F.lit(""))).alias("value"))
    return files.read_id_file(spark, write_lines(lines, new_path(spark, "ids"))).select("acc")


@query("a07_sniffed_table", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def sniffed_table(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "table")
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.csv(path, sep=";", header=True)
    return files.read_table(spark, path)


@query("a08_a09_typed_table", f"WITH {FEAT} SELECT acc, organism, n, round(fcr, 6) AS fcr, round(hydropathy, 6) AS hydropathy FROM v_feat")
def typed_table(spark: SparkSession, d: str) -> DataFrame:
    """Written with missing values as empty fields, and read with the exact schema: doubles come back to the digit."""
    got, path = features(spark, d).select("acc", "organism", "n", "fcr", "hydropathy"), new_path(spark, "typed")
    files.write_typed(got, path, "acc")
    return files.read_typed(spark, path, got.schema).withColumns({"fcr": r6("fcr"), "hydropathy": r6("hydropathy")})


def banner_files(df: DataFrame, by: str, lines: list[str], row: Column, path: str, **options: str) -> str:
    """A file for each value of ``by``: the given lines first, then a line a row."""
    heads = df.select(by).distinct().select(by, F.posexplode(F.array(*map(F.lit, lines))).alias("ord", "value"))
    rows = df.select(by, F.lit(len(lines)).alias("ord"), row.alias("value"))
    heads.union(rows).repartition(by).sortWithinPartitions(by, "ord").select(by, "value").write.partitionBy(by).options(**options).text(path)
    return path


@query("a12_a13_site_table", "SELECT 'D' || user_id AS acc, 'S' || event_id || '-p' AS site, lower(event_type) AS organism FROM events")
def site_table(spark: SparkSession, d: str) -> DataFrame:
    """A gzip file for each kind of event, with a banner above the header."""
    events = table(spark, d, "events").select(F.col("event_type").alias("kind"), "user_id", "event_id", "event_type")
    row = F.concat_ws("\t", F.lit("G"), F.concat(F.lit("D"), F.col("user_id").cast("string")), F.concat(F.lit("S"), F.col("event_id").cast("string"), F.lit("-p")), F.upper("event_type"))
    return files.read_sites(spark, banner_files(events, "kind", ["042026", "notice", "", "GENE\tACC_ID\tMOD_RSD\tORGANISM"], row, new_path(spark, "sites"), compression="gzip"))


@query("a15_score_lookup", "SELECT 'D' || p_partkey AS acc, round(p_retailprice, 6) AS value FROM part")
def score_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Under the second spelling of the key; lines without a key or with an unreadable number go."""
    good = _lookup(spark, d).select("acc", F.col("value").cast("string").alias("value"))
    path = new_path(spark, "lookup")
    good.union(good.select(F.lit(""), "value")).union(good.select(F.concat(F.lit("bad"), "acc"), F.lit("none"))).toDF("Swiss-Prot ID", "DeepPhase_score").write.csv(path, sep="\t", header=True)
    return files.read_lookup(spark, path, ["Swiss-Prot_ID", "Swiss-Prot ID"], "DeepPhase_score").withColumn("value", r6("value"))


@query("a19_masked_fasta", """
SELECT 'D' || doc_id AS acc, length(t) AS size, length(regexp_replace(t, '[^a-zX]', '', 'g')) AS masked
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS t FROM documents) WHERE t <> ''""")
def masked_fasta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("acc"), F.col("lang").alias("organism"), F.regexp_replace("text", "[^A-Za-z]", "").alias("t")).where("t != ''")
    got = files.read_masked_fasta(spark, write_lines(fasta_lines(docs, F.col("t")), new_path(spark, "masked")))
    return got.select("acc", F.size("label").cast("long").alias("size"), F.aggregate("label", F.lit(0), lambda a, x: a + x).cast("long").alias("masked"))


@query("a20_prion_output", "SELECT 'D' || p_partkey AS acc, round(p_retailprice, 6) AS value FROM part WHERE p_size % 5 <> 0")
def prion_output(spark: SparkSession, d: str) -> DataFrame:
    """Comment lines and ragged rows (here those of every fifth size) are left out."""
    part = table(spark, d, "part").withColumn("one", F.lit("x"))
    row = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("sp|D"), F.col("p_partkey").cast("string"))).otherwise(F.concat_ws("\t", F.concat(F.lit("sp|D"), F.col("p_partkey").cast("string"), F.lit("|X")), F.lit("1"), F.col("p_retailprice").cast("string")))
    path = banner_files(part, "one", ["# comment", "SEQid\tMW\tNLLR"], row, new_path(spark, "prion"))
    return files.read_prion_output(spark, path).withColumn("value", r6("value"))


@query("a21_contact_output", "SELECT 'D' || p_partkey AS acc, round(p_retailprice, 6) AS value FROM part")
def contact_output(spark: SparkSession, d: str) -> DataFrame:
    lines = _lookup(spark, d).select(F.explode(F.array(F.lit("log"), F.concat(F.lit("PScore: "), F.col("value").cast("string"), F.lit(" value >sp|"), "acc", F.lit("|X")))).alias("value"))
    return files.read_contact_output(spark, write_lines(lines, new_path(spark, "contacts"))).withColumn("value", r6("value"))


@query("a24_csv_sink", f"WITH {FEAT} SELECT acc, organism, n::VARCHAR AS n, round(fcr, 6) AS fcr FROM v_feat")
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "scores")
    files.write_csv(features(spark, d).select("acc", "organism", "n", "fcr"), path)
    return spark.read.csv(path, header=True).withColumn("fcr", r6(F.col("fcr").cast("double")))


@query("a26_manifest", f"WITH {FEAT} SELECT 'features' AS name, count(*) AS row_count, 5 AS columns, true AS has_bytes, 'pass' AS verdict FROM v_feat")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The written table's size, counted in the files themselves, against an expected one."""
    path = new_path(spark, "features")
    got = features(spark, d).select("acc", "n", "fcr", "hydropathy", "ncpr")
    files.write_typed(got, path, "acc")
    row = audit.manifest_row(spark, "features", path, files.read_typed(spark, path, got.schema))
    expected = got.agg(F.lit("features").alias("name"), F.count("*").alias("row_count"), F.lit(5).alias("columns"))
    return audit.expected_sizes(row, expected).select("name", "row_count", F.col("columns").cast("long").alias("columns"), (F.col("bytes") > 0).alias("has_bytes"), "verdict")


@query("a28_report", f"""
WITH {SCORED}, a AS ({AUC.format(by='task', rows='v_scored')}), v AS (SELECT CASE WHEN abs(auc - 0.5) <= 0.2 THEN 'pass' ELSE 'fail' END AS verdict FROM a UNION ALL SELECT 'skip')
SELECT count(*) AS checks, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail') AS failed, count(*) FILTER (WHERE verdict = 'skip') AS skipped, '0.2' AS tolerance, (SELECT count(*) FROM v_scored)::VARCHAR AS scored_rows FROM v""")
def report(spark: SparkSession, d: str) -> DataFrame:
    scored, path = _scored(spark, d), new_path(spark, "report")
    measured = metrics.auc(scored, ["task"]).select(F.col("task").alias("name"), F.col("auc").alias("value"))
    targets = spark.createDataFrame([("SaPS", 0.5), ("PdPS", 0.5), ("hSaPS", 0.5)], "name string, target double")
    audit.report(audit.metric_layer(measured, targets, 0.2), path, {"tolerance": "0.2"}, scored.agg(F.count("*").cast("string").alias("scored_rows")))
    got = spark.read.schema(audit.REPORT).json(path)
    return got.select(F.size("checks").cast("long").alias("checks"), "summary.passed", "summary.failed", "summary.skipped", F.col("thresholds")["tolerance"].alias("tolerance"), F.col("inputs")["scored_rows"].alias("scored_rows"))


@query("b10_b16_model_columns", f"WITH {FEAT} SELECT acc, round(fcr, 6) AS fcr, NULL::DOUBLE AS \"IDR\", NULL::DOUBLE AS \"LCR\" FROM v_feat")
def model_columns(spark: SparkSession, d: str) -> DataFrame:
    got = features(spark, d).select("acc", r6("fcr").alias("fcr"))
    checks.require_columns(got, ["acc", "fcr"])
    return checks.with_model_columns(got, ["fcr", "IDR", "LCR"]).select("acc", "fcr", "IDR", "LCR")


HYDRO = "((" + " + ".join(f"{v} * length(regexp_replace(seq, '[^{a}]', '', 'g'))" for a, v in HYDROPATHY10.items()) + f"){D} / 10.0{D} / length(seq) + 4.5{D}) / 9.0{D}"


@query("h01_arrivals", f"WITH {SEQ} SELECT acc, length(seq) AS n, round(length(regexp_replace(seq, '[^DEKR]', '', 'g')){D} / length(seq), 6) AS fcr, round({HYDRO}, 6) AS hydropathy FROM v_seq")
def stream_of_records(spark: SparkSession, d: str) -> DataFrame:
    """FASTA files that arrive twice: what the stream has stored in the end is each accession's features once."""
    source, store = new_path(spark, "arrivals"), new_path(spark, "store")
    lines = fasta_lines(sequences(spark, d), F.col("seq"))
    lines.write.text(source)
    lines.write.mode("append").text(source)
    arrivals.score_arrivals(arrivals.fasta_stream(spark, source), store, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(store).select("acc", "n", r6("fcr").alias("fcr"), r6("hydropathy").alias("hydropathy"))


@query("a14_version", "SELECT 'documents ' || count(*) AS version FROM documents")
def version(spark: SparkSession, d: str) -> DataFrame:
    marker = table(spark, d, "documents").select(F.concat(F.lit("documents "), F.count("*").cast("string")).alias("value"))
    return files.version_marker(spark, write_lines(spark.createDataFrame([("",), (" ",)], "value string").union(marker).coalesce(1), new_path(spark, "version")))


@query("a16_dump", f"""
WITH {SEQ} SELECT acc, 'entry "' || acc || '" {{}}' AS entry_name, organism, length(seq) AS n, CASE WHEN doc_id % 5 <> 0 THEN doc_id / 4.0{D} END AS single,
  CASE WHEN doc_id % 3 = 0 THEN -1 WHEN doc_id % 7 = 0 THEN 2 ELSE 3 END AS residues, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 <> 0 AND doc_id % 7 = 0 THEN 'unreadable number' END AS error FROM v_seq""")
def dump(spark: SparkSession, d: str) -> DataFrame:
    """Bulk dumps of all texts, an object a task, read back by ranges."""
    id_ = F.col("doc_id")
    single = F.when(id_ % 5 != 0, (id_ / 4.0).cast("string")).otherwise("none")
    residue = F.when(id_ % 3 == 0, "").when(id_ % 7 == 0, "0.5,x").otherwise("0.5, 1,2")
    value = F.struct(F.col("seq").alias("Sequence"), F.concat(F.lit('entry "'), "acc", F.lit('" {}')).alias("Entry name"), F.col("organism").alias("Organism"), F.struct(single.alias("single"), residue.alias("residue")).alias("catGRANULE"))
    path = new_path(spark, "dump")
    write_objects(sequences(spark, d).select(F.col("acc").alias("key"), F.to_json(value).alias("value")), path)
    return files.read_dump(spark, path).select("acc", "entry_name", "organism", F.length("seq").cast("long").alias("n"), "single", F.coalesce(F.size("residue"), F.lit(-1)).alias("residues"), "error")


@query("h02_stream_counts", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(value) AS scored, count(*) FILTER (WHERE value IS NULL) AS missing_rows FROM events GROUP BY 1)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def stream_of_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as files that a stream reads; what comes out are the windows that its watermark has closed."""
    source, out = new_path(spark, "events"), new_path(spark, "counts")
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    arrivals.stream_counts(stream, "ts", "value", out, new_path(spark, "progress"), delay="30 minutes")
    return spark.read.schema("start timestamp, scored long, missing_rows long").parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


MODEL = ", ".join(f"({m}, '{f}', {w!r}{D}, {c!r}{D}, {s!r}{D})" for m, f, w, c, s in MEMBERS)


@query("p01_predict", f"""
WITH {RES}, m(model, f, w, c, s) AS (VALUES {MODEL}),
r AS (SELECT acc, (avg(score) + 0.25 * ln(n{D}) - {NORMALISATION['paper'][0]!r}) / {NORMALISATION['paper'][1]!r} AS granule FROM v_w GROUP BY acc, n),
f AS (SELECT acc, length(seq) AS n, length(regexp_replace(seq, '[^DEKR]', '', 'g')){D} / length(seq) AS fcr, {HYDRO} AS hydropathy, p_retailprice AS glycine
  FROM v_seq LEFT JOIN part ON 'D' || p_partkey = acc),
z AS (SELECT acc, avg(1 / (1 + exp(-z))) AS score FROM (SELECT acc, model, sum(coalesce(CASE f WHEN '' THEN w WHEN 'fcr' THEN w * (fcr - c) / s ELSE w * (glycine - c) / s END, 0)) AS z FROM f CROSS JOIN m GROUP BY acc, model) GROUP BY acc)
SELECT acc, n, round(fcr, 6) AS fcr, round(hydropathy, 6) AS hydropathy, round(granule, 6) AS granule, round(score, 6) AS score, glycine IS NULL AS lacks, true AS stale FROM f JOIN r USING (acc) JOIN z USING (acc)""")
def predicted(spark: SparkSession, d: str) -> DataFrame:
    """One plan from FASTA to scores: computed features, an imported one, missing report, ensemble, age of the model."""
    path = write_lines(fasta_lines(sequences(spark, d), F.col("seq")), new_path(spark, "proteome"))
    members = spark.createDataFrame([("SaPS", *m) for m in MEMBERS], MEMBER_SCHEMA)
    imported = _lookup(spark, d).withColumnRenamed("value", "glycine")
    manifest = spark.createDataFrame([("SaPS", "1")], "task string, feature_definitions_version string")
    got = predict(files.read_fasta(spark, path), members, manifest, "SaPS", ["fcr", "glycine"], imported, "2")
    return got.select("acc", "n", r6("fcr").alias("fcr"), r6("hydropathy").alias("hydropathy"), r6("granule").alias("granule"), r6("score").alias("score"), (F.size("missing") > 0).alias("lacks"), "stale")
