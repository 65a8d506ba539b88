"""Queries of the residue windows and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptora.functions.sequence import charge_metrics, is_standard
from peptora.functions.tables import HYDROPATHY10, NORMALISATION, PROFILE_RADIUS, RESIDUES, SCALE_NAMES, SCALES100, YEAST, granule10000, prion_propensity, prion_ratio
from peptora.operators import batches, charge, kernels, states
from peptora.operators import residues as R
from peptora.plans.views import RES, SEQ, _values, residue_table, sequences

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def over(k: int, what: str) -> str:
    return f"{what} OVER (PARTITION BY acc ORDER BY pos ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


def ahead(n: int, what: str) -> str:
    return f"{what} OVER (PARTITION BY acc ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


SORT = "OVER (PARTITION BY acc ORDER BY pos)"
D = "::DOUBLE"


@query("e01_window_mean", f"""
WITH {RES} SELECT acc, round(max(m), 6) AS high, round(min(m), 6) AS low, round(avg(m), 6) AS mean FROM (SELECT acc, {over(3, "sum(hydro)")}{D} / w AS m FROM v_w) GROUP BY acc""")
def window_mean(spark: SparkSession, d: str) -> DataFrame:
    m = F.sum(R.valued(HYDROPATHY10)).over(R.around(3)).cast("double") / R.width(3)
    return R.own(residue_table(spark, d).withColumn("m", m)).groupBy("acc").agg(r6(F.max("m")).alias("high"), r6(F.min("m")).alias("low"), r6(F.avg("m")).alias("mean"))


@query("e02_residue_score", f"WITH {RES} SELECT acc, round(max(score), 6) AS high, round(min(score), 6) AS low, arg_max(pos, (score, -pos)) AS high_at FROM v_w GROUP BY acc")
def residue_score(spark: SparkSession, d: str) -> DataFrame:
    at = F.max_by("pos", F.struct("score", -F.col("pos"))).cast("long")
    return R.own(R.residue_scores(residue_table(spark, d))).groupBy("acc").agg(r6(F.max("score")).alias("high"), r6(F.min("score")).alias("low"), at.alias("high_at"))


def _score_sql(route: str) -> str:
    mean, sd = NORMALISATION[route]
    return f"""WITH {RES} SELECT acc, n, round(raw, 6) AS raw, round((raw - {mean!r}) / {sd!r}, 6) AS score FROM (
  SELECT acc, n, avg(score) + 0.25 * ln(n{D}) AS raw FROM v_w GROUP BY acc, n)"""


@query("e03_protein_score", _score_sql("paper"))
def protein_score(spark: SparkSession, d: str) -> DataFrame:
    return R.protein_scores(sequences(spark, d)).select("acc", "n", r6("raw").alias("raw"), r6("score").alias("score"))


@query("j11_route", _score_sql("legacy"))
def route(spark: SparkSession, d: str) -> DataFrame:
    return R.protein_scores(sequences(spark, d), "legacy").select("acc", "n", r6("raw").alias("raw"), r6("score").alias("score"))


PROFILE = f"""{RES},
v_prof AS (SELECT acc, n, pos, value FROM (SELECT acc, n, pos, {over(25, "avg(score)")} AS value FROM v_w) WHERE pos BETWEEN 24 AND n - 27)"""


@query("e04_profile", f"WITH {PROFILE} SELECT acc, count(*) AS size, min(pos) AS first, max(pos) AS last, round(avg(value), 6) AS mean, round(max(value), 6) AS high FROM v_prof GROUP BY acc")
def profile(spark: SparkSession, d: str) -> DataFrame:
    got = R.profile(residue_table(spark, d))
    return got.groupBy("acc").agg(F.count("*").alias("size"), F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"), r6(F.avg("value")).alias("mean"), r6(F.max("value")).alias("high"))


@query("e05_radii", f"WITH {RES} SELECT acc, " + ", ".join(f"round(avg(m{r}), 6) AS mean{r}, round(max(m{r}), 6) AS high{r}" for r in (3, 7, 13, 25)) + " FROM (SELECT acc, " + ", ".join(f"{over(r, 'sum(granule)')}{D} / (least(pos, {r}) + least(n - 1 - pos, {r}) + 1) AS m{r}" for r in (3, 7, 13, 25)) + " FROM v_res) GROUP BY acc")
def radii(spark: SparkSession, d: str) -> DataFrame:
    means = {f"m{r}": F.sum(R.valued(granule10000())).over(R.around(r)).cast("double") / R.width(r) for r in (3, 7, 13, 25)}
    got = R.own(residue_table(spark, d).withColumns(means))
    return got.groupBy("acc").agg(*[f for r in (3, 7, 13, 25) for f in (r6(F.avg(f"m{r}")).alias(f"mean{r}"), r6(F.max(f"m{r}")).alias(f"high{r}"))])


@query("e06_exposure", f"WITH {RES} SELECT acc, aa, round(sum(share), 6) AS weight FROM (SELECT acc, aa, {over(3, 'sum(1.0::DOUBLE / w)')} AS share FROM v_w) GROUP BY acc, aa")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    return R.exposure(residue_table(spark, d)).withColumn("weight", r6("weight"))


@query("e07_sliding_average", f"""
WITH {RES}, s AS (SELECT acc, n, pos, {over(20, "sum(k * granule)")}{D} / {over(20, "sum(k)")} AS m FROM (SELECT *, 1 + least(pos, least(20, n - 1)) + least(n - 1 - pos, least(20, n - 1)) AS k FROM v_res))
SELECT acc, round(avg(m), 4) AS mean, round(max(m), 4) AS high, count(*) FILTER (WHERE pos >= 20 AND pos < n - 20) AS inner_size FROM s GROUP BY acc""")
def sliding_average(spark: SparkSession, d: str) -> DataFrame:
    got = residue_table(spark, d).withColumn("v", R.valued(granule10000()))
    got = R.own(got.withColumns({"m": R.sliding_average(got, "v", 41, weighted=True), "inner": R.sliding_average(got, "v", 41, weighted=True, shrink=False)}))
    return got.groupBy("acc").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.max("m"), 4).alias("high"), F.count("inner").alias("inner_size"))


@query("e08_prolines", f"""
WITH {RES}, p AS (SELECT *, CASE WHEN aa = 'P' AND (lag(aa, 1) {SORT} IS NOT DISTINCT FROM 'P' OR lag(aa, 2) {SORT} IS NOT DISTINCT FROM 'P') THEN 0 ELSE granule END AS once FROM v_res)
SELECT acc, round(avg(m), 4) AS mean, round(max(m), 4) AS high FROM (SELECT acc, {over(20, "sum(once)")}{D} / (least(pos, 20) + least(n - 1 - pos, 20) + 1) AS m FROM p) GROUP BY acc""")
def prolines(spark: SparkSession, d: str) -> DataFrame:
    got = residue_table(spark, d).withColumn("v", R.valued(granule10000()))
    got = got.withColumn("once", R.proline_once(F.col("v")))
    m = R.sliding_average(got, "v", 41, numerator=F.col("once"))
    return R.own(got.withColumn("m", m)).groupBy("acc").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.max("m"), 4).alias("high"))


@query("e09_best_window", f"""
WITH {RES}, s AS (SELECT acc, n, pos, {ahead(80, "sum(CASE WHEN aa IN ('N', 'Q') THEN 1 ELSE 0 END)")} AS s FROM v_res)
SELECT acc, max(s)::BIGINT AS best, arg_max(pos, (s, -pos)) AS first, least(arg_max(pos, (s, -pos)) + 80, n) AS last FROM s WHERE pos + 80 <= n OR (n < 80 AND pos = 0) GROUP BY acc, n""")
def best_window(spark: SparkSession, d: str) -> DataFrame:
    return batches.best_window(sequences(spark, d, bound=True), {"N": 1, "Q": 1}, 80, shorter=True).select("acc", "best", "first", "last")


@query("e10_prion_like", f"""
WITH {RES}, s AS (SELECT acc, n, pos, {ahead(60, "sum(prion)")} AS s FROM v_res)
SELECT acc, n, round(max(s) FILTER (WHERE pos + 60 <= n), 6) AS llr, round(max(s) FILTER (WHERE pos + 60 <= n) / 60.0, 6) AS nllr FROM s GROUP BY acc, n""")
def prion_like(spark: SparkSession, d: str) -> DataFrame:
    got = batches.best_window(sequences(spark, d, bound=True), prion_ratio(), 60, shorter=False)
    return got.select("acc", "n", r6("best").alias("llr"), r6(F.col("best") / 60.0).alias("nllr"))


@query("e11_best_subarray", f"""
WITH {RES}, p AS (SELECT acc, pos, sum(charge) OVER (PARTITION BY acc ORDER BY pos) AS s FROM v_res)
SELECT acc, max(s - least(coalesce(m, 0), 0))::BIGINT AS best FROM (SELECT acc, s, min(s) OVER (PARTITION BY acc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) GROUP BY acc""")
def best_subarray(spark: SparkSession, d: str) -> DataFrame:
    return R.best_subarray(residue_table(spark, d), R.valued({"K": 1, "R": 1, "D": -1, "E": -1}))


W41 = "(least(pos, 20) + least(n - 1 - pos, 20) + 1)"
FOLD = f"""{RES},
v_fi AS (SELECT *, 2.785{D} * ({over(20, "sum(hydro)")}{D} / {W41} / 90.0{D} + 0.5{D}) + -1.0{D} * abs({over(20, "sum(charge)")}{D} / {W41}) + -1.151{D} AS fi FROM v_res)"""


@query("e12_fold_index", f"""
WITH {FOLD} SELECT acc, round(min(fi), 6) AS low, round(avg(fi), 6) AS mean, count(*) FILTER (WHERE fi < 0) AS negative,
  round(2.785{D} * (sum(hydro){D} / n / 90.0{D} + 0.5{D}) - abs(sum(charge){D} / n) - 1.151{D}, 6) AS whole FROM v_fi GROUP BY acc, n""")
def fold_index(spark: SparkSession, d: str) -> DataFrame:
    got = R.own(R.fold_index(residue_table(spark, d))).withColumn("h", R.valued(HYDROPATHY10)).withColumn("q", R.valued({"K": 1, "R": 1, "D": -1, "E": -1}))
    whole = 2.785 * (F.sum("h").cast("double") / F.first("n") / 90.0 + 0.5) - F.abs(F.sum("q").cast("double") / F.first("n")) - 1.151
    return got.groupBy("acc").agg(r6(F.min("fi")).alias("low"), r6(F.avg("fi")).alias("mean"), F.count_if(F.col("fi") < 0).alias("negative"), r6(whole).alias("whole"))


RUNS = """runs AS (SELECT acc, n, min(pos) AS first, max(pos) + 1 AS last FROM (
  SELECT acc, n, pos, pos - row_number() OVER (PARTITION BY acc ORDER BY pos) AS g FROM marked) GROUP BY acc, n, g)"""
DISORDER = f"""{FOLD},
marked AS (SELECT acc, n, pos FROM v_fi WHERE fi < 0 AND pos >= least(20, n // 2) AND pos < n - least(20, n // 2)), {RUNS},
dis AS (SELECT acc, n, first, last FROM (
  SELECT acc, n, CASE WHEN first = least(20, n // 2) THEN 0 ELSE first END AS first, CASE WHEN last = n - least(20, n // 2) THEN n ELSE last END AS last FROM runs) WHERE last - first >= 5)"""


@query("e13_disordered_runs", f"WITH {DISORDER} SELECT acc, count(*) AS stretches, sum(last - first)::BIGINT AS residues, max(last - first) AS longest, min(first) AS first FROM dis GROUP BY acc")
def disordered_runs(spark: SparkSession, d: str) -> DataFrame:
    return batches.disorder_summary(sequences(spark, d, bound=True))


W41K = "(1 + least(pos, least(20, n - 1)) + least(n - 1 - pos, least(20, n - 1)))"


@query("e14_papa", f"""
WITH {FOLD}, {_values("t_papa", prion_propensity())},
o AS (SELECT f.*, CASE WHEN aa = 'P' AND (lag(aa, 1) {SORT} IS NOT DISTINCT FROM 'P' OR lag(aa, 2) {SORT} IS NOT DISTINCT FROM 'P') THEN 0 ELSE t.v END AS once FROM v_fi f JOIN t_papa t USING (aa)),
m AS (SELECT acc, n, pos, fi, {over(20, "sum(once)")} / {W41} AS x FROM o),
t AS (SELECT acc, n, pos, {over(20, f"sum({W41K} * x)")} / {over(20, f"sum({W41K})")} AS x2, {over(20, f"sum({W41K} * fi)")} / {over(20, f"sum({W41K})")} AS fi2 FROM m)
SELECT acc, round(max(x2) FILTER (WHERE fi2 < 0 AND pos >= 20 AND pos < n - 20), 6) AS papa FROM t GROUP BY acc""")
def papa(spark: SparkSession, d: str) -> DataFrame:
    return batches.prion_propensity_peak(sequences(spark, d, bound=True)).select("acc", r6("papa").alias("papa"))


@query("e15_longest_run", f"WITH {RES}, marked AS (SELECT acc, n, pos FROM v_res WHERE charge <> 0), {RUNS} SELECT acc, max(last - first) AS longest, count(*) AS stretches FROM runs GROUP BY acc")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return batches.run_summary(sequences(spark, d, bound=True), "DEKR")


@query("e16_core_domains", f"""
WITH {FOLD}, marked AS (SELECT acc, n, pos FROM v_fi WHERE fi < 0), {RUNS},
c AS (SELECT acc, pos, s FROM (SELECT acc, n, pos, {ahead(60, "sum(-hydro)")} AS s, {ahead(60, "max(fi)")} AS m FROM v_fi) WHERE m < 0 AND pos + 60 <= n),
b AS (SELECT acc, max(s)::BIGINT AS core, arg_max(pos, (s, -pos)) AS core_first FROM c GROUP BY acc)
SELECT b.acc, core, core_first, sum(-v.hydro)::BIGINT AS domain, first AS domain_first, last AS domain_last
FROM b JOIN runs r ON r.acc = b.acc AND core_first >= r.first AND core_first < r.last JOIN v_res v ON v.acc = b.acc AND v.pos >= r.first AND v.pos < r.last GROUP BY ALL""")
def core_domains(spark: SparkSession, d: str) -> DataFrame:
    return batches.core_domains(sequences(spark, d, bound=True), {a: -v for a, v in HYDROPATHY10.items()})


ENTROPY_COUNTS = ", ".join(ahead(12, f"sum(CASE WHEN aa = '{a}' THEN 1 ELSE 0 END)") + f" AS c_{a}" for a in RESIDUES)
ENTROPY = f"""{SEQ}, v_res0 AS (SELECT acc, length(seq) AS n, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS aa FROM v_seq),
v_c AS (SELECT acc, n, pos, {ENTROPY_COUNTS} FROM v_res0),
v_h AS (SELECT acc, n, pos, -({" + ".join(f"CASE WHEN c_{a} > 0 THEN c_{a}{D} / 12{D} * log2(c_{a}{D} / 12{D}) ELSE 0 END" for a in RESIDUES)}) AS h FROM v_c WHERE pos + 12 <= n)"""


@query("e17_entropy", f"WITH {ENTROPY} SELECT acc, count(*) AS size, round(min(h), 6) + 0.0 AS low, round(avg(h), 6) AS mean FROM v_h GROUP BY acc")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    got = kernels.entropy_summary(sequences(spark, d)).where("size > 0")
    return got.select("acc", "size", (r6("low") + 0.0).alias("low"), r6("mean").alias("mean"))


LOW = f"""{ENTROPY}, isl AS (
  SELECT acc, n, min(pos) AS first, max(pos) + 12 AS last, min(h) AS least FROM (
    SELECT acc, n, pos, h, pos - row_number() OVER (PARTITION BY acc ORDER BY pos) AS g FROM v_h WHERE h <= 2.5 + 1e-9) GROUP BY acc, n, g HAVING min(h) <= 2.2 + 1e-9),
low AS (SELECT acc, n, min(first) AS first, max(last) AS last FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY acc ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY acc ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM isl)) GROUP BY acc, n, g)"""


@query("e18_low_complexity", f"WITH {LOW} SELECT acc, first, last FROM low")
def low_complexity(spark: SparkSession, d: str) -> DataFrame:
    return kernels.low_complexity(sequences(spark, d)).select("acc", "first", "last")


@query("d09_low_complexity_share", f"WITH {LOW} SELECT acc, round(sum(last - first){D} / n, 6) AS share FROM low GROUP BY acc, n")
def low_complexity_share(spark: SparkSession, d: str) -> DataFrame:
    return kernels.low_complexity(sequences(spark, d)).groupBy("acc", "n").agg(F.sum(F.col("last") - F.col("first")).alias("s")).select("acc", r6(F.col("s").cast("double") / F.col("n")).alias("share"))


@query("e19_exact_segments")
def exact_segments(spark: SparkSession, d: str) -> DataFrame:
    return kernels.exact_low_complexity(sequences(spark, d))


@query("e20_top_neighbourhood", f"""
WITH {RES}, cut AS (SELECT acc, score AS cut FROM (SELECT acc, n, score, row_number() OVER (PARTITION BY acc ORDER BY score DESC, pos) AS k FROM v_w) WHERE k = least(60, n)),
near AS (SELECT acc, score, {over(5, "max(CASE WHEN score >= cut THEN 1 ELSE 0 END)")} AS near FROM v_w JOIN cut USING (acc))
SELECT acc, round(avg(score), 6) AS top_mean, count(*) AS n_near FROM near WHERE near = 1 GROUP BY acc""")
def top_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return batches.top_neighbourhood(sequences(spark, d, bound=True)).withColumn("top_mean", r6("top_mean"))


def _spread_sql(w: int) -> str:
    mean = f"CASE WHEN pos >= {w // 2} AND pos + {w - w // 2} <= n THEN avg(score) OVER (PARTITION BY acc ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w - w // 2 - 1} FOLLOWING) END"
    return f"a{w} AS (SELECT acc, round(max(m), 9) AS high_{w} FROM (SELECT acc, {mean} AS m FROM v_w) GROUP BY acc)"


@query("e21_spread_average", f"WITH {RES}, {', '.join(_spread_sql(w) for w in (20, 40, 60))} SELECT acc, high_20, high_40, high_60 FROM a20 JOIN a40 USING (acc) JOIN a60 USING (acc)")
def spread_average(spark: SparkSession, d: str) -> DataFrame:
    got = batches.spread_average_peaks(sequences(spark, d, bound=True))
    return got.select("acc", *[F.round(f"high_{w}", 9).alias(f"high_{w}") for w in (20, 40, 60)])


@query("e22_hidden_states")
def hidden_states(spark: SparkSession, d: str) -> DataFrame:
    return states.hidden_state_summary(sequences(spark, d))


@query("c15_charge_decoration", f"""
WITH {RES}, q AS (SELECT acc, n, pos, charge FROM v_res WHERE charge <> 0),
p AS (SELECT a.acc, a.n, sum(a.charge * b.charge * sqrt((b.pos - a.pos){D})) AS s FROM q a JOIN q b ON a.acc = b.acc AND a.pos < b.pos GROUP BY a.acc, a.n)
SELECT acc, round(coalesce(s, 0){D} / length(seq), 3) AS scd FROM v_seq LEFT JOIN p USING (acc)""")
def charge_decoration(spark: SparkSession, d: str) -> DataFrame:
    return charge.charge_decoration(sequences(spark, d)).withColumn("scd", F.round("scd", 3))


@query("d02_background", f"""
WITH {RES}, yeast(aa, f) AS (VALUES {", ".join(f"('{a}', {f!r}{D})" for a, f in zip(RESIDUES, YEAST))}), valid AS (SELECT aa, count(*) AS c FROM v_res0 GROUP BY aa)
SELECT aa, c AS count, round(0.5 * f / (SELECT sum(f) FROM yeast) + 0.5 * c{D} / (SELECT sum(c) FROM valid), 6) AS frequency FROM yeast JOIN valid USING (aa)""")
def background(spark: SparkSession, d: str) -> DataFrame:
    return R.background(residue_table(spark, d), 0.5).withColumn("frequency", r6("frequency"))


@query("d03_digrams", f"WITH {RES} SELECT aa || b AS gram, count(*) AS count FROM (SELECT aa, lead(aa) {SORT} AS b FROM v_res0) WHERE b IS NOT NULL GROUP BY 1")
def digrams(spark: SparkSession, d: str) -> DataFrame:
    return R.letter_counts(residue_table(spark, d), 2)


@query("d03_trigrams", f"WITH {RES} SELECT aa || b || c AS gram, count(*) AS count FROM (SELECT aa, lead(aa) {SORT} AS b, lead(aa, 2) {SORT} AS c FROM v_res0) WHERE c IS NOT NULL GROUP BY 1")
def trigrams(spark: SparkSession, d: str) -> DataFrame:
    return R.letter_counts(residue_table(spark, d), 3)


@query("d04_normalisation", f"""
WITH {RES}, r AS (SELECT acc, avg(score) + 0.25 * ln(n{D}) AS x FROM v_w GROUP BY acc, n)
SELECT organism, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, count(x) AS scored, count(*) FILTER (WHERE x IS NULL) AS skipped FROM v_seq LEFT JOIN r USING (acc) GROUP BY organism""")
def normalisation(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d)
    got = s.select("acc", "organism").join(R.protein_scores(s).select("acc", "raw"), "acc", "left")
    return got.groupBy("organism").agg(r6(F.avg("raw")).alias("mean"), r6(F.stddev_pop("raw")).alias("sd"), F.count("raw").alias("scored"), F.count_if(F.col("raw").isNull()).alias("skipped"))


def _summary_sql(radii: tuple[int, ...]) -> str:
    scales = ",\n".join(_values(f"t_{n}", {a: row[k] for a, row in SCALES100.items()}) for k, n in enumerate(SCALE_NAMES))
    names = [(n, r) for r in radii for n in SCALE_NAMES]
    means = ", ".join(f"{over(r, f'sum({n})')}{D} / (least(pos, {r}) + least(n - 1 - pos, {r}) + 1) / 100.0{D} AS {n}{r}" for n, r in names)
    aggs = ", ".join(f"round(avg({x}), 9) AS {x}_mean, round(quantile_cont({x}, 0.25), 9) AS {x}_q25, round(quantile_cont({x}, 0.5), 9) AS {x}_q50, round(quantile_cont({x}, 0.75), 9) AS {x}_q75, round(stddev_pop({x}), 6) AS {x}_sd" for x in (f"{n}{r}" for n, r in names))
    return f"WITH {SEQ}, {scales}, v_res0 AS (SELECT acc, length(seq) AS n, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS aa FROM v_seq), s AS (SELECT acc, n, pos, {', '.join(f't_{n}.v AS {n}' for n in SCALE_NAMES)} FROM v_res0 " + " ".join(f"JOIN t_{n} USING (aa)" for n in SCALE_NAMES) + f"), m AS (SELECT acc, {means} FROM s) SELECT acc, {aggs} FROM m GROUP BY acc"


@query("d05_window_summaries", _summary_sql((3, 7, 13, 25)))
def window_summaries(spark: SparkSession, d: str) -> DataFrame:
    got = batches.window_summaries(sequences(spark, d, bound=True))
    return got.select("acc", *[F.round(c, 6 if c.endswith("_sd") else 9).alias(c) for c in got.columns if c != "acc"])


@query("d06_profile_statistics", f"WITH {PROFILE} SELECT acc, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS q{round(100 * p):02d}" for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + ", round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg((value > 0)::INT), 6) AS positive, round(coalesce(avg(value) FILTER (WHERE value > 0), 0), 6) AS strength FROM v_prof GROUP BY acc")
def profile_statistics(spark: SparkSession, d: str) -> DataFrame:
    got = batches.profile_statistics(sequences(spark, d, bound=True))
    return got.select("acc", *[r6(c).alias(c) for c in got.columns if c != "acc"])


@query("d07_strength", f"WITH {PROFILE} SELECT acc, round(coalesce(avg(value - 7.98) FILTER (WHERE value > 7.98), 0), 6) AS strength FROM v_prof GROUP BY acc")
def strength(spark: SparkSession, d: str) -> DataFrame:
    return R.profile(residue_table(spark, d)).groupBy("acc").agg(r6(R.strength(F.col("value") - 7.98)).alias("strength"))


@query("d08_state_share", f"WITH {FOLD} SELECT acc, round(avg((fi < 0)::INT), 6) AS share, round(avg(-fi), 6) AS mean, round(max(-fi), 6) AS high FROM v_fi GROUP BY acc")
def state_share(spark: SparkSession, d: str) -> DataFrame:
    got = R.own(R.fold_index(residue_table(spark, d))).select("acc", F.when(F.col("fi") < 0, "D").otherwise("O").alias("state"), (-F.col("fi")).alias("score"))
    return R.state_share(got).select("acc", r6("share").alias("share"), r6("mean").alias("mean"), r6("high").alias("high"))


@query("j10_aligned_profile", f"""
WITH {PROFILE}, s AS (SELECT acc, avg(score) AS single FROM v_w GROUP BY acc)
SELECT acc, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM (SELECT acc, value + (single - avg(value) OVER (PARTITION BY acc)) AS v FROM v_prof JOIN s USING (acc)) GROUP BY acc""")
def aligned_profile(spark: SparkSession, d: str) -> DataFrame:
    return batches.aligned_profile_summary(sequences(spark, d, bound=True)).select("acc", *[r6(c).alias(c) for c in ("low", "high", "mean")])


@query("j12_batch_scores", f"""
WITH {RES}, raw AS (SELECT acc, avg(score) + 0.25 * ln(n{D}) AS raw FROM v_w GROUP BY acc, n)
SELECT doc_id, acc, CASE WHEN regexp_full_match(v.raw, '[{RESIDUES}]+') THEN round((r.raw - {NORMALISATION['paper'][0]!r}) / {NORMALISATION['paper'][1]!r}, 6) END AS score,
  CASE WHEN NOT regexp_full_match(v.raw, '[{RESIDUES}]+') THEN 'unsupported residues' END AS error FROM v_seq v LEFT JOIN raw r USING (acc)""")
def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    got = sequences(spark, d)
    return R.batch_scores(got.select("doc_id", "acc", F.col("raw").alias("seq"))).select("doc_id", "acc", r6("score").alias("score"), "error")


FEATURE_SLICE = {"rc7_mean": 30, "rc7_q25": 36, "rc7_q50": 42, "rc7_q75": 48, "rc7_sd": 54, "profile_mean": 146, "profile_sd": 147, "profile_q50": 151, "profile_low": 155, "profile_high": 156, "share_a": 159, "n": 179, "ln_n": 180}


@query("j07_feature_map", f"""
WITH {PROFILE}, {_values("t_rc", {a: row[0] for a, row in SCALES100.items()})},
m AS (SELECT acc, {over(7, "sum(t.v)")}{D} / (least(pos, 7) + least(n - 1 - pos, 7) + 1) / 100.0{D} AS m FROM v_res0 JOIN t_rc t USING (aa)),
a AS (SELECT acc, round(avg(m), 6) AS rc7_mean, round(quantile_cont(m, 0.25), 6) AS rc7_q25, round(quantile_cont(m, 0.5), 6) AS rc7_q50, round(quantile_cont(m, 0.75), 6) AS rc7_q75, round(stddev_pop(m), 6) AS rc7_sd FROM m GROUP BY acc),
p AS (SELECT acc, round(avg(value), 6) AS profile_mean, round(stddev_pop(value), 6) AS profile_sd, round(quantile_cont(value, 0.5), 6) AS profile_q50, round(min(value), 6) AS profile_low, round(max(value), 6) AS profile_high FROM v_prof GROUP BY acc)
SELECT acc, 181 AS size, rc7_mean, rc7_q25, rc7_q50, rc7_q75, rc7_sd, coalesce(profile_mean, 0) AS profile_mean, coalesce(profile_sd, 0) AS profile_sd, coalesce(profile_q50, 0) AS profile_q50,
  coalesce(profile_low, 0) AS profile_low, coalesce(profile_high, 0) AS profile_high, round((length(seq) - length(replace(seq, 'A', ''))){D} / length(seq), 6) AS share_a, length(seq){D} AS n, round(ln(length(seq){D}), 6) AS ln_n
FROM v_seq JOIN a USING (acc) LEFT JOIN p USING (acc)""")
def feature_map(spark: SparkSession, d: str) -> DataFrame:
    """All 181 features of each text; SQL holds a slice of them."""
    got = kernels.feature_map(sequences(spark, d))
    return got.select("acc", F.size("features").cast("long").alias("size"), *[(r6(F.col("features")[k]) + 0.0).alias(name) for name, k in FEATURE_SLICE.items()])


@query("j18_size_batches", f"""
WITH {SEQ} SELECT acc, round((length(regexp_replace(seq, '[^KR]', '', 'g')) - length(regexp_replace(seq, '[^DE]', '', 'g'))){D} / length(seq), 6) AS value, NULL::VARCHAR AS error FROM v_seq""")
def size_batches(spark: SparkSession, d: str) -> DataFrame:
    """The mean charge that the batches were for: a column needs none, so nothing is cut by size."""
    return sequences(spark, d).select("acc", r6(charge_metrics(F.col("seq"))["ncpr"]).alias("value"), F.lit(None).cast("string").alias("error"))
