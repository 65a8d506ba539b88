"""URL allow and block rules by a sort-merge range join (DataFrame functions only).

A host's canonical key is its labels in reverse, each ended by a dot, so a rule for a host
and all its subdomains is a prefix, and a prefix is an interval of the sorted keys. Rules nest
like their intervals. Rules and distinct hosts are merged in key order; the sweep carries the
last rule's stack (the rule and all that hold it), and a host pops from it what has ended:
every rule of the stack that is no prefix of its key. The stack then goes to the URLs of the
host, where the path decides and the longest rule wins.

Hosts of a top-level label with many of them are dealt to parts, each of which gets that label's
rules, so that no label is swept by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptora.llm.common import apart, as_one, table

#: Hosts of a label that one task sweeps.
SHARE = 1_000_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules that op8 applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; null or without ``://``: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule host, the rules of it and of the hosts above it.

    Rules come as host, path, verdict. Without a host a rule fits nothing and goes; a null path
    is an empty one. The stack grows with the rules along one chain of hosts.
    """
    clean = (
        rules.where("host is not null and host != ''")
        .select(F.translate("host", CAPITALS, SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    )
    item = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), key_of(F.col("host")).alias("key"),
        F.concat("host", "path").alias("rule"), "path", "verdict",
    )
    items = clean.select(F.col("host").alias("above"), item.alias("item"))
    labels = F.split("host", r"\.", -1)
    chain = clean.select("host").distinct().withColumn("labels", labels)
    chain = chain.select(
        "host", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))).alias("above")
    )
    return chain.join(items, "above").groupBy("host").agg(F.collect_list("item").alias("stack")).select(key_of(F.col("host")).alias("key"), "stack")


def active_rules(hosts: DataFrame, rules: DataFrame, share: int) -> DataFrame:
    """(host, stack) of each distinct host that lies in a rule's interval: the sweep.

    A top-level label with more than ``share`` hosts is dealt to as many parts as that takes, and only its
    rules are copied to each of them.
    """
    label = F.substring_index("key", ".", 1)
    keyed = hosts.select("host", key_of(F.col("host")).alias("key")).withColumn("label", label)
    parts = keyed.groupBy("label").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    starts = rule_stacks(rules).withColumn("label", label).join(parts, "label")
    starts = starts.select("label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    points = keyed.join(parts, "label").select("label", F.expr("pmod(xxhash64(host), parts)").cast("int").alias("part"), "key", F.lit(1).alias("kind"), "host")
    sweep = Window.partitionBy("label", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.unionByName(points, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
    swept = swept.where("kind = 1 and stack is not null").withColumn("stack", F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"])))
    return swept.where(F.size("stack") > 0).select("host", "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", share: int = SHARE) -> DataFrame:
    """``pages`` (with a ``url``) and host, path, rule, verdict; columns of those names are replaced.

    The longest rule (host and path together; then the longer host, then the later name and
    verdict) wins. No rule, a null url or one without ``://``: rule null, verdict ``default``.
    Repeated rows stay; an empty table gives none; without rules every url gets the default.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(as_one(names), "url").select("rest", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = urls.select("host").where("host != ''").distinct()
    found = active_rules(hosts, rules, share)
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    return (
        urls.join(found, "host", "left").withColumn("best", best)
        .select(*apart(names), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def rule_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"select * from values {rows} as rules(host, path, verdict)")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""
