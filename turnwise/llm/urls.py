"""URL filters: a sort-merge range join of URLs with host and path rules.

A host is keyed by its labels in reverse order, each followed by a dot (``net.example.www.``), so a
rule's host and all its subdomains are one interval of keys, and the intervals of two rules are
nested or apart.  Rules and URLs are sorted together by key.  The stack of rules that are open at a
URL is the stack of the last rule before it, less the rules that have closed in between: if a rule's
key is a prefix of the URL's key, it is also a prefix of every key in between.  So the sweep only has
to carry the stack of the last rule forward, which is a window over the sorted rows.

The sorted rows are cut into ranges of equal size by key, path and id; what is open at the end of a
range is handed on through a table with one row per range.  A host that holds most URLs is spread
over many ranges, since path and id are part of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.base import partitions, query, table
from turnwise.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = rest.substr(F.length(raw) + 1, F.length(rest) + 1)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


def host_key(host: Column) -> Column:
    """``www.example.net`` as ``net.example.www.``; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key`` and ``stack``: for each host that has rules, the rules of this host and of all hosts above it."""
    own = rules.select(
        host_key(F.col("host")).alias("key"),
        F.struct(
            F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"),
            F.col("action").alias("action"), host_key(F.col("host")).alias("key"), F.col("path").alias("path"),
        ).alias("entry")).where("key <> '' AND entry.path IS NOT NULL AND entry.action IS NOT NULL").distinct()
    labels = F.split(F.regexp_replace("key", r"\.$", ""), r"\.")
    above = own.select("key").distinct().select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("upper"))
    return above.join(own.withColumnRenamed("key", "upper"), "upper").groupBy("key").agg(
        F.collect_list("entry").alias("stack"))


def filter_urls(
    pages: DataFrame, rules: DataFrame, *, id: str = "page_id", url: str = "url", default: str = "allow",
    ranges: int | None = None,
) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``rules`` has ``host`` (lower case), ``path`` and ``action``.  A rule fits its host and all
    subdomains if the path starts with the rule's; the longest (host and path together) wins, of equal
    rules with different actions ``block``.  Rows that no rule fits, also those with a null URL or one
    without ``://`` (host and path empty), have a null ``rule`` and the verdict ``default``.  Rows with
    equal or null ids are judged one by one; other columns of ``pages`` are ignored; rules with a null
    or empty host, a null path or action are ignored.  The stack of one host holds the rules of at most
    as many hosts as it has labels.
    """
    spark = pages.sparkSession
    host, path = url_host_path(F.col(url))
    points = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path")).withColumn(
        "key", host_key(F.col("host")))
    stacks = rule_stacks(rules)
    kind = stacks.schema["stack"].dataType
    events = stacks.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit("").alias("path"),
        F.lit(None).cast(points.schema["id"].dataType).alias("id"), "stack",
    ).unionByName(points.select(
        "key", F.lit(1).alias("kind"), "host", "path", "id", F.lit(None).cast(kind).alias("stack")))
    order = ["key", "kind", "path", "id"]
    # Stored, since the numbers of the ranges must not change between the two reads.
    swept = cut_lineage(events.repartitionByRange(ranges or partitions(spark), *order).withColumn(
        "range", F.spark_partition_id()))
    ends = swept.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    handed = swept.select("range").distinct().join(ends, "range", "left").select(
        "range", F.last("stack", ignorenulls=True).over(
            Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("handed"))
    running = F.last("stack", ignorenulls=True).over(
        Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = F.array_max(F.filter(
        F.coalesce("running", "handed"),
        lambda e: F.col("key").startswith(e["key"]) & F.col("path").startswith(e["path"])))
    # One row per range: the size is bounded by the number of ranges.
    return swept.withColumn("running", running).where("kind = 1").join(F.broadcast(handed), "range").withColumn(
        "best", fits).select(
            F.col("id").alias(id), "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
raws AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
points AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM raws),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM points p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1"""


@query("op8_url_filters", SQL)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(
        table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))
