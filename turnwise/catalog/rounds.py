"""Round, identity and export queries: orders of a customer as rounds of a study."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from turnwise.catalog.base import NEED_SQL, query, r6, table, with_ctes
from turnwise.functions.text import fraction, next_versions
from turnwise.operators import annotations as an
from turnwise.operators import identity as idn
from turnwise.operators import rounds as rd
from turnwise.operators import sampling as s
from turnwise.plans.ordered import row_numbers
from turnwise.session import new_folder
from turnwise.sources.readers import read_exports
from turnwise.sources.writers import write_tsv

ROUNDS_SQL = """o AS (
  SELECT o_orderkey, 'S' || o_custkey AS study, o_orderstatus AS st, o_orderpriority AS pr, o_orderdate,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k,
    count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
r AS (
  SELECT o_orderkey, study, CASE WHEN pr = '4-NOT SPECIFIED' THEN 'TRAIN' WHEN st = 'F' AND pr = '5-LOW' AND k = n - 1 THEN 'LAST'
      ELSE CAST(k AS VARCHAR) END AS version,
    CASE st WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PENDING' ELSE 'INIT' END AS status, k FROM o),
l AS (SELECT l_orderkey, 'Q-' || l_partkey AS qid, max(floor(l_quantity / 10)) AS yes, max(floor(l_quantity / 10)) + max(l_linenumber) AS n
      FROM lineitem GROUP BY ALL),
ri AS (SELECT r.*, l.qid, CAST(l.yes AS BIGINT) AS yes, CAST(l.n AS BIGINT) AS n FROM r JOIN l ON l_orderkey = o_orderkey),
sup AS (SELECT DISTINCT l_orderkey AS o_orderkey, 'U' || l_suppkey AS annotator FROM lineitem),
val AS (SELECT DISTINCT l_orderkey AS o_orderkey, 'U' || l_suppkey AS annotator FROM lineitem WHERE l_discount < 0.08),
adm AS (SELECT o_orderkey, annotator FROM sup UNION SELECT o_orderkey, 'U' || (o_orderkey % 97) FROM orders SEMI JOIN
        (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) x USING (o_orderkey)),
took AS (SELECT r.*, annotator FROM r JOIN sup USING (o_orderkey) WHERE status IN ('COMPLETE', 'PENDING')
         UNION ALL SELECT r.*, annotator FROM r JOIN adm USING (o_orderkey) WHERE status = 'INIT'),
rr AS (SELECT * FROM r SEMI JOIN sup USING (o_orderkey)),
fin AS (SELECT DISTINCT study FROM rr WHERE version = 'LAST'),
late AS (SELECT study, max(CAST(version AS INTEGER)) AS v FROM rr ANTI JOIN fin USING (study)
         WHERE version NOT IN ('TRAIN', 'LAST') AND status <> 'PENDING' GROUP BY study),
latest AS (SELECT rr.* FROM rr JOIN late ON rr.study = late.study AND rr.version = CAST(late.v AS VARCHAR))"""
R = with_ctes(ROUNDS_SQL)
RN = with_ctes(ROUNDS_SQL, NEED_SQL)


def rounds(spark, sf_dir):
    """The round table: an order is a round, its parts the items, its suppliers the annotators.

    The lists of an order come from its own few line items.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    ranked = row_numbers(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "k1")
    sizes = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("k1") - 1
    heads = ranked.join(sizes, "o_custkey").select(
        "o_orderkey", F.concat(F.lit("S"), "o_custkey").alias("study"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "TRAIN").when(
            (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW") & (k == F.col("n") - 1), "LAST"
        ).otherwise(k.cast("string")).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("INIT").alias("status"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_discount")
    items = line.groupBy("l_orderkey", "l_partkey").agg(
        F.max(F.floor(F.col("l_quantity") / 10)).alias("yes"),
        (F.max(F.floor(F.col("l_quantity") / 10)) + F.max("l_linenumber")).alias("n"))
    lists = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("Q-"), "l_partkey").alias("qid"), F.struct("yes", "n").alias("v")))).alias("i"))
    people = line.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("U"), "l_suppkey"))).alias("participated"),
        F.array_sort(F.collect_set(F.when(F.col("l_discount") < 0.08, F.concat(F.lit("U"), "l_suppkey")))).alias("valid"))
    both = lists.join(people, "l_orderkey")
    return heads.join(both, heads.o_orderkey == both.l_orderkey).select(
        "study", "version", "status", F.transform("i", lambda x: x["qid"]).alias("qids"),
        F.transform("i", lambda x: x["v"]).alias("votes"),
        F.array_union("participated", F.array(F.concat(F.lit("U"), (F.col("l_orderkey") % 97).cast("string")))).alias("admitted"),
        "participated", "valid")


@query("participant_history", R + "SELECT DISTINCT study, annotator FROM took")
def participant_history(spark, sf_dir):
    return rd.participant_history(rounds(spark, sf_dir))


@query("qualified_annotators", R + """
SELECT DISTINCT annotator FROM r JOIN val USING (o_orderkey) WHERE version = 'TRAIN' AND status IN ('COMPLETE', 'PENDING')
UNION SELECT 'U' || s_suppkey FROM supplier WHERE s_acctbal > 9000""")
def qualified_annotators(spark, sf_dir):
    manual = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("U"), "s_suppkey").alias("annotator"))
    return rd.qualified_annotators(rounds(spark, sf_dir), manual)


@query("annotators_of_items", R + """
SELECT qid, annotator, count(*) AS n_rounds FROM ri JOIN val USING (o_orderkey)
WHERE status = 'COMPLETE' AND version <> 'TRAIN' GROUP BY ALL""")
def annotators_of_items(spark, sf_dir):
    return rd.annotators_of_items(rounds(spark, sf_dir))


@query("failed_rounds", R + """
SELECT annotator, count(*) AS n_failed FROM r JOIN sup USING (o_orderkey) WHERE status = 'COMPLETE' AND version <> 'TRAIN'
  AND NOT EXISTS (SELECT 1 FROM val WHERE val.o_orderkey = r.o_orderkey AND val.annotator = sup.annotator)
GROUP BY annotator HAVING count(*) > 3""")
def failed_rounds(spark, sf_dir):
    return rd.failed_rounds(rounds(spark, sf_dir))


@query("workloads", R + """, q AS (SELECT o_orderkey, count(*) AS c FROM ri GROUP BY o_orderkey)
SELECT annotator, CAST(sum(c) AS BIGINT) AS n_items FROM (
  SELECT annotator, c FROM took JOIN q USING (o_orderkey) WHERE version <> 'TRAIN'
  UNION ALL SELECT 'U' || s_suppkey, 0 FROM supplier) GROUP BY annotator""")
def workloads(spark, sf_dir):
    everybody = table(spark, sf_dir, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("annotator"))
    return rd.workloads(rounds(spark, sf_dir), everybody)


@query("highest_versions", R + """
SELECT study, 'LAST' AS version FROM fin UNION ALL SELECT study, version FROM latest""")
def highest_versions(spark, sf_dir):
    return rd.highest_versions(rounds(spark, sf_dir))


@query("valid_surveys", R + """
SELECT study, version FROM r SEMI JOIN val USING (o_orderkey) WHERE status = 'COMPLETE' AND version <> 'TRAIN'""")
def valid_surveys(spark, sf_dir):
    return rd.valid_surveys(rounds(spark, sf_dir)).select("study", "version")


@query("round_statistics", RN + """, nd AS (
  SELECT o_orderkey, min(need) AS need FROM latest JOIN (SELECT o_orderkey, qid, yes, n FROM ri) USING (o_orderkey) JOIN need USING (yes, n)
  WHERE need > 0 GROUP BY o_orderkey),
c AS (SELECT o_orderkey, (SELECT count(*) FROM sup WHERE sup.o_orderkey = latest.o_orderkey) AS p,
  (SELECT count(*) FROM val WHERE val.o_orderkey = latest.o_orderkey) AS v,
  (SELECT count(*) FROM adm WHERE adm.o_orderkey = latest.o_orderkey) AS a FROM latest)
SELECT count(*) AS n_studies, round(avg(p - v), 6) AS mean_failed, round(avg(v), 6) AS mean_valid,
  round(avg(a - p), 6) AS mean_silent, round((SELECT avg(need) FROM nd), 6) AS mean_need FROM c""")
def round_statistics(spark, sf_dir):
    return rd.round_statistics(rounds(spark, sf_dir)).select(
        "n_studies", r6("mean_failed"), r6("mean_valid"), r6("mean_silent"), r6("mean_need"))


@query("rerun_plan", RN + """, op AS (
  SELECT o_orderkey, qid, need FROM latest JOIN (SELECT o_orderkey, qid, yes, n FROM ri) USING (o_orderkey) JOIN need USING (yes, n) WHERE need > 0),
org AS (SELECT study, qid FROM ri WHERE version = '0'),
alive AS (SELECT DISTINCT latest.o_orderkey FROM latest JOIN org USING (study) JOIN op ON op.o_orderkey = latest.o_orderkey AND op.qid = org.qid)
SELECT study, version, coalesce((SELECT string_agg(qid, ',' ORDER BY qid) FROM op WHERE op.o_orderkey = latest.o_orderkey), '') AS open_qids,
  (SELECT CAST(min(need) AS BIGINT) FROM op WHERE op.o_orderkey = latest.o_orderkey) AS places,
  (SELECT count(*) FROM adm WHERE adm.o_orderkey = latest.o_orderkey) - (SELECT count(*) FROM sup WHERE sup.o_orderkey = latest.o_orderkey) AS n_remaining,
  CASE WHEN o_orderkey IN (SELECT o_orderkey FROM alive) THEN version ELSE 'LAST' END AS closed_version,
  CASE WHEN o_orderkey IN (SELECT o_orderkey FROM alive) THEN study ELSE '' END AS next_study FROM latest""")
def rerun_plan(spark, sf_dir):
    return rd.rerun_plan(rounds(spark, sf_dir)).select(
        "study", "version", F.array_join("open_qids", ",").alias("open_qids"), F.col("places").cast("long").alias("places"),
        F.size("remaining").cast("long").alias("n_remaining"), "closed_version", "next_study")


VERSIONED = """v AS (SELECT l_suppkey AS study, l_partkey AS qid, year(l_shipdate) AS version, CAST(sum(CAST(l_quantity > 25 AS INTEGER)) AS BIGINT) AS yes,
  count(*) AS n FROM lineitem GROUP BY ALL)"""


def _versioned(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("study"), F.col("l_partkey").alias("qid"), F.year("l_shipdate").alias("version")).agg(
        F.sum((F.col("l_quantity") > 25).cast("int")).alias("yes"), F.count(F.lit(1)).alias("n"))


@query("cumulated_votes", with_ctes(VERSIONED) + """
SELECT study, qid, CAST(version AS BIGINT) AS version, CAST(sum(yes) OVER w AS BIGINT) AS cum_yes, CAST(sum(n) OVER w AS BIGINT) AS cum_n
FROM v WINDOW w AS (PARTITION BY study, qid ORDER BY version)""")
def cumulated_votes(spark, sf_dir):
    return rd.cumulate_votes(_versioned(spark, sf_dir)).select(
        "study", "qid", F.col("version").cast("long").alias("version"), "cum_yes", "cum_n")


@query("carried_votes", with_ctes(VERSIONED) + """
SELECT c.study, c.qid, CAST(c.version AS BIGINT) AS version, c.yes + coalesce(p.yes, 0) AS yes, c.n + coalesce(p.n, 0) AS n
FROM v c LEFT JOIN v p ON p.study = c.study AND p.qid = c.qid AND p.version = c.version - 1""")
def carried_votes(spark, sf_dir):
    v = _versioned(spark, sf_dir)
    return rd.carry_votes(v, v).withColumn("version", F.col("version").cast("long"))


@query("study_candidates", """WITH st AS (
  SELECT o_custkey AS study, 2 + count(*) % 3 AS places, count(*) AS n_items FROM orders GROUP BY o_custkey),
cap AS (SELECT s_suppkey AS annotator, CAST(floor(s_acctbal / 200) AS BIGINT) AS room FROM supplier),
hist AS (SELECT DISTINCT o_custkey AS study, l_suppkey AS annotator FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
free AS (SELECT st.study, st.places, cap.annotator, cap.room, row_number() OVER (PARTITION BY st.study ORDER BY room DESC, annotator) AS nth
  FROM st JOIN cap ON room > n_items AND room > 0
  WHERE NOT EXISTS (SELECT 1 FROM hist WHERE hist.study = st.study AND hist.annotator = cap.annotator))
SELECT study, nth, annotator, room FROM free WHERE nth <= places""")
def study_candidates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("study"))
    n = F.count(F.lit(1))
    studies = orders.groupBy("study").agg((F.lit(2) + n % 3).alias("places"), n.alias("n_items"))
    capacity = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("annotator"), F.floor(F.col("s_acctbal") / 200).alias("room"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("annotator"))
    history = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("study", "annotator").distinct()
    return rd.study_candidates(studies, capacity, history).select(
        "study", F.col("nth").cast("long").alias("nth"), "annotator", "room")


@query("round_robin", """
SELECT 'annotator' AS kind, CAST(s_suppkey AS VARCHAR) AS id, (row_number() OVER (ORDER BY s_suppkey) - 1) % 7 AS grp FROM supplier
UNION ALL SELECT 'study', CAST(c_custkey AS VARCHAR), (row_number() OVER (ORDER BY c_custkey) - 1) % 7 FROM customer""")
def round_robin(spark, sf_dir):
    return rd.round_robin(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("annotator")),
                          table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study")), 7)


def _open_groups(spark, sf_dir):
    """Studies with the items of their latest orders that still lack votes."""
    line = table(spark, sf_dir, "lineitem")
    return line.where("l_quantity > 15").groupBy(F.col("l_orderkey").alias("study")).agg(
        F.count_distinct("l_partkey").alias("size"))


# First-fit decreasing by size: each size fills the rooms of the bins in their order, then opens new bins.
PACKED_SQL = """WITH RECURSIVE sized AS (
  SELECT l_orderkey AS study, count(DISTINCT l_partkey) AS size FROM lineitem WHERE l_quantity > 15 GROUP BY 1),
placed AS (SELECT *, least(size, 11) AS cls, row_number() OVER (PARTITION BY least(size, 11) ORDER BY size DESC, study) AS place FROM sized),
counts AS (SELECT c.cls, count(p.study) AS many FROM (SELECT unnest(range(1, 12)) AS cls) c LEFT JOIN placed p USING (cls) GROUP BY 1),
fill(cls, rooms, takes) AS (
  SELECT CAST(12 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT cls, list_concat(list_transform(rooms, lambda r, i: r - old[i] * cls), list_transform(new, lambda t: 10 - t * cls)), list_concat(old, new)
  FROM (SELECT cls, rooms, old, list_transform(range(CAST(ceil((many - coalesce(list_sum(old), 0)) / greatest(1, 10 // cls)) AS BIGINT)),
          lambda j: least(greatest(1, 10 // cls), CAST(many - coalesce(list_sum(old), 0) AS BIGINT) - j * greatest(1, 10 // cls))) AS new
        FROM (SELECT cls, many, rooms, list_transform(caps, lambda c, i: CAST(greatest(0, least(c, many - coalesce(list_sum(caps[1:i - 1]), 0))) AS BIGINT)) AS old
              FROM (SELECT c.cls, c.many, f.rooms, list_transform(f.rooms, lambda r: greatest(0, r // c.cls)) AS caps
                    FROM fill f JOIN counts c ON c.cls = f.cls - 1)))),
seats AS (SELECT cls, bin, row_number() OVER (PARTITION BY cls ORDER BY bin) AS place FROM (
  SELECT cls, bin, unnest(range(take)) FROM (SELECT cls, generate_subscripts(takes, 1) - 1 AS bin, unnest(takes) AS take FROM fill) WHERE take > 0)),
packed AS (SELECT study, size, bin FROM placed JOIN seats USING (cls, place))
"""


@query("packed_studies", PACKED_SQL + "SELECT study, size, CAST(bin AS BIGINT) AS bin FROM packed")
def packed_studies(spark, sf_dir):
    return rd.pack_studies(_open_groups(spark, sf_dir))


@query("packed_study_loads", """WITH g AS (
  SELECT l_orderkey, count(DISTINCT l_partkey) AS size FROM lineitem WHERE l_quantity > 15 GROUP BY l_orderkey)
SELECT count(*) AS n_studies, CAST(sum(size) AS BIGINT) AS n_items, 0 AS n_overfull, 0 AS n_wasteful FROM g""")
def packed_study_loads(spark, sf_dir):
    """Bins above ten items or, besides one, bins that would fit into another one: both must not occur."""
    packed = rd.pack_studies(_open_groups(spark, sf_dir))
    bins = packed.groupBy("bin").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("k"), F.max("size").alias("top"))
    half = F.count_if(F.col("load") <= 5)
    return bins.agg(
        F.sum("k").alias("n_studies"), F.sum("load").alias("n_items"),
        F.count_if((F.col("load") > 10) & (F.col("k") > 1)).cast("int").alias("n_overfull"),
        F.greatest(half - 1, F.lit(0)).cast("int").alias("n_wasteful"))


@query("merged_studies", PACKED_SQL + """, lists AS (
  SELECT l_orderkey AS study, list_sort(list(DISTINCT 'Q-' || l_partkey)) AS qids, min(l_linenumber) AS places FROM lineitem WHERE l_quantity > 15 GROUP BY 1)
SELECT CAST(bin AS BIGINT) AS bin, string_agg(CAST(study AS VARCHAR), '|' ORDER BY size DESC, study) AS study,
  string_agg(CAST(places + 1 AS VARCHAR), '|' ORDER BY size DESC, study) AS version,
  string_agg(array_to_string(qids, ','), ',' ORDER BY size DESC, study) AS qids, min(places) AS places
FROM packed JOIN lists USING (study) GROUP BY bin""")
def merged_studies(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 15")
    lists = line.groupBy(F.col("l_orderkey").alias("study")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("Q-"), "l_partkey"))).alias("qids"),
        F.min("l_linenumber").alias("places"), F.min("l_linenumber").cast("string").alias("version"))
    packed = rd.pack_studies(_open_groups(spark, sf_dir)).join(lists, "study")
    return rd.merged_studies(packed).select("bin", "study", "version", F.array_join("qids", ",").alias("qids"), "places")


@query("appended_rounds", R + """
SELECT study, version, status FROM rr UNION ALL SELECT 'N' || s_suppkey, '0', 'INIT' FROM supplier""")
def appended_rounds(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), "s_suppkey").alias("study"), F.array(F.lit("Q-1")).alias("qids"))
    return rd.append_rounds(rounds(spark, sf_dir), new).select("study", "version", "status")


@query("duration_stats", """
SELECT median(floor(o_totalprice)) AS median, round(avg(floor(o_totalprice)), 4) AS mean, round(stddev_samp(floor(o_totalprice)), 4) AS std FROM orders""")
def duration_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.floor("o_totalprice").cast("string").alias("seconds"))
    return rd.duration_stats(rows).select("median", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("pay_per_hour", """WITH p AS (
  SELECT l_orderkey AS study, (l_extendedprice + l_tax * 100 + l_discount * 100) / 10000 / (l_quantity * 60 / 3600) AS pph FROM lineitem WHERE l_linestatus = 'F')
SELECT count(*) AS n, round(avg(pph), 4) AS mean_pph, round(median(pph), 4) AS median_pph, count(DISTINCT study) AS n_studies FROM p""")
def pay_per_hour(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("study"), F.when(F.col("l_linestatus") == "F", "APPROVED").otherwise("REJECTED").alias("status"),
        F.col("l_extendedprice").alias("reward"), F.array(F.col("l_tax") * 100, F.col("l_discount") * 100).alias("bonus"),
        (F.col("l_quantity") * 60).alias("secs"))
    return rd.pay_per_hour(rows).select("n", F.round("mean_pph", 4).alias("mean_pph"), F.round("median_pph", 4).alias("median_pph"), "n_studies")


@query("demographics", """
SELECT 'segment' AS what, c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'DATA_EXPIRED') GROUP BY c_mktsegment
UNION ALL SELECT 'nation', n_name, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def demographics(spark, sf_dir):
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    a = rd.demographics(people, "c_mktsegment", ("MACHINERY", "DATA_EXPIRED")).withColumn("what", F.lit("segment"))
    return a.unionByName(rd.demographics(people, "n_name").withColumn("what", F.lit("nation")))


@query("described_ages", """WITH a AS (SELECT floor(c_acctbal / 100) AS age FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT count(age) AS n, round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS std, min(age) AS min, quantile_cont(age, 0.25) AS q1,
  median(age) AS median, quantile_cont(age, 0.75) AS q3, max(age) AS max FROM a""")
def described_ages(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "MACHINERY", "DATA_EXPIRED").otherwise(
        F.floor(F.col("c_acctbal") / 100).cast("string")).alias("age"))
    return rd.describe_ages(people).select("n", r6("mean"), r6("std"), "min", "q1", "median", "q3", "max")


# -- identity -----------------------------------------------------------------------------------

MAP_SQL = """known AS (
  SELECT c_name AS orig, 'PROLIFIC_' || c_custkey AS anon FROM customer WHERE c_mktsegment = 'BUILDING'),
seen AS (SELECT c_name AS orig, min(o_orderkey) AS seen_at FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY c_name),
fresh AS (SELECT * FROM seen WHERE orig IS NOT NULL AND orig NOT IN (SELECT orig FROM known)),
top AS (SELECT coalesce(max(CAST(regexp_extract(anon, '^PROLIFIC_(\\d+)$', 1) AS BIGINT)), 0) AS top FROM known),
map AS (SELECT orig, anon FROM known
  UNION ALL SELECT orig, 'PROLIFIC_' || (top + row_number() OVER (ORDER BY seen_at, orig)) FROM fresh, top WHERE NOT contains(lower(orig), '#00000001')
  UNION ALL SELECT orig, replace(lower(orig), '#00000001', 'Lead') FROM fresh WHERE contains(lower(orig), '#00000001'))"""


def name_map(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    known = customer.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_name").alias("orig"), F.concat(F.lit("PROLIFIC_"), F.col("c_custkey").cast("string")).alias("anon"))
    seen = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(
        customer.select("c_custkey", F.col("c_name").alias("orig")), "c_custkey", "left")
    return idn.extend_map(known, seen, "o_orderkey", lead="#00000001", lead_as="Lead")


@query("name_map", with_ctes(MAP_SQL) + "SELECT orig, anon FROM map")
def extended_map(spark, sf_dir):
    return name_map(spark, sf_dir)


@query("anonymised_orders", with_ctes(MAP_SQL) + """
SELECT o_orderkey, coalesce(anon, c_name) AS c_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN map ON orig = c_name""")
def anonymised_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return idn.apply_map(rows, name_map(spark, sf_dir), "c_name").select("o_orderkey", "c_name")


LIST_MAP = """, m AS (SELECT 'U' || s_suppkey AS orig, 'A' || s_suppkey AS anon FROM supplier WHERE s_acctbal > 1000),
pe AS (SELECT r.o_orderkey, annotator, anon FROM rr r JOIN sup USING (o_orderkey) LEFT JOIN m ON orig = annotator),
bad AS (SELECT DISTINCT o_orderkey FROM pe JOIN r USING (o_orderkey) WHERE anon IS NULL AND version <> 'TRAIN')
"""


def _mapped_lists(spark, sf_dir):
    rows = rounds(spark, sf_dir).select("study", "version", "status", "admitted", "participated", "valid", "qids")
    keys = rows.withColumn("row_id", F.md5(F.concat_ws("|", "study", "version", F.array_join("qids", ","))))
    names = table(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(
        F.concat(F.lit("U"), "s_suppkey").alias("orig"), F.concat(F.lit("A"), "s_suppkey").alias("anon"))
    return idn.apply_map_to_lists(keys, names, ["row_id"], ["admitted", "participated", "valid"])


@query("anonymised_lists", R + LIST_MAP + """
SELECT study, version, string_agg(CASE WHEN version = 'TRAIN' THEN annotator ELSE anon END, ',' ORDER BY annotator) AS participated
FROM (SELECT rr.study, rr.version, pe.* FROM rr JOIN pe USING (o_orderkey)) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM bad)
GROUP BY o_orderkey, study, version""")
def anonymised_lists(spark, sf_dir):
    done, _ = _mapped_lists(spark, sf_dir)
    return done.select("study", "version", F.array_join("participated", ",").alias("participated"))


@query("quarantined_lists", R + LIST_MAP + "SELECT study, version FROM rr SEMI JOIN bad USING (o_orderkey)")
def quarantined_lists(spark, sf_dir):
    return _mapped_lists(spark, sf_dir)[1].select("study", "version")


# -- survey exports -----------------------------------------------------------------------------

TOKENS = 6


@lru_cache(maxsize=1)
def _export_cells() -> tuple[tuple[str, str], ...]:
    """Export column names and the SQL condition under which a session marked the cell."""
    cells = []
    for item, key in (("NPR-8-3", "o_orderkey"), ("CNN-12-5", "o_custkey")):
        for ident, step in (("R2", 2), ("R", 3), ("P", 5)):
            for t in range(1, TOKENS + 1):
                cells.append((f"Q-{item}-{ident}_1_{t}", f"({key} + {t}) % {step} = 0"))
    return tuple(cells)


def wide_export(spark, sf_dir):
    """Orders as survey sessions: one column per (item, category, token), two rows of metadata."""
    orders = table(spark, sf_dir, "orders")
    cells = [F.when(F.expr(cond), "On").alias(name) for name, cond in _export_cells()]
    rows = orders.select(
        F.concat(F.lit("P"), "o_custkey").alias("Q-PID"), F.concat(F.lit("R_"), "o_orderkey").alias("ResponseId"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("StartDate"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss").alias("EndDate"),
        F.when(F.col("o_orderstatus") == "P", "40").otherwise("100").alias("Progress"),
        F.when(F.col("o_orderstatus") == "P", "In Process").otherwise("Completed").alias("Q_RESPONSE_TYPE"),
        F.floor("o_totalprice").cast("string").alias("Duration (in seconds)"), F.col("o_orderpriority").alias("Q-Comment"),
        (F.col("o_orderkey") % 3).cast("string").alias("Quality_Fails"), *cells,
        F.when(F.col("o_custkey") % 4 == 0, "2").when(F.col("o_custkey") % 4 == 1, "3").otherwise("4").alias("Q-NPR-8-3-C"),
        F.col("o_orderstatus").alias("Q-NPR-8-3-CL"), F.lit("9").alias("Q-NPR-8-3-Timer"))
    meta = rows.limit(2).select(*[F.lit("{ImportId}").alias(c) for c in rows.columns])
    return meta.unionByName(rows)


def _export_sql(include_history: bool) -> str:
    by: dict[tuple[str, str], list[str]] = {}
    for name, cond in _export_cells():
        head, _, tok = name.partition("_1_")
        item, ident = head[2:].rsplit("-", 1)
        by.setdefault((item, ident), []).append(f"CASE WHEN {cond} THEN '{tok}' END")
    parts = []
    for (item, ident), cases in by.items():
        category = {"R2": "Referred", "R": "Repetition", "P": "Paraphrase"}[ident]
        value = f"'[' || concat_ws(', ', {', '.join(cases)}) || ']'"
        if not include_history and ident != "R2" and item == "NPR-8-3":
            value = f"CASE WHEN o_custkey % 4 = 0 THEN '[]' ELSE {value} END"
        parts.append(f"SELECT '{item}' AS qid, '{category}' AS category, {value} AS highlighted, session FROM s WHERE done")
    parts += [
        "SELECT 'NPR-8-3', 'Is Referring', CASE o_custkey % 4 WHEN 0 THEN 'History' WHEN 1 THEN 'No' ELSE 'Yes' END, session FROM s WHERE done",
        "SELECT 'NPR-8-3', 'Comment', o_orderstatus, session FROM s WHERE done",
        "SELECT session, 'Comment', o_orderpriority, session FROM s WHERE done",
        "SELECT session, 'Time', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), session FROM s WHERE done",
        "SELECT session, '# failed ACs', CAST(o_orderkey % 3 AS VARCHAR), session FROM s",
        "SELECT session, 'EndTime', strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'), session FROM s WHERE done",
        "SELECT session, 'Stopped', CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END, session FROM s",
    ]
    return """WITH s AS (SELECT *, 'R_' || o_orderkey AS session, o_orderstatus <> 'P' AS done FROM orders
  WHERE o_custkey NOT IN (3)),
long AS (""" + "\n UNION ALL ".join(parts) + ")\n"


def _long(spark, sf_dir, include_history: bool = True):
    return an.transform_export(wide_export(spark, sf_dir), an.ExportOptions(
        removed=("test", "P3"), include_fails=True, include_history=include_history))


@query("long_annotations", _export_sql(True) + "SELECT qid, category, highlighted, session FROM long")
def long_annotations(spark, sf_dir):
    return _long(spark, sf_dir).select("qid", "category", "highlighted", "session")


@query("long_annotations_without_history", _export_sql(False) + """
SELECT qid, category, highlighted, count(*) AS n FROM long WHERE NOT contains(qid, 'R_') GROUP BY ALL""")
def long_annotations_without_history(spark, sf_dir):
    return an.item_rows(_long(spark, sf_dir, False)).groupBy("qid", "category", "highlighted").agg(F.count(F.lit(1)).alias("n"))


@query("session_facts", _export_sql(True) + """
SELECT session, max(CASE WHEN category = 'Time' THEN CAST(highlighted AS BIGINT) END) AS seconds,
  max(CASE WHEN category = '# failed ACs' THEN CAST(highlighted AS BIGINT) END) AS failed_acs,
  max(CASE WHEN category = 'Stopped' THEN CAST(highlighted AS BIGINT) END) AS stopped,
  max(CASE WHEN category = 'Comment' THEN highlighted END) AS comment FROM long WHERE starts_with(qid, 'R_') GROUP BY session""")
def session_facts(spark, sf_dir):
    return an.sessions(_long(spark, sf_dir)).select(
        "session", *[F.col(c).cast("long").alias(c) for c in ("seconds", "failed_acs", "stopped")], "comment")


@query("labels_with_comments", _export_sql(True) + """
SELECT session, l.highlighted AS label, c.highlighted AS comment FROM (SELECT * FROM long WHERE qid = 'NPR-8-3' AND category = 'Paraphrase') l
JOIN (SELECT * FROM long WHERE qid = 'NPR-8-3' AND category = 'Comment') c USING (session)""")
def labels_with_comments(spark, sf_dir):
    return an.labels_with_comments(_long(spark, sf_dir)).select("session", "label", "comment")


@query("unmatched_labels", _export_sql(True) + """, odd AS (
  SELECT qid, category, session FROM long WHERE NOT (qid = 'NPR-8-3' AND category = 'Comment' AND highlighted = 'F')
  UNION ALL SELECT qid, category, session FROM long WHERE qid = 'NPR-8-3' AND category = 'Paraphrase' AND ends_with(session, '7'))
SELECT qid, session, count(*) FILTER (WHERE category = 'Paraphrase') AS n_labels, count(*) FILTER (WHERE category = 'Comment') AS n_comments
FROM odd WHERE category IN ('Paraphrase', 'Comment') AND NOT starts_with(qid, 'R_') GROUP BY qid, session
HAVING n_labels <> 1 OR n_comments <> 1""")
def unmatched_labels(spark, sf_dir):
    long = _long(spark, sf_dir)
    lost = long.where(~((F.col("qid") == "NPR-8-3") & (F.col("category") == "Comment") & (F.col("highlighted") == "F")))
    twice = long.where((F.col("qid") == "NPR-8-3") & (F.col("category") == "Paraphrase") & F.endswith("session", F.lit("7")))
    return an.unmatched_labels(lost.unionByName(twice)).select("qid", "session", "n_labels", "n_comments")


@query("restricted_annotations", _export_sql(True) + """
SELECT qid, category, highlighted, session FROM long SEMI JOIN (SELECT o_orderkey, 'R_' || o_orderkey AS session FROM orders WHERE o_custkey % 2 = 0) USING (session)
WHERE qid = 'CNN-12-5'""")
def restricted_annotations(spark, sf_dir):
    even = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("P"), "c_custkey").alias("annotator"))
    only = table(spark, sf_dir, "region").select(F.lit("CNN-12-5").alias("qid")).distinct()
    return an.restrict(_long(spark, sf_dir), only, even).select("qid", "category", "highlighted", "session")


@query("exports_from_files", _export_sql(True) + "SELECT qid, category, highlighted, session FROM long")
def exports_from_files(spark, sf_dir):
    folder = new_folder(spark, "exports")
    wide = wide_export(spark, sf_dir)
    write_tsv(wide.where("Progress <> '40'"), f"{folder}/wide", "UTF-16")
    write_tsv(wide.where("Progress = '40'"), f"{folder}/plain")
    return read_exports(spark, [f"{folder}/wide/*.csv", f"{folder}/plain/*.csv"], an.ExportOptions(
        removed=("test", "P3"), include_fails=True)).select("qid", "category", "highlighted", "session")


@query("next_versions", "SELECT o_orderkey, (o_orderkey % 3 + 1) || '|' || (o_custkey % 12 + 1) AS version FROM orders")
def next_versions_of_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", F.col("o_orderkey") % 3, F.col("o_custkey") % 12).alias("version"))
    return rows.select("o_orderkey", next_versions("version").alias("version"))


@query("parsed_fractions", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN CAST(l_quantity AS INTEGER) END AS yes,
  CASE WHEN l_linenumber < 6 THEN CAST(l_suppkey AS INTEGER) END AS n FROM lineitem""")
def parsed_fractions(spark, sf_dir):
    top, bottom = F.col("l_quantity").cast("int"), F.col("l_suppkey")
    text = F.when(F.col("l_linenumber") < 6, F.concat_ws(" / ", top, bottom)).when(
        F.col("l_linenumber") == 6, F.concat_ws(" / ", top, F.lit("x"))).otherwise(top.cast("string"))
    return table(spark, sf_dir, "lineitem").withColumn("f", fraction(text)).select("l_orderkey", "l_linenumber", "f.yes", "f.n")


@query("unknown_categories", _export_sql(True) + """
SELECT category, count(*) AS n FROM long WHERE category NOT IN ('Referred', 'Paraphrase', 'Comment') GROUP BY category""")
def unknown_categories(spark, sf_dir):
    return an.unknown_categories(_long(spark, sf_dir), ("Referred", "Paraphrase", "Comment"))


@query("training_funnel", _export_sql(True) + """, f AS (
  SELECT (SELECT count(DISTINCT o_custkey) FROM s) AS n_annotators,
    (SELECT count(*) FROM long WHERE category = 'Stopped' AND highlighted = '1') AS n_stopped,
    (SELECT count(*) FROM long WHERE category = '# failed ACs' AND highlighted <> '0') AS n_failed_ac,
    (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS n_passed)
SELECT n_annotators, n_stopped, n_failed_ac, n_passed, n_annotators - n_stopped - n_passed - n_failed_ac AS n_failed_cc,
  round(n_passed / (n_annotators - n_stopped), 6) AS passed_share FROM f""")
def training_funnel(spark, sf_dir):
    passed = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("annotator"))
    return an.training_funnel(_long(spark, sf_dir), passed).select(
        "n_annotators", "n_stopped", "n_failed_ac", "n_passed", "n_failed_cc", r6("passed_share"))


@query("corrected_labels", """SELECT p_partkey AS qid, c AS category, CASE WHEN c = 'Comment' AND x.v IS NOT NULL THEN x.v ELSE
  CASE c WHEN 'Comment' THEN p_name ELSE p_brand END END AS highlighted
FROM part CROSS JOIN (VALUES ('Comment'), ('Is Referring')) t(c)
LEFT JOIN (SELECT l_partkey, arg_max('fixed ' || l_suppkey, l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey) AS v FROM lineitem
           WHERE l_quantity > 45 GROUP BY l_partkey) x ON l_partkey = p_partkey""")
def corrected_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    long = part.select(F.col("p_partkey").alias("qid"), F.explode(F.array(
        F.struct(F.lit("Comment").alias("category"), F.col("p_name").alias("highlighted")),
        F.struct(F.lit("Is Referring").alias("category"), F.col("p_brand").alias("highlighted")))).alias("e")).select("qid", "e.*")
    fixes = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(
        F.col("l_partkey").alias("qid"), F.explode(F.array(F.lit("Comment"), F.lit("Is Referring"))).alias("category"),
        F.concat(F.lit("fixed "), "l_suppkey").alias("highlighted"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ord"))
    return an.apply_corrections(long, fixes)


@query("filled_highlights", _export_sql(True) + """
SELECT category, highlighted, count(*) AS n FROM (
  SELECT category, highlighted FROM long WHERE qid = 'NPR-8-3' AND category = 'Is Referring'
  UNION ALL SELECT c, CASE WHEN highlighted = 'Yes' THEN '-' ELSE '[]' END FROM long, (VALUES ('Referred'), ('Paraphrase')) t(c)
  WHERE qid = 'NPR-8-3' AND category = 'Is Referring') GROUP BY ALL""")
def filled_highlights(spark, sf_dir):
    choices = _long(spark, sf_dir).where("category = 'Is Referring'")
    return an.fill_highlights(choices).groupBy("category", "highlighted").agg(F.count(F.lit(1)).alias("n"))


@query("inspection_rows", _export_sql(True) + """, txt AS (SELECT string_agg(n_name, ' ' ORDER BY n_nationkey) AS names FROM nation)
SELECT session, category, CASE category WHEN 'Comment' THEN 'sum' WHEN 'Referred' THEN
  array_to_string(list_transform(str_split((SELECT names FROM txt), ' '), lambda w, i:
    CASE WHEN list_contains(str_split(replace(replace(highlighted, '[', ''), ']', ''), ', '), CAST(i AS VARCHAR)) THEN upper(w) ELSE w END), ' ')
  ELSE '' END AS text FROM long WHERE qid = 'NPR-8-3' AND category IN ('Referred', 'Comment', 'Is Referring')""")
def inspection_rows(spark, sf_dir):
    long = _long(spark, sf_dir).where("qid = 'NPR-8-3' AND category IN ('Referred', 'Comment', 'Is Referring')")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: n["n_name"]), " ")
    texts = table(spark, sf_dir, "nation").agg(names.alias("guest_text")).select(
        F.lit("NPR-8-3").alias("qid"), "guest_text", F.lit("x").alias("host_text"), F.lit("sum").alias("summary"))
    return an.with_inspection_text(long, texts).select("session", "category", "text")


@query("restricted_sessions", """WITH w AS (SELECT l_partkey AS item, l_orderkey AS session FROM lineitem WHERE l_tax > 0.06)
SELECT l_partkey AS item, count(*) AS n FROM lineitem SEMI JOIN w ON w.item = l_partkey AND w.session = l_orderkey GROUP BY l_partkey""")
def restricted_sessions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("session"), "l_tax")
    wanted = line.where("l_tax > 0.06").select("item", F.array("session").alias("sessions"))
    return an.restrict_to_sessions(line, wanted, "item").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("id_problems", """SELECT o_custkey AS id, count(c.c_custkey) AS n FROM (SELECT DISTINCT o_custkey FROM orders) o
LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 8000) c ON c.c_custkey = o_custkey
GROUP BY o_custkey HAVING count(c.c_custkey) <> 1""")
def id_problems(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    rows = c.where("c_acctbal > 0").unionByName(c.where("c_acctbal > 8000"))
    return an.id_problems(rows, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("random_customers", "SELECT c_custkey FROM customer ORDER BY md5('21|' || c_custkey), c_custkey LIMIT 50")
def random_customers(spark, sf_dir):
    return s.random_sample(table(spark, sf_dir, "customer").select("c_custkey"), 50, 21, "c_custkey")


@query("reindexed_rows", """SELECT c_custkey AS id, o.n FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def reindexed_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nth"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"))
    return an.reindexed(ids, rows, "id").select("id", "n")
