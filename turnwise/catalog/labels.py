"""Keyword label, sampling and set queries over parts as labelled pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.base import (CLASSES_SQL, FIRST_CLASSES_SQL, FLAGS_SQL, WORDS, comments, query, r6, table,
                                   unpivot_sql, with_ctes)
from turnwise.operators import keywords as k
from turnwise.operators import sampling as s
from turnwise.operators import sets

VOCAB = k.Vocabulary(WORDS)
FL = with_ctes(FLAGS_SQL)


def _flags(spark, sf_dir):
    return k.with_flags(comments(spark, sf_dir), VOCAB)


COUNTS = {
    "reviewed": "true", "context": "context", "ambiguous_not_context": "ambiguous AND NOT context",
    "context_and_ambiguous": "ambiguous AND context", "positive": "positive", "clear": "clear",
    "repetition": "repetition", "positive_not_repetition": "positive AND NOT repetition",
    "clear_not_repetition": "clear AND NOT repetition", "universal": "universal",
    "universal_not_repetition": "universal AND NOT repetition", "universal_not_context": "universal AND NOT context",
    "alike": "alike", "clear_not_alike": "clear AND NOT alike",
    "positive_not_alike": "positive AND NOT alike", "repetition_not_alike": "repetition AND NOT alike",
    "alike_not_repetition": "alike AND NOT repetition", "directional": "directional",
    "directional_not_alike": "directional AND NOT alike", "directional_not_repetition": "directional AND NOT repetition",
    "shift": "shift", "shift_not_alike": "shift AND NOT alike", "shift_not_repetition": "shift AND NOT repetition",
    "pragmatic": "pragmatic", "pragmatic_not_alike": "pragmatic AND NOT alike",
    "pragmatic_not_repetition": "pragmatic AND NOT repetition", "side": "side", "negative": "negative",
    "alike_non": "alike_non", "related": "related", "partial": "partial", "conclusion": "conclusion",
    "unrelated": "unrelated", "difficult_negative": "difficult AND negative",
    "difficult_positive": "difficult AND positive", "meta": "meta AND NOT context", "negated": "negated AND NOT context",
    "surrogate": "surrogate AND NOT context", "misrepresented": "misrepresented AND NOT context",
}


@query("review_counts", FL + unpivot_sql(list(COUNTS), list(COUNTS.values()), "flags", "measure"))
def review_counts(spark, sf_dir):
    return k.review_counts(_flags(spark, sf_dir))


def _combo_sql(names: list[str]) -> str:
    return " || ".join(f"CAST(CAST({n} AS INTEGER) AS VARCHAR)" for n in names)


@query("positive_combinations", FL + f"""
SELECT {_combo_sql(k.POSITIVE_FLAGS)} AS combo, count(*) AS n FROM flags WHERE positive AND NOT context GROUP BY 1""")
def positive_combinations(spark, sf_dir):
    return k.positive_combinations(_flags(spark, sf_dir))


@query("negative_combinations", FL + f"""
SELECT {_combo_sql(k.NEGATIVE_FLAGS)} AS combo, count(*) AS n FROM flags
WHERE negative OR (context AND NOT ambiguous AND NOT positive) GROUP BY 1""")
def negative_combinations(spark, sf_dir):
    return k.negative_combinations(_flags(spark, sf_dir))


@query("keyword_ids", FL + f"""
SELECT qid, 'with' AS kind FROM comments WHERE choice = 'Yes' AND contains(comment, 'STANDARD') AND contains(comment, 'red')
UNION ALL SELECT qid, 'without' FROM comments WHERE choice = 'Yes' AND NOT contains(comment, 'PROMO') AND NOT contains(comment, 'ring')
UNION ALL SELECT qid, 'both' FROM comments WHERE choice = 'No' AND contains(comment, 'cold') AND NOT contains(comment, 'rod')""")
def keyword_ids(spark, sf_dir):
    rows = comments(spark, sf_dir)
    a = k.keyword_ids(rows, VOCAB, ("paraphrase", "universal")).withColumn("kind", F.lit("with"))
    b = k.keyword_ids(rows, VOCAB, (), ("non_paraphrase", "repetition")).withColumn("kind", F.lit("without"))
    c = k.keyword_ids(rows, VOCAB, ("partial",), ("unrelated",), "no").withColumn("kind", F.lit("both"))
    return sets.union_all([a, b, c])


@query("choice_counts", FL + """
SELECT choice, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM comments), 6) AS percent FROM comments GROUP BY choice""")
def choice_counts(spark, sf_dir):
    return k.percentages(k.choice_counts(comments(spark, sf_dir))).select("choice", "n", r6("percent"))


@query("brand_percentages", """WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)
SELECT p_type, p_brand, n, round(100.0 * n / sum(n) OVER (PARTITION BY p_type), 6) AS percent FROM c""")
def brand_percentages(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return k.percentages(c, "p_type").select("p_type", "p_brand", "n", r6("percent"))


CLASSES = ["error", "context", "ambiguous", "positive", "negative", "repetition", "alike", "related", "difficult"]


@query("class_counts", with_ctes(CLASSES_SQL) + unpivot_sql(CLASSES, CLASSES, "classes", "class"))
def class_counts(spark, sf_dir):
    return k.class_counts(k.with_classes(comments(spark, sf_dir), VOCAB))


@query("class_counts_first_batch", with_ctes(FIRST_CLASSES_SQL) + unpivot_sql(CLASSES, CLASSES, "classes", "class"))
def class_counts_first_batch(spark, sf_dir):
    return k.class_counts(k.with_classes(comments(spark, sf_dir), VOCAB, True))


@query("class_summary", with_ctes(CLASSES_SQL) + """
SELECT 'plain' AS kind, count(*) FILTER (WHERE negative) AS negatives,
  count(*) FILTER (WHERE positive) - count(*) FILTER (WHERE repetition) AS other_positives,
  count(*) FILTER (WHERE repetition) AS repetitions FROM classes
UNION ALL SELECT 'with_ambiguous', count(*) FILTER (WHERE negative OR ambiguous OR context),
  count(*) FILTER (WHERE positive) - count(*) FILTER (WHERE repetition), count(*) FILTER (WHERE repetition) FROM classes""")
def class_summary(spark, sf_dir):
    c = k.with_classes(comments(spark, sf_dir), VOCAB)
    return k.class_summary(c).withColumn("kind", F.lit("plain")).unionByName(
        k.class_summary(c, True).withColumn("kind", F.lit("with_ambiguous")))


@query("class_overlaps", with_ctes(CLASSES_SQL) + """
SELECT count(*) FILTER (WHERE repetition AND NOT positive) AS repetition_outside,
  count(*) FILTER (WHERE positive AND negative) AS both_verdicts,
  count(*) FILTER (WHERE (positive OR negative) AND context) AS verdict_without_context,
  count(*) FILTER (WHERE (positive OR negative) AND ambiguous) AS verdict_on_ambiguous FROM classes""")
def class_overlaps(spark, sf_dir):
    return k.class_overlaps(k.with_classes(comments(spark, sf_dir), VOCAB))


SAMPLE = FL + ", sample_ AS (SELECT * FROM flags ORDER BY md5('6|' || qid), qid LIMIT 300)\n"

SAMPLE_COUNTS = {
    "positive": "positive", "unclear": "positive AND NOT clear", "clear": "positive AND clear",
    "repetition": "positive AND repetition", "universal": "positive AND universal",
    "context_dependent": "positive AND NOT universal", "shift": "positive AND shift", "alike": "positive AND alike",
    "pragmatic": "positive AND pragmatic", "directional": "positive AND directional", "negative": "negative",
    "negative_context": "context AND NOT positive AND NOT ambiguous", "alike_non": "alike_non", "partial": "partial",
    "unrelated": "unrelated", "conclusion": "conclusion", "related": "related",
}


@query("sample_label_counts", SAMPLE + unpivot_sql(list(SAMPLE_COUNTS), list(SAMPLE_COUNTS.values()), "sample_", "measure"))
def sample_label_counts(spark, sf_dir):
    flags = _flags(spark, sf_dir)
    return k.sample_label_counts(flags, s.random_sample(flags.select("qid"), 300, 6, "qid"))


STRATA = [(["0001000", "0001001"], 5), (["0001100", "0001010", "0001110"], 4), (["0011000"], 3), (["1101000"], 6)]


@query("combination_sample", FL + f""", c AS (SELECT qid, {_combo_sql(k.POSITIVE_FLAGS)} AS combo FROM flags WHERE positive AND NOT context),
s AS (SELECT *, CASE WHEN combo IN ('0001000', '0001001') THEN 0 WHEN combo IN ('0001100', '0001010', '0001110') THEN 1
  WHEN combo = '0011000' THEN 2 WHEN combo = '1101000' THEN 3 END AS stratum FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('8|' || qid), qid) AS k FROM s WHERE stratum IS NOT NULL)
SELECT qid, combo, stratum FROM r WHERE k <= CASE stratum WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 6 END""")
def combination_sample(spark, sf_dir):
    rows = _flags(spark, sf_dir).where("positive AND NOT context").select("qid", k.combination(k.POSITIVE_FLAGS).alias("combo"))
    return s.sample_by_combination(rows, STRATA, 8).select("qid", "combo", "stratum")


POOL = with_ctes(CLASSES_SQL) + """, pool AS (
  SELECT qid, CASE WHEN repetition THEN 'repetition' WHEN positive THEN 'positive' WHEN difficult THEN 'difficult'
    WHEN related THEN 'related' WHEN negative THEN 'other_negative' WHEN ambiguous THEN 'ambiguous' END AS class
  FROM classes WHERE NOT error AND NOT context),
pool_ AS (SELECT * FROM pool WHERE class IS NOT NULL),
s1 AS (SELECT *, 1 AS random FROM pool_ ORDER BY md5('12|' || qid), qid LIMIT 100),
got AS (SELECT class, count(*) AS n FROM s1 GROUP BY class),
q0 AS (SELECT * FROM (VALUES ('other_negative', 30), ('difficult', 20), ('related', 50), ('repetition', 40), ('positive', 90)) q(class, quota)),
excess AS (SELECT greatest(0, coalesce((SELECT n FROM got WHERE class = 'other_negative'), 0) - 30) AS e,
                  coalesce((SELECT n FROM got WHERE class = 'ambiguous'), 0) AS a),
quotas AS (SELECT class, CASE class WHEN 'other_negative' THEN quota + e WHEN 'difficult' THEN quota - e - a ELSE quota END AS quota FROM q0, excess),
missing AS (SELECT q.class, greatest(0, quota - coalesce(n, 0)) AS m FROM quotas q LEFT JOIN got USING (class)),
s2 AS (SELECT qid, class, 0 AS random FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('13|' || qid), qid) AS k FROM pool_ ANTI JOIN s1 USING (qid))
  JOIN missing USING (class) WHERE k <= m),
sample_ AS (SELECT qid, class, random FROM s1 UNION ALL SELECT * FROM s2)
"""


def _pool(spark, sf_dir):
    c = k.with_classes(comments(spark, sf_dir), VOCAB)
    cls = F.when(F.col("repetition"), "repetition").when(F.col("positive"), "positive").when(F.col("difficult"), "difficult") \
        .when(F.col("related"), "related").when(F.col("negative"), "other_negative").when(F.col("ambiguous"), "ambiguous")
    return c.where("NOT error AND NOT context").select("qid", cls.alias("class")).where("class IS NOT NULL")


def _quota_sample(pool):
    return s.quota_sample(pool, 100, {"other_negative": 30, "difficult": 20, "related": 50, "repetition": 40, "positive": 90},
                          12, ("other_negative", "difficult"), "ambiguous")


@query("quota_sample", POOL + "SELECT qid, class, random FROM sample_")
def quota_sample(spark, sf_dir):
    return _quota_sample(_pool(spark, sf_dir))


@query("sample_ratio", POOL + """
SELECT p.class, p.n AS n_pool, round(p.n / (SELECT count(*) FROM pool_), 6) AS share_pool, coalesce(x.n, 0) AS n_sample,
  round(coalesce(x.n, 0) / (SELECT count(*) FROM sample_), 6) AS share_sample
FROM (SELECT class, count(*) AS n FROM pool_ GROUP BY class) p LEFT JOIN (SELECT class, count(*) AS n FROM sample_ GROUP BY class) x USING (class)""")
def sample_ratio(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return s.sample_ratio(pool, _quota_sample(pool)).select("class", "n_pool", r6("share_pool"), "n_sample", r6("share_sample"))


@query("set_sizes", """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O')
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
  (SELECT count(*) FROM a SEMI JOIN b USING (id)) AS n_both, (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS n_any,
  (SELECT count(*) FROM a ANTI JOIN b USING (id)) AS n_only_a, (SELECT count(*) FROM b ANTI JOIN a USING (id)) AS n_only_b""")
def set_sizes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return sets.set_sizes(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "id")


@query("set_algebra", """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 400000)
SELECT id, 'both' AS part FROM a SEMI JOIN b USING (id) UNION ALL SELECT id, 'minus' FROM a ANTI JOIN b USING (id)
UNION ALL SELECT id, 'any' FROM (SELECT id FROM a UNION SELECT id FROM b)""")
def set_algebra(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    b = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return sets.union_all([
        sets.common_ids(a, b, "id").withColumn("part", F.lit("both")),
        sets.minus_ids(a, b, "id").withColumn("part", F.lit("minus")),
        sets.union_ids(a, b).withColumn("part", F.lit("any"))])


@query("set_relations", """WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), b AS (SELECT s_suppkey AS id FROM supplier)
SELECT CAST((SELECT count(*) FROM a SEMI JOIN b USING (id)) = 0 AS INTEGER) AS disjoint,
  CAST((SELECT count(*) FROM a ANTI JOIN b USING (id)) = 0 AS INTEGER) AS subset,
  CAST((SELECT count(*) FROM a ANTI JOIN b USING (id)) = 0 AND (SELECT count(*) FROM b ANTI JOIN a USING (id)) = 0 AS INTEGER) AS equal""")
def set_relations(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return sets.disjoint(a, b, "id").select(*[F.col(c).cast("int").alias(c) for c in ("disjoint", "subset", "equal")])


@query("in_every_study", """WITH g AS (SELECT l_partkey AS study, l_partkey // 2 AS grp, l_suppkey AS annotator FROM lineitem)
SELECT grp, annotator FROM g JOIN (SELECT grp, count(DISTINCT study) AS k FROM g GROUP BY grp) s USING (grp)
GROUP BY grp, annotator, k HAVING count(DISTINCT study) = k""")
def in_every_study(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("study"), F.col("l_suppkey").alias("annotator"))
    studies = rows.select(F.floor(F.col("study") / 2).alias("group"), "study").distinct()
    return sets.in_every_study(rows.distinct(), studies).withColumnRenamed("group", "grp")


@query("appended_runs", """WITH r AS (SELECT conv_id AS qid, role AS run, turn AS rep, text FROM conversations)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY run, rep) - 1 AS rep, md5(text) AS reply_md5 FROM r""")
def appended_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("qid"), F.col("role").alias("run"), F.col("turn").alias("rep"), F.col("text").alias("reply"))
    return sets.append_runs(rows).select("qid", "rep", F.md5("reply").alias("reply_md5"))
