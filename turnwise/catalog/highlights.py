"""Highlight, overlap and evaluation queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.base import HIGHLIGHTS_SQL, LETTERS, doc_tokens, highlights, query, r6, table, with_ctes
from turnwise.functions import text as x
from turnwise.operators import agreement as a
from turnwise.operators import evaluation as e
from turnwise.operators import highlights as h
from turnwise.operators import sampling as s
from turnwise.operators import sets
from turnwise.operators import subwords as sw
from turnwise.operators import votes as v

H = with_ctes(HIGHLIGHTS_SQL)

WEIGHTS = H + """, weights AS (
  SELECT t.item, t.toks, v.yes, v.n, w.tok, coalesce(c.c, 0) / greatest(v.yes, 1) AS w
  FROM toks t JOIN hl_votes v USING (item) JOIN words w ON w.item = t.item
  LEFT JOIN counts c ON c.item = w.item AND c.tok = w.tok)
"""


@query("token_weights", WEIGHTS + """
SELECT item, any_value(yes) AS yes, any_value(n) AS n, count(*) AS n_tok, round(sum(w), 6) AS total,
       round(max(w), 6) AS top, count(*) FILTER (WHERE w >= 0.5) AS n_half,
       md5(string_agg(CAST(CAST(round(w * 60) AS INTEGER) AS VARCHAR), ',' ORDER BY tok)) AS weights_md5
FROM weights GROUP BY item""")
def token_weights(spark, sf_dir):
    w = h.token_weights(highlights(spark, sf_dir), doc_tokens(spark, sf_dir))
    text = F.array_join(F.transform("weights", lambda i: F.round(i * 60).cast("int").cast("string")), ",")
    return w.select(
        "item", "yes", "n", F.size("toks").cast("long").alias("n_tok"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda acc, i: acc + i), 6).alias("total"),
        F.round(F.array_max("weights"), 6).alias("top"),
        F.size(F.filter("weights", lambda i: i >= 0.5)).cast("long").alias("n_half"), F.md5(text).alias("weights_md5"))


@query("highlight_votes", H + """
SELECT item, yes, n, CASE WHEN yes / n >= 0.5 THEN 1 ELSE 0 END AS label FROM hl_votes""")
def highlight_votes(spark, sf_dir):
    return v.majority_labels(v.binary_votes(highlights(spark, sf_dir))).select("item", "yes", "n", "label")


@query("individual_records", H + """, flags AS (
  SELECT h.item, h.annotator, w.tok, CAST(list_contains(h.hl, w.tok) AS INTEGER) AS f
  FROM hls h JOIN words w USING (item))
SELECT item, annotator, max(f) AS label, md5(string_agg(CAST(f AS VARCHAR), '' ORDER BY tok)) AS flags_md5
FROM flags GROUP BY item, annotator""")
def individual_records(spark, sf_dir):
    rows = h.individual_records(highlights(spark, sf_dir), doc_tokens(spark, sf_dir))
    return rows.select("item", "annotator", "label",
                       F.md5(F.array_join(F.col("flags").cast("array<string>"), "")).alias("flags_md5"))


@query("zip_sums", H + """
SELECT w.item, md5(string_agg(CAST(coalesce(c.c, 0) AS VARCHAR), '' ORDER BY w.tok)) AS sums_md5
FROM words w LEFT JOIN counts c USING (item, tok) GROUP BY w.item""")
def zip_sums(spark, sf_dir):
    rows = h.individual_records(highlights(spark, sf_dir), doc_tokens(spark, sf_dir))
    return h.zip_sum(rows).select("item", F.md5(F.array_join(F.col("sums").cast("array<string>"), "")).alias("sums_md5"))


JOINT = H + """, duos AS (SELECT item * 10 + annotator // 2 AS item, k FROM hls),
two AS (SELECT item, count(*) FILTER (WHERE k > 0) AS yes, count(*) AS n FROM duos GROUP BY item),
both_ AS (SELECT item * 10 + annotator // 2 AS item, tok, count(*) AS c FROM marked GROUP BY ALL),
joint_ AS (SELECT item, count(*) FILTER (WHERE c = n) / count(*) AS j FROM both_ JOIN two USING (item) WHERE yes = n GROUP BY item)
"""


def _duos(spark, sf_dir):
    """The highlights of annotators 2k and 2k + 1 on a text as an item of their own."""
    return highlights(spark, sf_dir).withColumn("item", F.col("item") * 10 + F.floor(F.col("annotator") / 2))


@query("joint_jaccard", JOINT + "SELECT item, round(j, 6) AS jaccard FROM joint_")
def joint_jaccard(spark, sf_dir):
    return h.joint_jaccard(_duos(spark, sf_dir)).select("item", r6("jaccard"))


@query("mean_joint_jaccard", JOINT + "SELECT round(coalesce(avg(j), 0), 6) AS mean_jaccard FROM joint_")
def mean_joint_jaccard(spark, sf_dir):
    return h.mean_joint_jaccard(_duos(spark, sf_dir)).select(r6("mean_jaccard"))


PAIR_JACCARD = """, jac AS (
  SELECT p.item, len(list_intersect(p.hl, q.hl)) AS i, p.k + q.k AS k FROM hls p JOIN hls q
    ON p.item = q.item AND p.annotator < q.annotator WHERE p.k > 0 AND q.k > 0)
"""


@query("pairwise_jaccard", H + PAIR_JACCARD + """
SELECT round(avg(i / (k - i)), 6) AS pairwise_jaccard, count(*) AS n_pairs FROM jac""")
def pairwise_jaccard(spark, sf_dir):
    return h.mean_pairwise_jaccard(highlights(spark, sf_dir)).select(r6("pairwise_jaccard"), "n_pairs")


ALPHA = """, units AS (
  SELECT v.yes - coalesce(c.c, 0) AS n0, coalesce(c.c, 0) AS n1 FROM words w JOIN hl_votes v USING (item)
  LEFT JOIN counts c USING (item, tok) WHERE v.yes >= 2),
al AS (SELECT 1 - sum(2.0 * n0 * n1 / (n0 + n1 - 1)) / (2.0 * sum(n0) * sum(n1) / (sum(n0) + sum(n1) - 1)) AS alpha FROM units)
"""


@query("unitising_alpha", H + ALPHA + "SELECT round(alpha, 6) AS alpha FROM al")
def unitising_alpha(spark, sf_dir):
    return h.unitising_alpha(highlights(spark, sf_dir), doc_tokens(spark, sf_dir)).select(r6("alpha"))


@query("overlap_report", H + PAIR_JACCARD.rstrip() + ALPHA + """
SELECT round((SELECT avg(i / (k - i)) FROM jac), 6) AS pairwise_jaccard, round((SELECT alpha FROM al), 6) AS alpha,
  round((SELECT avg(len(toks)) FROM toks), 6) AS mean_len, round((SELECT avg(k) FROM hls WHERE k > 0), 6) AS mean_hl_len""")
def overlap_report(spark, sf_dir):
    return h.overlap_report(highlights(spark, sf_dir), doc_tokens(spark, sf_dir)).select(
        r6("pairwise_jaccard"), r6("alpha"), r6("mean_len"), r6("mean_hl_len"))


@query("highlight_texts", H + """
SELECT item, annotator, md5(coalesce(string_agg(word, ' ' ORDER BY tok), '')) AS text_md5 FROM (
  SELECT t.item, p.annotator, w.word, w.tok FROM toks t CROSS JOIN people p
  LEFT JOIN words w ON w.item = t.item AND contains(w.word, p.letter)) GROUP BY item, annotator""")
def highlight_texts(spark, sf_dir):
    return h.highlight_texts(highlights(spark, sf_dir), doc_tokens(spark, sf_dir)).select(
        "item", "annotator", F.md5("text").alias("text_md5"))


@query("marked_texts", H + """
SELECT w.item, md5(string_agg(CASE WHEN contains(w.word, 'q') THEN upper(w.word) ELSE w.word END, ' ' ORDER BY w.tok)) AS text_md5
FROM words w GROUP BY w.item""")
def marked_texts(spark, sf_dir):
    second = highlights(spark, sf_dir).where(F.col("annotator") == LETTERS.index("q") + 1)
    return second.join(doc_tokens(spark, sf_dir), "item").select("item", F.md5(x.mark_upper("toks", "hl")).alias("text_md5"))


@query("weight_spans", WEIGHTS + """, cut AS (
  SELECT *, CASE WHEN lag(w) OVER (PARTITION BY item ORDER BY tok) IS DISTINCT FROM w THEN 1 ELSE 0 END AS b FROM weights),
spans AS (SELECT *, sum(b) OVER (PARTITION BY item ORDER BY tok) AS span FROM cut)
SELECT item, CAST(min(tok) - 1 AS BIGINT) AS start, CAST(max(tok) AS BIGINT) AS stop, round(any_value(w), 6) AS weight
FROM spans GROUP BY item, span""")
def weight_spans(spark, sf_dir):
    w = h.token_weights(highlights(spark, sf_dir), doc_tokens(spark, sf_dir))
    return h.weight_spans(w).select("item", F.col("start").cast("long").alias("start"),
                                    F.col("stop").cast("long").alias("stop"), r6("weight"))


@query("highlight_lengths", WEIGHTS + """, per AS (
  SELECT item, count(*) FILTER (WHERE w >= 0.5) AS k, sum(w) AS s FROM weights GROUP BY item)
SELECT round(avg(k) FILTER (WHERE k > 0), 6) AS mean_len, count(*) FILTER (WHERE k = 0 AND s > 0) AS inconclusive FROM per""")
def highlight_lengths(spark, sf_dir):
    w = h.token_weights(highlights(spark, sf_dir), doc_tokens(spark, sf_dir))
    return h.average_highlight_length(w).select(r6("mean_len"), "inconclusive")


@query("weight_jaccard", WEIGHTS + """, marks AS (
  SELECT item, tok, w >= 0.5 AS a, contains(word, 'o') AND contains(word, 'z') AS b FROM weights JOIN words USING (item, tok)),
per AS (SELECT item, count(*) FILTER (WHERE a) AS ka, count(*) FILTER (WHERE b) AS kb, count(*) FILTER (WHERE a AND b) AS i FROM marks GROUP BY item)
SELECT round(avg(i / (ka + kb - i)) FILTER (WHERE ka > 0 AND kb > 0), 6) AS mean_jaccard,
       count(*) FILTER (WHERE ka > 0 AND kb > 0) AS n_both, count(*) AS n FROM per""")
def weight_jaccard(spark, sf_dir):
    w = h.token_weights(highlights(spark, sf_dir), doc_tokens(spark, sf_dir))
    model = F.transform("toks", lambda t: (F.contains(t, F.lit("o")) & F.contains(t, F.lit("z"))).cast("double"))
    return h.weight_jaccard(w.withColumn("model", model), "weights", "model").select(r6("mean_jaccard"), "n_both", "n")


@query("highlight_histogram", H + """
SELECT k AS n_marked, count(*) AS n, round(count(*) / (SELECT count(*) FROM hls), 6) AS share FROM hls GROUP BY k""")
def highlight_histogram(spark, sf_dir):
    return h.candidate_positions(highlights(spark, sf_dir)).select(
        F.col("n_marked").cast("long").alias("n_marked"), "n", r6("share"))


@query("selection_frequency", H + """, per AS (
  SELECT annotator, count(*) AS n, count(*) FILTER (WHERE k = 0) AS empty FROM hls GROUP BY annotator),
t AS (SELECT sum(n) / count(*) AS load, avg(empty) AS e FROM per)
SELECT round(load - e, 6) AS mean_freq, round((load - e) / load, 6) AS rel_freq FROM t""")
def selection_frequency(spark, sf_dir):
    return v.selection_frequency(highlights(spark, sf_dir)).select(r6("mean_freq"), r6("rel_freq"))


@query("mean_cosine", """WITH u AS (
  SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS norm FROM u)
SELECT a.label, count(*) AS n_pairs, round(avg(list_dot_product(a.v, b.v) / (a.norm * b.norm)), 6) AS mean_cosine
FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def mean_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("item"), F.col("embedding").alias("vec"))
    return h.mean_cosine(rows).select(F.col("item").alias("label"), "n_pairs", r6("mean_cosine"))


@query("overall_cosine", """WITH u AS (
  SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS norm FROM u)
SELECT count(*) AS n_pairs, round(avg(list_dot_product(a.v, b.v) / (a.norm * b.norm)), 6) AS mean_cosine
FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id""")
def overall_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("item"), F.col("embedding").alias("vec"))
    return h.overall_cosine(rows).select("n_pairs", r6("mean_cosine"))


@query("lexical_jaccard", """WITH t AS (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(str_split(lower(text), ' ')) AS a, list_distinct(str_split(lower(reply), ' ')) AS b
      FROM t WHERE reply IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard FROM s""")
def lexical_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    replies = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return rows.join(replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(x.lexical_jaccard("text", "reply"), 6).alias("jaccard"))


@query("distinct_examples", """SELECT count(*) AS n_all, count(DISTINCT text) AS n_distinct FROM documents""")
def distinct_examples(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir)
    kept = sets.deduplicate(rows, ["toks"]).agg(F.count(F.lit(1)).alias("n_distinct")).withColumn("k", F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n_all")).withColumn("k", F.lit(1)).join(kept, "k").drop("k")


@query("rescaled_lengths", """WITH w AS (
  SELECT doc_id, list_transform(str_split(text, ' '), lambda t: length(t)) AS l FROM documents)
SELECT doc_id, round(list_sum(list_transform(l, lambda z: CASE WHEN list_max(l) > list_min(l)
  THEN (z - list_min(l)) / (list_max(l) - list_min(l)) * 100.0 ELSE 0.0 END)), 4) AS total FROM w""")
def rescaled_lengths(spark, sf_dir):
    lens = F.transform(F.split("text", " "), lambda t: F.length(t).cast("double"))
    rows = table(spark, sf_dir, "documents").select("doc_id", lens.alias("l"))
    return rows.select("doc_id", F.round(
        F.aggregate(x.rescale("l"), F.lit(0.0), lambda acc, z: acc + z), 4).alias("total"))


# -- classification -----------------------------------------------------------------------------

GOLD = """WITH rows_ AS (
  SELECT d.doc_id, l.quality AS gold, CAST(d.n_chars > 600 AS INTEGER) AS pred_a, CAST(d.lang = 'en' AS INTEGER) AS pred_b,
         d.n_chars FROM documents d JOIN labels l USING (doc_id))"""


def _gold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("gold"), (F.col("n_chars") > 600).cast("int").alias("pred_a"),
        (F.col("lang") == "en").cast("int").alias("pred_b"), "n_chars")


REPORT = GOLD + """, lab AS (SELECT gold AS label FROM rows_ UNION SELECT pred_a FROM rows_),
rep AS (SELECT label, (SELECT count(*) FROM rows_ WHERE gold = label) AS support,
  (SELECT count(*) FROM rows_ WHERE pred_a = label) AS predicted,
  (SELECT count(*) FROM rows_ WHERE gold = label AND pred_a = label) AS hit FROM lab),
pr AS (SELECT label, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2 * hit / (predicted + support) ELSE 0 END AS f1, support, hit FROM rep)
"""


@query("class_report", REPORT + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pr""")
def class_report(spark, sf_dir):
    return e.class_report(e.confusion(_gold(spark, sf_dir), "gold", "pred_a")).select(
        "label", r6("precision"), r6("recall"), r6("f1"), "support")


@query("macro_scores", REPORT + """
SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pr""")
def macro_scores(spark, sf_dir):
    return e.macro_scores(_gold(spark, sf_dir), "gold", "pred_a").select(
        r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query("compared_models", GOLD + """
SELECT CAST(pred_a = gold AS INTEGER) AS a_right, CAST(pred_b = gold AS INTEGER) AS b_right, count(*) AS n FROM rows_ GROUP BY ALL""")
def compared_models(spark, sf_dir):
    return e.compare_models(_gold(spark, sf_dir)).select(
        F.col("a_right").cast("int").alias("a_right"), F.col("b_right").cast("int").alias("b_right"), "n")


@query("difficulty", with_ctes(HIGHLIGHTS_SQL) + """, j AS (
  SELECT l.quality AS gold, CAST(v.yes / v.n >= 0.5 AS INTEGER) AS pred, v.yes / v.n AS share FROM hl_votes v JOIN labels l ON l.doc_id = v.item)
SELECT CAST(gold = pred AS INTEGER) AS correct, round(avg(abs(0.5 - share)), 6) AS mean_distance,
  round(avg(CASE WHEN share <= 0 OR share >= 1 THEN 0.0 ELSE -share * log2(share) - (1 - share) * log2(1 - share) END), 6) AS mean_entropy,
  count(*) AS support FROM j GROUP BY 1""")
def difficulty(spark, sf_dir):
    labels = v.majority_labels(v.binary_votes(highlights(spark, sf_dir)))
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.col("quality").alias("gold"))
    return e.difficulty(labels.join(gold, "item").withColumnRenamed("label", "pred")).select(
        F.col("correct").cast("int").alias("correct"), r6("mean_distance"), r6("mean_entropy"), "support")


@query("outcome_samples", GOLD + """
SELECT doc_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5('2|' || doc_id), doc_id) AS k
  FROM (SELECT doc_id, gold || '-' || pred_a AS outcome FROM rows_)) WHERE k <= 10""")
def outcome_samples(spark, sf_dir):
    rows = _gold(spark, sf_dir).select("doc_id", F.concat_ws("-", F.col("gold").cast("string"), F.col("pred_a").cast("string")).alias("outcome"))
    return s.per_stratum(rows, "outcome", 10, 2, "doc_id")


@query("selection_quality", GOLD + """
SELECT round((SELECT count(*) FROM rows_ WHERE pred_a = 1 AND gold = 1) / (SELECT count(*) FROM rows_ WHERE pred_a = 1), 6) AS precision,
  round((SELECT count(*) FROM rows_ WHERE pred_a = 1 AND gold = 1) / (SELECT count(*) FROM rows_ WHERE gold = 1), 6) AS recall,
  (SELECT count(*) FROM rows_ WHERE pred_a = 1 AND gold = 1) AS hits""")
def selection_quality(spark, sf_dir):
    rows = _gold(spark, sf_dir)
    return e.selection_quality(rows.where("pred_a = 1"), rows.where("gold = 1"), "doc_id").select(
        r6("precision"), r6("recall"), "hits")


@query("lead_overlap", GOLD + """
SELECT count(*) AS n, round(avg(CAST(pred_a = pred_b AS INTEGER)), 6) AS overlap FROM rows_""")
def lead_overlap(spark, sf_dir):
    return a.two_list_scores(_gold(spark, sf_dir), "pred_a", "pred_b").select("n", r6("overlap"))


@query("linear_fit", """WITH o AS (
  SELECT l_quantity AS x, l_extendedprice AS y, CAST('0x' || substr(md5('1|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM lineitem),
p AS (SELECT x, y, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS part FROM o),
f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p WHERE part = 'train')
SELECT part, count(*) AS n, round(any_value(s), 4) AS slope, round(any_value(i), 2) AS intercept,
  round(1 - sum((y - s * x - i) * (y - s * x - i)) / (var_pop(y) * count(*)), 6) AS r2 FROM p, f GROUP BY part""")
def linear_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.concat_ws(
        "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"))
    return e.linear_fit(rows, "x", "y").select(
        "part", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), r6("r2"))


# -- token predictions --------------------------------------------------------------------------

def _subwords(spark, sf_dir):
    """Character bigrams of the words as subwords, one special token at both ends."""
    words = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("item"), F.lit("guest").alias("side"), F.posexplode(F.split("text", " ")).alias("word", "w"))
    pieces = words.select("item", "side", "word", "w", F.explode(F.sequence(
        F.lit(0), F.greatest(F.floor((F.length("w") - 1) / 2), F.lit(0)).cast("int"))).alias("nth"))
    real = pieces.select("item", "side", (F.col("word") * 100 + F.col("nth")).alias("tok"), "word",
                         (F.length("w") + F.col("nth")).alias("label"))
    special = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("item"), F.lit("guest").alias("side"), F.explode(F.array(F.lit(-1), F.lit(1000000))).alias("tok"),
        F.lit(None).cast("int").alias("word"), F.lit(0).alias("label"))
    return real.unionByName(special)


@query("word_labels", """WITH w AS (
  SELECT item_id AS item, generate_subscripts(str_split(text, ' '), 1) - 1 AS word, unnest(str_split(text, ' ')) AS t FROM benchmark)
SELECT item, word, CAST(length(t) AS BIGINT) AS label FROM w""")
def word_labels(spark, sf_dir):
    return sw.word_labels(_subwords(spark, sf_dir)).select(
        "item", F.col("word").cast("long").alias("word"), F.col("label").cast("long").alias("label"))


@query("subword_labels", """WITH w AS (
  SELECT item_id AS item, generate_subscripts(str_split(text, ' '), 1) - 1 AS word, unnest(str_split(text, ' ')) AS t FROM benchmark),
p AS (SELECT item, word, t, unnest(range(0, greatest((length(t) - 1) // 2, 0) + 1)) AS nth FROM w)
SELECT item, CAST(word * 100 + nth AS BIGINT) AS tok, CAST(CASE WHEN nth = 0 THEN length(t) ELSE -100 END AS BIGINT) AS label FROM p
UNION ALL SELECT item_id, unnest([-1, 1000000]), -100 FROM benchmark""")
def subword_labels(spark, sf_dir):
    sub = _subwords(spark, sf_dir)
    return sw.subword_labels(sub.drop("label"), sw.word_labels(sub)).select(
        "item", F.col("tok").cast("long").alias("tok"), F.col("label").cast("long").alias("label"))


@query("separated_pairs", """WITH t AS (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)
SELECT conv_id, turn, md5(text || ' [SEP] ' || reply) AS words_md5, len(str_split(text, ' ')) AS n_first,
       len(str_split(reply, ' ')) AS n_second FROM t WHERE reply IS NOT NULL""")
def separated_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("s1"))
    second = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s1").alias("s2"))
    zeros = lambda c: F.transform(c, lambda w: F.lit(0))
    both = rows.join(second, ["conv_id", "turn"]).select(
        "conv_id", "turn", sw.joined_words("s1", "s2").alias("words"), sw.joined_labels(zeros("s1"), zeros("s2")).alias("labels"))
    halves = sw.split_at_separator("words", "labels")
    return both.select("conv_id", "turn", F.md5(F.array_join("words", " ")).alias("words_md5"),
                       F.size(halves["first"]).cast("long").alias("n_first"), F.size(halves["second"]).cast("long").alias("n_second"))


@query("pair_verdicts", """WITH t AS (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
w AS (SELECT conv_id, turn, str_split(text, ' ') AS a, str_split(reply, ' ') AS b FROM t WHERE reply IS NOT NULL)
SELECT conv_id, turn, CAST(len(list_filter(a, lambda z: length(z) >= 12)) > 0 AND len(list_filter(b, lambda z: length(z) >= 12)) > 0 AS INTEGER) AS label,
  CAST((len(list_filter(a, lambda z: length(z) >= 12)) > 0) <> (len(list_filter(b, lambda z: length(z) >= 12)) > 0) AS INTEGER) AS lopsided,
  md5(array_to_string(list_transform(a, lambda z: CAST(length(z) >= 12 AS INTEGER)), '')) AS labels_md5 FROM w""")
def pair_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("guest_toks"))
    reply = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("guest_toks").alias("host_toks"))
    prob = lambda c: F.transform(c, lambda w: F.length(w) / 24.0)
    both = rows.join(reply, ["conv_id", "turn"]).select(
        F.struct("conv_id", "turn").alias("item"), "guest_toks", "host_toks", prob("guest_toks").alias("guest_probs"),
        prob("host_toks").alias("host_probs"))
    out = sw.pair_verdicts(both)
    return out.select("item.conv_id", "item.turn", "label",
                      e.one_side_only("guest_labels", "host_labels").cast("int").alias("lopsided"),
                      F.md5(F.array_join(F.col("guest_labels").cast("array<string>"), "")).alias("labels_md5"))


@query("side_similarity", H + """, texts AS (
  SELECT t.item, p.annotator, list_transform(list_filter(t.toks, lambda w: contains(w, p.letter)), lambda w: lower(w)) AS ws
  FROM toks t CROSS JOIN people p),
pairs_ AS (SELECT g.item, g.annotator, g.ws AS a, h.ws AS b FROM texts g JOIN texts h ON h.item = g.item AND h.annotator = 6 - g.annotator),
sets_ AS (SELECT CASE WHEN len(a) = 0 THEN [''] ELSE list_distinct(a) END AS a, CASE WHEN len(b) = 0 THEN [''] ELSE list_distinct(b) END AS b
  FROM pairs_ WHERE len(a) > 0 OR len(b) > 0)
SELECT round(avg(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))), 6) AS mean_jaccard, count(*) AS n FROM sets_""")
def side_similarity(spark, sf_dir):
    """Guest side: the highlights of annotator k; host side: those of annotator 6 - k."""
    texts = h.highlight_texts(highlights(spark, sf_dir), doc_tokens(spark, sf_dir))
    host = texts.withColumn("annotator", 6 - F.col("annotator"))
    return h.side_similarity(texts, host).select(r6("mean_jaccard"), "n")
