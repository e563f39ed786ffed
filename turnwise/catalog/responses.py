"""Prompt and answer queries: answers about neighbouring turns, some damaged on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.base import query, r6, table
from turnwise.functions.quotes import first_positions, quote_flags
from turnwise.functions.text import tokens
from turnwise.operators import evaluation as e
from turnwise.operators import highlights as h
from turnwise.operators import responses as r

EXAMPLE = {
    "date": "2020-01-02", "summary": "A talk about rain.", "guest_name": "GUEST", "host_name": "HOST",
    "guest_utterance": "It rained for days.", "host_utterance": "So it did not stop raining?",
    "explanation": "Both talk about lasting rain.", "classification": "Yes.",
    "guest_quotes": ["rained for days."], "host_quotes": ["did not stop", "raining?"],
}


def exchanges(spark, sf_dir):
    """Neighbouring turns as guest and host side."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    reply = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("host_text"))
    return rows.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("guest_text"), "host_text",
        tokens("text", "run").alias("guest_toks"), tokens("host_text", "run").alias("host_toks"))


def answers(spark, sf_dir):
    """Five answers per exchange: sound, guest quote missing, host quote made up, unlabelled, one line missing."""
    def words(side: str, start: int, n: int):
        return F.array_join(F.slice(f"{side}_toks", start, n), " ")

    def reply(guest, host, last):
        guest_line = [F.lit("Verbatim Quote Guest: "), guest, F.lit("\n")]
        host_line = [F.lit("Verbatim Quote Host: "), host, F.lit("\n")] if host is not None else []
        return F.concat(F.lit("Explanation: as said.\n"), *guest_line, *host_line, last,
                        F.lit("\n\nGiven an interview on another day"))

    quote = F.lit('"')
    sound_g, sound_h = F.concat(quote, words("guest", 3, 4), quote), F.concat(quote, words("host", 2, 3), quote)
    verdict = F.when(F.length("guest_text") % 2 == 0, "Classification: No.").otherwise("Classification: Yes")
    made = F.array(
        reply(sound_g, sound_h, F.lit("Classification: Yes.")),
        reply(F.lit("None."), sound_h, verdict),
        reply(words("guest", 1, 3), F.lit('"never said by anybody"'), F.lit("Classification: yes, it is")),
        reply(sound_g, sound_h, F.lit("Answer: Yes")),
        reply(sound_g, None, F.lit("Classification: Yes.")))
    return exchanges(spark, sf_dir).select(
        "qid", "guest_text", "guest_toks", "host_toks", F.posexplode(made).alias("rep", "reply"))


ANSWERS_SQL = """WITH t AS (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
ex AS (
  SELECT conv_id || '-' || turn AS qid, text AS guest_text, regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9)), '\\s+') AS g,
         regexp_split_to_array(trim(reply, ' ' || chr(10) || chr(9)), '\\s+') AS h FROM t WHERE reply IS NOT NULL),
quotes AS (
  SELECT qid, g, h, 0 AS rep, '"' || array_to_string(g[3:6], ' ') || '"' AS gq, '"' || array_to_string(h[2:4], ' ') || '"' AS hq, 1 AS verdict FROM ex
  UNION ALL SELECT qid, g, h, 1, 'None.', '"' || array_to_string(h[2:4], ' ') || '"', CASE WHEN length(guest_text) % 2 = 0 THEN 0 ELSE 1 END FROM ex
  UNION ALL SELECT qid, g, h, 2, array_to_string(g[1:3], ' '), '"never said by anybody"', 1 FROM ex
  UNION ALL SELECT qid, g, h, 3, '"' || array_to_string(g[3:6], ' ') || '"', '"' || array_to_string(h[2:4], ' ') || '"', NULL FROM ex
  UNION ALL SELECT qid, g, h, 4, '"' || array_to_string(g[3:6], ' ') || '"', NULL, 1 FROM ex),
sides AS (
  SELECT qid, rep, verdict, 'guest' AS side, g AS w, gq AS q FROM quotes
  UNION ALL SELECT qid, rep, verdict, 'host', h, hq FROM quotes),
phrases AS (
  SELECT *, list_transform(w, lambda z: lower(z)) AS lw, list_transform(
    CASE WHEN len(regexp_extract_all(q, '"([^"]*)"', 1)) > 0 THEN regexp_extract_all(q, '"([^"]*)"', 1)
         WHEN NOT contains(array_to_string(w, ' '), '''') AND len(regexp_extract_all(q, '''([^'']*)''', 1)) > 0
           THEN regexp_extract_all(q, '''([^'']*)''', 1)
         ELSE [regexp_replace(q, '^"', '')] END, lambda z: lower(z)) AS ph FROM sides),
one AS (SELECT qid, rep, verdict, side, lw, q, len(lw) AS n_w,
   CASE WHEN len(trim(ph[1])) = 0 THEN [] ELSE regexp_split_to_array(trim(ph[1]), '\\s+') END AS p FROM phrases),
found AS (
  SELECT *, len(p) AS m, list_filter(range(0, greatest(n_w - len(p) + 1, 0)), lambda i:
    starts_with(lw[i + len(p)], p[len(p)]) AND lw[i + 1:i + len(p) - 1] = p[1:len(p) - 1])[1] AS start FROM one),
parsed AS (
  SELECT qid, rep, verdict, side, n_w, start, m,
    CASE WHEN coalesce(verdict, 0) = 0 THEN NULL WHEN q IS NULL THEN 'no_identifier' WHEN q = 'None.' THEN 'none'
         WHEN m = 0 THEN 'empty' WHEN start IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM found)
"""


@query("parsed_answers", ANSWERS_SQL + """
SELECT qid, rep, any_value(verdict) AS verdict, max(CASE WHEN side = 'guest' THEN status END) AS guest_status,
  max(CASE WHEN side = 'host' THEN status END) AS host_status,
  coalesce(max(CASE WHEN side = 'guest' AND status = 'ok' THEN array_to_string(range(start + 1, start + m + 1), ',') END), '') AS guest_marks,
  coalesce(max(CASE WHEN side = 'host' AND status = 'ok' THEN array_to_string(range(start + 1, start + m + 1), ',') END), '') AS host_marks
FROM parsed GROUP BY qid, rep""")
def parsed_answers(spark, sf_dir):
    rows = r.parse_replies(answers(spark, sf_dir))
    return rows.select("qid", "rep", "verdict", "guest_status", "host_status", *[
        F.array_join(F.col(f"{s}_marks").cast("array<string>"), ",").alias(f"{s}_marks") for s in ("guest", "host")])


COUNTS_SQL = ANSWERS_SQL + """, per AS (
  SELECT qid, rep, any_value(verdict) AS verdict, bool_or(coalesce(status, '') = 'not_found') AS inv,
    bool_or(coalesce(status, '') IN ('none', 'empty')) AS nop, bool_or(coalesce(status, '') = 'no_identifier') AS noi,
    bool_or(side = 'guest' AND coalesce(status, '') = 'not_found') AS ig, bool_or(side = 'host' AND coalesce(status, '') = 'not_found') AS ih
  FROM parsed GROUP BY qid, rep),
counts AS (
  SELECT qid, count(*) FILTER (WHERE verdict = 1) AS yes, count(*) FILTER (WHERE verdict = 0) AS no,
    count(*) FILTER (WHERE verdict IS NULL) AS unparsed, count(*) FILTER (WHERE noi) AS no_identifier,
    count(*) FILTER (WHERE inv OR nop OR noi) AS hl_errors, count(*) FILTER (WHERE nop) AS no_pair,
    count(*) FILTER (WHERE inv) AS invented, count(*) FILTER (WHERE ig) AS invented_guest, count(*) FILTER (WHERE ih) AS invented_host
  FROM per GROUP BY qid)
"""


@query("answer_counts", COUNTS_SQL + "SELECT * FROM counts")
def answer_counts(spark, sf_dir):
    return r.answer_counts(r.parse_replies(answers(spark, sf_dir)))


WEIGHTS_SQL = COUNTS_SQL + """, marks AS (
  SELECT qid, side, unnest(range(start + 1, start + m + 1)) AS tok FROM parsed WHERE status = 'ok'),
w AS (SELECT m.qid, m.side, m.tok, count(*) / greatest(any_value(CASE WHEN side = 'guest' THEN yes - invented_guest ELSE yes - invented_host END), 1) AS w
      FROM marks m JOIN counts USING (qid) GROUP BY m.qid, m.side, m.tok)
"""


@query("answer_weights", WEIGHTS_SQL + """
SELECT c.qid, round(coalesce(sum(w.w) FILTER (WHERE side = 'guest'), 0), 6) AS guest_total,
  round(coalesce(sum(w.w) FILTER (WHERE side = 'host'), 0), 6) AS host_total,
  coalesce(string_agg(CASE WHEN side = 'guest' THEN CAST(tok AS VARCHAR) END, ',' ORDER BY tok), '') AS guest_at
FROM counts c LEFT JOIN w USING (qid) GROUP BY c.qid""")
def answer_weights(spark, sf_dir):
    rows = answers(spark, sf_dir)
    w = r.answer_weights(r.parse_replies(rows), exchanges(spark, sf_dir))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), 6)
    at = F.filter(F.transform("guest_weights", lambda x, i: F.when(x > 0, i + 1)), lambda i: i.isNotNull())
    return w.select("qid", total("guest_weights").alias("guest_total"), total("host_weights").alias("host_total"),
                    F.array_join(at.cast("array<string>"), ",").alias("guest_at"))


@query("answer_rates", COUNTS_SQL + """
SELECT count(*) AS n_items, round(sum(unparsed) / sum(yes + no + unparsed), 6) AS unparsed_rate,
  count(*) FILTER (WHERE yes + no = 0) AS inconclusive, CAST(sum(yes) AS BIGINT) AS n_positive,
  round(sum(hl_errors) / sum(yes), 6) AS hl_errors_rate, round(sum(invented) / sum(yes), 6) AS invented_rate,
  round(sum(no_pair) / sum(yes), 6) AS no_pair_rate, round(sum(no_identifier) / sum(yes), 6) AS no_identifier_rate FROM counts""")
def answer_rates(spark, sf_dir):
    counts = r.answer_counts(r.parse_replies(answers(spark, sf_dir)))
    rates = e.parse_rates(counts).withColumn("k", F.lit(1)).join(
        e.highlight_error_rates(counts).withColumn("k", F.lit(1)), "k")
    return rates.select("n_items", r6("unparsed_rate"), "inconclusive", "n_positive", r6("hl_errors_rate"),
                        r6("invented_rate"), r6("no_pair_rate"), r6("no_identifier_rate"))


@query("answer_majority", COUNTS_SQL + """
SELECT qid, CASE WHEN yes + no > 0 AND yes / (yes + no) >= 0.5 THEN 1 ELSE 0 END AS pred FROM counts""")
def answer_majority(spark, sf_dir):
    counts = r.answer_counts(r.parse_replies(answers(spark, sf_dir)))
    return e.model_majority(counts).select("qid", "pred")


@query("answer_highlight_lengths", WEIGHTS_SQL + """, k AS (
  SELECT c.qid, count(*) FILTER (WHERE w.w >= 0.5) AS k, sum(w.w) AS s FROM counts c LEFT JOIN w ON w.qid = c.qid AND side = 'guest' GROUP BY c.qid)
SELECT round(avg(k) FILTER (WHERE k > 0), 6) AS mean_len, count(*) FILTER (WHERE k = 0 AND s > 0) AS inconclusive FROM k""")
def answer_highlight_lengths(spark, sf_dir):
    w = r.answer_weights(r.parse_replies(answers(spark, sf_dir)), exchanges(spark, sf_dir))
    return h.average_highlight_length(w, "guest_weights").select(r6("mean_len"), "inconclusive")


def _items(spark, sf_dir):
    return exchanges(spark, sf_dir).select(
        "qid", F.lit("2024-01-01").alias("date"), F.col("qid").alias("summary"), F.lit("USER").alias("guest_name"),
        F.col("guest_text").alias("guest_utterance"), F.lit("ASSISTANT").alias("host_name"),
        F.col("host_text").alias("host_utterance"))


PROMPT_SQL = """WITH t AS (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
p AS (SELECT conv_id || '-' || turn AS qid, '{header}' || 'Given an interview on 2024-01-01 with the summary: ' || conv_id || '-' || turn || chr(10)
  || 'Guest and Host say the following:' || chr(10) || 'Guest (USER): ' || text || chr(10) || 'Host (ASSISTANT): ' || reply || chr(10)
  || 'In the reply, does the host paraphrase something specific the guest says?' || chr(10) || chr(10)
  || 'Explanation: Let''s think step by step.' || chr(10) AS prompt FROM t WHERE reply IS NOT NULL)
""".replace("{header}", r.prompt_header([EXAMPLE]).replace("'", "''"))


@query("prompts", PROMPT_SQL + "SELECT qid, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM p")
def prompts(spark, sf_dir):
    return r.build_prompts(_items(spark, sf_dir), [EXAMPLE]).select(
        "qid", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


@query("prompt_requests", PROMPT_SQL + "SELECT qid, unnest(range(0, 3)) AS rep, md5(prompt) AS prompt_md5 FROM p")
def prompt_requests(spark, sf_dir):
    return r.expand_requests(r.build_prompts(_items(spark, sf_dir), [EXAMPLE]), 3).select(
        "qid", F.col("rep").cast("long").alias("rep"), F.md5("prompt").alias("prompt_md5"))


@query("stripped_replies", """WITH t AS (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN md5(' so: ' || reply || ' end ') END AS reply_md5
FROM t WHERE reply IS NOT NULL AND NOT contains(text || reply, 'Given an interview on')""")
def stripped_replies(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    reply = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    prompt = F.concat(F.lit("PROMPT "), F.col("text"), F.lit(" ASK"))
    echoed = F.concat(F.when(F.col("turn") % 3 < 2, prompt).otherwise("PROMPT"), F.lit(" so: "), F.col("answer"),
                      F.lit(" end Given an interview on a made-up day"))
    return rows.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.md5(r.strip_echo(echoed, prompt)).alias("reply_md5"))


@query("quoted_word_positions", """WITH d AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(w[len(w) - 2:len(w)], lambda z: list_position(w, z) - 1), ',') AS at FROM d""")
def quoted_word_positions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tokens("text", "run").alias("w"))
    last = F.array_join(F.slice("w", F.greatest(F.size("w") - 2, F.lit(1)), 3), " ")
    return docs.select("doc_id", F.array_join(first_positions("text", last).cast("array<string>"), ",").alias("at"))


# Words 2 and 3 of each text are quoted; only a quote mark inside them cannot be quoted.
@query("quote_flags", """WITH d AS (
  SELECT doc_id, regexp_split_to_array(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+') AS w FROM documents),
q AS (SELECT doc_id, w, w[2:3] AS p FROM d WHERE NOT contains(array_to_string(w[2:3], ' '), '"')),
f AS (SELECT doc_id, w, len(p) AS m, CASE len(p)
    WHEN 1 THEN list_filter(range(0, len(w)), lambda i: starts_with(w[i + 1], p[1]))[1]
    WHEN 2 THEN list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = p[1] AND starts_with(w[i + 2], p[2]))[1] END AS s FROM q)
SELECT doc_id, CASE WHEN s IS NOT NULL THEN
  md5(array_to_string(list_transform(range(0, len(w)), lambda i: CAST(i >= s AND i < s + m AS INTEGER)), '')) END AS flags_md5 FROM f""")
def quote_flag_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(
        F.slice(tokens(F.col("text"), "run"), 2, 2), " ").alias("phrase")).where(~F.contains("phrase", F.lit('"')))
    quoting = F.concat(F.lit('the "'), "phrase", F.lit('" part'))
    return docs.select("doc_id", F.md5(F.array_join(
        quote_flags("text", quoting).cast("array<string>"), "")).alias("flags_md5"))
