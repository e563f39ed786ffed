"""Dialogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.base import (DIALOGUES_SQL, RUNS_SQL, TALKS_SQL, dialogues, pairs_sql, query, r6, table, talks,
                                   with_ctes)
from turnwise.functions.text import tokens
from turnwise.operators import dialogue as d
from turnwise.operators import pairs as p
from turnwise.operators.sampling import draw, random_sample

SHORT = {"min_host_runs": 3, "drop_first": 1, "drop_last": 1}

PAIR_COLUMNS = """qid, conv, CAST(first_pos AS BIGINT) AS guest_pos, host, guest,
  CAST(last_pos + 1 AS BIGINT) AS guest_stop, CAST(host_last + 1 AS BIGINT) AS host_stop,
  CAST(reply_last + 1 AS BIGINT) AS reply_stop, n_tokens AS guest_tokens, host_tokens,
  md5(array_to_string(texts, chr(10))) AS guest_md5, md5(array_to_string(host_texts, chr(10))) AS host_md5,
  md5(array_to_string(reply_texts, chr(10))) AS reply_md5"""


def _pair_report(pairs):
    return pairs.select(
        "qid", "conv", F.col("guest_pos").cast("long").alias("guest_pos"), "host", "guest",
        F.col("guest_stop").cast("long").alias("guest_stop"), F.col("host_stop").cast("long").alias("host_stop"),
        F.col("reply_stop").cast("long").alias("reply_stop"), "guest_tokens", "host_tokens",
        *[F.md5(F.array_join(f"{s}_utts", "\n")).alias(f"{s}_md5") for s in ("guest", "host", "reply")])


@query("talk_pairs_report", with_ctes(TALKS_SQL, pairs_sql(3, 1, 1)) + """
SELECT conv, count(*) AS n_pairs, round(avg(n_tokens), 6) AS mean_guest_tokens,
       round(avg(host_tokens), 6) AS mean_host_tokens FROM pairs GROUP BY conv""")
def talk_pairs_report(spark, sf_dir):
    pairs = p.extract_pairs(d.speaker_runs(talks(spark, sf_dir)), **SHORT)
    return pairs.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("guest_tokens"), 6).alias("mean_guest_tokens"),
        F.round(F.avg("host_tokens"), 6).alias("mean_host_tokens"))


@query("talk_pairs", with_ctes(TALKS_SQL, pairs_sql(3, 1, 1)) + f"SELECT {PAIR_COLUMNS} FROM pairs")
def talk_pairs(spark, sf_dir):
    return _pair_report(p.extract_pairs(d.speaker_runs(talks(spark, sf_dir)), **SHORT))


@query("event_pairs", with_ctes(DIALOGUES_SQL, pairs_sql()) + f"SELECT {PAIR_COLUMNS} FROM pairs")
def event_pairs(spark, sf_dir):
    return _pair_report(p.extract_pairs(d.speaker_runs(dialogues(spark, sf_dir))))


@query("pair_positions", with_ctes(DIALOGUES_SQL, pairs_sql()) + """
SELECT qid, array_to_string(range(first_pos, last_pos + 1), ',') AS guest_idx,
       array_to_string(range(last_pos + 1, host_last + 1), ',') AS host_idx,
       array_to_string(range(host_last + 1, reply_last + 1), ',') AS reply_idx FROM pairs""")
def pair_positions(spark, sf_dir):
    rows = p.pair_positions(p.extract_pairs(d.speaker_runs(dialogues(spark, sf_dir))))
    return rows.select("qid", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
                                for c in ("guest_idx", "host_idx", "reply_idx")])


@query("canonical_speakers", with_ctes(DIALOGUES_SQL, RUNS_SQL) + "SELECT conv, speaker, canon FROM canon")
def canonical_speakers(spark, sf_dir):
    return d.canonical_speakers(dialogues(spark, sf_dir)).select("conv", "speaker", "canon")


@query("conversation_roles", with_ctes(TALKS_SQL, RUNS_SQL) + """
SELECT conv, n_speakers, host, guest, CAST(two_speakers AS INTEGER) AS two_speakers FROM roles""")
def conversation_roles(spark, sf_dir):
    return d.conversation_roles(talks(spark, sf_dir)).select(
        "conv", "n_speakers", "host", "guest", F.col("two_speakers").cast("int").alias("two_speakers"))


@query("merged_turns", with_ctes(DIALOGUES_SQL, RUNS_SQL) + """
SELECT conv, run, CAST(first_pos AS BIGINT) AS first_pos, array_to_string(texts, ' ') AS text FROM runs""")
def merged_turns(spark, sf_dir):
    return d.merged_turns(d.speaker_runs(dialogues(spark, sf_dir))).withColumn(
        "first_pos", F.col("first_pos").cast("long"))


@query("run_starts", with_ctes(DIALOGUES_SQL) + """, named AS (SELECT conv, pos FROM utterances WHERE speaker = 'RAY')
SELECT conv, CAST(pos AS BIGINT) AS pos FROM (SELECT *, lag(pos) OVER (PARTITION BY conv ORDER BY pos) AS b FROM named)
WHERE b IS NULL OR pos <> b + 1""")
def run_starts(spark, sf_dir):
    named = dialogues(spark, sf_dir).where("speaker = 'RAY'").select("conv", "pos")
    return d.run_starts(named).withColumn("pos", F.col("pos").cast("long"))


@query("reject_counts", with_ctes(TALKS_SQL, pairs_sql(3, 1, 1)) + """
SELECT source, reason, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'other' AS source, 'not_two_speakers' AS reason, count(*) AS n FROM roles WHERE NOT two_speakers
  UNION ALL SELECT 'other', 'short_dialogue', count(*) FROM
    (SELECT conv, max(run) + 1 AS k FROM runs GROUP BY conv) WHERE (k + 1) // 2 < 3
  UNION ALL SELECT 'other', verdict, count(*) FROM judged WHERE verdict <> 'short_dialogue' GROUP BY verdict)
WHERE n > 0 GROUP BY source, reason""")
def reject_counts(spark, sf_dir):
    rows = talks(spark, sf_dir)
    return p.rejects_by_source(d.speaker_runs(rows), d.conversation_roles(rows), **SHORT)


@query("event_reject_counts", with_ctes(DIALOGUES_SQL, pairs_sql()) + """
SELECT CASE WHEN contains(conv, 'NPR') THEN 'NPR' ELSE 'other' END AS source, verdict AS reason, count(*) AS n
FROM judged WHERE verdict <> 'short_dialogue' GROUP BY ALL""")
def event_reject_counts(spark, sf_dir):
    rows = dialogues(spark, sf_dir)
    return p.rejects_by_source(d.speaker_runs(rows), d.conversation_roles(rows))


@query("rebuilt_texts", with_ctes(DIALOGUES_SQL, pairs_sql()) + """
SELECT qid, md5(array_to_string(texts, ' ' || chr(10))) AS guest_md5,
       md5(array_to_string(host_texts, ' ' || chr(10))) AS host_md5,
       md5(array_to_string(reply_texts, ' ' || chr(10))) AS reply_md5 FROM pairs""")
def rebuilt_texts(spark, sf_dir):
    rows = dialogues(spark, sf_dir)
    texts = p.rebuild_texts(p.pair_positions(p.extract_pairs(d.speaker_runs(rows))), rows)
    return texts.select("qid", *[F.md5(f"{s}_text").alias(f"{s}_md5") for s in ("guest", "host", "reply")])


@query("resolved_ids", with_ctes(TALKS_SQL, RUNS_SQL) + """,
wanted AS (SELECT conv, pos, conv || '-' || pos AS qid FROM utterances)
SELECT w.qid, CAST(r.last_pos + 1 AS BIGINT) AS guest_stop, CAST(h.last_pos + 1 AS BIGINT) AS host_stop,
       CAST(coalesce(b.run IS NOT NULL AND p.run % 2 = 1, false) AS INTEGER) AS resolved
FROM wanted w LEFT JOIN placed p ON p.conv = w.conv AND p.pos = w.pos
LEFT JOIN runs r ON r.conv = p.conv AND r.run = p.run
LEFT JOIN runs h ON h.conv = p.conv AND h.run = p.run + 1
LEFT JOIN runs b ON b.conv = p.conv AND b.run = p.run + 2""")
def resolved_ids(spark, sf_dir):
    rows = talks(spark, sf_dir)
    qids = rows.select(F.concat_ws("-", "conv", F.col("pos").cast("string")).alias("qid"))
    return p.resolve_pair_ids(qids, d.speaker_runs(rows)).select(
        "qid", F.col("guest_stop").cast("long").alias("guest_stop"), F.col("host_stop").cast("long").alias("host_stop"),
        F.coalesce("resolved", F.lit(False)).cast("int").alias("resolved"))


@query("capped_pairs", with_ctes(TALKS_SQL, pairs_sql(3, 1, 1)) + """
SELECT qid, nth FROM (
  SELECT qid, row_number() OVER (PARTITION BY conv ORDER BY first_pos) AS nth FROM pairs
  WHERE len(str_split(array_to_string(texts, chr(10)), ' ')) <= 200
    AND len(str_split(array_to_string(host_texts, chr(10)), ' ')) <= 200) WHERE nth <= 5""")
def capped_pairs(spark, sf_dir):
    pairs = p.extract_pairs(d.speaker_runs(talks(spark, sf_dir)), **SHORT)
    return p.capped_pairs(p.pair_texts(pairs)).select("qid", F.col("nth").cast("long").alias("nth"))


@query("capped_event_pairs", with_ctes(DIALOGUES_SQL, pairs_sql()) + """
SELECT qid, nth FROM (
  SELECT qid, row_number() OVER (PARTITION BY conv ORDER BY first_pos) AS nth FROM pairs
  WHERE len(regexp_split_to_array(trim(array_to_string(texts, chr(10))), '\\s+')) <= 12
    AND len(regexp_split_to_array(trim(array_to_string(host_texts, chr(10))), '\\s+')) <= 12) WHERE nth <= 5""")
def capped_event_pairs(spark, sf_dir):
    texts = p.pair_texts(p.extract_pairs(d.speaker_runs(dialogues(spark, sf_dir))))
    return p.capped_pairs(texts, max_tokens=12, blanks="run").select("qid", F.col("nth").cast("long").alias("nth"))


@query("source_counts", with_ctes(DIALOGUES_SQL, pairs_sql()) + """
SELECT coalesce(source, 'all') AS source, count(DISTINCT conv) AS n_conversations, count(*) AS n_pairs
FROM (SELECT *, CASE WHEN contains(conv, 'NPR') THEN 'NPR' ELSE 'CNN' END AS source FROM pairs) GROUP BY ROLLUP (source)""")
def source_counts(spark, sf_dir):
    return p.source_counts(p.extract_pairs(d.speaker_runs(dialogues(spark, sf_dir))).select("qid"))


@query("found_texts", with_ctes(DIALOGUES_SQL, pairs_sql()) + """
SELECT qid FROM pairs WHERE contains(array_to_string(texts, chr(10)), '"k": 7')
  OR contains(array_to_string(texts, chr(10)), 'signup')""")
def found_texts(spark, sf_dir):
    texts = p.pair_texts(p.extract_pairs(d.speaker_runs(dialogues(spark, sf_dir))))
    return p.search_texts(texts, ['"k": 7', "signup"]).select("qid")


@query("benchmark_hits", """SELECT DISTINCT doc_id, md5(b.text) AS phrase_md5 FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def benchmark_hits(spark, sf_dir):
    """Every benchmark text is a phrase, looked for in all documents."""
    phrases = table(spark, sf_dir, "benchmark").select(F.col("text").alias("phrase"))
    hits = p.phrase_hits(table(spark, sf_dir, "documents"), phrases, "doc_id", "text")
    return hits.select("doc_id", F.md5("phrase").alias("phrase_md5"))


@query("length_features", with_ctes(DIALOGUES_SQL, RUNS_SQL) + """,
turns AS (SELECT conv, run, array_to_string(texts, ' ') AS text, max(run) OVER (PARTITION BY conv) + 1 AS k FROM runs),
lens AS (SELECT conv, (run - 3) // 2 AS pair, (run - 3) % 2 AS odd,
                len(regexp_split_to_array(trim(text), '\\s+')) AS len FROM turns WHERE run >= 3 AND run < k - 2)
SELECT conv, round(avg(len) FILTER (WHERE odd = 0), 6) AS mean_guest_len,
       CAST(sum(len) FILTER (WHERE odd = 0) AS BIGINT) AS total_guest,
       CAST(coalesce(sum(len) FILTER (WHERE odd = 1), 0) AS BIGINT) AS total_host,
       round(sum(len) FILTER (WHERE odd = 0) / sum(len) FILTER (WHERE odd = 1), 6) AS ratio
FROM lens GROUP BY conv""")
def length_features(spark, sf_dir):
    turns = d.merged_turns(d.speaker_runs(dialogues(spark, sf_dir)))
    return d.length_features(d.alternate_turns(turns)).select(
        "conv", r6("mean_guest_len"), "total_guest", "total_host", r6("ratio"))


def _reply_rows(spark, sf_dir):
    return talks(spark, sf_dir).select(
        F.concat_ws("-", "conv", F.col("pos").cast("string")).alias("utt_id"), "conv", "speaker", "text",
        F.when(F.col("pos") > 0, F.concat_ws("-", "conv", (F.col("pos") - 1).cast("string"))).alias("reply_to"))


@query("reply_edges", with_ctes(TALKS_SQL) + """
SELECT a.conv, a.conv || '-' || a.pos AS utt_id, b.conv || '-' || b.pos AS reply_id, a.speaker,
       b.speaker AS reply_speaker
FROM utterances a JOIN utterances b ON a.conv = b.conv AND b.pos = a.pos + 1
WHERE length(a.text) > 0 AND length(b.text) > 0""")
def reply_edges(spark, sf_dir):
    return d.reply_edges(_reply_rows(spark, sf_dir)).drop("text", "reply_text")


@query("two_person_talks", with_ctes(TALKS_SQL) + """
SELECT conv, count(*) AS n_utt FROM utterances GROUP BY conv HAVING count(DISTINCT speaker) = 2""")
def two_person_talks(spark, sf_dir):
    return d.two_person_conversations(talks(spark, sf_dir)).groupBy("conv").agg(F.count(F.lit(1)).alias("n_utt"))


@query("shuffled_pairs", with_ctes(DIALOGUES_SQL, pairs_sql()) + """
SELECT qid, md5('7|' || conv) AS place FROM pairs""")
def shuffled_pairs(spark, sf_dir):
    pairs = p.extract_pairs(d.speaker_runs(dialogues(spark, sf_dir))).select("qid", "conv", "guest_pos")
    return d.shuffled_conversations(pairs, 7).select("qid", draw(7, "conv").alias("place"))


@query("long_talk_sample", with_ctes(TALKS_SQL) + """,
long AS (SELECT conv, count(*) AS n_utt FROM utterances GROUP BY conv HAVING count(*) > 4)
SELECT conv, n_utt FROM long ORDER BY md5('11|' || conv), conv LIMIT 20""")
def long_talk_sample(spark, sf_dir):
    sizes = talks(spark, sf_dir).groupBy("conv").agg(F.count(F.lit(1)).alias("n_utt")).where("n_utt > 4")
    return random_sample(sizes, 20, 11, "conv")


@query("token_counts_of_documents", """
SELECT doc_id, len(str_split(text, ' ')) AS n_single,
  CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 THEN 0
       ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS n_run
FROM documents""")
def token_counts_of_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens("text")).cast("long").alias("n_single"),
        F.size(tokens("text", "run")).cast("long").alias("n_run"))


@query("pairs_with_context", with_ctes(DIALOGUES_SQL, pairs_sql()) + """,
facts AS (SELECT conv, count(*) || ' turns' AS summary FROM utterances GROUP BY conv)
SELECT qid, summary, md5(array_to_string(texts, ' ' || chr(10))) AS guest_md5 FROM pairs JOIN facts USING (conv)""")
def pairs_with_context(spark, sf_dir):
    rows = dialogues(spark, sf_dir)
    texts = p.rebuild_texts(p.pair_positions(p.extract_pairs(d.speaker_runs(rows))), rows)
    facts = rows.groupBy(F.col("conv").alias("id")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" turns")).alias("summary"))
    return p.with_context(texts, facts, ("summary",)).select("qid", "summary", F.md5("guest_text").alias("guest_md5"))
