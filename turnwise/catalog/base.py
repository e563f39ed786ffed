"""Registry of the driver's queries, and how its tables are read as dialogues, votes and so on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.dialogue import positions_in
from turnwise.operators.votes import keep_last_vote

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where it can be said in SQL, its SQL twin."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# -- votes: line items as votes of suppliers on parts ------------------------------------------

ORDER = ["start", "session", "line", "annotator"]


def raw_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("annotator"),
        F.col("l_orderkey").alias("session"), F.col("l_shipdate").alias("start"),
        F.col("l_linenumber").alias("line"), (F.col("l_quantity") > 25).cast("int").alias("vote"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last_vote(raw_votes(spark, sf_dir))


RAW_VOTES_SQL = """raw_votes AS (
  SELECT l_partkey AS item, l_suppkey AS annotator, l_orderkey AS session, l_shipdate AS start,
         l_linenumber AS line, CAST(l_quantity > 25 AS INTEGER) AS vote
  FROM lineitem)"""
VOTES_SQL = RAW_VOTES_SQL + """,
votes AS (
  SELECT item, annotator, session, start, line, vote FROM (
    SELECT *, row_number() OVER (PARTITION BY item, annotator ORDER BY start DESC, session DESC, line DESC) AS k
    FROM raw_votes) WHERE k = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY start, session, line, annotator) AS rank FROM votes),
tuples AS (
  SELECT item, CAST(sum(vote) AS BIGINT) AS yes, count(*) AS n, avg(vote) AS share FROM votes GROUP BY item)"""

NEED_SQL = """longest AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)),
entropies AS (
  SELECT y, m, CASE WHEN y <= 0 OR y >= m THEN 0.0
    ELSE -(y / m) * log2(y / m) - (1 - y / m) * log2(1 - y / m) END AS h
  FROM (SELECT CAST(a.i AS DOUBLE) AS y, CAST(b.i AS DOUBLE) AS m
        FROM (SELECT unnest(range(0, most + 16)) AS i FROM longest) a, (SELECT unnest(range(1, most + 16)) AS i FROM longest) b
        WHERE a.i <= b.i)),
need AS (
  SELECT CAST(e.y AS BIGINT) AS yes, CAST(e.m AS BIGINT) AS n,
    CASE WHEN e.h < 0.8 THEN greatest(0, 3 - e.m)
         ELSE greatest(coalesce((SELECT min(k.i) FROM range(1, 16) k(i) JOIN entropies f
                 ON f.y = greatest(e.y, e.m - e.y) + k.i AND f.m = e.m + k.i
                 WHERE f.h < 0.8 AND k.i <= 15 - e.m), 15 - e.m), 3 - e.m) END AS need
  FROM entropies e)"""

# -- long dialogues: the events of a user ------------------------------------------------------

SPEAKERS = {"click": "ANN LEE", "view": "ANN", "purchase": "BOB RAY", "signup": "RAY", "error": "BOB RAY"}


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv, pos, speaker, text; every fourth event says its type only."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    names = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    conv = F.concat(F.when(F.col("user_id") % 2 == 0, "NPR-").otherwise("CNN-"), F.col("user_id").cast("string"))
    rows = events.select(
        conv.alias("conv"), "ts", "event_id", F.try_element_at(names, "event_type").alias("speaker"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(
            F.concat_ws(" ", "event_type", "props")).alias("text"))
    return positions_in(rows, "conv", ["ts", "event_id"]).select("conv", "pos", "speaker", "text")


DIALOGUES_SQL = """utterances AS (
  SELECT (CASE WHEN user_id % 2 = 0 THEN 'NPR-' ELSE 'CNN-' END) || user_id AS conv,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         CASE event_type WHEN 'click' THEN 'ANN LEE' WHEN 'view' THEN 'ANN' WHEN 'purchase' THEN 'BOB RAY'
              WHEN 'signup' THEN 'RAY' WHEN 'error' THEN 'BOB RAY' END AS speaker,
         CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_type || ' ' || props END AS text
  FROM events)"""

# -- short dialogues: the conversations --------------------------------------------------------


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("int").alias("pos"),
        F.col("role").alias("speaker"), "text")


TALKS_SQL = """utterances AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv, turn AS pos, role AS speaker, text FROM conversations)"""

RUNS_SQL = """names AS (
  SELECT conv, speaker, min(pos) AS first_pos, max(pos) AS last_pos FROM utterances GROUP BY conv, speaker),
canon AS (
  SELECT a.conv, a.speaker, a.first_pos, a.last_pos,
         arg_max(b.speaker, len(b.speaker) * 1000000000 + b.last_pos) AS canon
  FROM names a JOIN names b ON a.conv = b.conv AND contains(b.speaker, a.speaker)
  GROUP BY a.conv, a.speaker, a.first_pos, a.last_pos),
people AS (SELECT conv, canon, min(first_pos) AS fp FROM canon GROUP BY conv, canon),
roles AS (
  SELECT conv, n_speakers, host, guest,
         coalesce(NOT regexp_matches(lower(guest), 'host|anchor'), false) AS two_speakers
  FROM (SELECT conv, count(*) AS n_speakers, arg_min(canon, fp) AS host,
               CASE WHEN count(*) = 2 THEN arg_max(canon, fp) END AS guest FROM people GROUP BY conv)),
spoken AS (
  SELECT u.conv, u.pos, u.text, r.host, r.guest, c.canon = r.host AS is_host
  FROM utterances u JOIN canon c USING (conv, speaker) JOIN roles r USING (conv) WHERE r.two_speakers),
broken AS (
  SELECT *, CASE WHEN lag(is_host) OVER (PARTITION BY conv ORDER BY pos) IS DISTINCT FROM is_host THEN 1 ELSE 0 END AS b
  FROM spoken),
placed AS (
  SELECT *, CAST(sum(b) OVER (PARTITION BY conv ORDER BY pos) AS BIGINT) - 1 AS run FROM broken),
runs AS (
  SELECT conv, run, any_value(host) AS host, any_value(guest) AS guest, min(pos) AS first_pos, max(pos) AS last_pos,
         count(*) AS n_utt, arg_min(len(str_split(text, ' ')), pos) AS first_tokens,
         CAST(sum(len(str_split(text, ' '))) AS BIGINT) AS n_tokens, list(text ORDER BY pos) AS texts
  FROM placed GROUP BY conv, run),
lookahead AS (
  SELECT *, max(run) OVER (PARTITION BY conv) + 1 AS n_runs,
    lead(last_pos) OVER w AS host_last, lead(n_utt) OVER w AS host_n_utt, lead(first_tokens) OVER w AS host_first_tokens,
    lead(n_tokens) OVER w AS host_tokens, lead(texts) OVER w AS host_texts,
    lead(last_pos, 2) OVER w AS reply_last, lead(texts, 2) OVER w AS reply_texts
  FROM runs WINDOW w AS (PARTITION BY conv ORDER BY run))"""


def pairs_sql(min_host_runs: int = 5, drop_first: int = 1, drop_last: int = 2) -> str:
    return RUNS_SQL + f""",
judged AS (
  SELECT *, conv || '-' || first_pos AS qid,
    CASE WHEN (n_runs + 1) // 2 < {min_host_runs} THEN 'short_dialogue'
         WHEN n_utt > 1 OR (first_tokens > 2 AND (host_n_utt > 1 OR host_first_tokens > 2)) THEN 'kept'
         WHEN NOT (n_utt > 1 OR first_tokens > 2) THEN 'short_guest' ELSE 'short_host' END AS verdict
  FROM lookahead
  WHERE run % 2 = 1 AND (run - 1) // 2 >= {drop_first} AND (run - 1) // 2 < n_runs // 2 - {drop_last}
    AND reply_last IS NOT NULL),
pairs AS (SELECT * FROM judged WHERE verdict = 'kept')"""


# -- highlights: annotators 1..5 mark the words of a document that hold their letter -----------

LETTERS = ["j", "q", "x", "z", "v"]


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item"), F.split("text", " ").alias("toks"))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.array(*[F.struct(F.lit(i + 1).alias("annotator"), F.lit(x).alias("letter"))
                       for i, x in enumerate(LETTERS)])
    holds_any = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in LETTERS])
    some = F.filter(F.transform("toks", lambda t, i: F.when(holds_any(t), F.struct((i + 1).alias("n"), t.alias("t")))),
                    lambda x: x.isNotNull())
    hl = F.transform(F.filter("some", lambda x: F.contains(x["t"], F.col("a.letter"))), lambda x: x["n"])
    return doc_tokens(spark, sf_dir).select("item", some.alias("some")).withColumn("a", F.explode(people)).select(
        "item", F.col("a.annotator").alias("annotator"), hl.alias("hl"))


HIGHLIGHTS_SQL = """toks AS (SELECT doc_id AS item, str_split(text, ' ') AS toks FROM documents),
people AS (SELECT * FROM (VALUES (1, 'j'), (2, 'q'), (3, 'x'), (4, 'z'), (5, 'v')) p(annotator, letter)),
words AS (
  SELECT item, generate_subscripts(toks, 1) AS tok, unnest(toks) AS word FROM toks),
marked AS (
  SELECT w.item, p.annotator, w.tok FROM words w JOIN people p ON contains(w.word, p.letter)),
hls AS (
  SELECT t.item, p.annotator, coalesce(m.hl, []) AS hl, coalesce(len(m.hl), 0) AS k
  FROM toks t CROSS JOIN people p
  LEFT JOIN (SELECT item, annotator, list(tok ORDER BY tok) AS hl FROM marked GROUP BY item, annotator) m
    ON m.item = t.item AND m.annotator = p.annotator),
hl_votes AS (
  SELECT item, count(*) FILTER (WHERE k > 0) AS yes, count(*) AS n FROM hls GROUP BY item),
counts AS (SELECT item, tok, count(*) AS c FROM marked GROUP BY item, tok)"""

# -- keyword comments: type, brand and name of a part ------------------------------------------

WORDS = {
    "paraphrase": "STANDARD", "non_paraphrase": "PROMO", "ambiguous": "ECONOMY", "repetition": "ring",
    "context": "anvil", "conclusion": "plate", "universal": "red", "difficult": "hot", "pragmatic": "blue",
    "shift": "gizmo", "alike": "old", "meta": "Brand#3", "surrogate": "Brand#4", "negated": "Brand#5",
    "directional": "new", "partial": "cold", "side": "gear", "unrelated": "rod", "related": "small",
    "error": "Brand#11", "near_repetition": "cold ring", "inspired": "MEDIUM",
}


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("qid"), F.when(F.col("p_size") > 25, "Yes").otherwise("No").alias("choice"),
        F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("comment"))


def _has(role: str) -> str:
    return f"contains(comment, '{WORDS[role]}')"


def _sql_flags() -> str:
    yes, no = "choice = 'Yes'", "choice = 'No'"
    h = _has
    plain = lambda role: f"({yes} AND {h(role)} AND NOT {h('paraphrase')} AND NOT {h('non_paraphrase')} AND NOT {h('ambiguous')})"
    relic = plain("repetition")
    pos = lambda role: f"({yes} AND {h(role)} AND {h('paraphrase')} AND positive)"
    neg = lambda role: f"({h(role)} AND {h('non_paraphrase')} AND negative)"
    return f"""comments AS (
  SELECT p_partkey AS qid, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS choice,
         p_type || ' ' || p_brand || ' ' || p_name AS comment FROM part),
base AS (
  SELECT *, {h('context')} AS context, ({yes} AND {h('ambiguous')}) AS ambiguous,
    (({yes} AND {h('paraphrase')}) OR {relic}) AND NOT {h('context')} AS positive,
    (({yes} AND {h('non_paraphrase')}) OR ({yes} AND NOT {h('repetition')} AND NOT {h('paraphrase')}
       AND NOT {h('non_paraphrase')} AND NOT {h('ambiguous')}) OR {no})
       AND NOT {h('context')} AND NOT ({yes} AND {h('ambiguous')}) AS negative
  FROM comments),
flags AS (
  SELECT *, (({yes} AND {h('paraphrase')} AND NOT {h('difficult')}) OR {relic}) AND positive AS clear,
    (({yes} AND {h('repetition')} AND {h('paraphrase')} AND NOT {h('near_repetition')}) OR {relic}) AND positive AS repetition,
    (({yes} AND {h('alike')} AND {h('paraphrase')}) OR {relic}) AND positive AS alike,
    {pos('universal')} AS universal, {pos('directional')} AS directional, {pos('shift')} AS shift, {pos('side')} AS side,
    ({pos('pragmatic')} AND NOT {h('shift')}) AS pragmatic,
    {neg('alike')} AS alike_non, {neg('partial')} AS partial, {neg('unrelated')} AS unrelated,
    ({neg('conclusion')} OR ({plain('conclusion')} AND negative)) AS conclusion,
    ({neg('related')} OR ({plain('inspired')} AND negative)) AS related,
    ({yes} AND {h('difficult')}) AS difficult, ({yes} AND {h('meta')}) AS meta, ({yes} AND {h('negated')}) AS negated,
    ({yes} AND {h('surrogate')}) AS surrogate, ({yes} AND {h('error')}) AS misrepresented
  FROM base)"""


FLAGS_SQL = _sql_flags()


def _sql_classes(first: bool) -> str:
    yes, no = "choice = 'Yes'", "choice = 'No'"
    h = _has
    silent = (f"({yes} AND NOT {h('repetition')} AND NOT {h('paraphrase')} AND NOT {h('non_paraphrase')} "
              f"AND NOT {h('ambiguous')})")
    error = "false" if first else h("error")
    if first:
        positive = (f"(({yes} AND {h('paraphrase')}) OR ({yes} AND {h('repetition')} AND NOT {h('paraphrase')} "
                    f"AND NOT {h('non_paraphrase')})) AND NOT context2 AND NOT ambiguous2")
        negative = f"({no} OR ({yes} AND {h('non_paraphrase')}) OR {silent})"
        rep = f"{h('repetition')} AND NOT {h('near_repetition')}"
    else:
        positive = f"({yes} AND NOT {h('non_paraphrase')}) AND NOT error2 AND NOT context2 AND NOT ambiguous2"
        negative = f"({no} OR ({yes} AND {h('non_paraphrase')}))"
        rep = h("repetition")
    return f"""comments AS (
  SELECT p_partkey AS qid, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS choice,
         p_type || ' ' || p_brand || ' ' || p_name AS comment FROM part),
c1 AS (SELECT *, {h('error')} AS error2, {error} AS error FROM comments),
c2 AS (SELECT *, {h('context')} AND NOT error2 AS context2, {h('context')} AND NOT error AS context FROM c1),
c3 AS (SELECT *, {h('ambiguous')} AND NOT context2 AND NOT error2 AS ambiguous2,
              {h('ambiguous')} AND NOT context AND NOT error AS ambiguous FROM c2),
c4 AS (SELECT *, {positive} AS positive, {negative} AND NOT error AND NOT context AND NOT ambiguous AS negative FROM c3),
c5 AS (SELECT *, {yes} AND {rep} AND positive AS repetition,
              positive AND {h('alike')} AND NOT {h('repetition')} AS alike,
              {yes} AND (negative OR ({h('related')} AND NOT error AND NOT context)) AS related FROM c4),
classes AS (SELECT *, {h('difficult')} AND NOT error AND NOT context AND NOT ambiguous AND NOT related AND negative AS difficult FROM c5)"""


CLASSES_SQL = _sql_classes(False)
FIRST_CLASSES_SQL = _sql_classes(True)


def unpivot_sql(names: list[str], tests: list[str], source: str, label: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS {label}, count(*) FILTER (WHERE {t}) AS n FROM {source}" for n, t in zip(names, tests))
