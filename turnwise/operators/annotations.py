"""Survey exports as a long table of labels, highlights and session facts, and repairs of it.

Long tables have ``qid, category, highlighted, annotator, session, session_start`` (all STRING but
the start).  Rows about a session carry the session id as ``qid``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import code_label, int_list, list_literal, mark_upper, tokens

# Identifiers in column names, categories and choice codes.
CATEGORIES = {
    "R2": "Referred",
    "R": "Repetition",
    "RE": "Reference",
    "I": "Interpretation",
    "EI": "Information",
    "Q": "Question",
    "P": "Paraphrase",
    "CL": "Comment",
    "C": "Is Referring",
}
OLD_CATEGORIES = {
    "R2": "Referred",
    "R": "Rephrase",
    "I": "Interpretation",
    "EI": "Information",
    "Q": "Question",
    "CL": "Comment",
    "C": "Is Referring",
}
HIGHLIGHTS = ("Referred", "Repetition", "Reference", "Paraphrase")
OLD_HIGHLIGHTS = ("Referred", "Rephrase", "Interpretation", "Information", "Question")
CHOICES = {2: "History", 3: "No", 4: "Yes"}
CANDIDATE_CHOICES = {4: "No", 3: "Yes"}
HISTORY = "2"
SESSION_CATEGORIES = {
    "Comment": "Q-Comment",
    "Time": "Duration (in seconds)",
    "# failed ACs": "Quality_Fails",
    "EndTime": "EndDate",
}
SESSION_MARK = "R_"

LONG = ["qid", "category", "highlighted", "annotator", "session", "session_start"]

_COLUMN = re.compile(r"^(?:Q[^-]*-)?((?:NPR|CNN)-.+)-([A-Z0-9a-z]+?)(?:_[^_]*_(\d+).*)?$")


@dataclass
class ExportOptions:
    candidates: bool = False
    include_history: bool = True
    old_categories: bool = False
    admitted: tuple[str, ...] = ()
    removed: tuple[str, ...] = ("test",)
    include_fails: bool = False
    highlights: tuple[str, ...] = field(default=HIGHLIGHTS)


def _question_columns(columns: list[str], categories: dict[str, str]) -> dict[tuple[str, str], list[tuple[int, str]]]:
    """(item, identifier) -> [(token number, column)] from the column names of an export; timers are left out."""
    found: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for name in columns:
        m = _COLUMN.match(name)
        if m and m.group(2) not in categories and m.group(2) != "Timer":
            raise ValueError(f"column of unknown kind: {name}")
        if m and m.group(2) in categories:
            found.setdefault((m.group(1), m.group(2)), []).append((int(m.group(3) or 0), name))
    return found


def transform_export(wide: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """Wide survey export to the long table.

    Everything about a session is in its row and the items are in the column names, so each row
    expands by itself: no shuffle.  The two rows of column metadata are those whose start is not a
    time; ``undated_sessions`` lists sessions that are dropped for the same reason.
    """
    categories = OLD_CATEGORIES if options.old_categories else CATEGORIES
    marks = OLD_HIGHLIGHTS if options.old_categories else options.highlights
    choices = CANDIDATE_CHOICES if options.candidates else CHOICES

    def cell(name: str) -> Column:
        return F.col(f"`{name}`").cast("string")

    rows = wide.where(F.try_to_timestamp(F.col("StartDate").cast("string")).isNotNull())
    if options.removed:
        rows = rows.where(~F.coalesce(F.col("`Q-PID`").isin(*options.removed), F.lit(False)))
    by_hand = F.coalesce(F.col("`Q-PID`").isin(*options.admitted), F.lit(False)) if options.admitted else F.lit(False)
    done = ~F.coalesce(F.col("Q_RESPONSE_TYPE") == "In Process", F.lit(False)) | by_hand

    def entry(qid: Column, category: str, value: Column, keep: Column) -> Column:
        return F.when(keep, F.struct(qid.alias("qid"), F.lit(category).alias("category"),
                                     value.cast("string").alias("highlighted")))

    session = F.col("ResponseId").cast("string")
    out = [entry(session, category, cell(name), done) for category, name in SESSION_CATEGORIES.items()
           if name in wide.columns]
    if options.include_fails:
        stopped = (F.col("Progress").try_cast("int") < 100).cast("int")
        out.append(entry(session, "Stopped", stopped, F.lit(True)))
        if "Quality_Fails" in wide.columns:
            out.append(entry(session, "# failed ACs", cell("Quality_Fails"), ~done))
    found = _question_columns(wide.columns, categories)
    for (qid, ident), cells in found.items():
        category = categories[ident]
        if category in marks:
            picked = F.array_compact(F.array(*[F.when(cell(n).isNotNull(), F.lit(t)) for t, n in sorted(cells)]))
            if not options.include_history and category != marks[0] and (qid, "C") in found:
                code = cell(found[(qid, "C")][0][1])
                picked = F.when(F.coalesce(code == HISTORY, F.lit(False)), F.array().cast("array<int>")).otherwise(picked)
            value = list_literal(picked)
        elif ident == "C":
            value = code_label(cell(cells[0][1]), choices)
        else:
            value = cell(cells[0][1])
        out.append(entry(F.lit(qid), category, value, done))
    return rows.select(
        F.explode(F.array_compact(F.array(*out))).alias("e"), F.col("`Q-PID`").alias("annotator"),
        session.alias("session"), F.try_to_timestamp(F.col("StartDate").cast("string")).alias("session_start"),
    ).select("e.qid", "e.category", "e.highlighted", "annotator", "session", "session_start")


def item_rows(long: DataFrame) -> DataFrame:
    return long.where(~F.contains("qid", F.lit(SESSION_MARK)))


def sessions(long: DataFrame) -> DataFrame:
    """One row per session: start, end, seconds, failed checks, stopped, comment."""
    def pick(category: str) -> Column:
        return F.max(F.when(F.col("category") == category, F.col("highlighted")))

    rows = long.where(F.startswith("qid", F.lit(SESSION_MARK)))
    return rows.groupBy("session", "annotator").agg(
        F.min("session_start").alias("start"), F.try_to_timestamp(pick("EndTime")).alias("end"),
        pick("Time").try_cast("int").alias("seconds"), pick("# failed ACs").try_cast("int").alias("failed_acs"),
        pick("Stopped").try_cast("int").alias("stopped"), pick("Comment").alias("comment"))


def highlight_rows(long: DataFrame, category: str) -> DataFrame:
    """``item, annotator, session, start, hl`` of one highlight category."""
    return item_rows(long).where(F.col("category") == category).select(
        F.col("qid").alias("item"), "annotator", "session", F.col("session_start").alias("start"),
        int_list("highlighted").alias("hl"))


def labels_with_comments(long: DataFrame, category: str = "Paraphrase") -> DataFrame:
    """Label rows joined with the comment rows of the same item, annotator, session and start."""
    keys = ["qid", "annotator", "session", "session_start"]
    rows = item_rows(long)
    label = rows.where(F.col("category") == category).select(*keys, F.col("highlighted").alias("label"))
    comment = rows.where(F.col("category") == "Comment").select(*keys, F.col("highlighted").alias("comment"))
    return label.join(comment, keys)


def unmatched_labels(long: DataFrame, category: str = "Paraphrase") -> DataFrame:
    """Keys whose label and comment rows are not one to one; empty in sound data."""
    keys = ["qid", "annotator", "session", "session_start"]
    return item_rows(long).where(F.col("category").isin(category, "Comment")).groupBy(*keys).agg(
        F.count_if(F.col("category") == category).alias("n_labels"),
        F.count_if(F.col("category") == "Comment").alias("n_comments")).where("n_labels <> 1 OR n_comments <> 1")


def undated_sessions(wide: DataFrame) -> DataFrame:
    """Sessions of an export whose start is not a time; ``transform_export`` leaves them out."""
    return wide.where(
        F.startswith("ResponseId", F.lit(SESSION_MARK)) & F.try_to_timestamp(F.col("StartDate").cast("string")).isNull()).select(
        F.col("ResponseId").alias("session"), F.col("`Q-PID`").alias("annotator"), F.col("StartDate").alias("session_start"))


def unknown_categories(long: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    known = allowed or tuple(set(CATEGORIES.values()) | set(SESSION_CATEGORIES) | {"Stopped"})
    return long.where(~F.col("category").isin(*known)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def restrict(long: DataFrame, qids: DataFrame | None = None, annotators: DataFrame | None = None) -> DataFrame:
    if qids is not None:
        long = long.join(qids, "qid", "left_semi")
    if annotators is not None:
        long = long.join(annotators, "annotator", "left_semi")
    return long.select(*LONG)


def restrict_to_sessions(rows: DataFrame, wanted: DataFrame, key: str = "qid") -> DataFrame:
    """Rows whose (key, session) is listed; ``wanted`` has the key and an array ``sessions``."""
    pairs = wanted.select(key, F.explode("sessions").alias("session"))
    return rows.join(pairs, [key, "session"], "left_semi").select(*rows.columns)


def apply_corrections(long: DataFrame, corrections: DataFrame, skip: str = "Is Referring",
                      order: str = "ord") -> DataFrame:
    """Overwrite ``highlighted`` by (qid, category); the last correction wins, one category is left alone."""
    last = corrections.where(F.col("category") != skip).groupBy("qid", "category").agg(
        F.max_by(F.struct("highlighted"), order).alias("c"))
    joined = long.join(last, ["qid", "category"], "left")
    fixed = F.when(F.col("c").isNotNull(), F.col("c.highlighted")).otherwise(F.col("highlighted"))
    return joined.withColumn("highlighted", fixed).select(*long.columns)


def fill_highlights(long: DataFrame, categories: tuple[str, ...] = ("Referred", "Paraphrase")) -> DataFrame:
    """Adds highlight rows for plain yes/no labels: "-" for Yes, "[]" otherwise."""
    choice = item_rows(long).where(F.col("category") == "Is Referring")
    made = choice.withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories]))).withColumn(
        "highlighted", F.when(F.col("highlighted") == "Yes", "-").otherwise("[]"))
    return long.unionByName(made)


def with_inspection_text(long: DataFrame, texts: DataFrame) -> DataFrame:
    """A text beside each row: marked guest or host text, or the summary for comments.

    ``texts`` has ``qid, guest_text, host_text, summary`` and is joined once.
    """
    marked = F.when(F.col("highlighted") == "-", F.array().cast("array<int>")).otherwise(int_list("highlighted"))
    text = F.when(F.col("category") == "Referred", mark_upper(tokens("guest_text"), marked)) \
        .when(F.col("category") == "Paraphrase", mark_upper(tokens("host_text"), marked)) \
        .when(F.col("category") == "Comment", F.col("summary")).otherwise("")
    return long.join(texts, "qid", "left").withColumn("text", text).select(*long.columns, "text")


def training_funnel(training: DataFrame, passed: DataFrame) -> DataFrame:
    """Stopped, passed, failed attention and comprehension checks among the trained annotators."""
    n_passed = passed.agg(F.count_distinct("annotator").alias("n_passed")).withColumn("k", F.lit(1))
    facts = training.agg(
        F.count_distinct("annotator").alias("n_annotators"),
        F.count_if((F.col("category") == "Stopped") & (F.col("highlighted") == "1")).alias("n_stopped"),
        F.count_if((F.col("category") == "# failed ACs") & (F.col("highlighted") != "0")).alias("n_failed_ac"),
    ).withColumn("k", F.lit(1)).join(n_passed, "k").drop("k")
    base = F.col("n_annotators") - F.col("n_stopped")
    failed_cc = base - F.col("n_passed") - F.col("n_failed_ac")
    return facts.select("*", failed_cc.alias("n_failed_cc"), (F.col("n_passed") / base).alias("passed_share"),
                        (F.col("n_failed_ac") / base).alias("failed_ac_share"), (failed_cc / base).alias("failed_cc_share"))


def id_problems(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted ids that do not match exactly one row."""
    hits = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return wanted.select(key).distinct().join(hits, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def reindexed(ids: DataFrame, rows: DataFrame, key: str = "qid", order: str = "nth") -> DataFrame:
    """Rows in the order of an id list (``key, order``); ids without a row stay with NULLs."""
    return ids.select(key, order).join(rows, key, "left").orderBy(order)
