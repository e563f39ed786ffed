"""Prompts and model answers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.quotes import (GUEST_QUOTE, HOST_QUOTE, NEXT_ITEM, VERDICT, labelled_text, quote_spans,
                                       quoted_phrases, says_none, span_positions, span_status, verdict)
from turnwise.functions.text import dense, tokens

# The wording of the few-shot prompt.
PROMPT_FORMAT = {
    "prefix": "A Paraphrase is a rewording or repetition of content in the guest's statement. "
              "It rephrases what the guest said.",
    "item": "Given an interview on {date} with the summary: {summary}\n"
            "Guest and Host say the following:\n"
            "Guest ({guest_name}): {guest_utterance}\n"
            "Host ({host_name}): {host_utterance}",
    "prompt": "In the reply, does the host paraphrase something specific the guest says?",
    "reply": "Explanation: {explanation}\n"
             "Verbatim Quote Guest: {quote_guest}\n"
             "Verbatim Quote Host: {quote_host}\n"
             "Classification: {classification}",
    "quote_string": "\"{quote}\"",
    "start_response": "Explanation: Let's think step by step.\n",
}

ITEM_FIELDS = ("date", "summary", "guest_name", "guest_utterance", "host_name", "host_utterance")


def prompt_header(examples: list[dict], form: dict = PROMPT_FORMAT) -> str:
    """The part all prompts share: prefix and worked examples, formatted once."""
    def quotes(values: list[str] | None) -> str:
        if values is None:
            return "None."
        return " ".join(form["quote_string"].format(quote=v) for v in values)

    parts = [form["prefix"] + "\n\n"] if form.get("prefix") else []
    for ex in examples:
        reply = form["reply"].format(
            explanation=ex["explanation"], classification=ex["classification"],
            quote_guest=quotes(ex["guest_quotes"]), quote_host=quotes(ex["host_quotes"]))
        parts.append(form["item"].format(**ex) + "\n" + form["prompt"] + "\n\n" + reply + "\n\n\n")
    return "".join(parts)


def prompt_column(examples: list[dict], form: dict = PROMPT_FORMAT) -> Column:
    """Prompt text of a row with the ITEM_FIELDS columns."""
    pieces = [F.lit(prompt_header(examples, form))]
    rest = form["item"]
    for name in ITEM_FIELDS:
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest + "\n" + form["prompt"] + "\n\n" + form["start_response"]))


def build_prompts(items: DataFrame, examples: list[dict], form: dict = PROMPT_FORMAT) -> DataFrame:
    return items.select("qid", prompt_column(examples, form).alias("prompt"))


def expand_requests(prompts: DataFrame, times: int) -> DataFrame:
    """Each prompt ``times`` times, numbered from 0."""
    return prompts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def strip_echo(reply, prompt) -> Column:
    """The reply without the echoed prompt and without made-up further items; NULL without an echo."""
    reply, prompt = (F.col(c) if isinstance(c, str) else c for c in (reply, prompt))
    rest = F.replace(reply, prompt, F.lit(""))
    return F.when(F.contains(reply, prompt), F.substring_index(rest, NEXT_ITEM, 1))


def _side(reply: str, label: str, toks: str) -> tuple[Column, Column]:
    quote = labelled_text(reply, label)
    original = F.array_join(toks, " ")
    spans = quote_spans(tokens(F.lower(original), "run"), quoted_phrases(quote, original))
    return quote, spans


def parse_replies(replies: DataFrame) -> DataFrame:
    """One row per reply (``qid, rep, reply, guest_toks, host_toks``) with verdict, status and marks.

    Status per side: ``ok``, ``no_identifier``, ``none``, ``empty`` or ``not_found``; marks are the
    1-based numbers of the quoted words and stay empty unless the verdict is yes and the status ok.
    """
    rows = replies.withColumn("verdict", verdict(labelled_text("reply", VERDICT)))
    for side, label in (("guest", GUEST_QUOTE), ("host", HOST_QUOTE)):
        quote, spans = _side("reply", label, f"{side}_toks")
        rows = rows.withColumn(f"{side}_quote", quote).withColumn(
            f"{side}_spans", F.when((F.col("verdict") == 1) & F.col(f"{side}_quote").isNotNull(), spans))
        status = F.when(F.coalesce(F.col("verdict"), F.lit(0)) == 0, F.lit(None).cast("string")) \
            .when(F.col(f"{side}_quote").isNull(), "no_identifier") \
            .when(says_none(f"{side}_quote"), "none").otherwise(span_status(f"{side}_spans"))
        rows = rows.withColumn(f"{side}_status", status)
        rows = rows.withColumn(f"{side}_marks", F.when(
            F.col(f"{side}_status") == "ok", span_positions(f"{side}_spans")).otherwise(F.array().cast("array<int>")))
        rows = rows.drop(f"{side}_spans", f"{side}_quote")
    return rows


COUNTS = ("yes", "no", "unparsed", "no_identifier", "hl_errors", "no_pair", "invented", "invented_guest", "invented_host")


def _count_flags() -> dict[str, Column]:
    """What one parsed reply adds to each count."""
    def either(*kinds: str) -> Column:
        return F.coalesce(F.col("guest_status").isin(*kinds), F.lit(False)) | F.coalesce(
            F.col("host_status").isin(*kinds), F.lit(False))

    invented, no_pair, missing = either("not_found"), either("none", "empty"), either("no_identifier")
    tests = (F.col("verdict") == 1, F.col("verdict") == 0, F.col("verdict").isNull(), missing,
             invented | no_pair | missing, no_pair, invented, F.col("guest_status") == "not_found",
             F.col("host_status") == "not_found")
    return dict(zip(COUNTS, tests))


def answer_counts(parsed: DataFrame) -> DataFrame:
    """Verdict and error counts per item."""
    return parsed.groupBy("qid").agg(*[F.count_if(test).alias(name) for name, test in _count_flags().items()])


def answer_marks(parsed: DataFrame) -> DataFrame:
    """How often each word of a side was quoted: ``qid, side, tok, c``."""
    return parsed.select("qid", F.explode(F.array(
        F.struct(F.lit("guest").alias("side"), F.col("guest_marks").alias("m")),
        F.struct(F.lit("host").alias("side"), F.col("host_marks").alias("m")))).alias("s")).select(
        "qid", "s.side", F.explode("s.m").alias("tok")).groupBy("qid", "side", "tok").agg(F.count(F.lit(1)).alias("c"))


def answer_weights(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Per item the counts and, per side, the quote weight of each word.

    The weight divides by the yes answers less the invented quotes of that side.  ``items`` has
    ``qid, guest_toks, host_toks``.  A reply becomes one row for its counts and one per quoted word,
    so the replies are parsed once and summed up before the shuffle; the words are bounded by the text.
    """
    flags = parsed.withColumns({f"__{n}": F.coalesce(t, F.lit(False)).cast("int") for n, t in _count_flags().items()})

    def marks(side: str) -> Column:
        return F.transform(f"{side}_marks", lambda t: F.struct(F.lit(side).alias("side"), t.alias("tok")))

    head = F.array(F.struct(F.lit("").alias("side"), F.lit(0).alias("tok")))
    rows = flags.select("qid", *[f"__{n}" for n in COUNTS], F.explode(F.concat(head, marks("guest"), marks("host"))).alias("x"))
    summed = rows.groupBy("qid", "x.side", "x.tok").agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(f"__{n}").alias(n) for n in COUNTS])
    is_head = F.col("side") == ""
    per = summed.groupBy("qid").agg(
        *[F.max(F.when(is_head, F.col(n))).alias(n) for n in COUNTS],
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct(F.col("tok").alias("pos"), "c")))).alias(f"{s}_at")
          for s in ("guest", "host")])

    def weights(side: str) -> Column:
        den = F.greatest(F.col("yes") - F.col(f"invented_{side}"), F.lit(1))
        entries = F.transform(f"{side}_at", lambda m: F.struct(m["pos"].alias("pos"), (m["c"] / den).alias("val")))
        return dense(F.size(f"{side}_toks"), entries, F.lit(0.0)).alias(f"{side}_weights")

    return items.join(per, "qid").select("qid", *COUNTS, weights("guest"), weights("host"))
