"""Parsing of model answers: labelled lines, verdicts, quoted phrases and their place in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.measures import col, let
from turnwise.functions.text import dense, tokens

# The labels of the answer lines.
VERDICT = "Classification"
GUEST_QUOTE = "Verbatim Quote Guest"
HOST_QUOTE = "Verbatim Quote Host"
NEXT_ITEM = "Given an interview on"

_EDGES = r"^\s+|\s+$"
_PUNCTUATION = r"[!-/:-@\[-`{-~]"
_NOT_WORD = r"(?U)[^\w\s]"


def labelled_text(text, label: str) -> Column:
    """Rest of the line after the first ``label:``, NULL when the label is absent."""
    text = col(text)
    found = F.regexp_extract(text, rf"(?s)^.*?{label}:([^\n]*)", 1)
    return F.when(F.contains(text, F.lit(f"{label}:")), F.regexp_replace(found, _EDGES, ""))


def verdict(text) -> Column:
    """1 for an answer that starts with yes, 0 for one that starts with no, else NULL."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(col(text), _EDGES, "")), _PUNCTUATION, "")
    return F.when(plain.startswith("yes"), 1).when(plain.startswith("no"), 0)


def quoted_phrases(text, original=None, whole_text: bool = True) -> Column:
    """Lower-cased phrases in double quotes, else in quote tags, else in single quotes (unless the
    original has one), else the whole text without a leading quote mark."""
    text = col(text)
    double = F.regexp_extract_all(text, F.lit(r'"([^"]*)"'), F.lit(1))
    tagged = F.regexp_extract_all(text, F.lit(r"<quote>(.*?)</quote>"), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r"'([^']*)'"), F.lit(1))
    if original is not None:
        single = F.when(~F.contains(col(original), F.lit("'")), single)
    none = F.array().cast("array<string>")
    last = F.array(F.regexp_replace(text, r'^"', "")) if whole_text else none
    picked = F.when(F.size(double) > 0, double).when(F.size(tagged) > 0, tagged) \
        .when(F.coalesce(F.size(single), F.lit(0)) > 0, single).otherwise(last)
    return F.transform(picked, F.lower)


def says_none(text) -> Column:
    """The word "none" outside of quotes."""
    text = col(text)
    in_quote = F.exists(quoted_phrases(text, F.lit(""), False), lambda q: F.contains(q, F.lit("none")))
    words = tokens(F.lower(F.regexp_replace(text, _NOT_WORD, "")), "run")
    return ~in_quote & F.array_contains(words, "none")


def phrase_words(phrase, strip_punct: bool = False) -> Column:
    words = tokens(col(phrase), "run")
    if strip_punct:
        words = F.filter(F.transform(words, lambda w: F.regexp_replace(w, _NOT_WORD, "")), lambda w: F.length(w) > 0)
    return words


def locate(words, phrase) -> Column:
    """0-based position of the first hit of a phrase (word array) in a word array, NULL without one.

    All words but the last are equal, the last one is a prefix of the word at its place.  The test of
    the last word comes first, so slices are only compared at its hits.
    """
    words, phrase = col(words), col(phrase)
    n, m = F.size(words), F.size(phrase)

    def search(p: Column) -> Column:
        starts = F.when((n >= m) & (m > 0), F.sequence(F.lit(0), F.greatest(n - m, F.lit(0)))).otherwise(
            F.array().cast("array<int>"))
        return F.get(F.filter(starts, lambda i: F.get(words, i + m - 1).startswith(p["tail"]) & (
            F.slice(words, i + 1, F.greatest(m - 1, F.lit(0))) == p["head"])), F.lit(0))

    return let(F.struct(
        F.slice(phrase, F.lit(1), F.greatest(m - 1, F.lit(0))).alias("head"), F.get(phrase, m - 1).alias("tail")), search)


def quote_spans(words, phrases, strip_punct: bool = False) -> Column:
    """``array<struct<start,len>>`` in phrase order; start is NULL when the phrase is not found."""
    words = col(words)
    if strip_punct:
        words = F.transform(words, lambda w: F.regexp_replace(w, _NOT_WORD, ""))
    return let(words, lambda ws: F.transform(col(phrases), lambda p: let(
        phrase_words(p, strip_punct),
        lambda pw: F.struct(locate(ws, pw).alias("start"), F.size(pw).alias("len")))))


def span_status(spans) -> Column:
    """``ok`` or the first problem in phrase order: ``empty`` phrase or ``not_found``."""
    spans = col(spans)
    bad = F.filter(spans, lambda s: (s["len"] == 0) | s["start"].isNull())
    return F.when(F.size(bad) == 0, "ok").when(F.get(bad, F.lit(0))["len"] == 0, "empty").otherwise("not_found")


def span_positions(spans) -> Column:
    """Distinct 1-based positions covered by the spans."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(col(spans), lambda s: F.sequence(
        s["start"] + 1, s["start"] + s["len"])))))


def quote_flags(text, quoting, strip_punct: bool = False) -> Column:
    """0/1 per word of the text for the quoted phrases, NULL when one is empty or not found."""
    def flags(ws: Column) -> Column:
        return let(quote_spans(ws, quoted_phrases(quoting, text), strip_punct), lambda spans: F.when(
            span_status(spans) == "ok",
            dense(F.size(ws), F.transform(span_positions(spans), lambda i: F.struct(
                i.alias("pos"), F.lit(1).alias("val"))), F.lit(0))))

    return let(tokens(F.lower(col(text)), "run"), flags)


def first_positions(text, quoted) -> Column:
    """0-based index of the first equal word for each quoted word, -1 without one."""
    return let(tokens(col(text), "run"), lambda ws: F.transform(
        tokens(col(quoted), "run"), lambda w: F.array_position(ws, w).cast("int") - 1))
