"""Token, highlight, id and list-literal expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.measures import col, let


def tokens(text, blanks: str = "single") -> Column:
    """``single`` splits at each blank and keeps empty tokens, ``run`` splits at runs of white space."""
    if blanks == "single":
        return F.split(col(text), " ")
    # The class [\s\p{Z}] also covers the Unicode blanks that \s leaves out.
    trimmed = F.regexp_replace(col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\s\p{Z}]+"))


def n_tokens(text, blanks: str = "single") -> Column:
    return F.size(tokens(text, blanks))


def conversation_of(qid) -> Column:
    """Part of a pair id before its last ``-``."""
    return F.regexp_extract(col(qid), r"^(.*)-([^-]*)$", 1)


def position_of(qid) -> Column:
    return F.regexp_extract(col(qid), r"^(.*)-(\d+)$", 2).try_cast("int")


def pair_id(conv, pos) -> Column:
    return F.concat_ws("-", col(conv).cast("string"), col(pos).cast("string"))


def dense(n, entries, zero) -> Column:
    """Array of length ``n`` with the values of ``entries`` and ``zero`` elsewhere.

    ``entries`` is ``array<struct<pos,val>>`` in order of distinct 1-based positions.  Built from the
    gaps between the entries, so the work is linear in ``n``.
    """
    def build(e: Column) -> Column:
        pieces = F.transform(e, lambda x, k: F.concat(
            F.array_repeat(zero, x["pos"] - F.coalesce(F.get(e, k - 1)["pos"], F.lit(0)) - 1), F.array(x["val"])))
        last = F.coalesce(F.get(e, F.size(e) - 1)["pos"], F.lit(0))
        return F.concat(F.flatten(pieces), F.array_repeat(zero, col(n) - last))

    return let(col(entries), build)


def marked_flags(n, marked) -> Column:
    """0/1 per token for 1-based highlighted numbers."""
    on = F.transform(F.array_sort(F.array_distinct(col(marked))), lambda i: F.struct(
        i.cast("int").alias("pos"), F.lit(1).alias("val")))
    return dense(n, F.filter(on, lambda e: (e["pos"] >= 1) & (e["pos"] <= col(n))), F.lit(0))


def mark_upper(toks, marked) -> Column:
    """Text with the highlighted tokens (1-based numbers) in upper case."""
    marked = F.coalesce(col(marked), F.array().cast("array<int>"))
    return let(col(toks), lambda ts: F.array_join(F.zip_with(
        ts, marked_flags(F.size(ts), marked), lambda t, on: F.when(on == 1, F.upper(t)).otherwise(t)), " "))


def marked_text(toks, marked) -> Column:
    """Only the highlighted tokens, ``""`` when there are none."""
    toks = col(toks)
    return F.coalesce(F.array_join(F.transform(col(marked), lambda i: F.get(toks, i - 1)), " "), F.lit(""))


def marked_numbers(weights, threshold: float = 0.5) -> Column:
    """0-based positions whose weight reaches the threshold."""
    weights = col(weights)
    idx = F.filter(F.transform(weights, lambda w, i: F.when(w >= threshold, i)), lambda i: i.isNotNull())
    return idx


def equal_spans(weights) -> Column:
    """Runs of equal weight as ``array<struct<start,stop,weight>>`` (0-based, stop exclusive)."""
    def spans(w: Column) -> Column:
        starts = F.filter(
            F.transform(w, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda st: F.transform(st, lambda s, k: F.struct(
            s.alias("start"), F.coalesce(F.get(st, k + 1), F.size(w)).alias("stop"), F.get(w, s).alias("weight"))))

    return let(col(weights), spans)


def rescale(values, top: float = 100.0) -> Column:
    """Min-max rescaling of an array to 0..top; a constant array becomes zeros."""
    def scaled(v: Column) -> Column:
        return let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda b: F.transform(
            v, lambda x: F.when(b["hi"] > b["lo"], (x - b["lo"]) / (b["hi"] - b["lo"]) * top).otherwise(F.lit(0.0))))

    return let(col(values), scaled)


def fraction(text) -> Column:
    """``"10 / 20"`` as a struct of two ints, NULL when malformed."""
    parts = F.split(col(text), "/")
    top, bottom = F.trim(F.get(parts, F.lit(0))).try_cast("int"), F.trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when((F.size(parts) == 2) & top.isNotNull() & bottom.isNotNull(),
                  F.struct(top.alias("yes"), bottom.alias("n")))


def int_list(literal) -> Column:
    """``"[1, 5, 6]"`` as ``array<int>``; ``"-"`` (no highlight data) is NULL."""
    return F.from_json(col(literal), "array<int>")


def string_list(literal) -> Column:
    """A JSON array or a Python list literal of texts as ``array<string>``; NULL if it is neither.

    Either kind of quotes may enclose a text, escaped characters are those of JSON, ``\\'`` and ``\\xhh``.
    """
    plain = F.regexp_replace(col(literal), r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    return F.from_json(plain, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def list_literal(values) -> Column:
    """Numbers as ``[1, 5, 6]``."""
    return F.concat(F.lit("["), F.array_join(col(values).cast("array<string>"), ", "), F.lit("]"))


def text_list_literal(values) -> Column:
    """Texts as a JSON array, which ``string_list`` reads back as they are."""
    return F.to_json(col(values))


def code_label(code, mapping: dict[int, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(code).try_cast("int"))


def next_versions(versions) -> Column:
    """``"0|1"`` to ``"1|2"``."""
    return F.array_join(
        F.transform(F.split(col(versions), r"\|"), lambda v: (v.cast("int") + 1).cast("string")), "|")


def index_range(start, stop) -> Column:
    """Positions ``start .. stop-1``."""
    return F.when(col(stop) > col(start), F.sequence(col(start), col(stop) - 1)) \
        .otherwise(F.array().cast("array<int>"))


def lexical_jaccard(a, b) -> Column:
    """Token-set overlap of two lower-cased texts; NULL when both are empty."""
    ta, tb = (F.array_distinct(F.split(F.lower(col(x)), " ")) for x in (a, b))
    inter = F.size(F.array_intersect(ta, tb))
    return F.when((F.length(col(a)) > 0) | (F.length(col(b)) > 0), inter / (F.size(ta) + F.size(tb) - inter))
