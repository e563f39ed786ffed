"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are combined for each row: the likelihood of the text under character trigram
models, the declared markup language, the address suffix, and a prior of the host.  The reliability
of declarations and the priors come from grouped aggregation over all rows, where each row counts
with the probabilities that its text alone gives.  Priors are smoothed along host, registered domain
and all rows, and a row's own text is taken out of the counts of its host and domain.

Texts are read once; what follows works on a narrow table.  Counts are combined before the shuffle,
so a host of a third of all rows is one row per task, and the join with the priors can be split.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import full, query, table
from turnwise.llm.urls import url_host_path
from turnwise.session import cut_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLE_BITS = 16  # of the hashed trigram table
SAMPLE = 8_000  # labelled texts that the trigram models are fitted on, at most about
ENOUGH = 200  # trigrams that count in full; in longer texts they count less each, as they depend on each other
STRENGTH = 0.5  # of a trigram's log likelihood
SMOOTHING = 20.0  # rows that a parent's share weighs in a prior
ACCEPT = 0.5  # least posterior of an accepted row
SUFFIX_TRUST = 0.8  # chance that a country's suffix tells the language of its texts

# Languages of country suffixes.
SUFFIXES = {
    "de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es",
    "co": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}


def trigrams(text: str) -> np.ndarray:
    """Table places of the trigrams of a text in lower case, other characters than letters as blanks; none without letters."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (points >= 97) & (points <= 122) | (points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & (
        (points < 0x2000) | (points > 0x303F))
    points = np.where(letters, points, 32).astype(np.uint32)
    if len(points) < 3 or not letters.any():
        return np.zeros(0, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    mixed = (a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA77) ^ c
    mixed = (mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - TABLE_BITS)
    return mixed[(b != 32) | (a != 32) & (c != 32)].astype(np.int64)


@dataclass
class TrigramModel:
    """Log likelihoods of hashed trigrams, a column per language."""

    languages: list[str]
    table: np.ndarray

    def log_likelihoods(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams, and the text's log likelihood per language, tempered by length."""
        total, n = np.zeros(len(self.languages)), 0
        text = text or ""
        for at in range(0, len(text), 1 << 18):  # so memory stays small for long texts
            places = trigrams(text[max(0, at - 2):at + (1 << 18)])
            total += self.table[places].sum(axis=0, dtype=np.float64)
            n += len(places)
        return n, STRENGTH * total * min(1.0, ENOUGH / max(n, 1))


def fit_trigrams(rows: list[tuple[str, str]]) -> TrigramModel:
    """Models of the languages of (text, language) rows, smoothed by the counts of all languages together."""
    languages = sorted({language for _, language in rows})
    counts = np.zeros((len(languages), 1 << TABLE_BITS))
    for text, language in rows:
        counts[languages.index(language)] += np.bincount(trigrams(text), minlength=1 << TABLE_BITS)
    common = counts.sum(axis=0) + 0.5
    common /= common.sum()
    shares = (counts + 500 * common) / (counts.sum(axis=1, keepdims=True) + 500)
    return TrigramModel(languages, np.log(shares).T.astype(np.float32))


def fit_languages(docs: DataFrame, *, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> TrigramModel:
    """Trigram models from about ``sample`` labelled texts at most, drawn by a hash of the text.

    Rows without a text or label are left out.  Without labelled rows the model knows no language, and
    no row will be accepted.
    """
    usable = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).where(
        "text IS NOT NULL AND text <> '' AND label IS NOT NULL")
    share = min(1.0, sample / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct().collect()
    return fit_trigrams(sorted((r["text"], r["label"]) for r in drawn))


def text_task(model: TrigramModel):
    """Task function: adds the number of trigrams and the log likelihoods of ``text``, and drops it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.log_likelihoods(t) for t in batch["text"]]
            yield batch.drop(columns="text").assign(n=[n for n, _ in found], likely=[x.tolist() for _, x in found])
    return run


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    return F.transform(logs, lambda x: F.exp(x - top) / F.aggregate(logs, F.lit(0.0), lambda s, y: s + F.exp(y - top)))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def html_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    return F.regexp_replace(F.regexp_replace(
        html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&\w+;", " ")


def identify_languages(rows: DataFrame, model: TrigramModel, *, accept: float = ACCEPT) -> DataFrame:
    """``id``, ``lang``, ``posterior``, ``text_lang``, ``host``, ``declared`` and ``accepted`` of every row.

    ``rows`` has ``id`` (any type), ``text``, ``declared`` (language code of the markup), ``suffix`` (last label of
    the address) and ``host``.  A null in ``declared``, ``suffix`` or ``host``, and a code that the model doesn't know,
    is no evidence.  ``lang`` is the language of the highest posterior, of equal ones the first by name; ``und``
    for texts without letters (null, empty, digits only), which are never accepted.  Other rows are accepted
    with a posterior of ``accept`` or more.  Repeated rows and null ids are worked one by one; an empty table
    gives an empty result; other columns are ignored.
    """
    spark, names = rows.sparkSession, model.languages
    key = rows.schema["id"].dataType.simpleString()
    code = F.lower(F.substring_index(F.trim("declared"), "-", 1))
    narrow = rows.select(
        "id", F.col("text"), F.when(code.isin(names), code).alias("declared"), F.lower("suffix").alias("suffix"),
        F.lower("host").alias("host"))
    if not names:
        return narrow.select(
            "id", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_lang"), "host",
            "declared", F.lit(False).alias("accepted"))
    read = cut_texts(narrow.mapInPandas(
        text_task(model), f"id {key}, declared string, suffix string, host string, n long, likely array<double>"))
    every = read.withColumn("shares", F.when(F.col("n") > 0, softmax(F.col("likely")))).withColumn(
        "domain", registered_domain(F.col("host")))
    shares = [F.coalesce(F.col("shares")[i], F.lit(0.0)) for i in range(len(names))]

    def summed(by: list[str], frame: DataFrame, columns: list[Column]) -> DataFrame:
        return frame.groupBy(*by).agg(F.array(*[F.sum(c) for c in columns]).alias("sums"))

    def again(i: int) -> Column:
        return F.col("sums")[i]

    size = range(len(names))
    hosts = summed(["host", "domain"], every.where("host IS NOT NULL"), shares)
    domains = summed(["domain"], hosts, [again(i) for i in size])
    # One row per known code and one without: a table of languages by languages.
    told = {r["declared"]: r["sums"] for r in summed(["declared"], every, shares).collect()}
    everything = np.sum([x for x in told.values()], axis=0) + 1.0 if told else np.ones(len(names))
    base = everything / everything.sum()
    trust = np.array([told.get(d, [0.0] * len(names)) for d in names]) + 1.0  # declared x true
    declared_log = np.log(trust / trust.sum(axis=0, keepdims=True))

    def vector(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def chosen(column: str, table: dict[str, np.ndarray]) -> Column:
        out = vector(np.zeros(len(names)))
        for value, logs in table.items():
            out = F.when(F.col(column) == value, vector(logs)).otherwise(out)
        return out

    suffix_logs = {
        s: np.log([SUFFIX_TRUST if x == language else (1 - SUFFIX_TRUST) / max(1, len(names) - 1) for x in names])
        for s, language in SUFFIXES.items() if language in names}
    own = F.coalesce("shares", vector(np.zeros(len(names))))
    less = lambda column: F.zip_with(F.coalesce(column, own), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(sums: str, parent: str) -> Column:
        total = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(sums, parent, lambda s, p: (s + SMOOTHING * p) / (total + SMOOTHING))

    fused = (
        every.join(hosts.select("host", F.col("sums").alias("host_sums")), "host", "left")
        .join(domains.select("domain", F.col("sums").alias("domain_sums")), "domain", "left")
        .withColumn("base", vector(base)).withColumn("own", own)
        .withColumn("domain_sums", less(F.col("domain_sums"))).withColumn("host_sums", less(F.col("host_sums")))
        .withColumn("domain_prior", smoothed("domain_sums", "base"))
        .withColumn("prior", smoothed("host_sums", "domain_prior"))
        .withColumn("told", chosen("declared", {d: declared_log[i] for i, d in enumerate(names)}))
        .withColumn("suffixed", chosen("suffix", suffix_logs))
        .withColumn("posteriors", softmax(F.transform(
            F.arrays_zip("likely", "prior", "told", "suffixed"),
            lambda e: e["likely"] + F.log(e["prior"]) + e["told"] + e["suffixed"]))))

    def best(values: str) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(values, F.array_max(values)).cast("int"))

    written = F.col("n") > 0
    return fused.select(
        "id", F.when(written, best("posteriors")).otherwise("und").alias("lang"),
        F.array_max("posteriors").alias("posterior"),
        F.when(written, best("likely")).otherwise("und").alias("text_lang"), "host", "declared",
        (written & (F.array_max("posteriors") >= accept)).alias("accepted"))


def document_rows(docs: DataFrame, id: Column) -> DataFrame:
    """Documents as evidence: their language column is a declaration, their source the host."""
    return docs.select(
        id.alias("id"), F.col("text"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
        F.col("source").alias("host"))


def page_rows(pages: DataFrame, id: Column) -> DataFrame:
    """Pages as evidence: text, declared language and address of the markup."""
    host, _ = url_host_path(F.col("url"))
    host = F.regexp_replace(host, r":\d*$", "")
    return pages.select(
        id.alias("id"), html_text(full("html")).alias("text"),
        F.nullif(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1), F.lit("")).alias("declared"),
        F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; one of ``doc_id`` and ``page_id`` is null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = document_rows(docs, F.struct(F.col("doc_id"), none.alias("page_id"))).unionByName(
        page_rows(pages, F.struct(none.alias("doc_id"), F.col("page_id"))))
    return identify_languages(rows, fit_languages(docs)).select(
        "id.doc_id", "id.page_id", "lang", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "accepted")
