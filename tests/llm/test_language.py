import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import language
from turnwise.llm.language import fit_languages, fit_trigrams, identify_languages, page_rows, registered_domain, trigrams

WORDS = {
    "en": "the and of that with which thing shoulder weather other nothing between".split(),
    "de": "der und die schlecht zwischen nicht auch einfach pfeffer schule wichtig über".split(),
    "fr": "le et les dans beaucoup oiseau être château déjà peut-être chose eau".split()}
ROWS = "id long, text string, declared string, suffix string, host string, lang string, n int"


@pytest.fixture(scope="module")
def sentence():
    draw = random.Random(4)
    return lambda code, n: " ".join(draw.choices(WORDS[code], k=n))


@pytest.fixture(scope="module")
def model(sentence):
    return fit_trigrams([(sentence(c, 40), c) for c in WORDS for _ in range(30)])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "zz", 3) for r in rows], ROWS)


def plain(rows, model):
    """The same fusion row by row."""
    names, size = model.languages, len(model.languages)
    likely = [model.log_likelihoods(t) for _, t, *_ in rows]
    shares = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() if n else np.zeros(size) for n, x in likely]
    codes = [(d or "").strip().split("-")[0].lower() for _, _, d, _, _ in rows]
    hosts = [h.lower() if h is not None else None for *_, h in rows]
    domains = [".".join(h.split(".")[-2:]) if h is not None else None for h in hosts]
    base = sum(shares) + 1
    base = base / base.sum()
    told = np.array([sum((s for s, c in zip(shares, codes) if c == d), np.zeros(size)) for d in names]) + 1
    told = np.log(told / told.sum(axis=0))
    out = []
    for k, (i, _, _, suffix, _) in enumerate(rows):
        def prior(groups, parent):
            sums = sum((s for s, g in zip(shares, groups) if g is not None and g == groups[k]), np.zeros(size))
            sums = np.maximum(sums - shares[k], 0)
            return (sums + language.SMOOTHING * parent) / (sums.sum() + language.SMOOTHING)
        logs = likely[k][1] + np.log(prior(hosts, prior(domains, base)))
        if codes[k] in names:
            logs = logs + told[names.index(codes[k])]
        of = language.SUFFIXES.get((suffix or "").lower())
        if of in names:
            logs = logs + np.log([0.8 if n == of else 0.2 / (size - 1) for n in names])
        p = np.exp(logs - logs.max())
        p /= p.sum()
        out.append((i, names[int(p.argmax())] if likely[k][0] else "und", float(p.max()), bool(likely[k][0] and p.max() >= language.ACCEPT)))
    return out


def test_fusion_against_plain_code(spark, model, sentence):
    draw = random.Random(9)
    hosts = ["a.example.de", "b.example.de", "x.fr", "hot.org", "HOT.org", "", None]
    rows = [
        (i, sentence(c := draw.choice(list(WORDS)), draw.choice([1, 1, 2, 30])), draw.choice([c, c, "EN-us", "xx", None]),
         draw.choice(["de", "fr", "org", "COM", None]), draw.choice(hosts)) for i in range(200)]
    rows += [(900, None, "de", "de", "x.fr"), (901, "", None, None, None), (902, "123 !!", "fr", "fr", "hot.org"), (None, "und der", None, None, None),
             (903, sentence("en", 60_000), None, None, None), (904, "q", None, None, None), (904, "q", None, None, None)]
    got = identify_languages(frame(spark, rows), model).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    for g, w in zip(sorted(((r.id, r.lang, r.posterior, r.accepted) for r in got), key=key), sorted(plain(rows, model), key=key), strict=True):
        assert g[:2] == w[:2] and g[3] == w[3] and g[2] == pytest.approx(w[2], abs=1e-9)
    assert not any(r.accepted for r in got if r.id in (900, 901, 902))
    long = next(r for r in got if r.id == 903)
    assert long.lang == "en" and long.accepted


def test_host_prior_decides_where_the_text_cannot(spark, model, sentence):
    rows = [(i, sentence("fr", 30), None, None, "www.site.com") for i in range(60)]
    rows += [(200 + i, sentence("de", 30), "de", "de", f"h{i}.de") for i in range(60)] + [(100, "xyz", None, None, "www.site.com"), (101, "xyz", "de", "de", None)]
    got = {r.id: r for r in identify_languages(frame(spark, rows), model).collect()}
    assert got[100].lang == "fr" and got[101].lang == "de"


def test_no_rows_no_labels(spark, model, documents):
    assert identify_languages(frame(spark, []), model).collect() == []
    none = fit_languages(spark.createDataFrame([(None, "en"), ("text", None)], "text string, lang string"))
    got = identify_languages(frame(spark, [(1, "some text", "en", None, None)]), none).collect()
    assert [(r.lang, r.accepted) for r in got] == [("und", False)]


def test_fitting_on_a_table(spark, sentence):
    rows = [(sentence(c, 30), c) for c in WORDS for _ in range(40)]
    fitted = fit_languages(spark.createDataFrame(rows * 2, "text string, lang string"), sample=90)
    assert fitted.languages == sorted(WORDS)
    for c in WORDS:
        assert fitted.languages[int(fitted.log_likelihoods(sentence(c, 10))[1].argmax())] == c


def test_page_evidence(spark):
    page = '<!DOCTYPE html><HTML data-x="1" LANG="de-AT"><style>p{a:b}</style><script>var t="</p>";</script><!-- <p>no</p> --><p>Der&amp;<b>Text</b></p>'
    pages = spark.createDataFrame([(1, "https://www.Example.DE:80/a", page), (2, None, None)], "page_id long, url string, html string")
    one, two = page_rows(pages, F.col("page_id")).orderBy("id").collect()
    assert one.text.split() == ["Der", "Text"] and (one.declared, one.suffix, one.host) == ("de", "de", "www.example.de")
    assert two.text == "" and two.declared is None and two.suffix is None and two.host is None
    assert [r[0] for r in pages.select(registered_domain(F.lit("a.b.c.net"))).collect()] == ["c.net"] * 2


def test_trigrams_are_of_letters_in_lower_case():
    assert trigrams("Ab, 12 cd").tolist() == trigrams("aB-!34 cd").tolist()
    assert len(trigrams("")) == len(trigrams("12 ,.")) == 0
