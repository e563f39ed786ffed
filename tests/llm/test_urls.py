import random

import pytest

from turnwise.llm.urls import RULES, filter_urls

PAGES = "page_id long, url string, host string, path string, rule int, key string"


def expected(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), h + p, a) for h, p, a in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("ranges", [1, 7])
def test_against_brute_force(spark, ranges):
    draw = random.Random(1)
    labels, tops = ["a", "b", "www", "example", "net", "xn--a"], ["net", "com", "org", "co.uk"]
    host = lambda: ".".join([*draw.choices(labels, k=draw.randint(0, 3)), draw.choice(tops)])
    path = lambda: "/" + "/".join(draw.choices(["en", "de", "fr", ""], k=draw.randint(0, 3)))
    rules = list({(host(), path(), draw.choice(["allow", "block"])) for _ in range(60)}) + RULES
    urls = [f"http://{draw.choice([host(), host().upper()])}{draw.choice([path(), '', '?q', '#f'])}{draw.choice(['', '?x=/en/', '#t'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "http:///en/", "a://b://c.net/", "http://NET/", "http://net:80/", "http://.net/", "http://Ä.NET/"]
    urls += ["http://hot.example.net/en/1"] * 200
    pages = spark.createDataFrame([(i, u, "x", "y", 0, "k") for i, u in enumerate(urls)] + [(None, urls[0], "x", "y", 0, "k")], PAGES)
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"), ranges=ranges).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert tuple(r)[1:] == expected(urls[r.page_id or 0], rules)


def test_no_rules_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    odd = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("", "/", "block"), ("net", "/", None)], none.schema)
    pages = spark.createDataFrame([(1, "http://a.net/", "x", "y", 0, "k")], PAGES)
    for rules in (none, odd):
        assert [tuple(r) for r in filter_urls(pages, rules).collect()] == [(1, "a.net", "/", None, "allow")]
    assert filter_urls(pages.limit(0), spark.createDataFrame(RULES, none.schema)).collect() == []
