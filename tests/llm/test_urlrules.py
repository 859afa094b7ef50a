from __future__ import annotations

import random
import re

from gridloom.llm import urlrules
from gridloom.llm.queries import URL_RULES


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def brute(url, rules, default="allow"):
    host, path = parse(url)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_given_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://example.org", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/es", "http://badexample.org/es/", "http://a.b.com/de/x://y/", "x://org/", "http://com?/fr/", "http://é.com/fr/ü", "http://a..org/z", "http://.org/", "https://example.org/en/123#top"]
    check(spark, urls + urls[:4], URL_RULES)


def test_very_long_urls(spark):
    long = "/en/1" + "x" * 1_000_000
    check(spark, [f"http://example.org{long}", "http://" + "a." * 200_000 + "com/de/" + "y" * 500_000, "http://" + "z" * 1_000_000 + "/fr/", "http://com" + long], URL_RULES)


def test_hot_host(spark, monkeypatch):
    from gridloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    check(spark, [f"http://www.example.org/es/{i}" for i in range(60)] + [f"http://a{i}.com/de/{i}" for i in range(30)], URL_RULES)


def test_random_nested_rules(spark):
    rnd = random.Random(9)
    def label():
        return rnd.choice("abc")
    def path():
        return "/" + "/".join(rnd.choice(["x", "xy", "é", "z"]) for _ in range(rnd.randint(0, 4)))
    rules = list({(".".join(label() for _ in range(rnd.randint(1, 3))), path()): None for _ in range(60)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{'.'.join(label() for _ in range(rnd.randint(1, 4)))}{path()}?q" for _ in range(600)] + ["http://a/x/x"] * 300
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        host, p, rule, _ = brute(u, rules)
        longest = max([len(h + q) for h, q, _ in rules if (host == h or host.endswith("." + h)) and p.startswith(q)], default=None)
        assert (got[i].rule and len(got[i].rule)) == longest, (u, got[i], rule)


def test_empty(spark):
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect() == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in urlrules.judge(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), none).collect()] == ["allow"]
