import random
import re

import pytest

from symweave.llm import urlfilter

RULES = urlfilter.RULES + [("block", "a.com", "/"), ("allow", "x.a.com", "/p"), ("block", "x.a.com", "/p/q"), ("block", "com.example", "/"), ("allow", "a.com", "/")]


def brute(url, rules):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("range_rows", [7, 10**6])
def test_matches_brute_force(spark, range_rows):
    r = random.Random(range_rows)
    hosts = ["com", "example.com", "www.example.com", "a.b.www.example.com", "example.net", "WWW.Example.COM", "notexample.com", "a.com", "x.a.com", "y.x.a.com", "xa.com", "com.example", "é.net", "", "example.com:80", "u@example.com", "com.", "localhost"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/2", "/fr/", "/p/q/r", "/p", "?x=/en/", "#/en/", "/en/?q#f"]
    urls = [None, "", "no scheme", "://", "http://", "http://http://com/"] + [r.choice(["http://", "https://", "x://"]) + r.choice(hosts) + r.choice(paths) for _ in range(600)] + ["http://www.example.com/en/hot"] * 300
    pages = spark.createDataFrame([(i, u, "k", 1, "h") for i, u in enumerate(urls)], "page_id long, url string, key string, rank int, host string")
    rules = spark.createDataFrame([*RULES, (None, "q.com", "/"), ("block", "", "/")], "action string, host string, path string")
    got = {g.page_id: (g.host, g.path, g.rule, g.verdict) for g in urlfilter.judge_urls(pages, rules, range_rows=range_rows).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_null_ids_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.net/es/"), (1, "http://a.net/es/"), (1, "http://a.net/es/")], "page_id long, url string")
    rules = urlfilter.rule_table(spark)
    assert [tuple(r)[1:] for r in urlfilter.judge_urls(pages, rules).collect()] == [("a.net", "/es/", "net/es/", "block")] * 3
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_clashing_columns_and_long_urls(spark):
    long = "http://" + "a." * 5000 + "net/fr/" + "x/" * 50_000
    pages = spark.createDataFrame([(1, long, "c", 3, "c", "c", "c", 0, "c"), (2, "http://" + "y" * 100_000, *["c", 3, "c", "c", "c", 0, "c"])], "page_id long, url string, key string, rank int, host string, path string, action string, part long, rest string")
    got = {g.page_id: g for g in urlfilter.judge_urls(pages, urlfilter.rule_table(spark)).collect()}
    assert (got[1].rule, got[1].verdict, len(got[1].path)) == ("net/fr/", "block", 100_004)
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("y" * 100_000, "", None, "allow")


def test_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MOST_RANGES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.net/es/{i}") for i in range(400)], "page_id long, url string")
    got = urlfilter.judge_urls(pages, urlfilter.rule_table(spark), range_rows=10).collect()
    assert len(got) == 400 and {g.verdict for g in got} == {"block"}
