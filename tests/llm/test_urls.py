"""Operator 2: parsing and rules against plain string handling, the model on names it should know."""

import itertools
import re

from calibrium.llm.urls import ALLOWED, BLOCKED, COMMON, RULES, NaiveBayes, NameWords, _names, filter_urls, op2_url_filter


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best and best[0]


def test_whole_table(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op2_url_filter(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_odd_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://ExÄmple.COM/en/1", "a://b://c/d", "x://com/en/9", "x://a.example.com/en/7?q", "x://notcom/en/", "x://a.com?/en/", "x://h#f/p", "://h/p", "x://h\n/p\nq", "http://example.com/en", "x://www.example.net/de/8#1", "x://www.example.net/de/9"]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == (verdict or "allow")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty).collect() == []


def test_viterbi_finds_the_cheapest_split():
    words = NameWords({"ab": 5.0, "abc": 2.0, "c": 4.0, "d": 1.0, "cd": 3.0, "a": 1.0, "bcd": 1.0})
    for n in range(1, 6):
        for name in map("".join, itertools.product("abcd", repeat=n)):
            cost = lambda parts: sum(words.cost.get(p, words.unknown + 2.3 * len(p)) for p in parts)
            splits = [[name[i:j] for i, j in zip((0, *cuts), (*cuts, n))] for k in range(n) for cuts in itertools.combinations(range(1, n), k)]
            assert abs(cost(words.split(name)) - min(map(cost, splits))) < 1e-9


def test_unruled_urls(spark):
    bad = ["bestcasinowin.io", "blog.freebets.biz", "m.casino-win.info", "cheappillsonline.shop", "www.adult-x.tv", "freexxxmovies.tv", "buyviagranow.biz", "m.ads-track.io"]
    good = ["dailynewsworld.org", "www.universityresearch.edu", "mygardenclub.org", "m.ththre.example.org", "docs.opensource.dev", "cookingrecipes.fr"]
    pages = spark.createDataFrame([(k, f"https://{h}/a/{k}.html") for k, h in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in filter_urls(pages).collect()}
    assert [got[k] for k in range(len(bad))] == ["block"] * len(bad) and [got[len(bad) + k] for k in range(len(good))] == ["allow"] * len(good)


def test_naive_bayes_by_hand():
    import math

    b = NaiveBayes([["x", "y"]], [["y", "z", "z"]], 0.5)
    assert math.isclose(b.score(["x", "y", "unknown"]), math.log((2 / 5) / (1 / 6)) + math.log((2 / 5) / (2 / 6)))
    assert len(_names(BLOCKED)) > 50 and len(_names(ALLOWED)) > 50 and len(set(COMMON)) == len(COMMON)
