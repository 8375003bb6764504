import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import url_filter as uf
from pagewright.llm.queries import URL_RULES


def plain(url, rules, default="allow"):
    """host, path, rule, verdict by trying every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, stops: s[: min([s.index(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], default if best is None else ("block" if best[2] else "allow")


def check(spark, urls, rules, default="allow"):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "_judged")})
    table = spark.createDataFrame(rules, uf.RULE)
    rows = uf.judge_urls(df, table, default).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == [(i, *plain(u, rules, default)) for i, u in enumerate(urls)]
    kept = uf.allowed_pages(df, table, default)
    assert kept.columns == df.columns and {r.page_id for r in kept.collect()} == {r.page_id for r in rows if r.verdict == "allow"}


ODD = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://Www.EXAMPLE.Org/es/a", "x://y://org/", "http://xorg/", "http://.org/", "http://a..org/", "http://org./", "http://example.org/en/1",
    "http://example.org/en/12/x?y#z", "http://example.org/en/2", "http://example.org?x=/es/", "http://example.org#/es/", "http://sub.example.org/es", "http://sub.example.org/es/", "http://notexample.org/es/",
    "ftp://ÀB.com/fr/\n", "http://com/fr/é", "http://com/de/" + "x/" * 40000, "http://user@com:80/fr/", "http://org:80/", "http://a.com//fr/", "http://" + "a." * 5000 + "com/de/",
]


def test_rules_of_the_query(spark):
    check(spark, ODD, URL_RULES)
    check(spark, ODD, URL_RULES, "block")
    check(spark, ODD, [])
    check(spark, [], URL_RULES)


@pytest.mark.parametrize("most", [100_000, 7])
def test_random_rules(spark, monkeypatch, most):
    """Prefixes of each other, any host, open and closed segments, both verdicts for one rule; one trie and several."""
    monkeypatch.setattr(uf, "MAX_RULES", most)
    r = random.Random(most)
    host = lambda n: ".".join(r.choice("ab") for _ in range(n))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randrange(5)))
    rules = list({(host(r.randrange(4)), r.choice(["", path()]), r.choice(["allow", "block"])) for _ in range(40)})
    check(spark, [f"http://{host(r.randrange(5))}{r.choice(['', path()])}{r.choice(['', '?a/b', '#'])}" for _ in range(300)], rules)


def test_unknown_verdicts_are_refused(spark):
    with pytest.raises(Exception, match="no verdict: maybe"):
        uf.judge_urls(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), spark.createDataFrame([("a", "/", "maybe")], uf.RULE)).collect()
