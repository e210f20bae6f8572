from __future__ import annotations

import pytest

from tools.compare import difference, open_oracle
from wagerlens.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http://com/", "HTTP://A.Example.COM/en/x?y=/z", "https://www.example.com/en/1", "https://m.www.example.com/en/",
    "http://example.com/en", "http://example.com", "http://badexample.com/en/", "ftp://x.net/es/a#b", "http://x.net/fr/", "http://x.net?/es/", "http://x.net/de/",
    "a://b://c.net/es/", "http://x.net/es/\nq", "http://ÉX.net/fr/é", "http://" + "a." * 400 + "com/" + "p/" * 2000, "http://x.org/en/", "http://x.org/en/",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize(
    "given",
    [U.RULES, (("block", "b.com/"), ("allow", "com/b/"), ("block", "org/en"), ("allow", "x.org/"), ("block", "a.b.c/(x+)/"), ("block", "net/"), ("block", "/es/"))],
)
def test_against_brute_force(spark, given):
    rules = [U.Rule.of(*rule) for rule in given]
    urls = [*URLS, "http://b.com/b/", "http://a.b.c/(x+)/1", "http://a.b.c/xx/1", "http://x.org/enx"]
    pages = spark.createDataFrame([(i, url, "h", "t") for i, url in enumerate(urls)], "page_id long, url string, host string, token string")
    found = {row.page_id: tuple(row)[1:] for row in U.judge_urls(pages, rules).collect()}
    assert found == {i: brute(url, [r for r in rules]) for i, url in enumerate(urls)}


def test_no_rows_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(pages, [U.Rule.of(*rule) for rule in U.RULES]).count() == 0
    one = spark.createDataFrame([(None, "http://a.net/es/")] * 2, "page_id long, url string")
    assert [tuple(r) for r in U.judge_urls(one, []).collect()] == [(None, "a.net", "/es/", None, "allow")] * 2


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["*", "h:com", "h:example", "p:en"],)] * 3 + [(["*", "h:com"],)] * 5, "tokens array<string>")
    index = U.rarest_tokens(urls, U.rule_frame(spark, [U.Rule.of("block", "example.com/en/"), U.Rule.of("allow", "com/"), U.Rule.of("block", "net/es/")]))
    assert {r.rule: r.token for r in index.collect()} == {"example.com/en/": "h:example", "com/": "h:com", "net/es/": "h:net"}


def test_no_python_in_the_plan(spark):
    plan = U.op1_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert difference(U.op1_url_filter(spark, sf_dir), open_oracle(sf_dir), U.ORACLE_SQL) is None
