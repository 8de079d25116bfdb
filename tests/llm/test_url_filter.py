import re

from conftest import DATA
from lastleg.llm import url_filter as uf
from lastleg.llm.queries import QUERIES, URL_RULES


def slow_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):])[0]


def test_query_equals_brute_force(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = QUERIES["op3_urls"](spark, DATA).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        host, path = slow_parts(pages[r["page_id"]])
        rule = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == (rule.action if rule else r["verdict"]) and r["verdict"] in ("allow", "block")


def page(i, url, html=None):
    return (i, url, html, "x", "y")


def judged(spark, rows, rules, redirects=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, alias string")
    return {r["page_id"]: (r["verdict"], r["rule"]) for r in uf.judge(pages, rules, redirects).collect()}


def test_blocks_pass_through_links_and_allows_come_first(spark):
    canonical = '<html><LINK href="{}" rel="canonical"></html>'.format
    refresh = "<meta content='0; URL={}' http-equiv='refresh'>".format
    rules = [uf.Rule("block", "bad.com", "/"), uf.Rule("allow", "good.com", "/ok")]
    got = judged(spark, [
        page(1, "http://bad.com/x"), page(2, "https://alias.net/y", canonical("http://www.bad.com/x/")), page(3, "http://far.net/z?a=1", refresh("https://alias.net/y?utm_source=q")),
        page(4, "http://m.far.net/z/?a=1&ref=k#top"), page(5, "http://far.net/z?a=2"), page(6, "http://good.com/ok", canonical("http://bad.com/q")),
        page(7, "http://bad.com/q"), page(8, "http://other.net/a/b", canonical("../x")), page(9, "http://bad.com.evil.net/"), page(10, None), page(11, "no address"),
        page(12, "http://r.net/a/1", canonical("/root")), page(13, "http://r.net/root", canonical("http://bad.com/x")), page(14, "http://s.net/q", canonical("http://bad.com/q")),
        page(10, None), page(None, "HTTP://BAD.com?x"),
    ], rules)
    assert {i for i, (v, _) in got.items() if v == "block"} == {1, 2, 3, 4, 7, 12, 13}
    assert got[6] == ("allow", "good.com/ok") and got[14][0] == "allow"  # an allowed page in the component
    assert got[7] == ("block", "bad.com/")  # but an own rule comes first
    assert got[None] == ("allow", None)  # no path, so the rule with a path doesn't fit


def test_redirect_table_without_html_and_empty_tables(spark):
    rules = [uf.Rule("block", "bad.com", "")]
    pages = spark.createDataFrame([(1, "http://a.net/1"), (2, "http://b.net/2")], "page_id long, url string")
    redirects = spark.createDataFrame([("http://a.net/1", "http://c.net/"), ("http://c.net", "http://bad.com/"), (None, "x"), ("x", None)], "source string, target string")
    both = uf.judge(pages.union(spark.createDataFrame([(3, "http://bad.com")], "page_id long, url string")), rules, redirects)
    assert {r["page_id"]: r["verdict"] for r in both.collect()} == {1: "block", 2: "allow", 3: "block"}
    assert uf.judge(pages.limit(0), rules, redirects).count() == 0
    assert uf.judge(pages, rules).count() == 2


CANONICAL = '<link rel="canonical" href="{}">'.format
REFRESH = '<meta http-equiv="refresh" content="0; url={}">'.format


def test_rules_of_targets_that_are_no_pages_count(spark):
    rules = [uf.Rule("block", "bad.com", "/"), uf.Rule("allow", "good.com", "/ok")]
    got = judged(spark, [
        page(1, "http://a.net/1", REFRESH("http://bad.com/de/x")), page(2, "http://b.net/2", CANONICAL("http://a.net/1")),
        page(3, "http://c.net/3", REFRESH("http://bad.com/y")), page(4, "http://d.net/4", CANONICAL("http://c.net/3") + REFRESH("http://good.com/ok")),
    ], rules)
    assert {i: v for i, (v, _) in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    pages = spark.createDataFrame([(1, "http://e.net/1")], "page_id long, url string")
    redirects = spark.createDataFrame([("http://e.net/1", "http://f.net/"), ("http://f.net", "http://bad.com/z")], "source string, target string")
    assert [r["verdict"] for r in uf.judge(pages, rules, redirects).collect()] == ["block"]
