"""The corpus queries with a twin give DuckDB's values."""

import pytest

from conftest import DATA
from lastleg.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_twin(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want


def test_url_twin_follows_links(spark, duck):
    """The given pages hold no links, so the twin is held against pages that do."""
    pages = [
        (1, "http://x.com/de/1", None), (2, "https://y.net/a?utm_x=1#f", '<link rel="canonical" href="http://www.x.com/de/1/">'),
        (3, "http://z.net/b/c", "<meta http-equiv=refresh content='0; url=../d'>"), (4, "http://z.net/b/../d", '<LINK HREF=//y.net/a rel=canonical>'),
        (5, "http://q.org/", '<link rel=canonical href="http://y.net/a">'), (6, None, None), (7, "http://w.net", '<link rel=canonical href="/de/1">'),
        (8, "http://two.net/a", '<link rel=canonical href="http://free.net/q"><p><link rel="canonical" href="http://d.com/de/9">'),
        (9, "http://far.net/", "<meta http-equiv=refresh content='0; url=http://example.com/de/x'><meta http-equiv=refresh content='1; url=/b'>"),
        (10, "http://far.net/b", None), (11, "http://one.net/", '<link rel=canonical href="http://n.com/de/1"><link rel=canonical href="http://n.org/">'),
    ]
    for rows in (pages, [p for p in pages if p[0] != 5]):
        duck.execute("CREATE OR REPLACE TABLE linked_pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        duck.executemany("INSERT INTO linked_pages VALUES (?, ?, ?)", rows)
        cursor = duck.execute(ORACLES["op3_urls"].replace("FROM pages", "FROM linked_pages"))
        names = [c[0] for c in cursor.description]
        from lastleg.llm import url_filter
        from lastleg.llm.queries import URL_RULES
        df = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES)
        want = sorted(map(repr, cursor.fetchall()))
        got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
        assert got == want
        verdicts = {r["page_id"]: r["verdict"] for r in df.collect()}
        assert verdicts[3] == ("allow" if len(rows) == len(pages) else "block")
        # a second tag counts, and so do links to pages that were not crawled
        assert verdicts[8] == verdicts[9] == verdicts[10] == "block" and verdicts[11] == "allow"
