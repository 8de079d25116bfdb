"""URL filtering with redirect equivalence.

A page is judged by the longest rule that fits its host and path. What no rule decides is decided
by its aliases: pages are connected by canonical links and redirects, found in their html or
given as a table, and a block anywhere in a connected component passes to all of it, unless some page of the
component is explicitly allowed; an own rule always comes first. Addresses that only links name, pages
that were not crawled, decide like all others. Without any decision a page is allowed.

A page is known by its address without scheme, fragment, trailing slash, ``www.`` or ``m.`` in front,
and tracking parameters (``utm_*``, ``ref``), since these lead to the same page; two pages with the
same address are aliases. Components are found by star contraction over stored tables, on edges
between different addresses alone.

Rules are a list in the program, each a column expression; up to some hundred make sense.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is allowed; a link to nowhere
or to the page itself is no edge; equal rows are judged alike; null page_ids are kept; an empty table gives no rows; a missing or null
html has no links; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.llm.graph import connected_components
from lastleg.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TRACKING = r"^(utm_[^=]*|ref)(=|$)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, action) of the longest rule that fits; null fields if none does."""
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The address a page is known by; null if the url has no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.split(F.substring(F.regexp_extract(url, _URL, 3), 2, 1 << 30), "&")
    kept = F.array_join(F.filter(query, lambda p: (p != "") & ~p.rlike(_TRACKING)), "&")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _absolute(link: Column, url: Column) -> Column:
    """A link made absolute: scheme-relative, host-relative and folder-relative ones too."""
    host = F.regexp_extract(url, _URL, 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    base = F.concat(F.lit("x://"), host)
    return (
        F.when(link.isNull() | (link == ""), None).when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link)).when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) urls of all canonical links and redirects in the pages' html."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")

    def named(tag: str, target: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, target, 1))

    targets = F.concat(named(_CANONICAL, _HREF), named(_REFRESH, _TARGET))
    links = pages.select(url.alias("url"), F.explode(targets).alias("link")).filter("link <> ''")
    return links.select(F.col("url").alias("source"), _absolute(F.col("link"), F.col("url")).alias("target"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias) of every page; ``redirects`` has columns source and target, as urls.

    ``alias`` is the smallest address of the page's component. Ends of links need not be pages: their rules count too.
    """
    url = F.col("url").cast("string")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    judged = stage(base.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules)), "judged")
    links = page_links(pages) if "html" in pages.columns else None
    if redirects is not None:
        given = redirects.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
        links = given if links is None else links.unionByName(given)
    if links is None:
        links = pages.select(url.alias("source"), url.alias("target")).limit(0)
    ends = [
        F.struct(address(F.col(c)).alias("address"), longest_rule(host_of(F.col(c)), path_of(F.col(c)), rules)["action"].alias("action")).alias(c)
        for c in ("source", "target")
    ]
    links = stage(links.select(*ends), "link_ends")
    edges = links.select(F.col("source.address").alias("source"), F.col("target.address").alias("target"))
    classes = stage(connected_components(edges, "source", "target"), "aliases")
    named = judged.join(classes, F.col("address") == F.col("node"), "left").withColumn("alias", F.coalesce("component", "address"))
    named = stage(named.select("page_id", "host", "path", "own", "alias"), "named")
    # an end with a rule may be no page at all, or differ from its page in what an address leaves out
    linked = links.select("source.*").unionByName(links.select("target.*")).filter("address IS NOT NULL AND action IS NOT NULL").distinct()
    linked = linked.join(classes, F.col("address") == F.col("node"), "left").select(F.coalesce("component", "address").alias("alias"), "action")
    known = named.select("alias", F.col("own.action").alias("action")).filter("action IS NOT NULL AND alias IS NOT NULL").unionByName(linked)
    decided = known.groupBy("alias").agg(F.min("action").alias("decision"))
    # "allow" comes before "block": the smallest action of a component gives allow precedence
    blocked = stage(decided.filter("decision = 'block'").select(F.col("alias").alias("blocked")), "blocked")
    open_pages = named.join(blocked, F.col("alias") == F.col("blocked"), "left")
    verdict = F.coalesce("own.action", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow"))
    return open_pages.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "alias")
