"""The registered queries of the corpus operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastleg.llm import (
    ann_forest, exact_dedup, fim, language_id, line_dedup, mixing, packing, pivot_index, sharded_lloyd, sharding, simhash, toxicity, url_filter,
)
from lastleg.llm.common import id_fold, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_fold(F.col("doc_id"), 4)
    predicted = language_id.predict(docs, language_id.fit(docs, fold != 2))
    return predicted.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


URL_RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(table(spark, sf_dir, "documents"), repetition_limit=1.5)
    return plan.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), "tokens", "epoch", "block", "mix_key")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = id_fold(F.col("doc_id"), 3) != 1
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return scored.select(
        F.col("d").alias("doc_id"), F.coalesce(id_fold(F.col("d"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("evidence.id").alias("neighbours"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset",
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["lo"], s["hi"])), ",")
    return done.select("doc_id", "text", F.coalesce(spans, F.lit("")).alias("removed"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivot_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)
    return found.withColumn("score", F.col("score").cast("long"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd.cluster(table(spark, sf_dir, "embeddings"), dimensions=64, k=40, rounds=5, scale=256, seed=2)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_urls": op3_urls,
    "op4_ann": op4_ann,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_topk": op10_topk,
    "op11_clustering": op11_clustering,
    "op12_fim": op12_fim,
    "op13_exact_dedup": op13_exact_dedup,
}

# A line goes if a window of 50 words or more around it, of shortest length, occurred before.
_LINE_DEDUP = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM docs),
lines AS (SELECT *, len(regexp_extract_all(line, '[^ \t\r]+')) AS words FROM split),
summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS upto, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS number
  FROM lines WHERE words > 0),
windows AS (
  SELECT doc_id, text, min(pos) OVER w AS lo, max(pos) OVER w AS hi, sum(words) OVER w AS n, list(trim(line)) OVER w AS content
  FROM summed WINDOW w AS (PARTITION BY doc_id, text ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, text, min(pos) OVER w, max(pos) OVER w, sum(words) OVER w, list(trim(line)) OVER w
  FROM summed WINDOW w AS (PARTITION BY doc_id, text ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, lo, hi) AS r FROM windows WHERE n >= 50),
hit AS (
  SELECT DISTINCT s.doc_id, s.text, s.pos, s.number FROM summed s
  JOIN ranked w ON s.doc_id = w.doc_id AND s.text = w.text AND s.pos BETWEEN w.lo AND w.hi WHERE w.r > 1),
islands AS (SELECT *, number - row_number() OVER (PARTITION BY doc_id, text ORDER BY number) AS g FROM hit),
spans AS (SELECT doc_id, text, g, min(pos) AS lo, max(pos) AS hi FROM islands GROUP BY 1, 2, 3),
gone AS (SELECT doc_id, text, unnest(range(lo, hi + 1)) AS pos FROM spans),
removed AS (SELECT doc_id, text, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed FROM spans GROUP BY 1, 2),
kept AS (
  SELECT s.doc_id, s.text, string_agg(s.line, chr(10) ORDER BY s.pos) AS rest FROM split s
  LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.text = g.text AND s.pos = g.pos WHERE g.pos IS NULL GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN r.removed IS NULL THEN d.text ELSE coalesce(k.rest, '') END AS text, coalesce(r.removed, '') AS removed
FROM documents d LEFT JOIN removed r ON d.doc_id = r.doc_id AND d.text = r.text
LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""

_TOPK = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# The same rules as literals; components by walking all edges.
_URLS = r"""
WITH RECURSIVE linked AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)))) AS link
  FROM pages),
absolute AS (
  SELECT url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'x:' || link
    WHEN starts_with(link, '/') THEN 'x://' || host || link
    ELSE 'x://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS link
  FROM (SELECT *, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host,
          regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM linked WHERE link <> '')),
parts AS (
  SELECT DISTINCT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_filter(string_split(substr(coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1), ''), 2), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')) AS query
  FROM (SELECT url FROM pages UNION SELECT link FROM absolute)),
known AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS address FROM parts),
edges AS (
  SELECT a.address AS a, b.address AS b FROM absolute x JOIN known a ON a.url = x.url JOIN known b ON b.url = x.link WHERE a.address <> b.address),
reached AS (
  SELECT a AS node, a AS seen FROM edges UNION SELECT b, b FROM edges
  UNION SELECT r.node, CASE WHEN e.a = r.seen THEN e.b ELSE e.a END FROM reached r JOIN edges e ON r.seen IN (e.a, e.b)),
classes AS (SELECT node, min(seen) AS component FROM reached GROUP BY node),
rules AS (FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(action, host, path)),
fitting AS (
  SELECT k.url, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY k.url ORDER BY length(r.host || r.path) DESC) AS n
  FROM known k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)),
judged AS (
  SELECT k.url, k.host, k.path, f.rule, f.action, coalesce(c.component, k.address) AS alias
  FROM known k LEFT JOIN fitting f ON f.url = k.url AND f.n = 1 LEFT JOIN classes c ON c.node = k.address)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule, coalesce(j.action, d.decision, 'allow') AS verdict, j.alias
FROM pages p LEFT JOIN judged j ON j.url = p.url LEFT JOIN (SELECT alias, min(action) AS decision FROM judged GROUP BY alias) d ON d.alias = j.alias
"""



def _lloyd(k: int = 40, rounds: int = 5) -> str:
    """Every round written out, over one row for each component."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(64)) AS i FROM kept),
start AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c FROM kept ORDER BY c LIMIT {k}),
centroids0 AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range(64)) AS i FROM start)"""]
    for n in range(rounds + 1):
        steps.append(f"""
near{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts JOIN centroids{n} USING (i) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
means{n} AS (SELECT n.best.c AS c, i, sum(x) AS s, count(*) AS m FROM parts p JOIN near{n} n USING (r) GROUP BY 1, 2),
centroids{n + 1} AS MATERIALIZED (
  SELECT o.c, o.i, CASE WHEN m IS NULL THEN y ELSE CAST((s - ((s % m) + m) % m) // m AS BIGINT) END AS y
  FROM centroids{n} o LEFT JOIN means{n} e ON e.c = o.c AND e.i = o.i)""")
    steps.append(f"""
named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centroids{rounds} GROUP BY c)""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN near{rounds} USING (r) JOIN named ON named.c = best.c
"""


_FIM = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS lines,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS r2,
    CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM split),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(lines[1:least(r1, r2)], '') AS p, array_to_string(lines[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
    array_to_string(lines[greatest(r1, r2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM formed
"""

_EXACT = r"""
WITH bare AS (
  SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g') AS t FROM documents),
placed AS (
  SELECT *, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, r) AS place,
    first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, r) AS keep_id FROM bare)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM placed
"""

ORACLES = {
    "op3_urls": _URLS, "op8_line_dedup": _LINE_DEDUP, "op10_topk": _TOPK, "op11_clustering": _lloyd(), "op12_fim": _FIM, "op13_exact_dedup": _EXACT,
}
