"""Queries of composition inside repositories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composing as J
from ..sources import tables as G


def _s(x):
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def router_mounts(spark, sf):
    s = G.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    third, half = F.floor(F.col("k") / 3), F.floor(F.col("k") / 2)
    mounts = s.where(third > 0).select(_s("k").alias("child"), _s(third).alias("parent"), F.concat(F.lit("/p"), _s(F.col("k") % 5), F.lit("/")).alias("prefix"))
    mounts = mounts.unionByName(s.where(F.col("k") % 10 == 0).select(_s("k").alias("child"), _s(half).alias("parent"), F.concat(F.lit("/h"), _s(F.col("k") % 3)).alias("prefix")))
    loop = s.where("k = 1").select(F.lit("a").alias("child"), F.lit("b").alias("parent"), F.lit("/x").alias("prefix")).unionByName(s.where("k = 1").select(F.lit("b").alias("child"), F.lit("a").alias("parent"), F.lit("/y").alias("prefix")))
    providers = s.select(F.concat(F.lit("op"), _s("k")).alias("provider"), _s("k").alias("router"), F.lit("/r").alias("route")).unionByName(s.where("k = 1").select(F.lit("opa").alias("provider"), F.lit("a").alias("router"), F.lit("/r").alias("route")))
    return J.mounted_routes(providers, mounts.unionByName(loop))


def symbol_resolution(spark, sf):
    c = G.table(spark, sf, "customer")
    symbols = c.select(F.concat(F.lit("sym"), _s("c_custkey")).alias("symbol"), F.concat(F.lit("r"), _s(F.col("c_nationkey") % 3)).alias("repo_id"), F.concat(F.lit("m"), _s(F.col("c_custkey") % 7)).alias("module"), F.concat(F.lit("a"), _s(F.col("c_custkey") % 4), F.lit("/b"), _s(F.col("c_custkey") % 9), F.lit("/f"), _s(F.col("c_custkey") % 500)).alias("key"))
    o = G.table(spark, sf, "orders")
    k = F.col("o_custkey")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("a"), _s(k % 4), F.lit("/b"), _s(k % 9), F.lit("/f"), _s(k % 500))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("b"), _s(k % 9), F.lit("/f"), _s(k % 500))).otherwise(F.concat(F.lit("z/f"), _s(k % 500)))
    refs = o.select(F.concat(F.lit("ref"), _s("o_orderkey")).alias("reference"), F.concat(F.lit("r"), _s(F.col("o_orderkey") % 3)).alias("repo_id"), F.concat(F.lit("m"), _s(k % 7)).alias("module"), name.alias("name"))
    return J.resolved_symbols(refs, symbols).select("reference", "symbol")


def url_wrappers(spark, sf):
    p = G.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    part = lambda kind, text, idx: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), idx.cast("int").alias("idx"))
    none = F.lit(None)
    urls = p.select(F.concat(F.lit("f"), _s("k")).alias("function"), F.array(part("text", F.concat(F.lit("/api/"), _s("k"), F.lit("/")), none), part("param", none, F.lit(0)), part("text", F.lit("/end"), none)).alias("parts"))
    half = F.floor(F.col("k") / 2)
    args = F.when(F.col("k") % 3 == 0, F.array(part("text", F.concat(F.lit("v"), _s("k")), none))).when(F.col("k") % 5 == 0, F.array().cast(J.PART)).otherwise(F.array(part("param", none, F.lit(0))))
    calls = p.where(half > 0).select(F.concat(F.lit("f"), _s("k")).alias("caller"), F.concat(F.lit("f"), _s(half)).alias("callee"), args.alias("arguments"))
    return J.instantiated(urls, calls).select("function", J.literal(F.col("parts")).alias("url"))


def reached_consumers(spark, sf):
    p = G.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    half = F.floor(F.col("k") / 2)
    calls = p.where(half > 0).select(_s("k").alias("caller"), _s(half).alias("callee"))
    return J.reached(p.select(F.concat(F.lit("t"), _s("k")).alias("test"), _s("k").alias("function")), calls, p.select(_s("k").alias("function"), F.concat(F.lit("c"), _s("k")).alias("consumer")))


def infrastructure_dependencies(spark, sf):
    s, c = G.table(spark, sf, "supplier"), G.table(spark, sf, "customer")
    repo = lambda k: F.concat(F.lit("r"), _s(F.col(k) % 4))
    first = s.select(repo("s_suppkey").alias("repo_id"), F.concat(F.lit("n"), _s(F.col("s_suppkey") % 70)).alias("name"), F.concat(F.lit("unit"), _s("s_suppkey")).alias("id"))
    second = c.select(repo("c_custkey").alias("repo_id"), F.concat(F.lit("n"), _s(F.col("c_custkey") % 1250)).alias("name"), F.concat(F.lit("res"), _s("c_custkey")).alias("id"))
    refs = G.table(spark, sf, "part").select(F.concat(F.lit("ref"), _s("p_partkey")).alias("reference"), repo("p_partkey").alias("repo_id"), F.concat(F.lit("n"), _s(F.col("p_partkey") % 1260)).alias("name"))
    return J.prioritised(refs, first, second).select("reference", "target")


def document_references(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, ("service", "repository", "http"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    refs = G.table(spark, sf, "part").select(F.concat(F.lit("doc"), _s(F.col("p_partkey") % 90)).alias("document"), kinds.alias("ref_kind"), _s(F.col("p_partkey") % 130).alias("value"))
    s = G.table(spark, sf, "supplier")
    targets = s.select(F.explode(F.array(F.lit("service"), F.lit("repository"))).alias("ref_kind"), _s(F.col("s_suppkey") % 80).alias("value"), F.concat(F.lit("x"), _s("s_suppkey")).alias("id"))
    links, gaps = J.document_links(refs, targets)
    return links.unionByName(gaps.select("document", F.lit("gap").alias("kind"), F.col("value").alias("target")))


def environment_keys(spark, sf):
    keys = G.table(spark, sf, "customer").select(F.concat(F.lit("r"), _s(F.col("c_custkey") % 5)).alias("repo_id"), F.concat(F.lit("K"), _s(F.col("c_custkey") % 800)).alias("name"), F.concat(F.lit("cfg"), _s("c_custkey")).alias("id"))
    env = G.table(spark, sf, "part").select(F.concat(F.lit("u"), _s("p_partkey")).alias("unit"), F.concat(F.lit("r"), _s(F.col("p_partkey") % 5)).alias("repo_id"), F.concat(F.lit("K"), _s(F.col("p_partkey") % 1000)).alias("name"))
    return J.shared_keys(keys, env)


QUERIES = {f.__name__: f for f in (router_mounts, symbol_resolution, url_wrappers, reached_consumers, infrastructure_dependencies, document_references, environment_keys)}

ORACLE_SQL = {
    "router_mounts": """WITH RECURSIVE m AS (SELECT DISTINCT * FROM (SELECT s_suppkey AS c, s_suppkey // 3 AS p, '/p' || (s_suppkey % 5) AS x FROM supplier WHERE s_suppkey // 3 > 0 UNION ALL SELECT s_suppkey, s_suppkey // 2, '/h' || (s_suppkey % 3) FROM supplier WHERE s_suppkey % 10 = 0)),
w AS (SELECT c, p AS top, x, 1 AS d FROM m UNION ALL SELECT w.c, m.p, m.x || w.x, d + 1 FROM w JOIN m ON m.c = w.top WHERE d < 8),
f AS (SELECT DISTINCT c, x FROM w WHERE top NOT IN (SELECT c FROM m)), g AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY x) AS n FROM f)
SELECT 'op' || s_suppkey AS provider, coalesce(x, '') || '/r' AS route FROM supplier LEFT JOIN g ON c = s_suppkey AND n <= 16 UNION ALL SELECT 'opa', '/r'""",
    "symbol_resolution": """WITH s AS (SELECT 'sym' || c_custkey AS symbol, 'r' || (c_nationkey % 3) AS repo, 'm' || (c_custkey % 7) AS module, 'a' || (c_custkey % 4) || '/b' || (c_custkey % 9) || '/f' || (c_custkey % 500) AS key FROM customer),
r AS (SELECT 'ref' || o_orderkey AS reference, 'r' || (o_orderkey % 3) AS repo, 'm' || (o_custkey % 7) AS module, CASE o_orderkey % 4 WHEN 0 THEN 'a' || (o_custkey % 4) || '/b' || (o_custkey % 9) || '/f' || (o_custkey % 500) WHEN 2 THEN 'b' || (o_custkey % 9) || '/f' || (o_custkey % 500) ELSE 'z/f' || (o_custkey % 500) END AS name FROM orders),
l AS (SELECT reference, min(symbol) AS x FROM r JOIN s ON r.repo = s.repo AND r.module = s.module AND key = name GROUP BY 1 HAVING count(DISTINCT symbol) = 1),
t AS (SELECT reference, min(symbol) AS x FROM r JOIN s ON r.repo = s.repo AND ends_with('/' || key, '/' || name) GROUP BY 1 HAVING count(DISTINCT symbol) = 1),
e AS (SELECT reference, min(symbol) AS x FROM r JOIN s ON r.repo = s.repo AND regexp_extract(key, '[^/]+$') = regexp_extract(name, '[^/]+$') GROUP BY 1 HAVING count(DISTINCT symbol) = 1)
SELECT r.reference, coalesce(l.x, t.x, e.x) AS symbol FROM r LEFT JOIN l USING (reference) LEFT JOIN t USING (reference) LEFT JOIN e USING (reference)""",
    "url_wrappers": """WITH RECURSIVE c AS (SELECT p_partkey AS k, p_partkey // 2 AS callee, CASE WHEN p_partkey % 3 = 0 THEN 'v' || p_partkey WHEN p_partkey % 5 = 0 THEN '{}' END AS v FROM part WHERE p_partkey // 2 > 0),
o AS (SELECT p_partkey AS origin, p_partkey AS f, CAST(NULL AS VARCHAR) AS v, 0 AS hops FROM part UNION ALL SELECT origin, k, c.v, hops + 1 FROM o JOIN c ON c.callee = o.f WHERE o.v IS NULL AND hops < 3)
SELECT DISTINCT 'f' || f AS function, '/api/' || origin || '/' || v || '/end' AS url FROM o WHERE v IS NOT NULL""",
    "reached_consumers": """WITH RECURSIVE r AS (SELECT p_partkey AS t, p_partkey AS f, 0 AS d FROM part UNION ALL SELECT t, f // 2, d + 1 FROM r WHERE d < 3 AND f // 2 > 0)
SELECT 't' || t AS test, 'c' || f AS consumer, min(d) AS depth FROM r GROUP BY ALL""",
    "infrastructure_dependencies": """WITH f AS (SELECT 'r' || (s_suppkey % 4) AS repo, 'n' || (s_suppkey % 70) AS name, min('unit' || s_suppkey) AS id, count(*) AS n FROM supplier GROUP BY ALL),
s AS (SELECT 'r' || (c_custkey % 4) AS repo, 'n' || (c_custkey % 1250) AS name, min('res' || c_custkey) AS id, count(*) AS n FROM customer GROUP BY ALL)
SELECT 'ref' || p_partkey AS reference, CASE WHEN f.n = 1 THEN f.id WHEN f.n IS NULL AND s.n = 1 THEN s.id END AS target FROM part LEFT JOIN f ON f.repo = 'r' || (p_partkey % 4) AND f.name = 'n' || (p_partkey % 1260) LEFT JOIN s ON s.repo = 'r' || (p_partkey % 4) AND s.name = 'n' || (p_partkey % 1260)""",
    "document_references": """WITH r AS (SELECT DISTINCT 'doc' || (p_partkey % 90) AS document, ['service', 'repository', 'http'][CAST(p_partkey % 3 + 1 AS INT)] AS k, p_partkey % 130 AS v FROM part), t AS (SELECT s_suppkey % 80 AS v, min('x' || s_suppkey) AS id, count(*) AS n FROM supplier GROUP BY 1)
SELECT DISTINCT document, CASE k WHEN 'repository' THEN 'depends_on_repository' ELSE 'documents' END AS kind, id AS target FROM r JOIN t USING (v) WHERE n = 1 AND k <> 'http' UNION ALL SELECT document, 'gap', CAST(v AS VARCHAR) FROM r WHERE k = 'repository' AND v NOT IN (SELECT v FROM t)""",
    "environment_keys": """WITH k AS (SELECT 'r' || (c_custkey % 5) AS repo_id, 'K' || (c_custkey % 800) AS name, min('cfg' || c_custkey) AS id FROM customer GROUP BY ALL HAVING count(*) = 1)
SELECT 'u' || p_partkey AS unit, 'r' || (p_partkey % 5) AS repo_id, 'K' || (p_partkey % 1000) AS name, coalesce(id, 'config:r' || (p_partkey % 5) || ':environment:K' || (p_partkey % 1000)) AS key FROM part LEFT JOIN k ON k.repo_id = 'r' || (p_partkey % 5) AND k.name = 'K' || (p_partkey % 1000)""",
}
