"""Queries of the graph build, stored snapshots, and what change analysis sums up, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import building as B
from ..operators import changes as H
from ..operators import communities as C
from ..operators import impact as P
from ..operators import linking as L
from ..sources import snapshots as N
from ..sources import tables as G
from ..sources.shared import new_path


def _s(x):
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _key(prefix, x):
    return F.concat(F.lit(prefix), _s(x))


def _pick(names, x):
    return F.element_at(F.array(*map(F.lit, names)), (x % len(names) + 1).cast("int"))


def _flat(edges):
    return edges.select("id", "kind", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), "status", F.array_join("evidence", ",").alias("evidence"))


def build_http_edges(spark, sf):
    """Every line is a use of its order's operation: by a client, a test, or the handler; equal ones merge."""
    line = G.table(spark, sf, "lineitem")
    pct = lambda c: (100 - F.round(F.col(c) * 100)) / 100
    return _flat(B.http_edges(line.select(
        _key("part:", "l_partkey").alias("call"), _key("order:", "l_orderkey").alias("provider"), _pick(("client", "test", "handler", "other"), F.col("l_linenumber")).alias("role"), pct("l_discount").alias("call_confidence"),
        pct("l_tax").alias("provider_confidence"), F.array(_key("ev:", "l_suppkey")).alias("evidence"))))


def build_resolver_edges(spark, sf):
    c, o = G.table(spark, sf, "customer"), G.table(spark, sf, "orders")
    resolvers = c.select(_key("symbol:", "c_custkey").alias("resolver"), _key("r", F.col("c_custkey") % 5).alias("repo_id"), _key("Query.f", F.col("c_custkey") % 400).alias("coordinate"), F.array(_key("ev:", "c_custkey")).alias("evidence"))
    providers = o.select(_key("gql:", "o_orderkey").alias("provider"), _key("r", F.col("o_orderkey") % 5).alias("repo_id"), _key("Query.f", F.col("o_orderkey") * 7 % 450).alias("coordinate"), F.col("o_orderkey").alias("seq"))
    return _flat(B.resolver_edges(resolvers, providers))


def build_rpc_edges(spark, sf):
    p, s = G.table(spark, sf, "part"), G.table(spark, sf, "supplier")
    markers = p.select(_key("marker:", "p_partkey").alias("marker"), _pick(("client", "server", "unknown"), F.col("p_partkey")).alias("role"), _key("S", F.col("p_partkey") % 25).alias("service"), _key("M", F.col("p_partkey") % 40).alias("method"), F.array(_key("ev:", "p_partkey")).alias("evidence"))
    methods = s.select(_key("rpc:", "s_suppkey").alias("id"), _key("S", "s_nationkey").alias("service"), _key("M", F.col("s_suppkey") % 40).alias("method"))
    return _flat(B.rpc_edges(markers, methods))


def build_event_edges(spark, sf):
    e = G.table(spark, sf, "events")
    ends = e.select(
        _key("user:", "user_id").alias("node"), _key("file:", F.col("event_id") % 300).alias("artifact"), F.concat(F.lit("channel:"), "event_type").alias("channel"), _pick(("publisher", "subscriber", "declaration"), F.col("event_id")).alias("role"),
        F.when(F.col("event_id") % 9 == 2, F.concat(F.lit("channel:"), "event_type", F.lit(".dead"))).alias("dead_letter"), F.array(_key("ev:", F.col("event_id") % 50)).alias("evidence"))
    schemas = e.select(F.concat(F.lit("channel:"), "event_type").alias("channel"), F.concat(F.lit("schema:"), "event_type", _s(F.col("event_id") % 3)).alias("schema"), F.array(F.lit("ev:s")).alias("evidence"))
    return _flat(B.event_edges(ends, schemas))


def build_package_edges(spark, sf):
    line = G.table(spark, sf, "lineitem")
    return _flat(B.package_edges(line.select(
        _key("manifest:", "l_suppkey").alias("manifest"), _key("package:", "l_suppkey").alias("package"), _key("part:", "l_partkey").alias("dependency"), ((100 - F.round(F.col("l_discount") * 100)) / 100).alias("confidence"), F.array(_key("ev:", "l_linenumber")).alias("evidence"))))


def build_data_edges(spark, sf):
    o, c = G.table(spark, sf, "orders"), G.table(spark, sf, "customer")
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 2 == 0, _key("T", F.col("o_custkey") % 900)).otherwise(_key("t", F.col("o_custkey") % 900))
    accesses = o.select(_key("symbol:", F.col("o_custkey")).alias("symbol"), _pick(("reader", "writer", "model_binding", "declaration", "reader"), k).alias("role"), name.alias("table_name"), F.when(k % 7 < 3, _key("Model", F.col("o_custkey") % 900)).alias("model"), F.array(_key("ev:", k % 20)).alias("evidence"))
    tables = c.select(_key("table:", "c_custkey").alias("id"), _key("t", F.col("c_custkey") % 1200).alias("alias"))
    return _flat(B.data_edges(accesses, tables))


def build_owners(spark, sf):
    c = G.table(spark, sf, "customer")
    rules = c.select(_key("doc:", F.col("c_nationkey")).alias("document"), F.array(_key("@Team", F.col("c_custkey") % 30), _key("@team", F.col("c_custkey") % 7)).alias("owners"), F.array(_key("ev:", F.col("c_custkey") % 9)).alias("evidence"))
    nodes, edges = B.owners(rules)
    return nodes.select("stable_key", "label").join(edges.join(nodes.select(F.col("id").alias("target"), "stable_key"), "target").groupBy("stable_key").agg(F.count("*").alias("documents")), "stable_key")


def corroborated_edges(spark, sf):
    e = G.edges(spark, sf, ("calls_remote", "consumes")).withColumn("kind", F.when(F.col("kind") == "consumes", "implemented_by").otherwise(F.col("kind")))
    found = G.table(spark, sf, "orders").select(_key("customer:", "o_custkey").alias("source"), _key("order:", "o_orderkey").alias("target"), F.explode(F.array(F.lit("ext:b"), F.lit("ext:a"))).alias("evidence_id"))
    found = found.unionByName(G.table(spark, sf, "lineitem").select(_key("order:", "l_orderkey").alias("source"), _key("supplier:", "l_suppkey").alias("target"), F.lit("ext:c").alias("evidence_id")))
    return _flat(B.corroborated(e, found))


def _built(spark, sf):
    """Two families of nodes and of edges; of the second family, edges to customers are repeated with another confidence, and lose."""
    nodes, edges = G.nodes(spark, sf, ("service", "symbol_ref", "http_operation", "repository", "owner")), G.edges(spark, sf, ("consumes", "contains", "calls_remote", "owned_by"))
    more = edges.where("kind = 'contains'").withColumn("confidence", F.lit(0.5).cast("float"))
    return B.graph([nodes, nodes.where("kind = 'owner'").withColumn("label", F.lower("label"))], [edges, more], G.evidence(spark, sf))


def build_graph(spark, sf):
    nodes, edges, problems = _built(spark, sf)
    n = nodes.groupBy("kind").agg(F.count("*").alias("n"), F.min("label").alias("first")).select(F.lit("node").alias("what"), "kind", "n", "first")
    e = edges.groupBy("kind").agg(F.count("*").alias("n"), F.min("confidence").cast("string").alias("first")).select(F.lit("edge").alias("what"), "kind", "n", "first")
    return n.unionByName(e).unionByName(problems.groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first")).select(F.lit("problem").alias("what"), F.col("problem").alias("kind"), "n", "first"))


def snapshot_scan(spark, sf):
    """Nodes of two kinds, read from a snapshot that was published, saved and restored."""
    root = new_path(spark, "store")
    nodes, edges = G.nodes(spark, sf), G.edges(spark, sf)
    N.publish(spark, root, "s1", nodes.where("kind = 'owner'"), edges.limit(0), G.evidence(spark, sf).limit(0))
    N.publish(spark, root, "s2", nodes, edges, G.evidence(spark, sf), expected="s1")
    N.backup(spark, root, f"{root}-saved")
    N.restore(spark, f"{root}-saved", root)
    return N.scan(spark, root, "nodes", ("service", "package"))


def snapshot_integrity(spark, sf):
    root = new_path(spark, "store")
    N.publish(spark, root, "s1", G.nodes(spark, sf), G.edges(spark, sf), G.evidence(spark, sf))
    return N.integrity(spark, root)


def query_cache_get(spark, sf):
    e = G.table(spark, sf, "events").select(_key("w", F.col("user_id") % 5).alias("workspace_id"), _key("k", F.col("event_id") % 40).alias("key"), _s("event_id").alias("value"), F.unix_timestamp("ts").alias("stored_at"))
    now = e.agg(F.max("stored_at")).first()[0] - 86_400
    return N.cached(e, "w2", "k7", now, 30 * 86_400)


def impact_page(spark, sf):
    from .graph import _items

    items = P.page(_items(spark, sf), 10, 25)
    return items.select("id", "classification", "depth", "repo_id", "stable_key")


def boundary_impacts(spark, sf):
    """Services that change: what calls them, and what consumes that; each way counted once at its nearest."""
    changed = G.nodes(spark, sf, ("service",)).select("id")
    return H.boundary_impacts(changed, G.edges(spark, sf, ("calls_remote", "consumes", "owned_by")), 2).groupBy("boundary", "depth").agg(F.count("*").alias("n"))


def change_summary(spark, sf):
    entities, contracts = G.nodes(spark, sf, ("symbol_ref",)), G.nodes(spark, sf, ("package",))
    risks = G.table(spark, sf, "supplier").select(_pick(("low", "high", "medium"), F.col("s_suppkey")).alias("risk"))
    done = H.summary(True, entities, contracts, risks).withColumn("complete", F.lit(True))
    return done.unionByName(H.summary(False, entities, contracts, risks).withColumn("complete", F.lit(False))).unionByName(H.summary(True, entities.limit(0), contracts.limit(0), risks.limit(0)).withColumn("complete", F.lit(True)))


def freshness_for_change(spark, sf):
    k = F.col("n_nationkey")
    f = G.table(spark, sf, "nation").select(_key("r", k % 3).alias("repo_id"), _key("c", k % 5).alias("checkout_id"), _key("h", k % 2).alias("head_commit"), _key("m", k % 7).alias("manifest_hash"), _s(k).alias("n"), F.lit("fresh").alias("state"))
    return H.freshness_for({"repo_id": "r1", "checkout_id": "c1", "head": "h1", "manifest_hash": "m1"}, f)


def community_ids(spark, sf):
    """Two partitions with the same members under other names have the same ids."""
    m = G.memberships(spark, sf)
    a, b = C.community_ids(m), C.community_ids(m.withColumn("community_id", F.concat(F.lit("x"), "community_id")))
    return a.join(b.withColumnRenamed("community_id", "other"), "id").select("community_id", "other", F.length("id").alias("length"))


def gaps_of_hits(spark, sf):
    from .linking import _providers, _resolved

    gaps = L.link_gaps(L.resolved_calls(_resolved(spark, sf), _providers(spark), []))
    return L.gaps_of(gaps, G.table(spark, sf, "pages").where("html like '%footer%'").select(_s("page_id").alias("id"))).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    build_http_edges, build_resolver_edges, build_rpc_edges, build_event_edges, build_package_edges, build_data_edges, build_owners, corroborated_edges, build_graph, snapshot_scan, snapshot_integrity, query_cache_get, impact_page,
    boundary_impacts, change_summary, freshness_for_change, community_ids, gaps_of_hits)}


def _merged(rows: str) -> str:
    """Merged edges of rows(s, k, t, c, ev)."""
    return f"SELECT s || '>' || k || '>' || t AS id, k AS kind, round(CAST(max(c) AS DOUBLE), 6) AS confidence, CASE WHEN max(c) >= 1 THEN 'confirmed' ELSE 'inferred' END AS status, string_agg(DISTINCT ev, ',' ORDER BY ev) AS evidence FROM ({rows}) WHERE s IS NOT NULL AND t IS NOT NULL AND k IS NOT NULL GROUP BY s, k, t"


def _oracles() -> dict[str, str]:
    from .graph import _IMPACT
    from .linking import _RESOLVED

    return {
        "build_http_edges": _merged("""SELECT CASE WHEN r = 2 THEN o ELSE p END AS s, ['calls_remote', 'validates', 'implemented_by', NULL][CAST(r + 1 AS INT)] AS k, CASE WHEN r = 2 THEN p ELSE o END AS t, least(a, b) AS c, ev FROM (
  SELECT 'part:' || l_partkey AS p, 'order:' || l_orderkey AS o, l_linenumber % 4 AS r, CAST((100 - round(l_discount * 100)) / 100 AS FLOAT) AS a, CAST((100 - round(l_tax * 100)) / 100 AS FLOAT) AS b, 'ev:' || l_suppkey AS ev FROM lineitem)"""),
        "build_resolver_edges": """WITH p AS (SELECT o_orderkey % 5 AS r, o_orderkey * 7 % 450 AS f, min(o_orderkey) AS k FROM orders GROUP BY ALL) """ + _merged("SELECT 'gql:' || k AS s, 'implemented_by' AS k, 'symbol:' || c_custkey AS t, 1.0 AS c, 'ev:' || c_custkey AS ev FROM customer JOIN p ON r = c_custkey % 5 AND f = c_custkey % 400"),
        "build_rpc_edges": """WITH m AS (SELECT s_nationkey AS sv, s_suppkey % 40 AS me, min(s_suppkey) AS k FROM supplier GROUP BY ALL HAVING count(*) = 1), h AS (SELECT p_partkey AS p, k, p_partkey % 3 AS r FROM part JOIN m ON sv = p_partkey % 25 AND me = p_partkey % 40) """
        + _merged("SELECT CASE r WHEN 1 THEN 'rpc:' || k ELSE 'marker:' || p END AS s, CASE r WHEN 0 THEN 'calls_remote' WHEN 1 THEN 'implemented_by' END AS k, CASE r WHEN 1 THEN 'marker:' || p ELSE 'rpc:' || h.k END AS t, 1.0 AS c, 'ev:' || p AS ev FROM h"),
        "build_event_edges": "WITH e AS (SELECT *, event_id % 3 AS r, 'channel:' || event_type AS ch, 'ev:' || (event_id % 50) AS ev FROM events) " + _merged("""SELECT 'user:' || user_id AS s, CASE r WHEN 0 THEN 'publishes' WHEN 1 THEN 'subscribes' END AS k, ch AS t, 1.0 AS c, ev FROM e
  UNION ALL SELECT ch, 'delivers_to', 'user:' || user_id, 1.0, ev FROM e WHERE r = 1 UNION ALL SELECT 'file:' || (event_id % 300), 'contains', ch, 1.0, ev FROM e WHERE r = 2
  UNION ALL SELECT ch, 'calls_remote', ch || '.dead', 1.0, ev FROM e WHERE event_id % 9 = 2 UNION ALL SELECT ch, 'contains', 'schema:' || event_type || (event_id % 3), 1.0, 'ev:s' FROM e"""),
        "build_package_edges": "WITH l AS (SELECT l_suppkey AS s, l_partkey AS p, CAST((100 - round(l_discount * 100)) / 100 AS FLOAT) AS c, 'ev:' || l_linenumber AS ev FROM lineitem) " + _merged(
            "SELECT 'manifest:' || l.s AS s, 'contains' AS k, 'package:' || l.s AS t, c, ev FROM l UNION ALL SELECT 'package:' || l.s, 'depends_on_package', 'part:' || p, c, ev FROM l"),
        "build_data_edges": """WITH a AS (SELECT 'symbol:' || o_custkey AS sy, o_orderkey % 5 AS r, CASE WHEN o_orderkey % 3 <> 0 THEN 't' || (o_custkey % 900) END AS n, CASE WHEN o_orderkey % 7 < 3 THEN o_custkey % 900 END AS m, 'ev:' || (o_orderkey % 20) AS ev FROM orders),
b AS (SELECT m, min(n) AS bound FROM a WHERE r = 2 AND n IS NOT NULL AND m IS NOT NULL GROUP BY m HAVING count(DISTINCT n) = 1), t AS (SELECT 't' || (c_custkey % 1200) AS n, min('table:' || c_custkey) AS id FROM customer GROUP BY 1 HAVING count(*) = 1),
h AS (SELECT a.*, t.id FROM a LEFT JOIN b USING (m) JOIN t ON t.n = coalesce(a.n, bound)) """ + _merged("SELECT CASE r WHEN 2 THEN id ELSE sy END AS s, CASE r WHEN 0 THEN 'reads_table' WHEN 4 THEN 'reads_table' WHEN 1 THEN 'writes_table' WHEN 2 THEN 'implemented_by' END AS k, CASE r WHEN 2 THEN sy ELSE id END AS t, 1.0 AS c, ev FROM h"),
        "build_owners": """WITH r AS (SELECT c_nationkey AS d, unnest(['@Team' || (c_custkey % 30), '@team' || (c_custkey % 7)]) AS o FROM customer) SELECT 'owner:' || lower(o) AS stable_key, min(o) AS label, count(DISTINCT d) AS documents FROM r GROUP BY 1""",
        "corroborated_edges": f"""WITH {G.GRAPH} SELECT source || '>' || kind || '>' || target AS id, CASE kind WHEN 'consumes' THEN 'implemented_by' ELSE kind END AS kind, round(CAST(confidence AS DOUBLE), 6) AS confidence, status,
  evidence || CASE kind WHEN 'consumes' THEN ',ext:a,ext:b' ELSE '' END AS evidence FROM edges WHERE kind IN ('calls_remote', 'consumes')""",
        "build_graph": f"""WITH {G.GRAPH}, n AS (SELECT kind, CASE kind WHEN 'owner' THEN lower(label) ELSE label END AS label FROM nodes WHERE kind NOT IN ('package', 'document')), e AS (SELECT * FROM edges WHERE kind <> 'depends_on_package')
SELECT 'node' AS what, kind, count(*) AS n, min(label) AS first FROM n GROUP BY kind UNION ALL SELECT 'edge', kind, count(*), CAST(min(confidence) AS VARCHAR) FROM e GROUP BY kind
UNION ALL SELECT 'problem', 'missing_evidence', count(*), min(id) FROM e WHERE kind <> 'consumes'""",
        "snapshot_scan": f"WITH {G.GRAPH} SELECT * FROM nodes WHERE kind IN ('service', 'package')",
        "snapshot_integrity": f"""WITH {G.GRAPH} SELECT 'nodes' AS "table", count(*) AS rows, count(*) AS expected_rows, true AS ok FROM nodes UNION ALL SELECT 'edges', count(*), count(*), true FROM edges UNION ALL SELECT 'evidence', count(*), count(*), true FROM evidence""",
        "query_cache_get": """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS value, CAST(floor(epoch(ts)) AS BIGINT) AS stored_at, user_id % 5 = 2 AND event_id % 40 = 7 AS own FROM events), n AS (SELECT max(stored_at) - 86400 AS t FROM e)
SELECT value, stored_at FROM e, n WHERE own AND t - stored_at < 2592000 AND stored_at <= t ORDER BY stored_at DESC, value LIMIT 1""",
        "impact_page": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT} SELECT id, classification, depth, repo_id, stable_key FROM items ORDER BY c, depth, repo_id NULLS FIRST, stable_key, id LIMIT 25 OFFSET 10",
        "boundary_impacts": f"""WITH {G.GRAPH}, b AS (SELECT id FROM nodes WHERE kind = 'service' ORDER BY id LIMIT 1000), one AS (SELECT DISTINCT target AS boundary, source AS node FROM edges JOIN b ON b.id = target WHERE kind = 'calls_remote' AND status = 'confirmed'),
two AS (SELECT DISTINCT boundary, source AS node FROM one JOIN edges ON target = node WHERE kind = 'consumes') SELECT boundary, 1 AS depth, count(*) AS n FROM one GROUP BY boundary UNION ALL SELECT boundary, 2, count(*) FROM two GROUP BY boundary""",
        "change_summary": """WITH c AS (SELECT (SELECT count(*) FROM customer) AS e, (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM supplier) AS s)
SELECT 'impact_detected' AS conclusion, 'high' AS highest_risk, e AS changed_entities, p AS changed_contracts, s AS impact_reports, true AS complete FROM c UNION ALL SELECT 'unknown', 'unknown', e, p, s, false FROM c UNION ALL SELECT 'no_semantic_impact_detected', 'low', 0, 0, 0, true""",
        "freshness_for_change": """SELECT 'r' || (k % 3) AS repo_id, 'c' || (k % 5) AS checkout_id, 'h' || (k % 2) AS head_commit, 'm' || (k % 7) AS manifest_hash, CAST(k AS VARCHAR) AS n,
  CASE WHEN k % 3 <> 1 THEN 'fresh' WHEN k % 5 <> 1 THEN 'unknown' WHEN k % 2 <> 1 THEN 'commits_behind' WHEN k % 7 <> 1 THEN 'config_changed' ELSE 'fresh' END AS state FROM (SELECT n_nationkey AS k FROM nation)""",
        "community_ids": f"WITH {G.GRAPH} SELECT DISTINCT community_id, 'x' || community_id AS other, 74 AS length FROM memberships",
        "gaps_of_hits": f"WITH {_RESOLVED} SELECT outcome AS reason, count(*) AS n FROM res JOIN pages ON CAST(page_id AS VARCHAR) = call WHERE outcome <> 'linked' AND html LIKE '%footer%' GROUP BY 1",
    }


ORACLE_SQL = _oracles()
