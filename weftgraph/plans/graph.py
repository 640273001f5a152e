"""Queries of traversal, impact, risk and communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as C
from ..operators import impact as P
from ..operators import search as S
from ..operators import traverse as T
from ..sources import tables as G

START, SUPPLIER = "customer:1", "supplier:7"


def _s(x):
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _spine(spark, sf):
    return G.nodes(spark, sf, ("symbol_ref", "http_operation", "service", "owner")), G.edges(spark, sf, ("consumes", "calls_remote", "owned_by"))


def _paths(spark, sf, **more):
    nodes, edges = _spine(spark, sf)
    return T.paths(nodes, edges, START, max_depth=3, max_cross=16, **more)


def trace_shortest(spark, sf):
    _, edges = _spine(spark, sf)
    return T.trace(edges.where(f"kind <> 'owned_by' or source not like 'customer:%'"), START, "region:1", 8)


def traverse_bfs(spark, sf):
    return T.shortest(_paths(spark, sf, only="shortest")).select("node", "depth", "cross", F.array_join("edge_ids", "|").alias("edge_ids"))


def traverse_dijkstra(spark, sf):
    return T.k_best(_paths(spark, sf, costs={"calls_remote": 2.0, "owned_by": 0.5}, only="lightest"), 1).select("node", "depth", F.round("weight", 6).alias("weight"), F.array_join("edge_ids", "|").alias("edge_ids"))


def k_shortest_paths(spark, sf):
    return T.k_best(_paths(spark, sf, min_confidence=0.6), 4).select("node", "place", "depth", F.round("weight", 6).alias("weight"), F.array_join("edge_ids", "|").alias("edge_ids"))


def traverse_candidates(spark, sf):
    """Edges that a traversal from the first hundred customers reports, but does not walk."""
    _, edges = _spine(spark, sf)
    return T.split_edges(edges, ("calls_remote",), 0.55)[1].groupBy("status").agg(F.count("*").alias("edges"))


def reachable_frontier(spark, sf):
    return T.deepest_layer(_paths(spark, sf, only="shortest"))


def repository_ownership_closure(spark, sf):
    e = G.edges(spark, sf, ("contains", "consumes", "calls_remote")).where("status = 'confirmed'")
    contains = e.select(F.col("source").alias("parent"), F.col("target").alias("child"))
    owned = G.nodes(spark, sf, ("repository",)).select(F.col("id").alias("node"), "repo_id")
    return T.ownership(contains.where("child not like 'supplier:%' or parent like 'nation:%'"), owned)


# --- impact ---------------------------------------------------------------------------------------------------------


def _items(spark, sf):
    nodes = G.nodes(spark, sf, ("symbol_ref", "http_operation", "service", "repository"))
    return P.impact(nodes, G.edges(spark, sf, ("consumes", "calls_remote", "contains", "owned_by")), SUPPLIER, direction="upstream", max_depth=4)


def _tests(spark, sf):
    d = G.table(spark, sf, "documents")
    id_ = F.concat(F.lit("test:"), _s("doc_id"))
    nodes = d.select(id_.alias("id"), F.lit("test_case").alias("kind"), F.col("source").alias("repo_id"), F.concat(F.lit("test:"), "source", F.lit(":"), _s("doc_id")).alias("stable_key"), F.concat(F.lit("tests/t"), _s("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".rs")).alias("label"))
    edges = d.select(id_.alias("source"), F.concat(F.lit("order:"), _s(F.col("doc_id") * 13 % 997)).alias("target"), F.lit("validates").alias("kind"))
    return nodes, edges


def impact_items(spark, sf):
    return _items(spark, sf).select("id", "kind", "repo_id", "classification", "depth")


def impact_by_repository(spark, sf):
    return P.by_repository(_items(spark, sf))


def impact_by_service(spark, sf):
    members = S.service_memberships(G.nodes(spark, sf, ("service",)), G.edges(spark, sf, ("calls_remote",)))
    return P.by_group(_items(spark, sf), members, "service_id")


def impact_by_community(spark, sf):
    return P.by_group(_items(spark, sf), G.memberships(spark, sf), "community_id")


def impact_depth_buckets(spark, sf):
    return P.depth_buckets(_items(spark, sf))


def impact_contracts(spark, sf):
    return P.by_contract(_items(spark, sf))


def impact_tests(spark, sf):
    nodes, edges = _tests(spark, sf)
    owned = nodes.where("label like '%.py'").select(F.col("id").alias("source"), F.concat(F.lit("owner:"), "repo_id").alias("target"), F.lit("owned_by").alias("kind"))
    return P.tests(_items(spark, sf), edges.unionByName(owned), nodes).withColumn("owners", F.array_join("owners", ","))


def impact_coverage(spark, sf):
    """The target's repository counts; one nation's freshness is not known."""
    out = P.coverage(_items(spark, sf), G.freshness(spark, sf).where("repo_id <> 'nation-4'"), "nation-99", possible_edges=1)
    return out.withColumn("gaps", F.array_join("gaps", ","))


def _tags(spark):
    """The changed service is tagged with and without evidence; a node that is not reached counts for nothing."""
    return spark.createDataFrame([(SUPPLIER, "payment", []), (SUPPLIER, "authentication", ["policy"]), ("nowhere:1", "security", ["policy"])], "node_id string, tag string, evidence array<string>")


def risk_factors(spark, sf):
    items = _items(spark, sf)
    nodes, edges = _tests(spark, sf)
    return P.risk_factors(items, "nation-0", services=items.where("kind = 'service'").select(F.col("id").alias("service_id")), n_tests=P.tests(items, edges, nodes).count(), n_owners=0, environments=2, public=1, target_id=SUPPLIER, tags=_tags(spark)).withColumn("weight", F.round("weight", 6))


def risk_score(spark, sf):
    return P.risk_score(risk_factors(spark, sf), True).withColumn("score", F.round("score", 6))


def risk_unknown(spark, sf):
    """Stale repositories take the number away."""
    return P.risk_score(risk_factors(spark, sf), False)


def worst_freshness(spark, sf):
    e = G.table(spark, sf, "events")
    state = F.element_at(F.array(*map(F.lit, ("fresh", "commits_behind", "partial", "unavailable"))), (F.col("event_id") * 7 % 4 + 1).cast("int"))
    rows = e.select(F.concat(F.lit("nation-"), _s(F.col("user_id") % 25)).alias("repo_id"), state.alias("state"), F.col("event_id").alias("seq"))
    return P.worst_freshness(rows, F.array_position(F.array(*map(F.lit, ("fresh", "commits_behind", "partial", "unavailable"))), F.col("state")))


# --- communities ----------------------------------------------------------------------------------------------------


_KINDS = ("repository", "owner", "service", "symbol_ref", "http_operation", "package")


def _whole(spark, sf):
    return G.nodes(spark, sf, _KINDS), G.edges(spark, sf)


def _members(spark, sf):
    return G.memberships(spark, sf)


def community_edges(spark, sf):
    return C.undirected(C.accepted_edges(_whole(spark, sf)[1], 0.5, {"contains": 0.4})).withColumn("weight", F.round("weight", 6))


def connected_components(spark, sf):
    nodes, edges = _whole(spark, sf)
    return C.connected_components(nodes, C.accepted_edges(edges, 0.8))


def community_metrics(spark, sf):
    nodes, edges = _whole(spark, sf)
    return C.metrics(_members(spark, sf), C.accepted_edges(edges, 0.5), nodes)


def god_nodes(spark, sf):
    """Over a star: a workspace that is tied to every customer, and the customers' owners beside it."""
    star = G.table(spark, sf, "customer").select(F.lit("workspace:1").alias("source"), F.concat(F.lit("customer:"), _s("c_custkey")).alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).cast("float").alias("confidence"), F.lit("confirmed").alias("status"))
    e = star.unionByName(G.edges(spark, sf, ("owned_by",)).where("source like 'customer:%'").select(star.columns))
    ids = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return C.god_nodes(ids, C.accepted_edges(e))


def pagerank_64(spark, sf):
    nodes, edges = _whole(spark, sf)
    return C.page_rank(nodes, C.accepted_edges(edges, 0.5))


def _central(spark, sf):
    nodes, edges = _whole(spark, sf)
    a = C.accepted_edges(edges, 0.5)
    degree = C.degrees(a)
    ranks = degree.select("node", (1.0 / (F.length("node") + F.col("degree"))).alias("rank"))
    weights = C.weighted_degrees(C.undirected(a))
    return C.central_nodes(_members(spark, sf), ranks, weights, degree.where("degree >= 30").select("node"))


def central_nodes_top3(spark, sf):
    return _central(spark, sf)


def community_labels(spark, sf):
    return C.labels(_members(spark, sf), _whole(spark, sf)[0], _central(spark, sf))


def community_delta(spark, sf):
    before = _members(spark, sf)
    k = F.regexp_extract("node_id", "[0-9]+$", 0).cast("long")
    after = before.select(F.when(F.col("community_id") == "community:1-0", F.concat(F.lit("split-"), _s(k % 4))).when(F.col("community_id").startswith("community:2"), "joined").when(k % 9 == 0, F.concat(F.lit("new-"), _s(k % 2))).otherwise(F.col("community_id")).alias("community_id"), "node_id")
    out = C.delta(before, after)
    return out.select("change", F.array_join("before", ",").alias("before_ids"), F.array_join("after", ",").alias("after_ids"), F.round("overlap", 6).alias("overlap"))


def louvain(spark, sf):
    nodes, edges = _whole(spark, sf)
    return C.louvain(nodes, C.accepted_edges(edges, 0.5))


def label_propagation(spark, sf):
    nodes, edges = _whole(spark, sf)
    return C.label_propagation(nodes, C.accepted_edges(edges, 0.5))


def community_list(spark, sf):
    return C.listed(community_metrics(spark, sf).select("community_id", "size", "cohesion"), 0, 5)


QUERIES = {f.__name__: f for f in (
    trace_shortest, traverse_bfs, traverse_dijkstra, k_shortest_paths, traverse_candidates, reachable_frontier, repository_ownership_closure, impact_items, impact_by_repository, impact_by_service,
    impact_by_community, impact_depth_buckets, impact_contracts, impact_tests, impact_coverage, risk_factors, risk_score, risk_unknown, worst_freshness, community_edges, connected_components,
    community_metrics, god_nodes, pagerank_64, central_nodes_top3, community_labels, community_delta, louvain, label_propagation, community_list)}


def _walk(cost: str = "1.0", least: float = 0.0) -> str:
    return f"""spine AS (SELECT id, source, target, confidence, {cost} / greatest(CAST(confidence AS DOUBLE), 0.01) AS w FROM edges WHERE kind IN ('consumes', 'calls_remote', 'owned_by') AND status = 'confirmed' AND CAST(confidence AS DOUBLE) >= {least}),
walk AS (SELECT id AS node, 0 AS depth, 0.0::DOUBLE AS weight, 0 AS cross_, [id] AS nodes, []::VARCHAR[] AS edge_ids, repo_id FROM nodes WHERE id = '{START}'
  UNION ALL SELECT n.id, depth + 1, weight + w, cross_ + CASE WHEN walk.repo_id IS NOT DISTINCT FROM n.repo_id THEN 0 ELSE 1 END, list_append(nodes, n.id), list_append(edge_ids, e.id), n.repo_id
  FROM walk JOIN spine AS e ON e.source = walk.node JOIN nodes AS n ON n.id = e.target WHERE depth < 3 AND NOT list_contains(nodes, n.id)),
found AS (SELECT * FROM walk WHERE depth > 0)"""


_IMPACT = f"""adj AS (SELECT target AS node, source AS next, id, CASE WHEN status = 'confirmed' AND confidence >= CAST(0.8 AS FLOAT) THEN 0 WHEN status IN ('confirmed', 'inferred', 'ambiguous') THEN 1 ELSE 2 END AS sure
  FROM edges WHERE kind IN ('consumes', 'calls_remote', 'contains')),
spread AS (SELECT '{SUPPLIER}' AS node, 0 AS sure, 0 AS depth, ['{SUPPLIER}'] AS visited
  UNION ALL SELECT next, greatest(spread.sure, adj.sure), depth + 1, list_append(visited, next) FROM spread JOIN adj USING (node) WHERE depth < 4 AND NOT list_contains(visited, next)),
reached AS (SELECT node, min(sure * 100 + depth) AS best FROM spread WHERE depth > 0 GROUP BY node),
items AS (SELECT n.id, kind, repo_id, stable_key, label, best // 100 AS sure, best % 100 AS depth,
  CASE WHEN best = 1 THEN 'directly_dependent' WHEN best < 100 THEN 'transitively_affected' WHEN best < 200 THEN 'possibly_affected' ELSE 'unknown_due_to_coverage' END AS classification,
  CASE WHEN best = 1 THEN 1 WHEN best < 100 THEN 2 WHEN best < 200 THEN 3 ELSE 4 END AS c FROM reached JOIN nodes AS n ON n.id = node)"""
_NAMES = "['directly_dependent', 'transitively_affected', 'possibly_affected', 'unknown_due_to_coverage']"
_TESTS = """tests AS (SELECT 'test:' || doc_id AS test_id, 'order:' || (doc_id * 13 % 997) AS id, 'tests/t' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.rs' END AS label, 'test:' || source || ':' || doc_id AS test_key FROM documents)"""
_FACTORS = f"""n AS (SELECT count(*) FILTER (c = 1) AS d, count(*) FILTER (c = 2) AS t, count(DISTINCT repo_id) FILTER (repo_id <> 'nation-0') + 1 AS r, count(*) AS n, count(DISTINCT id) FILTER (kind = 'service') AS s, (SELECT count(*) FROM tests JOIN items USING (id)) AS tests FROM items),
factors AS (SELECT * FROM (
  SELECT 'direct_consumers' AS code, least(d * 4.0, 24) AS weight FROM n UNION ALL SELECT 'transitive_fanout', least(t * 1.5, 15) FROM n UNION ALL SELECT 'cross_repository_count', least((r - 1) * 4.0, 16) FROM n
  UNION ALL SELECT 'missing_tests', CASE WHEN tests = 0 AND n > 0 THEN 10.0 ELSE 0 END FROM n UNION ALL SELECT 'missing_owners', CASE WHEN n > 0 THEN 8.0 ELSE 0 END FROM n UNION ALL SELECT 'service_impact', least(s * 2.0, 10) FROM n
  UNION ALL SELECT 'public_contract', 12.0 UNION ALL SELECT 'cross_environment', 10.0 UNION ALL SELECT 'payment_tag', 50.0 UNION ALL SELECT 'authentication_tag', 35.0) WHERE weight > 0)"""
_SMALL = """small AS (SELECT source, target, kind, confidence AS f, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE status = 'confirmed'),
sn AS (SELECT id, kind, stable_key, label FROM nodes WHERE kind <> 'document'), sm AS (SELECT * FROM memberships)"""
_RANKED = """deg AS (SELECT node, count(DISTINCT o) AS degree FROM (SELECT source AS node, target AS o FROM small UNION ALL SELECT target, source FROM small) GROUP BY node),
wd AS (SELECT node, round(sum(w), 9) AS weight FROM (SELECT unnest([a, b]) AS node, w FROM (SELECT least(source, target) AS a, greatest(source, target) AS b, round(sum(confidence), 9) AS w FROM small GROUP BY ALL)) GROUP BY node),
mw AS (SELECT community_id, node_id, degree, coalesce(weight, 0) AS weight, max(coalesce(weight, 0)) OVER (PARTITION BY community_id) AS top FROM sm LEFT JOIN deg ON deg.node = node_id LEFT JOIN wd ON wd.node = node_id),
central AS (SELECT community_id, node_id, place FROM (SELECT community_id, node_id, row_number() OVER (PARTITION BY community_id ORDER BY CASE WHEN degree >= 30 THEN 1 ELSE 0 END DESC,
    round(0.65 * coalesce(1.0 / (length(node_id) + degree), 0.0) + 0.35 * CASE WHEN top > 0 THEN weight / top ELSE 0 END, 9) DESC, node_id) AS place FROM mw) WHERE place <= 3)"""


def _components(rounds: int = 14) -> str:
    """The least id within so many steps, more than the graph is wide."""
    out = f"""WITH {G.GRAPH}, {_SMALL}, u AS MATERIALIZED (SELECT source AS x, target AS y FROM small WHERE f >= CAST(0.8 AS FLOAT) UNION SELECT target, source FROM small WHERE f >= CAST(0.8 AS FLOAT)),
l0 AS MATERIALIZED (SELECT id AS node, id AS component FROM sn)"""
    for k in range(1, rounds + 1):
        out += f",\nl{k} AS MATERIALIZED (SELECT l.node, least(l.component, coalesce(m, l.component)) AS component FROM l{k - 1} AS l LEFT JOIN (SELECT x, min(component) AS m FROM u JOIN l{k - 1} ON node = y GROUP BY x) ON x = l.node)"
    return f"{out}\nSELECT * FROM l{rounds}"


def _pagerank(rounds: int = 64) -> str:
    parts = [f"""WITH {G.GRAPH}, {_SMALL},
cnt AS (SELECT count(*) AS n FROM sn), o AS (SELECT source, sum(confidence) AS out FROM small GROUP BY 1), sh AS MATERIALIZED (SELECT small.source, target, sum(confidence) / max(out) AS share FROM small JOIN o ON o.source = small.source GROUP BY 1, 2),
r0 AS MATERIALIZED (SELECT id AS node, 1.0 / n AS rank FROM sn, cnt)"""]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} AS MATERIALIZED (SELECT p.node, 0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT source FROM sh)) / n) AS rank
FROM r{k - 1} AS p LEFT JOIN (SELECT target, sum(rank * share) AS got FROM r{k - 1} JOIN sh ON node = source GROUP BY target) AS g ON g.target = p.node, cnt)""")
    return ",\n".join(parts) + f"\nSELECT node, round(rank, 9) AS rank FROM r{rounds}"


ORACLE_SQL = {
    "trace_shortest": f"""WITH RECURSIVE {G.GRAPH}, e AS (SELECT id, source, target, kind FROM edges WHERE kind IN ('consumes', 'calls_remote') OR (kind = 'owned_by' AND NOT starts_with(source, 'customer:'))),
walk AS (SELECT '{START}' AS node, []::VARCHAR[] AS ids UNION ALL SELECT target, list_append(ids, id) FROM walk JOIN e ON source = node WHERE len(ids) < 3),
best AS (SELECT ids FROM walk WHERE node = 'region:1' ORDER BY len(ids), ids LIMIT 1),
s AS (SELECT unnest(range(0, len(ids))) AS step, unnest(ids) AS edge_id FROM best)
SELECT CAST(step AS INT) AS step, edge_id, source, target, kind FROM s JOIN e ON e.id = edge_id""",
    "traverse_bfs": f"WITH RECURSIVE {G.GRAPH}, {_walk()} SELECT node, depth, cross_ AS \"cross\", array_to_string(edge_ids, '|') AS edge_ids FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, edge_ids) AS n FROM found) WHERE n = 1",
    "traverse_dijkstra": f"WITH RECURSIVE {G.GRAPH}, {_walk(chr(40) + 'CASE kind WHEN ' + chr(39) + 'calls_remote' + chr(39) + ' THEN 2.0 WHEN ' + chr(39) + 'owned_by' + chr(39) + ' THEN 0.5 ELSE 1.0 END)')} SELECT node, depth, round(weight, 6) AS weight, array_to_string(edge_ids, '|') AS edge_ids FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(weight, 9), nodes, edge_ids) AS n FROM found) WHERE n = 1",
    "k_shortest_paths": f"WITH RECURSIVE {G.GRAPH}, {_walk(least=0.6)} SELECT node, row_number() OVER (PARTITION BY node ORDER BY round(weight, 9), depth, edge_ids, nodes) AS place, depth, round(weight, 6) AS weight, array_to_string(edge_ids, '|') AS edge_ids FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(weight, 9), nodes, edge_ids) AS n FROM found) WHERE n <= 4",
    "traverse_candidates": f"WITH {G.GRAPH} SELECT status, count(*) AS edges FROM edges WHERE kind = 'calls_remote' AND status <> 'confirmed' AND CAST(confidence AS DOUBLE) >= 0.55 GROUP BY status",
    "reachable_frontier": f"WITH RECURSIVE {G.GRAPH}, {_walk()}, near AS (SELECT node, min(depth) AS depth FROM found GROUP BY node) SELECT * FROM near WHERE depth = (SELECT max(depth) FROM near)",
    "repository_ownership_closure": f"""WITH RECURSIVE {G.GRAPH}, c AS (SELECT source AS parent, target AS child FROM edges WHERE status = 'confirmed' AND kind IN ('contains', 'consumes', 'calls_remote') AND (NOT starts_with(target, 'supplier:') OR starts_with(source, 'nation:'))),
own AS (SELECT id AS node, repo_id FROM nodes WHERE kind = 'repository' UNION SELECT child, repo_id FROM own JOIN c ON parent = node) SELECT node, repo_id FROM own""",
    "impact_items": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT} SELECT id, kind, repo_id, classification, depth FROM items",
    "impact_by_repository": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT} SELECT repo_id, min(depth) AS min_depth, count(*) AS items, {_NAMES}[min(c)] AS strongest FROM items WHERE repo_id IS NOT NULL GROUP BY repo_id",
    "impact_by_service": f"""WITH RECURSIVE {G.GRAPH}, {_IMPACT}, s AS (SELECT id FROM nodes WHERE kind = 'service'),
mem AS (SELECT target AS service_id, source AS node_id FROM edges WHERE kind = 'calls_remote' UNION SELECT id, id FROM s)
SELECT service_id, min(depth) AS min_depth, count(*) AS items, {_NAMES}[min(c)] AS strongest FROM items JOIN mem ON node_id = id GROUP BY service_id""",
    "impact_by_community": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT} SELECT community_id, min(depth) AS min_depth, count(*) AS items, {_NAMES}[min(c)] AS strongest FROM items JOIN memberships ON node_id = id GROUP BY community_id",
    "impact_depth_buckets": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT} SELECT depth, " + ", ".join(f"count(*) FILTER (c = {i + 1}) AS {x}" for i, x in enumerate(P.CLASSES)) + " FROM items GROUP BY depth",
    "impact_contracts": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT} SELECT id, kind, stable_key, classification, depth FROM items WHERE kind = 'http_operation'",
    "impact_tests": f"""WITH RECURSIVE {G.GRAPH}, {_IMPACT}, {_TESTS}
SELECT dense_rank() OVER (ORDER BY c, depth, test_key) AS rank, test_id, t.label, classification, depth, CASE WHEN ends_with(t.label, '.py') THEN 'pytest ' || t.label ELSE 'cargo test' END AS command, CASE WHEN ends_with(t.label, '.py') THEN 'owner:' || string_split(test_key, ':')[2] ELSE '' END AS owners FROM tests AS t JOIN items AS i ON i.id = t.id""",
    "impact_coverage": f"""WITH RECURSIVE {G.GRAPH}, {_IMPACT}, r AS (SELECT x.repo_id, state FROM (SELECT repo_id FROM items WHERE repo_id IS NOT NULL UNION SELECT 'nation-99') AS x LEFT JOIN (SELECT * FROM freshness WHERE repo_id <> 'nation-4') AS f USING (repo_id)),
c AS (SELECT count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state IN ('working_tree_changed', 'commits_behind')) AS stale, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'unavailable') AS unavailable, count(*) FILTER (state IS NULL) AS missing FROM r)
SELECT *, CASE WHEN stale > 0 THEN 'repositories_stale,' ELSE '' END || CASE WHEN partial > 0 THEN 'repositories_partial,' ELSE '' END || CASE WHEN unavailable > 0 THEN 'repositories_unavailable,' ELSE '' END || 'repositories_missing,possible_relationships' AS gaps, false AS sufficient_for_score FROM c""",
    "risk_factors": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT}, {_TESTS}, {_FACTORS} SELECT code, round(CAST(weight AS DOUBLE), 6) AS weight, code = 'authentication_tag' AS backed FROM factors",
    "risk_score": f"WITH RECURSIVE {G.GRAPH}, {_IMPACT}, {_TESTS}, {_FACTORS}, s AS (SELECT greatest(least(CAST(sum(weight) AS DOUBLE), 100), 1) AS score FROM factors) SELECT CASE WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level, round(score, 6) AS score FROM s",
    "risk_unknown": "SELECT 'unknown' AS level, CAST(NULL AS DOUBLE) AS score",
    "worst_freshness": """SELECT 'nation-' || (user_id % 25) AS repo_id, ['fresh', 'commits_behind', 'partial', 'unavailable'][CAST(max(event_id * 7 % 4) + 1 AS INT)] AS state FROM events GROUP BY user_id % 25""",
    "community_edges": f"WITH {G.GRAPH}, {_SMALL} SELECT least(source, target) AS a, greatest(source, target) AS b, round(sum(CASE kind WHEN 'contains' THEN 0.4 ELSE 1.0 END * confidence), 6) AS weight FROM small WHERE source <> target GROUP BY ALL",
    "connected_components": _components(),
    "community_metrics": f"""WITH {G.GRAPH}, {_SMALL}, e AS (SELECT small.*, a.community_id AS sc, b.community_id AS tc FROM small LEFT JOIN sm AS a ON a.node_id = source LEFT JOIN sm AS b ON b.node_id = target),
own AS (SELECT sc AS community_id, sum(confidence) AS cohesion, count(DISTINCT (source, target)) AS pairs FROM e WHERE sc = tc GROUP BY sc),
x AS (SELECT community_id, sum(confidence) AS coupling, count(*) AS n FROM (SELECT sc AS community_id, confidence FROM e WHERE sc IS DISTINCT FROM tc UNION ALL SELECT tc, confidence FROM e WHERE sc IS DISTINCT FROM tc) WHERE community_id IS NOT NULL GROUP BY 1),
z AS (SELECT community_id, count(*) AS size FROM sm GROUP BY 1)
SELECT community_id, size, round(coalesce(cohesion, 0), 6) AS cohesion, round(coalesce(coupling, 0), 6) AS coupling, coalesce(n, 0) AS cross_edges, 0 AS inbound_contracts, 0 AS outbound_contracts,
  CASE WHEN size > 1 THEN round(coalesce(pairs, 0) / (size * (size - 1)), 9) ELSE 0.0 END AS density FROM z LEFT JOIN own USING (community_id) LEFT JOIN x USING (community_id)""",
    "god_nodes": "SELECT 'workspace:1' AS node, count(*) AS degree FROM customer",
    "pagerank_64": _pagerank(),
    "central_nodes_top3": f"WITH {G.GRAPH}, {_SMALL}, {_RANKED} SELECT * FROM central",
    "community_labels": f"""WITH {G.GRAPH}, {_SMALL}, {_RANKED},
m AS (SELECT sm.community_id, sm.node_id, label, stable_key, CASE kind WHEN 'service' THEN 400 ELSE 0 END + CASE WHEN c.node_id IS NULL THEN 0 ELSE 100 END AS score FROM sm JOIN sn ON id = sm.node_id LEFT JOIN central AS c ON c.node_id = sm.node_id AND c.community_id = sm.community_id),
t AS (SELECT community_id, term, sum(score) AS score FROM (SELECT community_id, score, unnest(list_distinct(list_concat(regexp_split_to_array(lower(label), '[^\\p{{L}}\\p{{N}}]+'), regexp_split_to_array(lower(stable_key), '[^\\p{{L}}\\p{{N}}]+')))) AS term FROM m WHERE score > 0)
  WHERE strlen(term) BETWEEN 3 AND 32 AND regexp_matches(term, '\\p{{L}}') AND term NOT IN ({", ".join(f"'{x}'" for x in C.STOP_TERMS)}) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY score DESC, term) AS place FROM t)
SELECT community_id, string_agg(upper(term[1]) || term[2:], ' / ' ORDER BY place) AS label FROM p WHERE place <= 3 GROUP BY community_id""",
    "community_delta": f"""WITH {G.GRAPH}, {_SMALL}, b AS (SELECT community_id AS before_id, node_id FROM sm),
a AS (SELECT CASE WHEN community_id = 'community:1-0' THEN 'split-' || (k % 4) WHEN starts_with(community_id, 'community:2') THEN 'joined' WHEN k % 9 = 0 THEN 'new-' || (k % 2) ELSE community_id END AS after_id, node_id FROM (SELECT *, CAST(regexp_extract(node_id, '[0-9]+$') AS BIGINT) AS k FROM sm)),
j AS (SELECT before_id, after_id, count(*) AS n FROM a JOIN b USING (node_id) GROUP BY ALL), nb AS (SELECT before_id, count(*) AS nb FROM b GROUP BY 1), na AS (SELECT after_id, count(*) AS na FROM a GROUP BY 1),
r AS (SELECT before_id, after_id, n / (nb + na - n) AS q FROM j JOIN nb USING (before_id) JOIN na USING (after_id) WHERE n / (nb + na - n) >= 0.25),
w AS (SELECT *, count(*) OVER (PARTITION BY before_id) AS ob, count(*) OVER (PARTITION BY after_id) AS oa FROM r),
c AS (SELECT 'split' AS change, before_id AS before_ids, string_agg(after_id, ',' ORDER BY after_id) AS after_ids, max(q) AS overlap FROM w WHERE ob > 1 GROUP BY before_id
  UNION ALL SELECT 'merged', string_agg(before_id, ',' ORDER BY before_id), after_id, max(q) FROM w WHERE oa > 1 GROUP BY after_id UNION ALL SELECT 'materially_changed', before_id, after_id, q FROM w WHERE ob = 1 AND oa = 1 AND q < 0.8
  UNION ALL SELECT 'removed', before_id, '', 0 FROM nb WHERE before_id NOT IN (SELECT before_id FROM r) UNION ALL SELECT 'created', '', after_id, 0 FROM na WHERE after_id NOT IN (SELECT after_id FROM r))
SELECT change, before_ids, after_ids, round(CAST(overlap AS DOUBLE), 6) AS overlap FROM c""",
}
ORACLE_SQL["community_list"] = ORACLE_SQL["community_metrics"].replace("SELECT community_id, size, round(coalesce(cohesion", "SELECT * FROM (SELECT community_id, size, round(coalesce(cohesion", 1).split(", round(coalesce(coupling")[0] + " FROM z LEFT JOIN own USING (community_id)) ORDER BY size DESC, cohesion DESC, community_id LIMIT 5"
