"""Queries of contracts, export, doctor and status, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as V
from ..sources import tables as G

_KINDS = ("symbol_ref", "http_operation", "service", "package")


def _g(spark, sf):
    return G.nodes(spark, sf, _KINDS), G.edges(spark, sf, ("consumes", "calls_remote", "depends_on_package"))


def contracts_list(spark, sf):
    return V.contracts(G.nodes(spark, sf))


def contract_links(spark, sf):
    return V.contract_links(*_g(spark, sf)).groupBy("contract", "direction").agg(F.count("*").alias("edges"), F.min("other").alias("first_other"))


def contract_issues(spark, sf):
    nodes, edges = _g(spark, sf)
    """All edges against all nodes but the suppliers, and all evidence: ends dangle, links are unsure, evidence is not observed."""
    edges = G.edges(spark, sf)
    return V.contract_issues(G.nodes(spark, sf, ("repository", "owner", "symbol_ref", "http_operation", "package")), edges, G.evidence(spark, sf)).groupBy("code", "severity").agg(F.count("*").alias("n"), F.min("subject").alias("first_id"), F.max("subject").alias("last_id"))


def evidence_index(spark, sf):
    return V.evidence_index(G.edges(spark, sf, ("consumes", "contains"))).withColumn("edges", F.array_join("edges", ","))


def explain_link(spark, sf):
    nodes, edges = _g(spark, sf)
    return V.explain_link(edges, G.evidence(spark, sf), nodes, edges.where("kind = 'consumes'").agg(F.min("id")).first()[0])


def export_nodes(spark, sf):
    return V.exported(*_g(spark, sf))[0]


def export_edges(spark, sf):
    return V.exported(*_g(spark, sf))[1].select("id", "source", "target", "kind")


def export_graphml(spark, sf):
    return V.graphml(*_g(spark, sf))


def export_markdown(spark, sf):
    return V.markdown(*_g(spark, sf))


def freshness_summary(spark, sf):
    return V.freshness_summary(G.freshness(spark, sf))


def freshness_states(spark, sf):
    k = F.col("n_nationkey")
    flags = {"unavailable": k % 11 == 0, "corrupt": k % 13 == 0, "config_changed": k % 7 == 0, "extractor_changed": k % 5 == 0, "commits_behind": k % 3 == 0, "working_tree_changed": k % 2 == 0}
    return V.freshness(G.table(spark, sf, "nation").select(F.concat(F.lit("nation-"), k.cast("string")).alias("repo_id"), *(c.alias(n) for n, c in flags.items())))


def status_rows(spark, sf):
    f = G.freshness(spark, sf)
    n = F.regexp_extract("repo_id", "[0-9]+", 0).cast("int")
    return V.status(f.where(n % 4 != 0), f.where(n % 3 != 0).withColumn("state", F.when(n % 2 == 0, "fresh").otherwise(F.col("state"))))


def doctor_checks(spark, sf):
    nodes, edges = _g(spark, sf)
    return V.doctor(nodes.where("id not like 'supplier:%7'"), edges, G.freshness(spark, sf))


def doctor_overall(spark, sf):
    return V.overall(doctor_checks(spark, sf))


def relations(spark, sf):
    nodes, edges = _g(spark, sf)
    return V.relations(edges, nodes, "order:3")


QUERIES = {f.__name__: f for f in (
    contracts_list, contract_links, contract_issues, evidence_index, explain_link, export_nodes, export_edges, export_graphml, export_markdown, freshness_summary, freshness_states, status_rows, doctor_checks,
    doctor_overall, relations)}

_SOME = f"""{G.GRAPH}, n AS (SELECT * FROM nodes WHERE kind IN ('symbol_ref', 'http_operation', 'service', 'package')), e AS (SELECT * FROM edges WHERE kind IN ('consumes', 'calls_remote', 'depends_on_package')),
c AS (SELECT * FROM n WHERE kind IN ('http_operation', 'package')),
l AS (SELECT c.id AS contract, e.id AS edge_id, 'outgoing' AS direction, target AS other, e.kind FROM e JOIN c ON source = c.id UNION ALL SELECT c.id, e.id, 'incoming', source, e.kind FROM e JOIN c ON target = c.id)"""
_ISSUES = f"""{G.GRAPH}, ids AS (SELECT id FROM nodes WHERE kind NOT IN ('service', 'document')),
i AS (SELECT 'dangling_edge' AS code, 'error' AS severity, id FROM (SELECT id, unnest([source, target]) AS x FROM edges) WHERE x NOT IN (SELECT id FROM ids)
  UNION ALL SELECT 'unresolved_link', 'unknown', id FROM edges WHERE status <> 'confirmed' UNION ALL SELECT 'evidence_not_observed', 'unknown', id FROM edges WHERE evidence NOT IN (SELECT id FROM evidence))"""
_XML = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_DOCTOR = f"""{_SOME}, nn AS (SELECT id FROM n WHERE NOT (starts_with(id, 'supplier:') AND ends_with(id, '7'))),
d AS (SELECT 'integrity' AS "check", 'failed' AS bad, count(*) AS affected FROM e WHERE source NOT IN (SELECT id FROM nn) OR target NOT IN (SELECT id FROM nn) UNION ALL SELECT 'identity', 'failed', 0
  UNION ALL SELECT 'freshness', 'degraded', count(*) FROM freshness WHERE state NOT IN ('fresh', 'unavailable') UNION ALL SELECT 'availability', 'unknown', count(*) FROM freshness WHERE state = 'unavailable')"""

ORACLE_SQL = {
    "contracts_list": f"WITH {G.GRAPH} SELECT id, kind, repo_id, stable_key, label FROM nodes WHERE kind IN ('http_operation', 'package')",
    "contract_links": f"WITH {_SOME} SELECT contract, direction, count(*) AS edges, min(other) AS first_other FROM l GROUP BY ALL",
    "contract_issues": f"WITH {_ISSUES} SELECT 'contract.' || code AS code, severity, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM i GROUP BY ALL",
    "evidence_index": f"WITH {G.GRAPH} SELECT evidence AS evidence_id, id AS edges FROM edges WHERE kind IN ('consumes', 'contains')",
    "explain_link": f"""WITH {_SOME} SELECT e.id AS edge_id, e.kind, status, a.label AS source_label, b.label AS target_label, e.evidence AS evidence_id, file_path, start_line, end_line
FROM e JOIN n AS a ON a.id = source JOIN n AS b ON b.id = target LEFT JOIN evidence AS v ON v.id = e.evidence WHERE e.id = (SELECT min(id) FROM e WHERE kind = 'consumes')""",
    "export_nodes": f"WITH {_SOME} SELECT * FROM n ORDER BY stable_key, id LIMIT 100000",
    "export_edges": f"WITH {_SOME}, x AS (SELECT id FROM n ORDER BY stable_key, id LIMIT 100000) SELECT id, source, target, kind FROM e WHERE source IN (SELECT id FROM x) AND target IN (SELECT id FROM x) ORDER BY id LIMIT 1000000",
    "export_graphml": f"""WITH {_SOME} SELECT 1 AS section, '<node id="' || {_XML.format(x='id')} || '"><data key="kind">' || kind || '</data><data key="label">' || {_XML.format(x='label')} || '</data></node>' AS line FROM n
UNION ALL SELECT * FROM (SELECT 2, '<edge id="' || {_XML.format(x='id')} || '" source="' || source || '" target="' || target || '"><data key="kind">' || kind || '</data></edge>' AS line FROM e)""",
    "export_markdown": f"WITH {_SOME} SELECT 1 AS section, '| | ' || replace(kind, '|', '\\|') || ' | ' || replace(label, '|', '\\|') || ' | ' || replace(stable_key, '|', '\\|') || ' | |' AS line FROM n UNION ALL SELECT 2, '| | ' || replace(source, '|', '\\|') || ' | ' || kind || ' | ' || replace(target, '|', '\\|') || ' | |' FROM e",
    "freshness_summary": f"""WITH {G.GRAPH} SELECT CASE WHEN bool_and(state = 'fresh') THEN 'fresh' WHEN bool_or(state IN ('unavailable', 'corrupt', 'unknown')) THEN 'unknown' WHEN bool_or(state = 'partial') THEN 'partial' ELSE 'stale' END AS overall, count(*) AS repositories, count(*) FILTER (state = 'fresh') AS fresh FROM freshness""",
    "freshness_states": """SELECT 'nation-' || k AS repo_id, CASE WHEN k % 11 = 0 THEN 'unavailable' WHEN k % 13 = 0 THEN 'corrupt' WHEN k % 7 = 0 THEN 'config_changed' WHEN k % 5 = 0 THEN 'extractor_changed' WHEN k % 3 = 0 THEN 'commits_behind' WHEN k % 2 = 0 THEN 'working_tree_changed' ELSE 'fresh' END AS state FROM (SELECT n_nationkey AS k FROM nation)""",
    "status_rows": f"""WITH {G.GRAPH}, f AS (SELECT *, CAST(regexp_extract(repo_id, '[0-9]+') AS INT) AS n FROM freshness), p AS (SELECT repo_id, CASE WHEN n % 2 = 0 THEN 'fresh' ELSE state END AS before FROM f WHERE n % 3 <> 0)
SELECT f.repo_id, state, before FROM f LEFT JOIN p USING (repo_id) WHERE n % 4 <> 0 UNION ALL SELECT p.repo_id, 'unavailable', before FROM p JOIN f USING (repo_id) WHERE n % 4 = 0""",
    "doctor_checks": f"""WITH {_DOCTOR} SELECT "check", CASE WHEN affected > 0 THEN bad ELSE 'healthy' END AS outcome, affected FROM d""",
    "doctor_overall": "SELECT 'failed' AS outcome",
    "relations": f"""WITH {_SOME}, o AS (SELECT repo_id AS r FROM n WHERE id = 'order:3'), x AS (SELECT e.id, e.kind, CASE WHEN source = 'order:3' THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN source = 'order:3' THEN target ELSE source END AS other FROM e WHERE source = 'order:3' OR target = 'order:3'),
y AS (SELECT x.*, n.label, CASE WHEN r IS NULL OR repo_id IS NULL THEN 'workspace' WHEN r <> repo_id THEN 'cross_repository' ELSE 'local' END AS scope FROM x JOIN n ON n.id = other, o)
SELECT *, CASE scope WHEN 'cross_repository' THEN '0' WHEN 'workspace' THEN '1' ELSE '2' END || '1' || CASE direction WHEN 'outgoing' THEN '0' ELSE '1' END || CASE kind WHEN 'calls_remote' THEN '0' ELSE '1' END AS priority FROM y ORDER BY priority, kind, id LIMIT 50""",
}
