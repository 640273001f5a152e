"""Queries of ranked search and of the graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import search as S
from ..sources import tables as G

NORM = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def graph_nodes(spark, sf):
    return G.nodes(spark, sf)


def graph_edges(spark, sf):
    return G.edges(spark, sf).select("id", "source", "target", "kind", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), "status", F.array_join("evidence", ",").alias("evidence"))


def _graph(spark, sf):
    return G.nodes(spark, sf, ("repository", "service", "symbol_ref", "owner", "package", "http_operation"))


def search_ranked(spark, sf):
    """Everything at once: full text, centrality, communities, evidence and freshness."""
    nodes = _graph(spark, sf)
    fts = S.full_text(nodes, "supplier 7")
    members = G.memberships(spark, sf)
    central = members.where("node_id like 'supplier:%'").groupBy("community_id").agg(F.slice(F.sort_array(F.collect_list("node_id")), 1, 3).alias("central_nodes"))
    ev = lambda ids: S.node_evidence(G.edges(spark, sf, ("consumes", "contains", "owned_by")), ids).join(G.evidence(spark, sf).select(F.col("id").alias("evidence_id"), "confidence"), "evidence_id")
    return S.search(nodes, "supplier 7", fts=fts, centrality=S.centrality(central), communities=members, evidence=ev, freshness=G.freshness(spark, sf), limit=50)


def search_filtered(spark, sf):
    nodes = G.nodes(spark, sf, ("service", "symbol_ref"))
    return S.search(nodes, "supplier", kinds=["service"], repos=[f"nation-{i}" for i in range(12)], services=S.service_memberships(nodes, G.edges(spark, sf, ("contains",))), freshness=G.freshness(spark, sf), limit=100)


def search_page_2(spark, sf):
    return S.search(G.nodes(spark, sf, ("symbol_ref",)), "customer", freshness=G.freshness(spark, sf), offset=20, limit=20)


def search_coverage(spark, sf):
    """Of a search among services and symbols while the freshness of one nation is not known."""
    nodes = G.nodes(spark, sf)
    eligible = nodes.where("kind in ('service', 'symbol_ref')")
    fts = S.full_text(eligible, "supplier")
    out = S.coverage(nodes, eligible, eligible.where(normalized(F.col("label")).startswith("supplier")), freshness=G.freshness(spark, sf).where("repo_id <> 'nation-3'"), fts=fts, centrality=True)
    return out.withColumn("gaps", F.array_join("gaps", ",")).withColumn("freshness_unknown_repositories", F.array_join("freshness_unknown_repositories", ","))


def search_repeated_words(spark, sf):
    """A query whose words repeat is held against labels as it stands, and full text takes its distinct terms."""
    twice = G.nodes(spark, sf, ("owner", "repository")).withColumn("label", F.concat_ws(" - ", "label", "label"))
    return S.search(twice, "ASIA  asia", fts=S.full_text(twice, "ASIA  asia"), limit=20)


def fts_bm25_documents(spark, sf):
    return S.full_text(G.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "license apache water the and", columns=("text",))


def fts_reciprocal_rank(spark, sf):
    return S.full_text(G.nodes(spark, sf, ("package",)), "Brand 12 blue small", limit=100).select("id", "rank", F.round("fts", 6).alias("fts"))


def service_membership(spark, sf):
    return S.service_memberships(G.nodes(spark, sf, ("service",)), G.edges(spark, sf))


def node_evidence(spark, sf):
    return S.node_evidence(G.edges(spark, sf))


def centrality_from_communities(spark, sf):
    members = G.memberships(spark, sf)
    ranked = members.groupBy("community_id").agg(F.slice(F.sort_array(F.collect_list("node_id")), 1, 3).alias("central_nodes"))
    return S.centrality(ranked).select("node_id", F.round("centrality", 6).alias("centrality"))


QUERIES = {f.__name__: f for f in (
    graph_nodes, graph_edges, search_ranked, search_filtered, search_page_2, search_coverage, search_repeated_words, fts_bm25_documents, fts_reciprocal_rank, service_membership, node_evidence,
    centrality_from_communities)}


def _bm25(rows: str, key: str, text: str, terms: list[str], limit: int = 500) -> str:
    """CTEs docs..best: BM25 with k1 = 1.2 and b = 0.75."""
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""bw AS (SELECT {key} AS id, list_filter(string_split({NORM.format(x=text)}, ' '), lambda x: x <> '') AS w FROM {rows}),
bs AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM bw),
bt AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM bw) WHERE term IN ({wanted}) GROUP BY ALL),
bd AS (SELECT term, count(*) AS df FROM bt GROUP BY term),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25 FROM bt JOIN bd USING (term), bs GROUP BY id),
best AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS rank, 1.0 / row_number() OVER (ORDER BY bm25 DESC, id) AS fts FROM bm ORDER BY bm25 DESC, id LIMIT {limit})"""


def _search(query: str, where: str, fts: str = "NULL", joins: str = "", scope: float = 0.0, central: str = "0.0", community: str = "0.0", evidence: str = "0.0", offset: int = 0, limit: int = 20) -> str:
    label, key, kind = NORM.format(x="label"), NORM.format(x="stable_key"), "replace(kind, '_', ' ')"
    penalty = "CASE WHEN s.repo_id IS NULL THEN 0.0 ELSE coalesce(CASE state WHEN 'fresh' THEN 0.0 WHEN 'working_tree_changed' THEN 0.05 WHEN 'commits_behind' THEN 0.1 WHEN 'partial' THEN 0.2 WHEN 'unavailable' THEN 0.5 END, 0.2) END"
    return f"""hits AS (SELECT s.id, kind, s.repo_id, stable_key, label,
    CASE WHEN {label} = '{query}' OR {key} = '{query}' THEN 4.0 ELSE CASE WHEN starts_with({label}, '{query}') OR starts_with({key}, '{query}') THEN 1.5 ELSE 0.0 END
      + CASE WHEN ends_with({label}, '{query}') OR ends_with({key}, '{query}') THEN 1.0 ELSE 0.0 END END AS lexical,
    CASE WHEN {kind} = '{query}' THEN 0.5 WHEN starts_with({kind}, '{query}') OR ends_with({kind}, '{query}') THEN 0.25 ELSE 0.0 END AS kind_score,
    least(coalesce({fts}, 0.0), 1.0) * 2 AS fts_score, CAST({scope} AS DOUBLE) AS scope_score, {central} AS centrality_score, {community} AS community_score, {evidence} AS evidence_score, {penalty} AS penalty
  FROM nodes AS s LEFT JOIN freshness AS fr ON s.repo_id = fr.repo_id {joins} WHERE {where}),
found AS (SELECT *, round(greatest(CAST(lexical AS DOUBLE) + kind_score + fts_score + scope_score + centrality_score + community_score + evidence_score - penalty, 0), 6) AS score
  FROM hits WHERE lexical > 0 OR kind_score = 0.5 OR fts_score > 0)
SELECT *, (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM found) > {offset + limit} AS truncated FROM found ORDER BY score DESC, stable_key, id LIMIT {limit} OFFSET {offset}"""


ORACLE_SQL = {
    "graph_nodes": f"WITH {G.GRAPH} SELECT * FROM nodes",
    "graph_edges": f"WITH {G.GRAPH} SELECT id, source, target, kind, round(CAST(confidence AS DOUBLE), 6) AS confidence, status, evidence FROM edges",
    "search_ranked": f"""WITH {G.GRAPH}, pool AS (SELECT * FROM nodes WHERE kind <> 'document'), {_bm25("pool", "id", "label || ' ' || stable_key", ["supplier", "7"])},
cn AS (SELECT node_id, max(1.0 / place) AS c FROM (SELECT node_id, row_number() OVER (PARTITION BY community_id ORDER BY node_id) AS place FROM memberships WHERE starts_with(node_id, 'supplier:')) WHERE place <= 3 GROUP BY 1),
ev AS (SELECT DISTINCT unnest([source, target]) AS id FROM edges WHERE kind = 'consumes'),
""" + _search("supplier 7", "kind <> 'document'", "best.fts", "LEFT JOIN best ON best.id = s.id LEFT JOIN cn ON cn.node_id = s.id LEFT JOIN (SELECT DISTINCT node_id FROM memberships) AS mb ON mb.node_id = s.id LEFT JOIN ev ON ev.id = s.id",
                  central="least(coalesce(cn.c, 0.0), 1.0) * 0.5", community="CASE WHEN mb.node_id IS NULL THEN 0.0 ELSE 0.1 END", evidence="CASE WHEN ev.id IS NULL THEN 0.0 ELSE 0.75 END", limit=50),
    "search_filtered": f"WITH {G.GRAPH}, " + _search("supplier", "kind = 'service' AND s.repo_id IN (" + ", ".join(f"'nation-{i}'" for i in range(12)) + ")", scope=0.3, limit=100),
    "search_page_2": f"WITH {G.GRAPH}, " + _search("customer", "kind = 'symbol_ref'", offset=20, limit=20),
    "search_coverage": f"""WITH {G.GRAPH}, el AS (SELECT * FROM nodes WHERE kind IN ('service', 'symbol_ref')), ma AS (SELECT * FROM el WHERE starts_with({NORM.format(x='label')}, 'supplier')),
{_bm25("el", "id", "label || ' ' || stable_key", ["supplier"])}, un AS (SELECT DISTINCT repo_id FROM ma WHERE repo_id NOT IN (SELECT repo_id FROM freshness WHERE repo_id <> 'nation-3'))
SELECT (SELECT count(*) FROM nodes) AS input_nodes, (SELECT count(*) FROM el) AS eligible_nodes, (SELECT count(*) FROM ma) AS matched_nodes, (SELECT count(*) FROM best) AS fts_scored_nodes,
  coalesce((SELECT string_agg(repo_id, ',' ORDER BY repo_id) FROM un), '') AS freshness_unknown_repositories,
  CASE WHEN (SELECT count(*) FROM best) = 0 THEN 'full_text_not_provided,' ELSE '' END || 'evidence_not_provided,communities_not_provided' || CASE WHEN (SELECT count(*) FROM un) > 0 THEN ',freshness_unavailable' ELSE '' END AS gaps""",
    "search_repeated_words": f"""WITH {G.GRAPH.replace("nodes AS (", "plain AS (", 1)}, nodes AS (SELECT id, kind, repo_id, stable_key, label || ' - ' || label AS label FROM plain WHERE kind IN ('owner', 'repository')),
{_bm25("nodes", "id", "label || ' ' || stable_key", ["asia"])}, """ + _search("asia asia", "true", "best.fts", "LEFT JOIN best ON best.id = s.id").replace("LEFT JOIN freshness AS fr ON s.repo_id = fr.repo_id", "").replace("CASE WHEN s.repo_id IS NULL THEN 0.0 ELSE coalesce(CASE state WHEN 'fresh' THEN 0.0 WHEN 'working_tree_changed' THEN 0.05 WHEN 'commits_behind' THEN 0.1 WHEN 'partial' THEN 0.2 WHEN 'unavailable' THEN 0.5 END, 0.2) END", "0.0::DOUBLE"),
    "fts_bm25_documents": f"""WITH {_bm25("documents", "doc_id", "text", ["license", "apache", "water", "the", "and"])} SELECT * FROM best""",
    "fts_reciprocal_rank": f"""WITH {G.GRAPH}, pool AS (SELECT * FROM nodes WHERE kind = 'package'), {_bm25("pool", "id", "label || ' ' || stable_key", ["brand", "12", "blue", "small"], 100)} SELECT id, rank, round(fts, 6) AS fts FROM best""",
    "service_membership": f"""WITH {G.GRAPH}, s AS (SELECT id FROM nodes WHERE kind = 'service')
SELECT s.id AS service_id, target AS node_id FROM edges JOIN s ON source = s.id UNION SELECT s.id, source FROM edges JOIN s ON target = s.id UNION SELECT id, id FROM s""",
    "node_evidence": f"WITH {G.GRAPH} SELECT DISTINCT unnest([source, target]) AS node_id, evidence AS evidence_id FROM edges",
    "centrality_from_communities": f"""WITH {G.GRAPH} SELECT node_id, round(max(1.0 / place), 6) AS centrality FROM (
  SELECT node_id, row_number() OVER (PARTITION BY community_id ORDER BY node_id) AS place FROM memberships) WHERE place <= 3 GROUP BY node_id""",
}
