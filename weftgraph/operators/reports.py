"""Contracts, export, doctor, freshness and status: views over the graph, and its sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INSPECTED_CONTRACTS
from ..sources.shared import written

MOST_NODES, MOST_EDGES = 100_000, 1_000_000


def contracts(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(list(INSPECTED_CONTRACTS))).select("id", "kind", "repo_id", "stable_key", "label")


def contract_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(contract, edge_id, direction, other): edges on either side of a contract."""
    c = contracts(nodes).select(F.col("id").alias("contract"))
    out = edges.join(c, F.col("source") == F.col("contract")).select("contract", F.col("id").alias("edge_id"), F.lit("outgoing").alias("direction"), F.col("target").alias("other"))
    back = edges.join(c, F.col("target") == F.col("contract")).select("contract", F.col("id").alias("edge_id"), F.lit("incoming").alias("direction"), F.col("source").alias("other"))
    return out.unionByName(back)


def contract_issues(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(code, severity, subject): what keeps links from proving a contract.

    Ends of edges that are no nodes (one row for each end), confidences that are no share (of edges and of evidence), links that
    are not confirmed, and evidence that an edge names but nobody observed (one row for each).
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | ~F.col(c).cast("double").between(0.0, 1.0)
    row = lambda df, code, severity, col="id": df.select(F.lit(f"contract.{code}").alias("code"), F.lit(severity).alias("severity"), F.col(col).alias("subject"))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    dangling = ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti")
    named = edges.select("id", F.explode("evidence").alias("evidence_id"))
    unseen = named.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")
    return (row(dangling, "dangling_edge", "error").unionByName(row(edges.where(bad("confidence")), "invalid_confidence", "error")).unionByName(row(edges.where("status <> 'confirmed'"), "unresolved_link", "unknown"))
            .unionByName(row(unseen, "evidence_not_observed", "unknown")).unionByName(row(evidence.where(bad("confidence")), "invalid_evidence_confidence", "error")))


def evidence_index(edges: DataFrame) -> DataFrame:
    """(evidence_id, edges): which edges a piece of evidence backs."""
    return edges.select(F.explode("evidence").alias("evidence_id"), "id").groupBy("evidence_id").agg(F.array_sort(F.collect_set("id")).alias("edges"))


def explain_link(edges: DataFrame, evidence: DataFrame, nodes: DataFrame, edge_id: str) -> DataFrame:
    """One row for each piece of evidence of an edge, with the names of its ends."""
    e = edges.where(F.col("id") == edge_id)
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    ev = evidence.select(F.col("id").alias("evidence_id"), "file_path", "start_line", "end_line")
    return e.withColumn("evidence_id", F.explode("evidence")).join(name("source"), "source").join(name("target"), "target").join(ev, "evidence_id", "left").select(
        F.col("id").alias("edge_id"), "kind", "status", "source_label", "target_label", "evidence_id", "file_path", "start_line", "end_line")


def exported(nodes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """Nodes by (stable_key, id) and edges by id, within the bounds; an edge needs both of its ends."""
    n = nodes.orderBy("stable_key", "id").limit(min(most_nodes, MOST_NODES))
    ids = n.select("id")
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return n, e.orderBy("id").limit(min(most_edges, MOST_EDGES))


def _xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, line) of a GraphML document: 1 for nodes, 2 for edges."""
    q = lambda name, c: F.concat(F.lit(f' {name}="'), _xml(F.coalesce(F.col(c), F.lit(""))), F.lit('"'))
    n = nodes.select(F.lit(1).alias("section"), F.concat(F.lit("<node"), q("id", "id"), F.lit(">"), F.lit('<data key="kind">'), _xml(F.col("kind")), F.lit('</data><data key="label">'), _xml(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("section"), F.concat(F.lit("<edge"), q("id", "id"), q("source", "source"), q("target", "target"), F.lit('><data key="kind">'), _xml(F.col("kind")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def markdown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, line) of a Markdown document."""
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    n = nodes.select(F.lit(1).alias("section"), F.concat_ws(" | ", F.lit("|"), safe("kind"), safe("label"), safe("stable_key"), F.lit("|")).alias("line"))
    return n.unionByName(edges.select(F.lit(2).alias("section"), F.concat_ws(" | ", F.lit("|"), safe("source"), safe("kind"), safe("target"), F.lit("|")).alias("line")))


def write_export(nodes: DataFrame, edges: DataFrame, path: str, form: str = "json") -> None:
    """Writes path/nodes and path/edges as JSON, or path as lines of GraphML or Markdown in order."""
    if form == "json":
        nodes.write.json(f"{path}/nodes")
        edges.write.json(f"{path}/edges")
    else:
        (graphml if form == "graphml" else markdown)(nodes, edges).orderBy("section", "line").select("line").write.text(path)


# --- freshness, doctor, status --------------------------------------------------------------------------------------

#: The first condition that holds names the state.
STATES = ("unavailable", "corrupt", "config_changed", "extractor_changed", "commits_behind", "working_tree_changed")


def freshness(repos: DataFrame) -> DataFrame:
    """repos(repo_id, and a boolean for each of STATES) with state: the first that holds, else fresh."""
    state = F.lit("fresh")
    for s in reversed(STATES):
        state = F.when(F.col(s), s).otherwise(state)
    return repos.select("repo_id", state.alias("state"))


def freshness_summary(states: DataFrame) -> DataFrame:
    """One row: fresh if all are; unknown if any is unknown, unavailable or corrupt; then partial if any is; else stale."""
    a = states.agg(
        F.bool_and(F.col("state") == "fresh").alias("all"), F.bool_or(F.col("state").isin("unavailable", "corrupt", "unknown")).alias("lost"), F.bool_or(F.col("state") == "partial").alias("part"), F.count("*").alias("repositories"),
        F.count_if(F.col("state") == "fresh").alias("fresh"))
    overall = F.when((F.col("repositories") == 0) | F.col("lost"), "unknown").when(F.col("all"), "fresh").when(F.col("part"), "partial").otherwise("stale")
    return a.select(overall.alias("overall"), "repositories", "fresh")


def status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(repo_id, state, before): current repositories with their former state; ones that are gone are unavailable."""
    b = previous.select("repo_id", F.col("state").alias("before"))
    now = current.select("repo_id", "state").join(b, "repo_id", "left")
    gone = b.join(current.select("repo_id"), "repo_id", "left_anti").select("repo_id", F.lit("unavailable").alias("state"), "before")
    return now.unionByName(gone)


def doctor(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """(check, outcome, affected): failed before unknown before degraded before healthy."""
    ids = nodes.select("id")
    row = lambda df, name, bad: df.agg(F.count("*").alias("affected")).select(F.lit(name).alias("check"), F.when(F.col("affected") > 0, bad).otherwise("healthy").alias("outcome"), "affected")
    dangling = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("id").unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("id")).distinct()
    parts = [row(dangling, "integrity", "failed"), row(nodes.groupBy("id").count().where("count > 1"), "identity", "failed"), row(states.where("state not in ('fresh', 'unavailable')"), "freshness", "degraded"), row(states.where("state = 'unavailable'"), "availability", "unknown")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall(checks: DataFrame) -> DataFrame:
    order = ("failed", "unknown", "degraded", "healthy")
    return checks.agg(F.min(F.array_position(F.array(*map(F.lit, order)), F.col("outcome"))).alias("r")).select(F.coalesce(F.element_at(F.array(*map(F.lit, order)), F.col("r").cast("int")), F.lit("unknown")).alias("outcome"))


def envelope(data: DataFrame, states: DataFrame, warnings: Sequence[str] = ()) -> dict:
    """The result wrapper of the Python API: data stays a DataFrame."""
    f = freshness_summary(states).first()
    return {"schema_version": 1, "status": "ok" if f.overall == "fresh" else "partial", "data": data, "freshness": f.asDict(), "warnings": list(warnings)}


#: Kinds of edges that come first among a node's relations.
FIRST_RELATIONS = ("calls_remote", "depends_on_repository", "reads_table", "writes_table", "publishes", "subscribes", "delivers_to")


def relations(edges: DataFrame, nodes: DataFrame, node_id: str, most: int = 50, deliveries: DataFrame | None = None) -> DataFrame:
    """What a node is tied to: across repositories, then by workspace, then within one; delivery paths before observed edges; outgoing first.

    deliveries(id, source, target): derived event paths, which count as edges of kind delivers_to.
    """
    e = edges.select("id", "source", "target", "kind", F.lit(1).alias("_d"))
    if deliveries is not None:
        e = e.unionByName(deliveries.select("id", "source", "target", F.lit("delivers_to").alias("kind"), F.lit(0).alias("_d")))
    e = e.where((F.col("source") == node_id) | (F.col("target") == node_id)).withColumn("direction", F.when(F.col("source") == node_id, "outgoing").otherwise("incoming"))
    e = e.withColumn("other", F.when(F.col("direction") == "outgoing", F.col("target")).otherwise(F.col("source")))
    own = nodes.where(F.col("id") == node_id).select(F.col("repo_id").alias("_r"))  # one row
    e = e.join(nodes.select(F.col("id").alias("other"), "label", "repo_id"), "other").join(F.broadcast(own))
    scope = F.when(F.col("_r").isNull() | F.col("repo_id").isNull(), "workspace").when(F.col("_r") != F.col("repo_id"), "cross_repository").otherwise("local")
    place = F.array_position(F.array(F.lit("cross_repository"), F.lit("workspace"), F.lit("local")), scope) - 1
    kind = F.when(F.col("kind").isin(list(FIRST_RELATIONS)), 0).otherwise(1)
    digit = lambda c: c.cast("string")
    e = e.withColumn("scope", scope).withColumn("priority", F.concat(digit(place), digit(F.col("_d")), digit(F.when(F.col("direction") == "outgoing", 0).otherwise(1)), digit(kind)))
    return e.select("id", "kind", "direction", "scope", "other", "label", "priority").orderBy("priority", "kind", "id").limit(most)
