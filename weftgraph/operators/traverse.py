"""Paths through the graph: trace, bounded and weighted traversal, ownership.

Every level is a join of the frontier with the edges and a map-side aggregation; the frontier is written to the shared folder,
so that plans stay short.  Ties are settled by the sequence of edge ids, which orders states as a queue would.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

MOST_DEPTH, MOST_K = 128, 16
GENERATED = r"/(?:generated|gen|dist|build|target|node_modules|vendor|__generated__)/"


def adjacency(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """edges with (node, neighbor, reversed): outgoing, incoming, or both with self-loops once."""
    out = edges.withColumns({"node": F.col("source"), "neighbor": F.col("target"), "reversed": F.lit(False)})
    back = edges.withColumns({"node": F.col("target"), "neighbor": F.col("source"), "reversed": F.lit(True)})
    if direction == "outgoing":
        return out
    return back if direction == "incoming" else out.unionByName(back.where("source <> target"))


def trace(edges: DataFrame, source: str, target: str, max_depth: int = 8) -> DataFrame:
    """(step, edge_id, source, target, kind): the first shortest path along outgoing edges of any status; no rows without one."""
    spark = edges.sparkSession
    e = written(edges.select("source", F.col("id").alias("edge_id"), "target"), "adjacency")  # every level reads it
    frontier = spark.createDataFrame([(source, [])], "node string, path array<string>")
    seen = [frontier.select("node")]
    found = None
    for _ in range(max_depth):
        step = frontier.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.concat("path", F.array("edge_id")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).join(reduce(DataFrame.unionByName, seen), "node", "left_anti")
        frontier = written(step, "frontier")
        hit = frontier.where(F.col("node") == target).select("path").first()
        if hit:
            found = hit.path
            break
        if frontier.isEmpty():
            break
        seen.append(frontier.select("node"))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(found or [])], "step int, edge_id string")
    return F.broadcast(rows).join(edges.select(F.col("id").alias("edge_id"), "source", "target", "kind"), "edge_id").select("step", "edge_id", "source", "target", "kind")


def generated_artifact(key: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(key)).rlike(GENERATED) | F.lower(key).rlike(r"\.generated\.|_pb2|\.pb\.")


def allowed_nodes(nodes: DataFrame, include_tests: bool = True, include_generated: bool = True, namespaces: Sequence[str] = ()) -> DataFrame:
    """Nodes that a traversal may enter."""
    out = nodes if include_tests else nodes.where("kind <> 'test_case'")
    out = out if include_generated else out.where(~((F.col("kind") == "artifact") & generated_artifact(F.col("stable_key"))))
    if namespaces:
        out = out.where((F.col("kind") != "deployment") | F.get(F.split("stable_key", ":", 4), F.lit(2)).isin(list(namespaces)))
    return out


def split_edges(edges: DataFrame, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(confirmed edges, candidates): other states are reported, never walked."""
    e = edges.where(F.col("kind").isin(list(kinds))) if kinds else edges
    e = e.where(F.col("confidence").cast("double") >= min_confidence)
    return e.where("status = 'confirmed'"), e.where("status <> 'confirmed'")


def edge_weight(costs: dict[str, float] | None = None) -> Column:
    cost = F.lit(1.0)
    if costs:
        table = F.create_map(*(F.lit(x) for kv in costs.items() for x in kv))
        cost = F.coalesce(table[F.col("kind")], F.lit(1.0))
    return cost / F.greatest(F.col("confidence").cast("double"), F.lit(0.01))


def paths(
    nodes: DataFrame, edges: DataFrame, source: str, *, max_depth: int = 8, max_cross: int = 4, direction: str = "outgoing", kinds: Sequence[str] = (), min_confidence: float = 0.0,
    costs: dict[str, float] | None = None, only: str | None = None,
) -> DataFrame:
    """All loopless confirmed paths from a node within the bounds: (node, depth, weight, cross, nodes, edge_ids).

    These grow with every level.  only = "shortest" or "lightest" keeps what the first of the shortest or lightest path to any node
    can go through: one state for each node, number of crossings and level.
    """
    # ties: shortest ones by edge ids, lightest ones by nodes, then edge ids
    best_by = {None: (), "shortest": ("edge_ids",), "lightest": ("_weight", "nodes", "edge_ids")}[only]
    confirmed, _ = split_edges(edges, kinds, min_confidence)
    repo = nodes.select(F.col("id").alias("neighbor"), F.col("repo_id").alias("_r2"))
    a = adjacency(confirmed, direction).withColumn("w", edge_weight(costs)).select("node", "neighbor", F.col("id").alias("edge_id"), "w")
    a = written(a.join(repo, "neighbor"), "adjacency")  # an end that isn't among the nodes can't be entered; every level reads it
    start = nodes.where(F.col("id") == source).select(
        F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("weight"), F.lit(0).alias("cross"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edge_ids"), F.col("repo_id").alias("_r"))
    levels, now = [start], start
    for _ in range(min(max_depth, MOST_DEPTH)):
        s = now.join(a, "node").where(~F.array_contains("nodes", F.col("neighbor")))
        hop = (~F.col("_r").eqNullSafe(F.col("_r2"))).cast("int")
        s = s.select(
            F.col("neighbor").alias("node"), (F.col("depth") + 1).alias("depth"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("cross") + hop).alias("cross"),
            F.concat("nodes", F.array("neighbor")).alias("nodes"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.col("_r2").alias("_r")).where(F.col("cross") <= max_cross)
        if only == "lightest":
            s = s.withColumn("_weight", F.round("weight", 9))
        if best_by:  # one state for each node and number of crossings, unless an earlier level has one that is as good
            s = s.groupBy("node", "cross").agg(F.min(F.struct(*best_by, "depth", "weight", "_r", *(c for c in ("nodes", "edge_ids") if c not in best_by))).alias("x")).select("node", F.col("x.depth"), F.col("x.weight"), "cross", F.col("x.nodes"), F.col("x.edge_ids"), F.col("x._r"))
            old = reduce(DataFrame.unionByName, levels).select("node", F.col("cross").alias("_c"), F.col("weight").alias("_w"))
            worse = (F.col("_c") <= F.col("cross")) & (F.lit(True) if best_by[0] == "edge_ids" else F.col("_w") < F.col("weight") - 1e-9)
            s = s.join(old.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & worse, "left_anti")
        now = written(s, "paths")
        if now.isEmpty():
            break
        levels.append(now)
    return reduce(DataFrame.unionByName, levels).drop("_r").where("depth > 0")


def shortest(found: DataFrame) -> DataFrame:
    """The first of the shortest paths to each node."""
    w = Window.partitionBy("node").orderBy("depth", "edge_ids")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def k_best(found: DataFrame, k: int = 1) -> DataFrame:
    """The k lightest paths to each node, chosen by weight, nodes and edge ids, and then put in order by weight, length and edge ids."""
    weight = F.round("weight", 9)
    w = Window.partitionBy("node").orderBy(weight, "nodes", "edge_ids")
    chosen = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= min(k, MOST_K)).drop("_n")
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(weight, "depth", "edge_ids", "nodes")))


def deepest_layer(found: DataFrame) -> DataFrame:
    """Nodes of the deepest layer by their least depth."""
    near = found.groupBy("node").agg(F.min("depth").alias("depth"))
    deepest = near.agg(F.max("depth").alias("depth"))
    return near.join(F.broadcast(deepest), "depth").select("node", "depth")


def ownership(contains: DataFrame, owned: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, repo_id): repositories that own a node directly, else through what contains it; several may.

    contains(parent, child), confirmed; owned(node, repo_id), direct.  Direct owners win over inherited ones.  Rounds go on until nothing is new, as many as the containment is deep.
    """
    contains = written(contains.select("parent", "child").distinct(), "contains")
    known = written(owned.select("node", "repo_id").distinct(), "owners")
    frontier = known
    for _ in range(max_rounds):
        new = frontier.join(contains, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "repo_id").distinct()
        new = written(new.join(owned.select("node").distinct(), "node", "left_anti").join(known, ["node", "repo_id"], "left_anti"), "owners")
        if new.isEmpty():
            break
        known, frontier = known.unionByName(new), new  # the rounds before are written tables
    else:
        raise RuntimeError(f"ownership: not settled after {max_rounds} rounds")
    return known
