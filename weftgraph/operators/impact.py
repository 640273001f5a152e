"""Impact: certainty-aware propagation, aggregates, tests, coverage and risk."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import IMPACT_CONTRACTS, NOT_PROPAGATING
from ..sources.shared import written

#: States of freshness that are behind, but known.
BEHIND = ("working_tree_changed", "commits_behind", "config_changed", "extractor_changed", "provider_stale")
CLASSES = ("directly_dependent", "transitively_affected", "possibly_affected", "unknown_due_to_coverage")


def certainty(confirmed_confidence: float = 0.8) -> Column:
    """0 confirmed, 1 possible, 2 unknown."""
    sure = (F.col("status") == "confirmed") & (F.col("confidence") >= F.lit(confirmed_confidence).cast("float"))
    return F.when(sure, 0).when(F.col("status").isin("confirmed", "inferred", "ambiguous"), 1).otherwise(2)


def classification(sure: Column, depth: Column) -> Column:
    return F.when((sure == 0) & (depth == 1), CLASSES[0]).when(sure == 0, CLASSES[1]).when(sure == 1, CLASSES[2]).otherwise(CLASSES[3])


def class_rank(column: str = "classification") -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), F.col(column))


def impact(nodes: DataFrame, edges: DataFrame, target: str, *, direction: str = "upstream", max_depth: int = 8, confirmed_confidence: float = 0.8) -> DataFrame:
    """Items (id, kind, repo_id, stable_key, label, classification, depth, path) that a change of ``target`` reaches.

    A state is better if it is more certain, then nearer, then first in the order of edge ids.  A node that a later path
    reaches more certainly is spread from again.  ``contains`` is never walked up and then down, or the reverse.
    """
    spark = edges.sparkSession
    e = edges.where(~F.col("kind").isin(list(NOT_PROPAGATING))).withColumn("sure", certainty(confirmed_confidence))
    down = e.select(F.col("source").alias("node"), F.col("target").alias("next"), "id", "kind", "sure", F.lit(False).alias("reversed"))
    up = e.select(F.col("target").alias("node"), F.col("source").alias("next"), "id", "kind", "sure", F.lit(True).alias("reversed"))
    a = written({"downstream": down, "upstream": up}.get(direction) or down.unionByName(up), "adjacency")  # every round reads it
    state = "node string, sure int, depth int, path array<string>, visited array<string>, last_contains boolean, last_reversed boolean"
    frontier = spark.createDataFrame([(target, 0, 0, [], [target], False, False)], state)
    best = [frontier.select("node", "sure", "depth", "path")]  # what improved, round by round; the least counts
    for _ in range(max_depth + 32):
        if frontier.isEmpty():
            break
        s = frontier.withColumnRenamed("sure", "so_far").where(F.col("depth") < max_depth).join(a, "node").where(~F.array_contains("visited", F.col("next")))
        pivot = F.col("last_contains") & (F.col("kind") == "contains") & (F.col("last_reversed") != F.col("reversed"))
        s = s.where(~pivot).select(
            F.col("next").alias("node"), F.greatest("so_far", "sure").alias("sure"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("id")).alias("path"),
            F.concat("visited", F.array("next")).alias("visited"), (F.col("kind") == "contains").alias("last_contains"), F.col("reversed").alias("last_reversed"))
        s = s.groupBy("node").agg(F.min(F.struct("sure", "depth", "path", "visited", "last_contains", "last_reversed")).alias("x")).select("node", "x.*")
        old = reduce(DataFrame.unionByName, best).groupBy("node").agg(F.min(F.struct("sure", "depth")).alias("x")).select("node", F.col("x.sure").alias("_s"), F.col("x.depth").alias("_d"))
        better = s.join(old, "node", "left").where(F.col("_s").isNull() | (F.struct("sure", "depth") < F.struct(F.col("_s").alias("sure"), F.col("_d").alias("depth")))).drop("_s", "_d")
        frontier = written(better, "impact")
        best.append(frontier.select("node", "sure", "depth", "path"))
    found = reduce(DataFrame.unionByName, best).groupBy("node").agg(F.min(F.struct("sure", "depth", "path")).alias("x")).select("node", "x.*")
    out = found.where(F.col("node") != target).withColumnRenamed("node", "id").join(nodes, "id")
    return out.select("id", "kind", "repo_id", "stable_key", "label", classification(F.col("sure"), F.col("depth")).alias("classification"), "depth", "path")


ORDER = ("class_rank", "depth", "repo_id", "stable_key", "id")


def resolved_target(nodes: DataFrame, target: str) -> str:
    """The id that a target names: a node's own, or the stable key of exactly one node."""
    found = nodes.where((F.col("id") == target) | (F.col("stable_key") == target)).select("id", (F.col("id") == target).alias("own")).orderBy(F.desc("own"), "id").limit(3).collect()
    if found and found[0].own:
        return target
    if len(found) != 1:
        raise LookupError(f"{target!r} names {'several nodes' if found else 'no node'}")
    return found[0].id


def page(items: DataFrame, offset: int = 0, limit: int = 100, summary_only: bool = False) -> DataFrame:
    """Items in order (class, depth, repository, stable key, id, path) from offset on; none if only the summary is asked for."""
    rows = items.withColumn("class_rank", class_rank()).orderBy(*(F.asc_nulls_first(c) for c in ORDER), "path").drop("class_rank")
    return rows.limit(0) if summary_only else rows.offset(offset).limit(limit)


def _strongest(rows: DataFrame, *keys: str) -> DataFrame:
    g = rows.withColumn("_c", class_rank()).groupBy(*keys).agg(F.min("_c").alias("_c"), F.min("depth").alias("min_depth"), F.count("*").alias("items"))
    return g.withColumn("strongest", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("_c").cast("int"))).drop("_c")


def by_repository(items: DataFrame) -> DataFrame:
    return _strongest(items.where("repo_id is not null"), "repo_id")


def by_group(items: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Services or communities: members(group, node_id)."""
    return _strongest(items.join(members.select(group, F.col("node_id").alias("id")), "id"), group)


def by_contract(items: DataFrame) -> DataFrame:
    return items.where(F.col("kind").isin(list(IMPACT_CONTRACTS))).select("id", "kind", "stable_key", "classification", "depth")


def depth_buckets(items: DataFrame) -> DataFrame:
    return items.groupBy("depth").pivot("classification", list(CLASSES)).count().na.fill(0)


def tests(items: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rank, test_id, label, classification, depth, command, owners): tests that validate an item, the closest first, with who owns them."""
    t = nodes.where("kind = 'test_case'").select(F.col("id").alias("test_id"), "label", F.col("stable_key").alias("test_key"))
    v = edges.where("kind = 'validates'")
    link = v.select(F.col("source").alias("test_id"), F.col("target").alias("id")).unionByName(v.select(F.col("target").alias("test_id"), F.col("source").alias("id")))
    hit = link.join(items.select("id", "classification", "depth"), "id").join(t, "test_id").withColumn("_c", class_rank())
    one = written(hit.groupBy("test_id", "label", "test_key").agg(F.min(F.struct("_c", "depth", "classification")).alias("x")).select("test_id", "label", "test_key", "x.*"), "tests")
    command = F.when(F.col("label").endswith(".py"), F.concat(F.lit("pytest "), "label")).when(F.col("label").endswith(".rs"), F.lit("cargo test"))
    owns = edges.where("kind = 'owned_by'").join(one.select(F.col("test_id").alias("source")), "source", "left_semi").groupBy(F.col("source").alias("test_id")).agg(F.array_sort(F.collect_set("target")).alias("owners"))
    # places from counts: as many rows as classes and depths, and within each the keys in order
    groups = one.groupBy("_c", "depth").agg(F.count_distinct("test_key").alias("n"))
    before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_c", "depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.col("before") + F.dense_rank().over(Window.partitionBy("_c", "depth").orderBy("test_key"))
    ranked = one.join(F.broadcast(before), ["_c", "depth"]).withColumn("rank", place.cast("int")).join(owns, "test_id", "left")
    return ranked.select("rank", "test_id", "label", "classification", "depth", command.alias("command"), F.coalesce("owners", F.array().cast("array<string>")).alias("owners"))


def worst_freshness(rows: DataFrame, severity: Column) -> DataFrame:
    """The worst state of each repository; the first of equal ones."""
    return rows.groupBy("repo_id").agg(F.max_by("state", F.struct(severity.alias("s"), (-F.col("seq")).alias("o"))).alias("state"))


def coverage(
    items: DataFrame, freshness: DataFrame, target_repo: str | None = None, *, possible_edges: int = 0, unknown_edges: int = 0, graph_complete: bool = True, unknown_compatibility: int = 0, gaps: Sequence[str] = (),
) -> DataFrame:
    """One row: how many of the repositories of the items and the target are fresh, stale, partial, unavailable or missing, the gaps, and
    whether a number may be given.  possible_edges tell of a gap that does not take the number away.
    """
    r = items.select("repo_id")
    if target_repo is not None:
        r = r.unionByName(items.sparkSession.createDataFrame([(target_repo,)], "repo_id string"))
    r = r.where("repo_id is not null").distinct().join(freshness.select("repo_id", "state"), "repo_id", "left")
    group = (F.when(F.col("state") == "fresh", "fresh").when(F.col("state").isin(*BEHIND), "stale").when(F.col("state") == "partial", "partial").when(F.col("state").isin("unavailable", "corrupt"), "unavailable").otherwise("missing"))
    names = ("fresh", "stale", "partial", "unavailable", "missing")
    out = r.select(group.alias("g")).agg(*(F.count_if(F.col("g") == g).alias(g) for g in names))
    told = [F.lit(g) for g in gaps] + ([] if graph_complete else [F.lit("graph_incomplete")]) + [F.when(F.col(g) > 0, f"repositories_{g}") for g in names[1:]]
    told += [F.lit("possible_relationships")] * (possible_edges > 0) + [F.lit("unknown_relationships")] * (unknown_edges > 0) + [F.lit("compatibility_unknown")] * (unknown_compatibility > 0)
    sure = F.lit(graph_complete and not unknown_edges and not unknown_compatibility and not gaps)
    return out.withColumn("gaps", F.array_compact(F.array(*told))).withColumn("sufficient_for_score", sure & (F.col("stale") + F.col("partial") + F.col("unavailable") + F.col("missing") == 0))


#: Weight for each tag that makes a node critical.
TAGS = {"critical": 55.0, "authentication": 35.0, "security": 50.0, "payment": 50.0, "data_boundary": 45.0}
EXPLICIT = ("critical_tag", "security_tag", "payment_tag", "data_boundary_tag")


def risk_factors(
    items: DataFrame, target_repo: str | None = None, *, target_id: str | None = None, services: DataFrame | None = None, communities: DataFrame | None = None, public: int = 0, compatibility: DataFrame | None = None, centrality: float = 0.0,
    tags: DataFrame | None = None, n_tests: int | None = None, n_owners: int | None = None, environments: int = 0,
) -> DataFrame:
    """(code, weight, backed): what adds to the risk, each bounded; backed: whether evidence stands behind a tag.

    services(service_id): reached ones; communities(community_id, coupling): reached ones; compatibility(node_id, status);
    tags(node_id, tag, evidence array<string>): each one adds; target_id: the changed node, whose own tags and reports count.
    """
    ids = items.select(F.col("id").alias("node_id"))
    if target_id is not None:
        ids = ids.unionByName(items.sparkSession.createDataFrame([(target_id,)], "node_id string")).distinct()
    spark = items.sparkSession
    count = lambda cond: F.count_if(cond)
    repos = F.count_distinct(F.coalesce("repo_id", F.lit(target_repo))) if target_repo is None else F.size(F.array_distinct(F.array_append(F.collect_set("repo_id"), F.lit(target_repo))))
    base = items.agg(count(F.col("classification") == CLASSES[0]).alias("d"), count(F.col("classification") == CLASSES[1]).alias("t"), repos.alias("r"), F.count("*").alias("n"))
    row = lambda code, weight: F.struct(F.lit(code).alias("code"), weight.cast("double").alias("weight"))
    cap = lambda x, by, most: F.least(x * by, F.lit(float(most)))
    parts = [
        row("direct_consumers", cap(F.col("d"), 4.0, 24)), row("transitive_fanout", cap(F.col("t"), 1.5, 15)), row("cross_repository_count", cap(F.greatest(F.col("r") - 1, F.lit(0)), 4.0, 16)),
        row("missing_tests", F.when(F.lit(n_tests == 0) & (F.col("n") > 0), 10.0).otherwise(0.0)), row("missing_owners", F.when(F.lit(n_owners == 0) & (F.col("n") > 0), 8.0).otherwise(0.0))]
    frames = [base.select(F.explode(F.array(*parts)).alias("x")).select("x.*")]
    if services is not None:
        frames.append(services.agg(F.least(F.count_distinct("service_id") * 2.0, F.lit(10.0)).alias("weight")).select(F.lit("service_impact").alias("code"), "weight"))
    if communities is not None:
        frames.append(communities.agg(F.least(F.count_if(F.col("coupling") > 0) * 3.0, F.lit(9.0)).alias("weight")).select(F.lit("community_process_fanout").alias("code"), "weight"))
    if compatibility is not None:
        hit = compatibility.join(ids, "node_id", "left_semi")
        frames.append(hit.select(F.when(F.col("status") == "breaking", "breaking_compatibility").when(F.col("status") == "potentially_breaking", "potential_compatibility").alias("code"),
                                 F.when(F.col("status") == "breaking", 30.0).when(F.col("status") == "potentially_breaking", 18.0).otherwise(0.0).alias("weight")))
    if tags is not None:
        weight = F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv))
        hit = tags.join(ids, "node_id", "left_semi")
        frames.append(hit.select(F.concat("tag", F.lit("_tag")).alias("code"), F.coalesce(weight[F.col("tag")], F.lit(0.0)).alias("weight"), (F.size("evidence") > 0).alias("backed")))
    fixed = [("public_contract", 12.0 if public > 0 else 0.0), ("centrality", centrality * 12.0 if centrality >= 0.75 else 0.0), ("cross_environment", 10.0 if environments > 1 else 0.0)]
    frames.append(spark.createDataFrame(fixed, "code string, weight double"))
    frames = [f if "backed" in f.columns else f.withColumn("backed", F.lit(False)) for f in frames]
    return reduce(DataFrame.unionByName, frames).where("weight > 0")


def risk_score(factors: DataFrame, sufficient: bool | Column) -> DataFrame:
    """One row (score, level): 1 to 100, or no number where coverage does not allow one.  critical needs a tag with evidence."""
    ok = F.lit(sufficient) if isinstance(sufficient, bool) else sufficient
    s = factors.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"), F.coalesce(F.bool_or(F.col("code").isin(*EXPLICIT) & F.col("backed")), F.lit(False)).alias("explicit"))
    s = s.withColumn("score", F.greatest(F.least("s", F.lit(100.0)), F.lit(1.0)))
    level = F.when(~ok, "unknown").when((F.col("score") >= 85) & F.col("explicit"), "critical").when(F.col("score") >= 50, "high").when(F.col("score") >= 25, "medium").otherwise("low")
    return s.select(level.alias("level"), F.when(ok, F.col("score")).alias("score"))
