"""From observations to the graph: what links and declarations say, as edges; families put together, checked and ready to publish.

Every function takes the rows of extractors or of linking and gives edges (id, source, target, kind, confidence, status, evidence).
Edges that say the same are one: the greatest confidence, all evidence, confirmed only if certain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from .linking import assembled, exactly_one, merged_edges, validated

EDGE_COLUMNS = ("id", "source", "target", "kind", "confidence", "status", "evidence")


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit(">"), kind, F.lit(">"), target)


def edges_of(rows: DataFrame, source: Column, target: Column, kind: Column, confidence: Column | None = None, evidence: str = "evidence") -> DataFrame:
    """Merged edges of rows; rows whose kind is null say nothing.  evidence: a column with an array of ids."""
    e = rows.select(source.alias("source"), target.alias("target"), kind.alias("kind"), (F.lit(1.0) if confidence is None else confidence).cast("float").alias("confidence"), F.col(evidence).alias("evidence"))
    e = e.where("source is not null and target is not null and kind is not null")
    return merged_edges(e.withColumn("id", edge_id(F.col("source"), F.col("kind"), F.col("target")))).select(*EDGE_COLUMNS)


def http_edges(linked: DataFrame) -> DataFrame:
    """linked(call, provider, role, call_confidence, provider_confidence, evidence): clients call, tests validate, handlers implement the provider."""
    own, other, role = F.col("call"), F.col("provider"), F.col("role")
    kind = F.when(role == "client", "calls_remote").when(role == "test", "validates").when(role == "handler", "implemented_by")
    back = role == "handler"
    return edges_of(linked, F.when(back, other).otherwise(own), F.when(back, own).otherwise(other), kind, F.least("call_confidence", "provider_confidence"))


def resolver_edges(resolvers: DataFrame, providers: DataFrame) -> DataFrame:
    """resolvers(resolver, repo_id, coordinate, evidence) against providers(provider, repo_id, coordinate, seq): the first provider of the
    repository that has the coordinate is implemented by the resolver."""
    first = providers.groupBy("repo_id", "coordinate").agg(F.min(F.struct("seq", "provider")).alias("x")).select("repo_id", "coordinate", "x.provider")
    hit = resolvers.join(first, ["repo_id", "coordinate"])
    return edges_of(hit, F.col("provider"), F.col("resolver"), F.lit("implemented_by"))


def rpc_edges(markers: DataFrame, methods: DataFrame) -> DataFrame:
    """markers(marker, role, service, method, evidence) against methods(id, service, method): exactly one method; its role decides the direction."""
    hit = markers.join(exactly_one(methods, ["service", "method"]), ["service", "method"])
    role, own, rpc = F.col("role"), F.col("marker"), F.col("id")
    return edges_of(hit, F.when(role == "server", rpc).otherwise(own), F.when(role == "server", own).otherwise(rpc), F.when(role == "client", "calls_remote").when(role == "server", "implemented_by"))


def event_edges(ends: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """ends(node, artifact, channel, role, dead_letter, evidence) and schemas(channel, schema, evidence).

    A publisher publishes; a subscriber subscribes, and the channel delivers to it; a declaration's artifact contains the channel; a
    channel calls its dead letter channel and contains its schemas.
    """
    node, channel, role = F.col("node"), F.col("channel"), F.col("role")
    parts = [
        edges_of(ends, node, channel, F.when(role == "publisher", "publishes").when(role == "subscriber", "subscribes")), edges_of(ends.where("role = 'subscriber'"), channel, node, F.lit("delivers_to")),
        edges_of(ends.where("role = 'declaration'"), F.col("artifact"), channel, F.lit("contains")), edges_of(ends.where("dead_letter is not null"), channel, F.col("dead_letter"), F.lit("calls_remote"))]
    if schemas is not None:
        parts.append(edges_of(schemas, channel, F.col("schema"), F.lit("contains")))
    return reduce(DataFrame.unionByName, parts)


def package_edges(dependencies: DataFrame) -> DataFrame:
    """dependencies(manifest, package, dependency, confidence, evidence): the manifest contains its package, which depends on others."""
    contains = edges_of(dependencies, F.col("manifest"), F.col("package"), F.lit("contains"), F.col("confidence"))
    return contains.unionByName(edges_of(dependencies, F.col("package"), F.col("dependency"), F.lit("depends_on_package"), F.col("confidence")))


def data_edges(accesses: DataFrame, tables: DataFrame) -> DataFrame:
    """accesses(symbol, role, table_name, model, evidence) against tables(id, alias): readers, writers and model bindings.

    An access without a table takes that of its model, if all bindings of the model name one.  A name that several tables answer
    to links nothing, nor does a declaration.
    """
    bound = exactly_one(accesses.where("role = 'model_binding' and table_name is not null and model is not null").select("model", F.lower("table_name").alias("bound")), ["model"], "bound")
    one = exactly_one(tables.select(F.lower("alias").alias("name"), "id"), ["name"])
    a = accesses.join(bound, "model", "left").withColumn("name", F.coalesce(F.lower(F.nullif("table_name", F.lit(""))), "bound"))
    hit = a.join(one, "name")
    role, back = F.col("role"), F.col("role") == "model_binding"
    kind = F.when(role == "reader", "reads_table").when(role == "writer", "writes_table").when(back, "implemented_by")
    return edges_of(hit, F.when(back, F.col("id")).otherwise(F.col("symbol")), F.when(back, F.col("symbol")).otherwise(F.col("id")), kind)


def owners(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ownership rules(document, owners array<string>, evidence): a node for each owner, who owns the document."""
    r = rules.select("document", F.explode("owners").alias("owner"), "evidence")
    r = r.withColumn("key", F.concat(F.lit("owner:"), F.lower("owner"))).withColumn("owner_id", stable_id("node", F.col("key")))
    nodes = r.groupBy(F.col("owner_id").alias("id")).agg(F.first("key").alias("stable_key"), F.min("owner").alias("label")).select("id", F.lit("owner").alias("kind"), F.lit(None).cast("string").alias("repo_id"), "stable_key", "label")
    return nodes, edges_of(r, F.col("document"), F.col("owner_id"), F.lit("owned_by"))


def corroborated(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges with the evidence that an outside provider has found(source, target, evidence_id), on existing implemented_by edges only."""
    f = found.groupBy("source", "target").agg(F.array_sort(F.collect_set("evidence_id")).alias("_more"))
    more = F.when(F.col("kind") == "implemented_by", F.col("_more"))
    none = F.array().cast("array<string>")
    return edges.join(f, ["source", "target"], "left").withColumn("evidence", F.array_sort(F.array_union("evidence", F.coalesce(more, none)))).select(*edges.columns)


def graph(node_families: Sequence[DataFrame], edge_families: Sequence[DataFrame], evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, problems): the last family's nodes, the first family's edges, and what validation finds."""
    nodes, edges = assembled(node_families, first_wins=False), assembled(edge_families, first_wins=True)
    return nodes, edges, validated(nodes, edges, evidence)
