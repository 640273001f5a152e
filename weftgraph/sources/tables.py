"""The driver's tables, and the graph that they stand for.

Repositories are nations, services suppliers, HTTP operations orders, symbols customers, packages parts, owners regions.  Customers
consume their orders, orders call the services and depend on the packages of their lines, nations contain customers and services,
services and customers are owned by regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _key(prefix: str, *parts: str | Column) -> Column:
    return F.concat(F.lit(prefix), *(p if isinstance(p, Column) else _s(p) for p in parts))


def nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All nodes, or those of some kinds: only their tables are read."""

    def made(df: DataFrame, kind: str, id_: Column, repo: Column, key: Column, label: Column) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), repo.cast("string").alias("repo_id"), key.alias("stable_key"), label.alias("label"))

    t = lambda name: table(spark, sf_dir, name)
    colon, none = F.lit(":"), F.lit(None)
    makers = {
        "repository": lambda: made(t("nation"), "repository", _key("nation:", "n_nationkey"), _key("nation-", "n_nationkey"), _key("repository:nation-", "n_nationkey"), F.col("n_name")),
        "owner": lambda: made(t("region"), "owner", _key("region:", "r_regionkey"), none, _key("owner:", F.lower("r_name")), F.col("r_name")),
        "service": lambda: made(t("supplier"), "service", _key("supplier:", "s_suppkey"), _key("nation-", "s_nationkey"), _key("service:nation-", _s("s_nationkey"), colon, F.lower("s_name")), F.col("s_name")),
        "symbol_ref": lambda: made(t("customer"), "symbol_ref", _key("customer:", "c_custkey"), _key("nation-", "c_nationkey"), _key("symbol:nation-", _s("c_nationkey"), colon, F.lower("c_name")), F.col("c_name")),
        "http_operation": lambda: made(
            t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), "http_operation", _key("order:", "o_orderkey"), _key("nation-", "c_nationkey"),
            _key("http:nation-", _s("c_nationkey"), F.lit(":provider:POST:/orders/"), _s("o_orderkey")), _key("POST /orders/", "o_orderkey")),
        "package": lambda: made(t("part"), "package", _key("part:", "p_partkey"), none, _key("package:", F.lower("p_brand"), colon, _s("p_partkey")), F.col("p_name")),
        "document": lambda: made(t("documents"), "document", _key("doc:", "doc_id"), F.col("source"), _key("document:", F.col("source"), colon, _s("doc_id")), _key("", F.col("lang"), F.lit(" document "), _s("doc_id"))),
    }
    out = None
    for kind, make in makers.items():
        if kinds is None or kind in kinds:
            out = make() if out is None else out.unionByName(make())
    return out


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All edges, or those of some kinds.  Several lines between the same two ends become one edge of the least confidence."""
    t = lambda name: table(spark, sf_dir, name)

    def made(df: DataFrame, kind: str, source: Column, target: Column, pct: Column, status: Column) -> DataFrame:
        out = df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), (pct / 100.0).cast("float").alias("confidence"), status.alias("status"))
        id_ = F.concat_ws("", "source", F.lit(f">{kind}>"), "target")
        return out.select(id_.alias("id"), "source", "target", "kind", "confidence", "status", F.array(F.concat(F.lit("ev:"), id_)).alias("evidence"))

    sure, confirmed = F.lit(100), F.lit("confirmed")
    worst = F.min(F.concat("l_returnflag", "l_linestatus"))
    status = F.when(F.col("flag").isin("AF", "NF", "NO"), "confirmed").when(F.col("flag") == "AO", "inferred").when(F.col("flag") == "RF", "ambiguous").otherwise("stale")

    def of_lines(kind: str, key: str, prefix: str) -> DataFrame:
        lines = t("lineitem").groupBy("l_orderkey", key).agg(F.max(F.round(F.col("l_discount") * 100).cast("int")).alias("pct"), worst.alias("flag"))
        return made(lines, kind, _key("order:", "l_orderkey"), _key(prefix, key), 100 - 5 * F.col("pct"), status)

    nation, customer, supplier = (lambda: t("nation")), (lambda: t("customer")), (lambda: t("supplier"))
    makers = {
        "consumes": lambda: [made(t("orders"), "consumes", _key("customer:", "o_custkey"), _key("order:", "o_orderkey"), sure, confirmed)],
        "calls_remote": lambda: [of_lines("calls_remote", "l_suppkey", "supplier:")],
        "depends_on_package": lambda: [of_lines("depends_on_package", "l_partkey", "part:")],
        "contains": lambda: [
            made(customer(), "contains", _key("nation:", "c_nationkey"), _key("customer:", "c_custkey"), sure, confirmed),
            made(supplier(), "contains", _key("nation:", "s_nationkey"), _key("supplier:", "s_suppkey"), sure, confirmed)],
        "owned_by": lambda: [
            made(customer().join(nation(), F.col("c_nationkey") == F.col("n_nationkey")), "owned_by", _key("customer:", "c_custkey"), _key("region:", "n_regionkey"), sure, confirmed),
            made(supplier().join(nation(), F.col("s_nationkey") == F.col("n_nationkey")), "owned_by", _key("supplier:", "s_suppkey"), _key("region:", "n_regionkey"), sure, confirmed)],
    }
    out = None
    for kind, make in makers.items():
        if kinds is None or kind in kinds:
            for df in make():
                out = df if out is None else out.unionByName(df)
    return out


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of evidence for each edge from a customer to an order: a few lines of a source file."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    start = (F.col("o_orderkey") % 500 + 1).cast("int")
    return o.select(
        F.concat(F.lit("ev:customer:"), _s("o_custkey"), F.lit(">consumes>order:"), _s("o_orderkey")).alias("id"), _key("nation-", "c_nationkey").alias("repo_id"),
        F.concat(F.lit("src/customer_"), _s(F.col("o_custkey") % 97), F.lit(".py")).alias("file_path"), start.alias("start_line"), (start + F.col("o_orderkey") % 7).cast("int").alias("end_line"),
        F.lit("orders").alias("extractor"), F.lit("1").alias("extractor_version"), F.lit("static").alias("provenance"), F.lit(1.0).cast("float").alias("confidence"),
        F.lit(None).cast("string").alias("observed_at_commit"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("note"))


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id and state: by how long ago, in days before the last event of all, the repository's last event is."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25).alias("n")).agg(F.max("ts").alias("last"))
    newest = table(spark, sf_dir, "events").agg(F.max("ts").alias("newest"))  # one row
    hours = F.floor((F.unix_timestamp("newest") - F.unix_timestamp("last")) / 3600)
    state = F.when(hours < 2, "fresh").when(hours < 6, "working_tree_changed").when(hours < 12, "commits_behind").when(hours < 24, "partial").otherwise("unavailable")
    return e.join(F.broadcast(newest)).select(_key("nation-", "n").alias("repo_id"), state.alias("state"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(community_id, node_id): suppliers and customers by region and parity of their key."""
    n = table(spark, sf_dir, "nation")
    part = lambda df, nation, key, prefix: df.join(n, F.col(nation) == F.col("n_nationkey")).select(
        _key("community:", _s("n_regionkey"), F.lit("-"), _s(F.col(key) % 2)).alias("community_id"), _key(prefix, key).alias("node_id"))
    return part(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "supplier:").unionByName(part(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "customer:"))


#: The same in DuckDB SQL, for the oracles: WITH <GRAPH>, ...
GRAPH = """
nodes AS (
  SELECT 'nation:' || n_nationkey AS id, 'repository' AS kind, 'nation-' || n_nationkey AS repo_id, 'repository:nation-' || n_nationkey AS stable_key, n_name AS label FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'owner', NULL, 'owner:' || lower(r_name), r_name FROM region
  UNION ALL SELECT 'supplier:' || s_suppkey, 'service', 'nation-' || s_nationkey, 'service:nation-' || s_nationkey || ':' || lower(s_name), s_name FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'symbol_ref', 'nation-' || c_nationkey, 'symbol:nation-' || c_nationkey || ':' || lower(c_name), c_name FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'http_operation', 'nation-' || c_nationkey, 'http:nation-' || c_nationkey || ':provider:POST:/orders/' || o_orderkey, 'POST /orders/' || o_orderkey
    FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'part:' || p_partkey, 'package', NULL, 'package:' || lower(p_brand) || ':' || p_partkey, p_name FROM part
  UNION ALL SELECT 'doc:' || doc_id, 'document', source, 'document:' || source || ':' || doc_id, lang || ' document ' || doc_id FROM documents),
raw_edges AS (
  SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, 'consumes' AS kind, 100 AS pct, 'confirmed' AS status FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, x.target, x.kind, 100 - 5 * pct, CASE WHEN flag IN ('AF', 'NF', 'NO') THEN 'confirmed' WHEN flag = 'AO' THEN 'inferred' WHEN flag = 'RF' THEN 'ambiguous' ELSE 'stale' END
    FROM (SELECT l_orderkey, 'supplier:' || l_suppkey AS target, 'calls_remote' AS kind, max(CAST(round(l_discount * 100) AS INT)) AS pct, min(l_returnflag || l_linestatus) AS flag FROM lineitem GROUP BY l_orderkey, l_suppkey
      UNION ALL SELECT l_orderkey, 'part:' || l_partkey, 'depends_on_package', max(CAST(round(l_discount * 100) AS INT)), min(l_returnflag || l_linestatus) FROM lineitem GROUP BY l_orderkey, l_partkey) AS x
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 100, 'confirmed' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 100, 'confirmed' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey, 'owned_by', 100, 'confirmed' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey, 'owned_by', 100, 'confirmed' FROM supplier JOIN nation ON s_nationkey = n_nationkey),
edges AS (
  SELECT source || '>' || kind || '>' || target AS id, source, target, kind, CAST(pct / 100.0 AS FLOAT) AS confidence, status, 'ev:' || source || '>' || kind || '>' || target AS evidence FROM raw_edges),
evidence AS (
  SELECT 'ev:customer:' || o_custkey || '>consumes>order:' || o_orderkey AS id, 'nation-' || c_nationkey AS repo_id, 'src/customer_' || (o_custkey % 97) || '.py' AS file_path,
    CAST(o_orderkey % 500 + 1 AS INT) AS start_line, CAST(o_orderkey % 500 + 1 + o_orderkey % 7 AS INT) AS end_line FROM orders JOIN customer ON o_custkey = c_custkey),
freshness AS (
  SELECT 'nation-' || n AS repo_id, CASE WHEN h < 2 THEN 'fresh' WHEN h < 6 THEN 'working_tree_changed' WHEN h < 12 THEN 'commits_behind' WHEN h < 24 THEN 'partial' ELSE 'unavailable' END AS state
  FROM (SELECT n, floor((floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(last))) / 3600) AS h FROM (SELECT user_id % 25 AS n, max(ts) AS last FROM events GROUP BY 1))),
memberships AS (
  SELECT 'community:' || n_regionkey || '-' || (s_suppkey % 2) AS community_id, 'supplier:' || s_suppkey AS node_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'community:' || n_regionkey || '-' || (c_custkey % 2), 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
