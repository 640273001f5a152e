"""Composition inside a repository, before linking: mounts, symbols, URL templates, reached consumers; and typed references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .linking import exactly_one

MOST_MOUNT_DEPTH, MOST_PREFIXES, MOST_HOPS, MOST_OPEN = 8, 16, 3, 16


def joined_path(prefix: Column, route: Column) -> Column:
    p = F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), route), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def mounted_routes(providers: DataFrame, mounts: DataFrame) -> DataFrame:
    """(provider, route): every full route of providers(provider, router, route) under mounts(child, parent, prefix).

    Walks up at most eight mounts; a way that meets itself again is dropped; at most sixteen prefixes for a router, the first in
    order.  A router that is mounted nowhere keeps its routes.
    """
    m = mounts.select("child", "parent", "prefix").distinct()
    parents = m.select(F.col("child").alias("at")).distinct()
    now = written(m.select("child", F.col("parent").alias("at"), "prefix", F.array("child", "parent").alias("seen")).where("child <> at"), "mounts")
    done = []
    for _ in range(MOST_MOUNT_DEPTH):
        done.append(now.join(parents, "at", "left_anti").select("child", "prefix"))
        up = m.select(F.col("child").alias("at"), F.col("parent").alias("next"), F.col("prefix").alias("more"))
        now = written(now.join(up, "at").where(~F.array_contains("seen", F.col("next"))).select("child", F.col("next").alias("at"), joined_path(F.col("more"), F.col("prefix")).alias("prefix"), F.concat("seen", F.array("next")).alias("seen")), "mounts")
        if now.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done).groupBy("child").agg(F.slice(F.array_sort(F.collect_set("prefix")), 1, MOST_PREFIXES).alias("prefixes"))
    out = providers.join(found.withColumnRenamed("child", "router"), "router", "left")
    prefix = F.explode(F.when(F.size("prefixes") > 0, F.col("prefixes")).otherwise(F.array(F.lit(""))))
    return out.select("provider", "route", prefix.alias("prefix")).select("provider", joined_path(F.col("prefix"), F.col("route")).alias("route"))


def resolved_symbols(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references(reference, repo_id, module, name) with ``symbol``: of the same module, else the only one whose key ends with the
    name, else the only one of its last segment.  symbols(symbol, repo_id, module, key); segments are parted by slashes."""
    local = references.join(symbols.select("repo_id", "module", F.col("key").alias("name"), F.col("symbol").alias("_l")), ["repo_id", "module", "name"], "left").groupBy(*references.columns).agg(F.min("_l").alias("_l"), F.max("_l").alias("_m"))
    segs = F.split("key", "/")
    tails = symbols.select("repo_id", "symbol", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, i, F.size(segs)), "/"))).alias("name"))
    suffix = exactly_one(tails, ["repo_id", "name"], "symbol").withColumnRenamed("symbol", "_s")
    last = exactly_one(symbols.select("repo_id", F.element_at(segs, -1).alias("_last"), "symbol"), ["repo_id", "_last"], "symbol").withColumnRenamed("symbol", "_e")
    out = local.join(suffix, ["repo_id", "name"], "left").withColumn("_last", F.element_at(F.split("name", "/"), -1)).join(last, ["repo_id", "_last"], "left")
    return out.select(*references.columns, F.coalesce(F.when(F.col("_l") == F.col("_m"), F.col("_l")), "_s", "_e").alias("symbol"))


PART = "array<struct<kind:string,text:string,idx:int>>"


def bound(parts: Column, arguments: Column) -> Column:
    """A URL template with its parameters replaced by arguments; one that isn't given becomes a runtime value."""
    value = F.struct(F.lit("value").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("idx"))
    return F.transform(parts, lambda p: F.when(p["kind"] == "param", F.coalesce(F.get(arguments, p["idx"]), value)).otherwise(p))


def is_open(parts: Column) -> Column:
    return F.exists(parts, lambda p: p["kind"] == "param")


def literal(parts: Column) -> Column:
    """The path of a closed template: a value that fills a segment is {}, one in part of a segment leaves no path."""
    raw = F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "text", p["text"]).otherwise("\x00")), "")
    segs = F.split(raw, "/")
    return F.when(~F.exists(segs, lambda s: F.contains(s, F.lit("\x00")) & (s != "\x00")), F.array_join(F.transform(segs, lambda s: F.when(s == "\x00", "{}").otherwise(s)), "/"))


def instantiated(open_urls: DataFrame, calls: DataFrame) -> DataFrame:
    """(function, parts): closed URLs that wrappers come to at their callers, at most three hops up.

    open_urls(function, parts) with parameters of the function; calls(caller, callee, arguments), arguments being parts whose
    parameters are the caller's own.
    """
    now, done = open_urls.where(is_open(F.col("parts"))), [open_urls.where(~is_open(F.col("parts")))]
    for _ in range(MOST_HOPS):
        s = now.join(calls, F.col("function") == F.col("callee")).select(F.col("caller").alias("function"), bound(F.col("parts"), F.col("arguments")).alias("parts")).distinct()
        s = written(s, "urls")
        done.append(s.where(~is_open(F.col("parts"))))
        now = s.where(is_open(F.col("parts")))
    return reduce(DataFrame.unionByName, done).distinct()


def reached(tests: DataFrame, calls: DataFrame, consumers: DataFrame, depth: int = 3) -> DataFrame:
    """(test, consumer, depth): what tests(test, function) come to through calls(caller, callee) within the depth, nearest first."""
    now, seen = tests.select("test", "function").distinct(), []
    for d in range(depth + 1):
        seen.append(now.withColumn("depth", F.lit(d)))
        now = written(now.join(calls, F.col("function") == F.col("caller")).select("test", F.col("callee").alias("function")).distinct(), "reached")
    near = reduce(DataFrame.unionByName, seen).groupBy("test", "function").agg(F.min("depth").alias("depth"))
    return near.join(consumers.select("function", "consumer"), "function").groupBy("test", "consumer").agg(F.min("depth").alias("depth"))


def prioritised(references: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """references(reference, repo_id, name) with ``target``: the only one of first(repo_id, name, id); where first has none, of
    second.  An ambiguous first match does not fall through."""
    def only(df: DataFrame, col: str) -> DataFrame:
        return df.groupBy("repo_id", "name").agg(F.min("id").alias(col), (F.min("id") == F.max("id")).alias(f"{col}_one"))

    out = references.join(only(first, "_f"), ["repo_id", "name"], "left").join(only(second, "_s"), ["repo_id", "name"], "left")
    target = F.when(F.col("_f").isNotNull(), F.when(F.col("_f_one"), F.col("_f"))).when(F.col("_s_one"), F.col("_s"))
    return out.select(*references.columns, target.alias("target"))


def document_links(references: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, gaps) of references(document, ref_kind, value) to targets(ref_kind, value, id): one distinct target each; repository
    dependencies that match none are reported."""
    one = exactly_one(targets, ["ref_kind", "value"])
    links = references.join(one, ["ref_kind", "value"]).select("document", F.when(F.col("ref_kind") == "repository", "depends_on_repository").otherwise("documents").alias("kind"), F.col("id").alias("target")).distinct()
    gaps = references.where("ref_kind = 'repository'").join(targets.select("ref_kind", "value").distinct(), ["ref_kind", "value"], "left_anti").select("document", "value").distinct()
    return links, gaps


def shared_keys(keys: DataFrame, environment: DataFrame) -> DataFrame:
    """environment(unit, repo_id, name) with ``key``: the only setting of the repository with that name, else one of its own."""
    one = exactly_one(keys.select("repo_id", "name", "id"), ["repo_id", "name"])
    return environment.join(one, ["repo_id", "name"], "left").select("unit", "repo_id", "name", F.coalesce("id", F.concat_ws(":", F.lit("config"), "repo_id", F.lit("environment"), "name")).alias("key"))


def generated_client_links(clients: DataFrame, operations: DataFrame) -> DataFrame:
    """(client, operation): operations of the very file that a client was generated from, in the same repository."""
    return clients.select("client", "repo_id", F.col("input_spec").alias("file_path")).join(operations.select("repo_id", "file_path", F.col("id").alias("operation")), ["repo_id", "file_path"]).select("client", "operation")


def symbol_boundaries(observations: DataFrame) -> DataFrame:
    """(repo_id, path, symbol, boundaries, tests): consumer and test observations of one symbol taken together."""
    g = observations.where("symbol is not null and role in ('consumer', 'test')").groupBy("repo_id", "path", "symbol")
    return g.agg(F.array_sort(F.collect_set(F.when(F.col("role") == "consumer", F.concat_ws(" ", "method", "route")))).alias("boundaries"), F.count_if(F.col("role") == "test").alias("tests"))
