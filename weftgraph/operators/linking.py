"""Joins that turn observations into edges.

Ambiguity is never settled by chance: a link needs exactly one candidate, or the most specific one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import routes as R
from ..model import STATUSES


def exactly_one(candidates: DataFrame, keys: Sequence[str], id_: str = "id") -> DataFrame:
    """(keys, id) for keys that have exactly one distinct id.  Least and greatest id tell, so nothing is gathered."""
    return candidates.groupBy(*keys).agg(F.min(id_).alias(id_), F.max(id_).alias("_max")).where(F.col(id_) == F.col("_max")).drop("_max")


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status)


def worst_status(a: Column, b: Column) -> Column:
    return F.when(severity(a) >= severity(b), a).otherwise(b)


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge for each id: the greatest confidence and all evidence; confirmed only if certain."""
    out = edges.groupBy("id").agg(
        F.first("source").alias("source"), F.first("target").alias("target"), F.first("kind").alias("kind"), F.max("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return out.withColumn("status", F.when(F.col("confidence") >= 1.0, "confirmed").otherwise("inferred"))


# --- routes ---------------------------------------------------------------------------------------------------------


def route_shapes(providers: DataFrame) -> DataFrame:
    """providers with their segments, class vector, and what a call must equal at the static places."""
    p = providers.withColumn("segs", R.segments(F.col("path"))).withColumn("vector", R.classes(F.col("segs")))
    p = p.withColumn("open", F.col("vector").endswith("3")).withColumn("size", F.size("segs") - F.col("open").cast("int"))
    p = p.withColumn("mask", F.substring(F.regexp_replace("vector", "[12]", "x"), F.lit(1), F.col("size")))
    key = F.transform(F.slice("segs", 1, F.greatest(F.col("size"), F.lit(1))), lambda s: F.when(R.classes(F.array(s)) == "0", s).otherwise("*"))
    p = p.withColumn("key", F.when(F.col("size") > 0, F.array_join(key, "/")).otherwise(""))
    mixed = F.transform("segs", lambda s: F.when(R.classes(F.array(s)) == "1", R.canonical_segment(s)).otherwise(""))
    return p.withColumn("mixed", mixed).withColumn("canonical", R.canonical(F.col("path")))


def route_matches(calls: DataFrame, providers: DataFrame, scope: str | None = None) -> DataFrame:
    """(call, provider, repo_id, vector): the most specific templates that match each call.

    calls(call, method, path), providers(id, repo_id, method, path).  ``scope``: a column of calls; where it isn't null only
    providers of that repository count.  Calls meet the few distinct masks of static places first (as many as route
    styles, broadcast) and then the templates by an equi-join on the static segments, instead of every template.
    """
    shapes = route_shapes(providers)
    masks = shapes.select("method", "mask", "open", "size").distinct()
    c = calls.withColumn("csegs", R.segments(F.col("path"))).withColumn("cvector", R.classes(F.col("csegs")))
    n = F.size("csegs")
    fits = F.when(F.col("open"), n > F.col("size")).otherwise(n == F.col("size"))
    key = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("size"), F.lit(1))), lambda i: F.when(F.substring("mask", i, F.lit(1)) == "0", F.get("csegs", i - 1)).otherwise("*")), "/")
    met = c.join(F.broadcast(masks), "method").where(fits).withColumn("key", F.when(F.col("size") > 0, key).otherwise(""))
    right = shapes.select("method", "mask", "open", "size", "key", F.col("id").alias("provider"), "repo_id", "vector", "mixed")
    m = met.join(right, ["method", "mask", "open", "size", "key"])
    # what a call's own parameters may meet: only parameters and the rest; mixed ones only the same literals
    at = lambda i: F.get("csegs", i - 1)
    mine, theirs = (lambda i: F.substring("cvector", i, F.lit(1))), (lambda i: F.substring("vector", i, F.lit(1)))

    def agrees(i: Column) -> Column:
        lit = F.get("mixed", i - 1)
        return (F.when(theirs(i) == "1", F.when(mine(i) == "0", F.regexp_like(at(i), R.mixed_pattern(lit))).otherwise((mine(i) == "1") & (R.canonical_segment(at(i)) == lit)))
                .when(theirs(i) == "0", mine(i) == "0").when(theirs(i) == "2", mine(i) != "3").otherwise(True))

    m = m.where(F.forall(F.sequence(F.lit(1), F.greatest(F.length("vector"), F.lit(1))), agrees) | (F.col("vector") == ""))
    if scope:
        m = m.where(F.col(scope).isNull() | (F.col(scope) == F.col("repo_id")))
    best = F.min("vector").over(Window.partitionBy("call"))
    m = m.withColumn("best", best)
    upto = F.instr("best", "1")
    m = m.where((F.col("vector") == F.col("best")) | (upto > 0) & (F.substring("vector", F.lit(1), upto) == F.substring("best", F.lit(1), upto)))
    branch = Window.partitionBy("call", "mixed").orderBy("vector")
    return m.withColumn("_r", F.rank().over(branch)).where("_r = 1").select(*calls.columns, "provider", "repo_id", "vector")


def resolved_calls(calls: DataFrame, providers: DataFrame, known_repos: Sequence[str]) -> DataFrame:
    """Each call with what became of it: linked, no_provider, ambiguous or external, and the candidates.

    calls(call, method, path, caller_repo, target_repo, external): a target repository is strict; with none, a single
    provider of the caller's own repository wins, else a single one of all.
    """
    inside = calls.where(~F.col("external"))
    m = route_matches(inside, providers, "target_repo")
    local = F.col("repo_id") == F.col("caller_repo")
    by = m.groupBy("call").agg(
        F.array_sort(F.collect_set("provider")).alias("candidates"), F.array_sort(F.collect_set(F.when(local, F.col("provider")))).alias("local"))
    one = F.when(F.size("local") == 1, F.get("local", F.lit(0))).when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))
    by = by.withColumn("provider", one)
    out = calls.join(by, "call", "left")
    outcome = F.when(F.col("external"), "external").when(F.col("candidates").isNull(), "no_provider").when(F.col("provider").isNotNull(), "linked").otherwise("ambiguous")
    return out.withColumn("outcome", outcome).withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>"))).drop("local")


def preferred(first: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the first resolution, and of the fallback for keys that the first has none for."""
    return first.unionByName(fallback.join(first.select(key).distinct(), key, "left_anti"))


def link_coverage(resolved: DataFrame) -> DataFrame:
    """One row of counters; they add up to the calls."""
    return resolved.agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("linked", "no_provider", "ambiguous", "external")), F.count("*").alias("calls"))


def gaps_of(gaps: DataFrame, hits: DataFrame) -> DataFrame:
    """The link gaps of the nodes among the hits(id)."""
    return gaps.join(hits.select(F.col("id").alias("caller")).distinct(), "caller", "left_semi")


def link_gaps(resolved: DataFrame) -> DataFrame:
    return resolved.where("outcome <> 'linked'").select(F.col("call").alias("caller"), "method", "path", F.col("outcome").alias("reason"), "candidates")


def resolved_authorities(calls: DataFrame, declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """calls(.., authority, caller_repo) with target_repo, external and how it was found.

    Loopback is the caller itself; declared(authority, repo_id) counts by host and port, then by host; inferred(authority,
    repo_id) from infrastructure counts if it names one repository, else the whole workspace is searched; others are external.
    """
    full = R.normalized_authority(F.col("authority"))
    host = F.regexp_replace(full, r":[0-9]+$", "")
    d = declared.select(R.normalized_authority(F.col("authority")).alias("_k"), F.col("repo_id").alias("_d"))
    i = inferred.groupBy(R.normalized_authority(F.col("authority")).alias("_k")).agg(F.min("repo_id").alias("_i"), F.max("repo_id").alias("_j"))
    out = calls.withColumn("_full", full).withColumn("_host", host)
    out = out.join(d.withColumnsRenamed({"_k": "_full", "_d": "_d1"}), "_full", "left").join(d.withColumnsRenamed({"_k": "_host", "_d": "_d2"}), "_host", "left")
    out = out.join(i.withColumnRenamed("_k", "_host"), "_host", "left")
    none = F.col("authority").isNull()
    how = (F.when(none, "relative").when(R.is_loopback(F.col("authority")), "loopback").when(F.col("_d1").isNotNull() | F.col("_d2").isNotNull(), "declared")
           .when(F.col("_i").isNotNull() & (F.col("_i") == F.col("_j")), "inferred").when(F.col("_i").isNotNull(), "conflict").otherwise("external"))
    out = out.withColumn("how", how)
    target = F.when(F.col("how") == "loopback", F.col("caller_repo")).when(F.col("how") == "declared", F.coalesce("_d1", "_d2")).when(F.col("how") == "inferred", F.col("_i"))
    return out.withColumn("target_repo", target).withColumn("external", F.col("how") == "external").drop("_full", "_host", "_d1", "_d2", "_i", "_j")


# --- events ---------------------------------------------------------------------------------------------------------


def resolved_channels(endpoints: DataFrame, declarations: DataFrame) -> DataFrame:
    """endpoints(endpoint, channel, broker, namespace) with the channel's identity.

    A declaration fits if the channel is equal, the brokers are equal or one is generic, and the namespaces are equal or one
    is unset.  All fitting ones must agree on one identity; otherwise the raw channel stands.
    """
    d = declarations.select(F.col("channel"), F.col("broker").alias("_b"), F.col("namespace").alias("_n"), F.col("id").alias("_id"))
    fits = ((F.col("broker") == F.col("_b")) | (F.col("broker") == "generic") | (F.col("_b") == "generic")) & (F.col("namespace").isNull() | F.col("_n").isNull() | (F.col("namespace") == F.col("_n")))
    one = exactly_one(endpoints.join(d, "channel").where(fits), ["endpoint"], "_id")
    raw = F.concat_ws(":", F.lit("event"), "broker", F.coalesce("namespace", F.lit("")), "channel")
    return endpoints.join(one, "endpoint", "left").withColumn("channel_id", F.coalesce("_id", raw)).drop("_id")


def event_deliveries(edges: DataFrame, owners: DataFrame, channels: DataFrame, most_evidence: int = 16) -> DataFrame:
    """Per channel, publishing and subscribing repositories: least confidence, worst status, bounded evidence.

    edges(source, target, kind, confidence, status, evidence) of kinds publishes and subscribes; owners(node_id, repo_id);
    channels(id, label, namespaced).  Observations are added up per channel and repository before the sides meet.
    """
    e = edges.join(owners.select(F.col("node_id").alias("source"), "repo_id"), "source").withColumn("_s", severity(F.col("status")))

    def side(kind: str, name: str) -> DataFrame:
        g = e.where(F.col("kind") == kind).groupBy("target", "repo_id").agg(F.max("_s").alias(f"{name}_s"), F.min("confidence").alias(f"{name}_c"), F.flatten(F.collect_set("evidence")).alias(f"{name}_e"))
        return g.withColumn(f"{name}_e", F.slice(F.array_sort(F.array_distinct(f"{name}_e")), 1, most_evidence + 1)).withColumnRenamed("repo_id", f"{name}_repository")

    both = side("publishes", "publisher").join(side("subscribes", "subscriber"), "target").join(channels.select(F.col("id").alias("target"), "label", "namespaced"), "target")
    seen = F.greatest("publisher_s", "subscriber_s")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.when(F.col("namespaced"), seen).otherwise(F.greatest(seen, F.lit(STATUSES.index("ambiguous") + 1))).cast("int"))
    low = F.least("publisher_c", "subscriber_c")
    union = F.array_distinct(F.concat(F.slice("publisher_e", 1, 1), F.slice("subscriber_e", 1, 1), F.array_sort(F.array_union("publisher_e", "subscriber_e"))))
    return both.select(
        F.col("target").alias("channel_id"), F.col("label").alias("channel_label"), "namespaced", "publisher_repository", "subscriber_repository", status.alias("status"),
        F.when(F.col("namespaced"), low).otherwise(F.least(low, F.lit(0.5).cast("float"))).alias("confidence"), F.slice(union, 1, most_evidence).alias("evidence"), (F.size(union) > most_evidence).alias("evidence_truncated"))


# --- packages, tables, migrations, manual links ---------------------------------------------------------------------


def package_owner_links(dependencies: DataFrame, owners: DataFrame) -> DataFrame:
    """(source_repo, target_repo, package): a package that exactly one repository owns, used by another one."""
    one = exactly_one(owners, ["package"], "repo_id").withColumnRenamed("repo_id", "target_repo")
    return dependencies.join(one, "package").where("source_repo <> target_repo").select("source_repo", "target_repo", "package").distinct()


def table_aliases(tables: DataFrame) -> DataFrame:
    """(alias, id) of tables(id, db, schema, name): the key, its suffix, and the name with fewer and more qualifiers."""
    n, s, d = F.lower("name"), F.lower("schema"), F.lower("db")
    names = F.array_compact(F.array(F.col("id"), n, F.when(s != "", F.concat_ws(".", s, n)), F.when(d != "", F.concat_ws(".", d, n)), F.when((d != "") & (s != ""), F.concat_ws(".", d, s, n))))
    return tables.select(F.explode(F.array_distinct(names)).alias("alias"), "id")


def resolved_tables(references: DataFrame, tables: DataFrame, column: str = "reference") -> DataFrame:
    one = exactly_one(table_aliases(tables), ["alias"])
    return references.join(one.select(F.col("alias").alias("_a"), F.col("id").alias("table_id")), F.lower(column) == F.col("_a"), "left").drop("_a")


def foreign_key_links(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """(fk, source, target): column pairs by place, all or nothing; without referenced columns one pair of tables.

    keys(fk, table_id, columns, referenced_table_id, referenced_columns), columns(table_id, name, id).
    """
    plain = keys.where(F.size("referenced_columns") == 0).select("fk", F.col("table_id").alias("source"), F.col("referenced_table_id").alias("target"))
    paired = keys.where((F.size("referenced_columns") > 0) & (F.size("columns") == F.size("referenced_columns")))
    pairs = paired.select("fk", "table_id", "referenced_table_id", F.size("columns").alias("n"), F.posexplode(F.arrays_zip("columns", "referenced_columns")).alias("at", "p"))
    c = columns.select("table_id", F.col("name").alias("_n"), F.col("id").alias("source"))
    r = columns.select(F.col("table_id").alias("referenced_table_id"), F.col("name").alias("_m"), F.col("id").alias("target"))
    found = pairs.join(c, (pairs.table_id == c.table_id) & (F.col("p.columns") == F.col("_n"))).drop(c.table_id).join(r, ["referenced_table_id"]).where(F.col("p.referenced_columns") == F.col("_m"))
    whole = found.withColumn("_found", F.count("*").over(Window.partitionBy("fk"))).where(F.col("_found") == F.col("n"))
    return plain.unionByName(whole.select("fk", "source", "target"))


def migration_lineage(migrations: DataFrame) -> DataFrame:
    """(source, target, kind): ``precedes`` along unique, consecutive order hints of a directory, ``reverts`` from the only
    down to the only up migration of a family.  migrations(id, repo_id, directory, order_hint, family, direction)."""
    ups = migrations.where("direction <> 'down' and order_hint is not null")
    hints = ups.groupBy("repo_id", "directory", "order_hint").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    w = Window.partitionBy("repo_id", "directory").orderBy("order_hint")
    steps = hints.withColumn("target", F.lead("id").over(w)).withColumn("m", F.lead("n").over(w)).where("n = 1 and m = 1")
    precedes = steps.select(F.col("id").alias("source"), "target", F.lit("precedes").alias("kind"))
    family = migrations.groupBy("repo_id", "directory", "family").agg(
        *(f for d in ("up", "down") for f in (F.count_if(F.col("direction") == d).alias(f"n_{d}"), F.min(F.when(F.col("direction") == d, F.col("id"))).alias(d))))
    reverts = family.where("n_up = 1 and n_down = 1").select(F.col("down").alias("source"), F.col("up").alias("target"), F.lit("reverts").alias("kind"))
    return precedes.unionByName(reverts)


def path_references(references: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(reference, artifact): the only artifact of the path, or all below it if the reference is a directory."""
    a = artifacts.select("repo_id", F.col("path").alias("_p"), F.col("id").alias("artifact"))
    files = exactly_one(references.where("not directory").join(a, "repo_id").where("path = _p"), ["reference"], "artifact")
    # every folder above a file is a key, so that the containment is an equi-join
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("_p", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("_p", "/"), F.lit(1), i), "/"))
    below = a.select("repo_id", F.explode(up).alias("path"), "artifact")
    dirs = references.where("directory").select("reference", "repo_id", F.regexp_replace("path", "/+$", "").alias("path")).join(below, ["repo_id", "path"]).select("reference", "artifact")
    return files.unionByName(dirs)


def manual_overlay(edges: DataFrame, nodes: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with manual links added and suppressed ones taken out, problems).

    manual(link, action, source, target, kind): ends are ids or stable keys, each of exactly one node.
    """
    names = nodes.select(F.col("id").alias("name"), "id").unionByName(nodes.select(F.col("stable_key").alias("name"), "id"))
    wanted = manual.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    found = names.join(wanted, "name").groupBy("name").agg(F.min("id").alias("id"), F.max("id").alias("_max"))
    out = manual
    for end in ("source", "target"):
        f = found.select(F.col("name").alias(end), F.col("id").alias(f"_{end}"), F.col("_max").alias(f"_{end}_max"))
        out = out.join(f, end, "left")
    key = ["_source", "_target", "kind"]
    same = edges.select(F.col("source").alias("_source"), F.col("target").alias("_target"), "kind").distinct().withColumn("_there", F.lit(True))
    out = out.join(same, key, "left").withColumn("_n", F.count("*").over(Window.partitionBy(*key, "action")))
    ambiguous = (F.col("_source") != F.col("_source_max")) | (F.col("_target") != F.col("_target_max"))
    problem = (F.when(F.col("_source").isNull() | F.col("_target").isNull(), "missing_endpoint").when(ambiguous, "ambiguous_endpoint").when(F.col("_source") == F.col("_target"), "self_link")
               .when(F.col("_n") > 1, "duplicate").when((F.col("action") == "suppress") & F.col("_there").isNull(), "missing_suppression"))
    out = out.withColumn("problem", problem)
    good = out.where("problem is null")
    drop = good.where("action = 'suppress'").select(F.col("_source").alias("source"), F.col("_target").alias("target"), "kind")
    id_ = F.concat_ws(">", "_source", "kind", "_target")
    add = good.where("action = 'add'").select(
        id_.alias("id"), F.col("_source").alias("source"), F.col("_target").alias("target"), "kind", F.lit(1.0).cast("float").alias("confidence"), F.lit("confirmed").alias("status"),
        F.array(F.concat(F.lit("manual:"), "link")).alias("evidence"))
    kept = edges.join(drop, ["source", "target", "kind"], "left_anti").select(add.columns)
    kept = kept.join(add.select("id"), "id", "left_anti").select(add.columns)
    return kept.unionByName(add), out.where("problem is not null").select("link", "problem")


# --- assembly -------------------------------------------------------------------------------------------------------


def assembled(families: Sequence[DataFrame], first_wins: bool) -> DataFrame:
    """Rows of all families, one for each id: the first family's, or the last one's."""
    out = None
    for n, f in enumerate(families):
        f = f.withColumn("_family", F.lit(n))
        out = f if out is None else out.unionByName(f)
    w = Window.partitionBy("id").orderBy(F.asc("_family") if first_wins else F.desc("_family"), *(c for c in families[0].columns if c not in ("id", "evidence")))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_family")


def validated(nodes: DataFrame, edges: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(problem, id) of a graph: duplicate ids, dangling ends, confidence out of range, unsafe or overlong text; of evidence also
    reversed lines, and what edges repeat or name though it is missing."""
    ids = nodes.select("id")
    unsafe = lambda c: F.coalesce(F.col(c).rlike("[\\x00-\\x1f\\x7f\\u202a-\\u202e\\u2066-\\u2069]") | (F.octet_length(c) > 65536), F.lit(False))
    bad = F.col("confidence").isNull() | F.isnan(F.col("confidence").cast("double")) | ~F.col("confidence").between(0, 1)
    row = lambda df, problem: df.select(F.lit(problem).alias("problem"), "id")
    twice = lambda df: df.groupBy("id").count().where("count > 1")
    parts = [
        row(twice(nodes), "duplicate_node"), row(twice(edges), "duplicate_edge"), row(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti"), "dangling_source"),
        row(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"), "dangling_target"), row(edges.where(bad), "confidence"), row(nodes.where(unsafe("id") | unsafe("label") | unsafe("stable_key")), "unsafe_text"), row(edges.where(unsafe("id")), "unsafe_text")]
    if evidence is not None:
        texts = [c for c in ("id", "extractor", "extractor_version", "file_path", "observed_at_commit", "content_hash", "note") if c in evidence.columns]
        named = edges.select("id", F.explode("evidence").alias("evidence_id"))
        parts += [
            row(twice(evidence), "duplicate_evidence"), row(evidence.where(bad), "evidence_confidence"), row(evidence.where("start_line > end_line"), "reversed_lines"), row(evidence.where(reduce(lambda x, y: x | y, map(unsafe, texts))), "unsafe_text"),
            row(edges.where(F.size("evidence") > F.size(F.array_distinct("evidence"))), "repeated_evidence"), row(named.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti").select("id").distinct(), "missing_evidence")]
    return reduce(DataFrame.unionByName, parts)
