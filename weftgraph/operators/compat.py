"""Compatibility of two versions of contracts: keyed differences, findings, roll-up.

Every engine joins both sides fully on the key, turns each pair into findings (path, code, status), keeps the first finding of
each path and code, and rolls the statuses up to the worst.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the worst to the best, for one report, and for reports of the same contract taken together.
REPORT_ORDER = ("breaking", "potentially_breaking", "incomparable", "unknown", "compatible")
MERGE_ORDER = ("breaking", "potentially_breaking", "unknown", "incomparable", "compatible")
#: Widths of database types that can be compared.
INTEGER_RANK = {"tinyint": 0, "smallint": 1, "int": 2, "integer": 2, "bigint": 3}


def rank(status: Column, order: Sequence[str] = REPORT_ORDER) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), status)


def both_sides(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with structs ``b`` and ``a`` of the other columns; null where a side lacks the key."""
    pack = lambda df, name: df.select(*keys, F.struct(*(F.col(c) for c in df.columns if c not in keys), F.lit(True).alias("there")).alias(name))
    return pack(before, "b").join(pack(after, "a"), list(keys), "full_outer")


def findings(pairs: DataFrame, path: Column, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(path, code, status) of every rule (code, status, condition) that holds for a pair."""
    each = [F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"))) for code, status, cond in rules]
    return pairs.select(path.alias("path"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("path", "x.*")


def deduplicated(*parts: DataFrame) -> DataFrame:
    """One finding for each path and code: the worst."""
    out = reduce(DataFrame.unionByName, parts)
    return out.groupBy("path", "code").agg(F.min_by("status", rank(F.col("status"))).alias("status"))


def rolled_up(found: DataFrame, order: Sequence[str] = REPORT_ORDER) -> DataFrame:
    """One row: the worst status of all findings; compatible without any."""
    worst = found.agg(F.min(rank(F.col("status"), order)).alias("r"))
    return worst.select(F.coalesce(F.element_at(F.array(*map(F.lit, order)), F.col("r").cast("int")), F.lit("compatible")).alias("status"))


def rolled_up_by(found: DataFrame, key: str, order: Sequence[str] = MERGE_ORDER) -> DataFrame:
    worst = found.groupBy(key).agg(F.min(rank(F.col("status"), order)).alias("r"))
    return worst.select(key, F.element_at(F.array(*map(F.lit, order)), F.col("r").cast("int")).alias("status"))


def _gone(b: str = "b", a: str = "a") -> Column:
    return F.col(a).isNull()


def _new(b: str = "b", a: str = "a") -> Column:
    return F.col(b).isNull()


def _both() -> Column:
    return F.col("a").isNotNull() & F.col("b").isNotNull()


def http(before: DataFrame, after: DataFrame) -> DataFrame:
    """HTTP operations (role, method, path, incomplete).  A removed one with exactly one new partner of the same role and the same
    method or path has changed."""
    keys = ["role", "method", "path"]
    one = lambda df: df.groupBy(*keys).agg(F.bool_or("incomplete").alias("incomplete"), F.count("*").alias("n"))
    pairs = both_sides(one(before), one(after), keys)
    gone, new = pairs.where(_gone()).select(*keys), pairs.where(_new()).select("role", F.col("method").alias("m2"), F.col("path").alias("p2"))
    # a new one that shares the method with a removed one has another path, and the reverse: counts by either tell the partners
    by_method = new.groupBy("role", F.col("m2").alias("method")).agg(F.count("*").alias("n1"))
    by_path = new.groupBy("role", F.col("p2").alias("path")).agg(F.count("*").alias("n2"))
    partner = gone.join(by_method, ["role", "method"], "left").join(by_path, ["role", "path"], "left").na.fill(0, ["n1", "n2"])
    pairs = pairs.join(partner.select(*keys, (F.col("n1") + F.col("n2")).alias("partners")), keys, "left")
    where = F.concat_ws(" ", "method", "path")
    rules = [
        ("http.operation_changed", "potentially_breaking", _gone() & (F.col("partners") == 1)), ("http.operation_removed", "breaking", _gone() & (F.coalesce("partners", F.lit(0)) != 1)),
        ("http.operation_added", "compatible", _new()), ("http.operation_incomplete", "unknown", F.coalesce("b.incomplete", F.lit(False)) | F.coalesce("a.incomplete", F.lit(False))),
        ("http.operation_duplicate", "incomparable", (F.coalesce("b.n", F.lit(0)) > 1) | (F.coalesce("a.n", F.lit(0)) > 1))]
    always = before.sparkSession.createDataFrame([("schema", "http.schema_semantics_unmodeled", "incomparable")], "path string, code string, status string")
    return deduplicated(findings(pairs, where, rules), always)


def _once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key, the greatest of several, with how many there are."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max(F.struct(*rest) if rest else F.lit(1)).alias("x"), F.count("*").alias("n"))
    return g.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest), "n")


def _several() -> Column:
    return (F.coalesce("b.n", F.lit(0)) > 1) | (F.coalesce("a.n", F.lit(0)) > 1)


def packages(before: DataFrame, after: DataFrame, dependencies: tuple[DataFrame, DataFrame], values: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Packages (ecosystem, name, version, source_path), their dependencies (package, name, scope, range, optional, condition) and
    values (package, kind, value) of kinds export, feature and workspace.

    A package that is gone was renamed if its file has exactly one new coordinate of the ecosystem; of several that are gone the
    first by name was.  Dependencies are the same by package and name: another scope, range, option or condition is drift.
    """
    p = both_sides(*(_once(x, ["ecosystem", "name"]) for x in (before, after)), ["ecosystem", "name"])
    file = ["ecosystem", "source_path"]
    one_new = p.where(_new()).groupBy("ecosystem", F.col("a.source_path").alias("source_path")).agg(F.min("name").alias("to"), F.count("*").alias("c")).where("c = 1")
    renamed = p.where(_gone()).groupBy("ecosystem", F.col("b.source_path").alias("source_path")).agg(F.min("name").alias("from")).join(one_new, file)
    p = p.join(renamed.select("ecosystem", F.col("from").alias("name"), F.lit(True).alias("was_renamed")), ["ecosystem", "name"], "left").join(renamed.select("ecosystem", F.col("to").alias("name"), F.lit(True).alias("is_rename")), ["ecosystem", "name"], "left")
    was, is_ = F.coalesce("was_renamed", F.lit(False)), F.coalesce("is_rename", F.lit(False))
    major = lambda c: F.regexp_extract(c, r"^[^0-9]*([0-9]+)", 1)
    bv, av = F.col("b.version"), F.col("a.version")
    differ = _both() & ~bv.eqNullSafe(av)
    main = findings(p, F.concat_ws(":", "ecosystem", "name"), [
        ("package.coordinate_renamed", "breaking", _gone() & was), ("package.coordinate_removed", "breaking", _gone() & ~was), ("package.coordinate_added", "compatible", _new() & ~is_), ("package.coordinate_duplicate", "incomparable", _several()),
        ("package.declared_version_changed", "unknown", differ & (bv.isNull() | av.isNull())), ("package.declared_version_changed", "breaking", differ & (major(bv) != major(av))),
        ("package.declared_version_changed", "potentially_breaking", differ & (major(bv) == major(av)))])
    d = both_sides(*(_once(x, ["package", "name"]) for x in dependencies), ["package", "name"])
    weak = F.col("b.scope").isin("dev", "test")
    drift = _both() & ~reduce(lambda x, y: x & y, (F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in dependencies[0].columns if c not in ("package", "name")))
    vague = F.col("b.range").isNull() | F.col("a.range").isNull()
    deps = findings(d, F.concat_ws("/", "package", "name"), [
        ("package.dependency_removed", "unknown", _gone() & weak), ("package.dependency_removed", "potentially_breaking", _gone() & ~weak), ("package.dependency_duplicate", "incomparable", _several()),
        ("package.dependency_drift", "unknown", drift & (vague | weak)), ("package.dependency_drift", "potentially_breaking", drift & ~vague & ~weak),
        ("package.dependency_added", "potentially_breaking", _new() & (F.col("a.scope") == "peer")), ("package.dependency_added", "unknown", _new() & (F.col("a.scope") != "peer"))])
    v = both_sides(*(x.distinct().withColumn("one", F.lit(1)) for x in values), ["package", "kind", "value"])
    vals = findings(v, F.concat_ws("/", "package", "kind", "value"), [
        ("package.export_removed", "breaking", _gone() & (F.col("kind") == "export")), ("package.feature_removed", "potentially_breaking", _gone() & (F.col("kind") == "feature")),
        ("package.workspace_removed", "unknown", _gone() & (F.col("kind") == "workspace"))])
    cycles = v.where((_gone() | _new()) & (F.col("kind") == "workspace")).select(F.lit("package.workspace").alias("path"), F.lit("package.workspace_cycle_unmodeled").alias("code"), F.lit("unknown").alias("status")).distinct()
    always = before.sparkSession.createDataFrame([("package.types", "package.type_declarations_unmodeled", "unknown")], "path string, code string, status string")
    return deduplicated(main, deps, vals, cycles, always)


def narrowed(before: Column, after: Column) -> Column:
    """Whether a database type became narrower: a lesser whole-number type, or fewer characters of the same type."""
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    rank_of = lambda c: F.create_map(*(F.lit(x) for kv in INTEGER_RANK.items() for x in kv))[plain(c)]
    part = lambda c, i: F.regexp_extract(plain(c), r"^(char|varchar|binary|varbinary)\(([0-9]+)\)$", i)
    ints = rank_of(after) < rank_of(before)
    chars = F.when((part(before, 1) != "") & (part(before, 1) == part(after, 1)), part(after, 2).cast("decimal(38,0)") < part(before, 2).cast("decimal(38,0)"))
    return F.coalesce(ints, chars, F.lit(False))


def database(before: DataFrame, after: DataFrame, extras: tuple[DataFrame, DataFrame] | None = None, documents: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Columns (table, column, type, nullable, has_default, primary_key, unique), extras (table, kind, name) of kinds index and
    foreign_key, and documents (document, incomplete, revision, down_revision), one for each file that declares a migration.

    Types and nullability that are null on one side are unknown.  Tables and columns that are new are no findings.  Columns without
    ``unique`` are taken as not unique.
    """
    before, after = (x if "unique" in x.columns else x.withColumn("unique", F.lit(False)) for x in (before, after))
    tables = both_sides(*(df.select("table").distinct().withColumn("one", F.lit(1)) for df in (before, after)), ["table"])
    t = findings(tables, F.col("table"), [("database.table_removed", "breaking", _gone())])
    both = tables.where(_both()).select("table")
    c = both_sides(*(_once(x.join(both, "table", "left_semi"), ["table", "column"]) for x in (before, after)), ["table", "column"])
    differ = lambda x: _both() & ~F.col(f"b.{x}").eqNullSafe(F.col(f"a.{x}"))
    known = lambda x: F.col(f"b.{x}").isNotNull() & F.col(f"a.{x}").isNotNull()
    narrow = narrowed(F.col("b.type"), F.col("a.type"))
    strict = F.col("b.nullable") & ~F.col("a.nullable")
    cols = findings(c, F.concat_ws(".", "table", "column"), [
        ("database.column_removed", "breaking", _gone()), ("database.column_duplicate", "incomparable", _several()), ("database.column_type_changed", "unknown", differ("type") & ~known("type")),
        ("database.column_type_changed", "breaking", differ("type") & known("type") & narrow), ("database.column_type_changed", "potentially_breaking", differ("type") & known("type") & ~narrow),
        ("database.column_nullability_changed", "unknown", differ("nullable") & ~known("nullable")), ("database.column_nullability_changed", "potentially_breaking", differ("nullable") & strict & F.col("a.has_default")),
        ("database.column_nullability_changed", "breaking", differ("nullable") & strict & ~F.col("a.has_default")), ("database.column_nullability_changed", "compatible", differ("nullable") & known("nullable") & ~strict),
        ("database.primary_key_removed", "breaking", _both() & F.col("b.primary_key") & ~F.col("a.primary_key")), ("database.unique_constraint_removed", "potentially_breaking", _both() & F.col("b.unique") & ~F.col("a.unique"))])
    parts = [t, cols, before.sparkSession.createDataFrame([("database.consumers", "database.shared_consumer_impact_unmodeled", "unknown")], "path string, code string, status string")]
    if extras:
        x = both_sides(*(e.join(both, "table", "left_semi").distinct().withColumn("one", F.lit(1)) for e in extras), ["table", "kind", "name"])
        parts.append(x.where(_gone()).select(F.concat_ws(".", "table", "name").alias("path"), F.concat(F.lit("database."), "kind", F.lit("_removed")).alias("code"), F.lit("potentially_breaking").alias("status")))
    if documents:
        m = both_sides(*(_once(x, ["document"]) for x in documents), ["document"])
        same = F.col("b.revision") == F.col("a.revision")
        parts.append(findings(m, F.col("document"), [
            ("database.extraction_incomplete", "unknown", F.coalesce("b.incomplete", F.lit(False)) | F.coalesce("a.incomplete", F.lit(False))),
            ("database.migration_predecessor_changed", "breaking", same & differ("down_revision")), ("database.migration_predecessor_conflict", "potentially_breaking", known("revision") & ~same & ~F.col("a.down_revision").eqNullSafe(F.col("b.revision")))]))
    return deduplicated(*parts)


def graphql(before: DataFrame, after: DataFrame, arguments: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fields (type, field, type_ref); arguments (type, field, argument, required, has_default)."""
    types = both_sides(*(df.select("type").distinct().withColumn("one", F.lit(1)) for df in (before, after)), ["type"])
    t = findings(types, F.col("type"), [("graphql.type_removed", "breaking", _gone())])
    both = types.where(_both()).select("type")
    f = both_sides(before.join(both, "type", "left_semi"), after.join(both, "type", "left_semi"), ["type", "field"])
    named = lambda c: F.regexp_replace(c, r"[\[\]!]", "")
    b, a = F.col("b.type_ref"), F.col("a.type_ref")
    # another named type, or a mark that was not there: both count as narrower
    narrow = _both() & ((named(b) != named(a)) | (F.regexp_replace(b, "!", "") == F.regexp_replace(a, "!", "")) & (F.length(a) > F.length(b)))
    parts = [t, findings(f, F.concat_ws(".", "type", "field"), [("graphql.field_removed", "breaking", _gone()), ("graphql.return_type_narrowed", "breaking", narrow)])]
    if arguments:
        g = both_sides(*arguments, ["type", "field", "argument"]).join(f.where(_both()).select("type", "field"), ["type", "field"], "left_semi")
        parts.append(findings(g, F.concat_ws(".", "type", "field", "argument"), [("graphql.required_argument_added", "breaking", _new() & F.col("a.required") & ~F.col("a.has_default"))]))
    return deduplicated(*parts)


def events(before: DataFrame, after: DataFrame, fields: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Channels (channel, routing_key, schema_version, covered) and fields (channel, field, field_type, required)."""
    c = both_sides(before, after, ["channel"])
    differ = lambda x: _both() & ~F.col(f"b.{x}").eqNullSafe(F.col(f"a.{x}"))
    main = findings(c, F.col("channel"), [
        ("event.channel_removed", "breaking", _gone()), ("event.routing_key_changed", "breaking", differ("routing_key")), ("event.schema_version_changed", "breaking", differ("schema_version")),
        ("event.schema_coverage_changed", "unknown", differ("covered"))])
    both = c.where(_both()).select("channel")
    f = both_sides(*(x.join(both, "channel", "left_semi") for x in fields), ["channel", "field"])
    return deduplicated(main, findings(f, F.concat_ws(".", "channel", "field"), [
        ("event.field_removed", "breaking", _gone()), ("event.field_type_changed", "breaking", _both() & (F.col("b.field_type") != F.col("a.field_type"))),
        ("event.required_field_added", "breaking", _new() & F.col("a.required"))]))


def protobuf(before: DataFrame, after: DataFrame, methods: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fields (message, name, number, wire_type, required) and methods (service, method, signature)."""
    m = both_sides(*(df.select("message").distinct().withColumn("one", F.lit(1)) for df in (before, after)), ["message"])
    parts = [findings(m, F.col("message"), [("protobuf.message_removed", "breaking", _gone())])]
    both = m.where(_both()).select("message")
    b, a = (df.join(both, "message", "left_semi") for df in (before, after))
    by_name = both_sides(b, a, ["message", "name"])
    parts.append(findings(by_name, F.concat_ws(".", "message", "name"), [
        ("protobuf.field_removed", "breaking", _gone()), ("protobuf.field_number_changed", "breaking", _both() & (F.col("b.number") != F.col("a.number"))),
        ("protobuf.field_wire_incompatible", "breaking", _both() & (F.col("b.wire_type") != F.col("a.wire_type"))), ("protobuf.required_field_added", "breaking", _new() & F.col("a.required"))]))
    by_number = both_sides(b.select("message", "number", "name", "wire_type"), a.select("message", "number", "name", "wire_type"), ["message", "number"])
    other = _both() & (F.col("b.name") != F.col("a.name"))
    parts.append(findings(by_number, F.concat_ws("#", "message", F.col("number").cast("string")), [
        ("protobuf.field_number_reused", "breaking", other), ("protobuf.field_wire_incompatible", "breaking", other & (F.col("b.wire_type") != F.col("a.wire_type")))]))
    if methods:
        s = both_sides(*methods, ["service", "method"])
        parts.append(findings(s, F.concat_ws("/", "service", "method"), [("protobuf.method_removed", "breaking", _gone()), ("protobuf.method_signature_changed", "breaking", _both() & (F.col("b.signature") != F.col("a.signature")))]))
    return deduplicated(*parts)
