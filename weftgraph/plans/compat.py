"""Queries of contract compatibility, with their SQL.  Two versions: keys modulo 10 other than 0, and other than 1 with changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compat as K
from ..sources import tables as G


def _s(x):
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _split(df, key):
    return df.where(F.col(key) % 10 != 0), df.where(F.col(key) % 10 != 1)


def http_compat(spark, sf):
    b, a = _split(G.table(spark, sf, "part"), "p_partkey")
    path = lambda extra: F.concat(F.lit("/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"), _s(F.col("p_partkey") % 300), extra)
    view = lambda df, extra: df.select(F.lit("provider").alias("role"), F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("method"), path(extra).alias("path"), (F.col("p_partkey") % 50 == 0).alias("incomplete"))
    return K.http(view(b, F.lit("")), view(a, F.when(F.col("p_partkey") % 7 == 0, "/v2").otherwise("")))


def package_compat(spark, sf):
    b, a = _split(G.table(spark, sf, "part"), "p_partkey")
    major = lambda new: F.when(F.lit(new) & (F.col("p_partkey") % 7 == 0), F.col("p_size") + 1).otherwise(F.col("p_size"))
    minor = lambda new: F.when(F.lit(new) & (F.col("p_partkey") % 5 == 0), 1).otherwise(0)
    view = lambda df, new: df.select(F.lit("npm").alias("ecosystem"), _s("p_partkey").alias("name"), F.when(F.col("p_partkey") % 11 != 0, F.concat_ws(".", _s(major(new)), _s(minor(new)), F.lit("0"))).alias("version"), F.concat(F.lit("p"), _s(F.floor(F.col("p_partkey") / 7))).alias("source_path"))
    scope = F.element_at(F.array(*map(F.lit, ("runtime", "dev", "peer"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    moved = lambda new: F.when(F.lit(new) & (F.col("p_partkey") % 13 == 0), "dev").otherwise(scope)
    deps = lambda df, new: df.select(_s(F.col("p_partkey") % 100).alias("package"), _s("p_partkey").alias("name"), moved(new).alias("scope"), F.when(F.col("p_partkey") % 17 != 0, F.concat(F.lit("^"), _s(major(new)))).alias("range"))
    kind = F.element_at(F.array(*map(F.lit, ("export", "feature", "workspace"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    vals = lambda df: df.select(_s(F.col("p_partkey") % 100).alias("package"), kind.alias("kind"), _s("p_partkey").alias("value"))
    return K.packages(view(b, False), view(a, True), (deps(b, False), deps(a, True)), (vals(b), vals(a)))


def database_compat(spark, sf):
    b, a = _split(G.table(spark, sf, "customer"), "c_custkey")
    old = F.element_at(F.array(*map(F.lit, ("BIGINT", "VARCHAR(40)", "TINYINT", "TEXT"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    new = F.when(F.col("c_custkey") % 7 == 0, F.element_at(F.array(*map(F.lit, ("INTEGER", "VARCHAR(20)", None, "JSON"))), (F.col("c_custkey") % 4 + 1).cast("int"))).otherwise(old)
    view = lambda df, kind, changed: df.select(
        F.concat(F.lit("t"), _s("c_nationkey"), F.when(F.col("c_nationkey") == 3, "a" if changed else "b").otherwise("")).alias("table"), _s("c_custkey").alias("column"), kind.alias("type"),
        (F.when(F.col("c_custkey") % 23 != 0, F.col("c_custkey") % 6 != 0) if not changed else F.col("c_custkey") % 4 != 0).alias("nullable"), (F.col("c_custkey") % 8 == 0).alias("has_default"), (F.col("c_custkey") % (5 if not changed else 15) == 0).alias("primary_key"), (F.col("c_custkey") % (3 if not changed else 9) == 0).alias("unique"))
    kind = F.element_at(F.array(*map(F.lit, ("index", "foreign_key"))), (F.col("c_custkey") % 2 + 1).cast("int"))
    extra = lambda df: df.select(F.concat(F.lit("t"), _s("c_nationkey")).alias("table"), kind.alias("kind"), _s("c_custkey").alias("name"))
    rev = lambda df, new: df.select(F.concat(F.lit("m"), _s("c_custkey")).alias("document"), (F.col("c_custkey") % 31 == 0).alias("incomplete"), F.when(F.lit(new) & (F.col("c_custkey") % 3 == 0), F.concat(_s("c_custkey"), F.lit("n"))).otherwise(_s("c_custkey")).alias("revision"),
                                    F.when(F.lit(new) & (F.col("c_custkey") % 5 == 0), _s("c_custkey")).otherwise("base").alias("down_revision"))
    return K.database(view(b, old, False), view(a, new, True), (extra(b), extra(a)), (rev(b, False), rev(a, True)))


def graphql_compat(spark, sf):
    b, a = _split(G.table(spark, sf, "supplier"), "s_suppkey")
    view = lambda df, new: df.select(F.concat(F.lit("T"), _s("s_nationkey")).alias("type"), _s("s_suppkey").alias("field"), F.when(F.lit(new) & (F.col("s_suppkey") % 7 == 0), "[Int!]").when(F.lit(new) & (F.col("s_suppkey") % 5 == 0), "Float").otherwise("[Int]").alias("type_ref"))
    args = lambda df, new: df.where("true" if new else "s_suppkey % 3 = 0").select(F.concat(F.lit("T"), _s("s_nationkey")).alias("type"), _s("s_suppkey").alias("field"), F.lit("x").alias("argument"), (F.col("s_suppkey") % 2 == 0).alias("required"), (F.col("s_suppkey") % 4 == 0).alias("has_default"))
    return K.graphql(view(b, False), view(a, True), (args(b, False), args(a, True)))


def event_compat(spark, sf):
    b, a = _split(G.table(spark, sf, "part"), "p_partkey")
    view = lambda df, new: df.select(_s("p_partkey").alias("channel"), (F.when(F.lit(new) & (F.col("p_partkey") % 7 == 0), "k2").otherwise("k1")).alias("routing_key"), F.when(F.lit(new) & (F.col("p_partkey") % 6 == 0), "2").alias("schema_version"), (F.col("p_partkey") % 2 == 0).alias("covered"))
    fields = lambda df, new: df.select(_s("p_partkey").alias("channel"), F.explode(F.array(F.lit("id"), F.when(F.lit(new), "currency").otherwise("note"))).alias("field"), F.col("p_partkey").alias("k")).select(
        "channel", "field", F.when(F.lit(new) & (F.col("k") % 5 == 0) & (F.col("field") == "id"), "integer").otherwise("string").alias("field_type"), (F.col("k") % 3 == 0).alias("required"))
    return K.events(view(b, False), view(a, True), (fields(b, False), fields(a, True)))


def protobuf_compat(spark, sf):
    b, a = _split(G.table(spark, sf, "supplier"), "s_suppkey")
    view = lambda df, new: df.select(
        F.concat(F.lit("M"), _s("s_nationkey")).alias("message"), F.concat(F.lit("f"), _s("s_suppkey"), F.when(F.lit(new) & (F.col("s_suppkey") % 7 == 0), "x").otherwise("")).alias("name"), F.col("s_suppkey").alias("number"),
        F.when(F.lit(new) & (F.col("s_suppkey") % 3 == 0), "varint").otherwise("length").alias("wire_type"), (F.col("s_suppkey") % 2 == 0).alias("required"))
    methods = lambda df, new: df.select(F.concat(F.lit("S"), _s("s_nationkey")).alias("service"), _s("s_suppkey").alias("method"), F.when(F.lit(new) & (F.col("s_suppkey") % 4 == 0), "B").otherwise("A").alias("signature"))
    return K.protobuf(view(b, False), view(a, True), (methods(b, False), methods(a, True)))


def compat_rollup(spark, sf):
    found = database_compat(spark, sf).withColumn("table", F.get(F.split("path", r"\."), F.lit(0)))
    return K.rolled_up_by(found, "table")


def compat_rollup_report(spark, sf):
    """Where nothing breaks, what can't be compared outranks what is unknown."""
    return K.rolled_up(http_compat(spark, sf).where("status not in ('breaking', 'potentially_breaking')"))


QUERIES = {f.__name__: f for f in (http_compat, package_compat, database_compat, graphql_compat, event_compat, protobuf_compat, compat_rollup, compat_rollup_report)}

_ONCE = "SELECT path, code, ['breaking', 'potentially_breaking', 'incomparable', 'unknown', 'compatible'][min(list_position(['breaking', 'potentially_breaking', 'incomparable', 'unknown', 'compatible'], status))] AS status FROM f GROUP BY path, code"

_HTTP = f"""v AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, '/' || replace(p_brand, '#', '') || '/' || (p_partkey % 300) AS p FROM part),
b AS (SELECT m, p, bool_or(k % 50 = 0) AS inc, count(*) AS n FROM v WHERE k % 10 <> 0 GROUP BY ALL), a AS (SELECT m, p || CASE WHEN k % 7 = 0 THEN '/v2' ELSE '' END AS p, bool_or(k % 50 = 0) AS inc, count(*) AS n FROM v WHERE k % 10 <> 1 GROUP BY ALL),
j AS (SELECT coalesce(a.m, b.m) AS m, coalesce(a.p, b.p) AS p, a.m IS NULL AS gone, b.m IS NULL AS new, coalesce(a.inc, false) OR coalesce(b.inc, false) AS inc, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM a FULL JOIN b ON a.m = b.m AND a.p = b.p),
q AS (SELECT x.m, x.p, count(*) AS c FROM j AS x JOIN j AS y ON x.gone AND y.new AND (x.m = y.m) <> (x.p = y.p) GROUP BY ALL),
f AS (SELECT j.m || ' ' || j.p AS path, CASE WHEN c = 1 THEN 'http.operation_changed' ELSE 'http.operation_removed' END AS code, CASE WHEN c = 1 THEN 'potentially_breaking' ELSE 'breaking' END AS status FROM j LEFT JOIN q ON q.m = j.m AND q.p = j.p WHERE gone
  UNION ALL SELECT m || ' ' || p, 'http.operation_added', 'compatible' FROM j WHERE new UNION ALL SELECT m || ' ' || p, 'http.operation_incomplete', 'unknown' FROM j WHERE inc UNION ALL SELECT m || ' ' || p, 'http.operation_duplicate', 'incomparable' FROM j WHERE n > 1
  UNION ALL SELECT 'schema', 'http.schema_semantics_unmodeled', 'incomparable')"""
_DATABASE = f"""v AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
j AS (SELECT *, k % 10 <> 0 AS inb, k % 10 <> 1 AS ina, 't' || n || '.' || k AS path FROM v WHERE n <> 3),
f AS (SELECT 't3b' AS path, 'database.table_removed' AS code, 'breaking' AS status
  UNION ALL SELECT path, 'database.column_removed', 'breaking' FROM j WHERE NOT ina
  UNION ALL SELECT path, 'database.column_type_changed', CASE k % 4 WHEN 2 THEN 'unknown' WHEN 3 THEN 'potentially_breaking' ELSE 'breaking' END FROM j WHERE ina AND inb AND k % 7 = 0
  UNION ALL SELECT path, 'database.column_nullability_changed', CASE WHEN b IS NULL THEN 'unknown' WHEN a THEN 'compatible' WHEN k % 8 = 0 THEN 'potentially_breaking' ELSE 'breaking' END
    FROM (SELECT *, CASE WHEN k % 23 <> 0 THEN k % 6 <> 0 END AS b, k % 4 <> 0 AS a FROM j WHERE ina AND inb) WHERE b IS DISTINCT FROM a
  UNION ALL SELECT path, 'database.primary_key_removed', 'breaking' FROM j WHERE ina AND inb AND k % 5 = 0 AND k % 15 <> 0
  UNION ALL SELECT path, 'database.unique_constraint_removed', 'potentially_breaking' FROM j WHERE ina AND inb AND k % 3 = 0 AND k % 9 <> 0
  UNION ALL SELECT 't' || n || '.' || k, 'database.' || ['index', 'foreign_key'][CAST(k % 2 + 1 AS INT)] || '_removed', 'potentially_breaking' FROM v WHERE k % 10 = 1 AND n <> 3
  UNION ALL SELECT 'm' || k, 'database.extraction_incomplete', 'unknown' FROM v WHERE k % 31 = 0
  UNION ALL SELECT 'm' || k, 'database.migration_predecessor_changed', 'breaking' FROM v WHERE k % 10 > 1 AND k % 3 <> 0 AND k % 5 = 0 UNION ALL SELECT 'm' || k, 'database.migration_predecessor_conflict', 'potentially_breaking' FROM v WHERE k % 10 > 1 AND k % 3 = 0 AND k % 5 <> 0
  UNION ALL SELECT 'database.consumers', 'database.shared_consumer_impact_unmodeled', 'unknown')"""

ORACLE_SQL = {
    "http_compat": f"WITH {_HTTP} {_ONCE}",
    "package_compat": f"""WITH v AS (SELECT p_partkey AS k, p_size AS s, CAST(p_partkey AS VARCHAR) AS name, p_partkey // 7 AS file, k % 10 <> 0 AS inb, k % 10 <> 1 AS ina FROM part),
rn AS (SELECT min(name) FILTER (NOT ina) AS from_, min(name) FILTER (NOT inb) AS to_ FROM v GROUP BY file HAVING count(*) FILTER (NOT inb) = 1 AND count(*) FILTER (NOT ina) > 0),
dp AS (SELECT *, ['runtime', 'dev', 'peer'][CAST(k % 3 + 1 AS INT)] AS scope, CASE WHEN k % 13 = 0 THEN 'dev' ELSE ['runtime', 'dev', 'peer'][CAST(k % 3 + 1 AS INT)] END AS scope2, k % 17 = 0 AS vague FROM v),
f AS (SELECT 'npm:' || k AS path, CASE WHEN name IN (SELECT from_ FROM rn) THEN 'package.coordinate_renamed' ELSE 'package.coordinate_removed' END AS code, 'breaking' AS status FROM v WHERE NOT ina
  UNION ALL SELECT 'npm:' || k, 'package.coordinate_added', 'compatible' FROM v WHERE NOT inb AND name NOT IN (SELECT to_ FROM rn)
  UNION ALL SELECT 'npm:' || k, 'package.declared_version_changed', CASE WHEN k % 7 = 0 THEN 'breaking' ELSE 'potentially_breaking' END FROM v WHERE ina AND inb AND k % 11 <> 0 AND (k % 7 = 0 OR k % 5 = 0)
  UNION ALL SELECT (k % 100) || '/' || k, 'package.dependency_removed', CASE scope WHEN 'dev' THEN 'unknown' ELSE 'potentially_breaking' END FROM dp WHERE NOT ina
  UNION ALL SELECT (k % 100) || '/' || k, 'package.dependency_added', CASE scope2 WHEN 'peer' THEN 'potentially_breaking' ELSE 'unknown' END FROM dp WHERE NOT inb
  UNION ALL SELECT (k % 100) || '/' || k, 'package.dependency_drift', CASE WHEN vague OR scope = 'dev' THEN 'unknown' ELSE 'potentially_breaking' END FROM dp WHERE ina AND inb AND ((k % 7 = 0 AND NOT vague) OR scope <> scope2)
  UNION ALL SELECT (k % 100) || '/' || kind || '/' || k, 'package.' || kind || '_removed', CASE kind WHEN 'export' THEN 'breaking' WHEN 'feature' THEN 'potentially_breaking' ELSE 'unknown' END
    FROM (SELECT *, ['export', 'feature', 'workspace'][CAST(k % 3 + 1 AS INT)] AS kind FROM v) WHERE NOT ina
  UNION ALL SELECT 'package.workspace', 'package.workspace_cycle_unmodeled', 'unknown' UNION ALL SELECT 'package.types', 'package.type_declarations_unmodeled', 'unknown') {_ONCE}""",
    "database_compat": f"WITH {_DATABASE} {_ONCE}",
    "graphql_compat": f"""WITH v AS (SELECT s_suppkey AS k, 'T' || s_nationkey AS t, k % 10 <> 0 AS inb, k % 10 <> 1 AS ina FROM supplier),
tt AS (SELECT t, bool_or(inb) AS tb, bool_or(ina) AS ta FROM v GROUP BY t),
f AS (SELECT t AS path, 'graphql.type_removed' AS code, 'breaking' AS status FROM tt WHERE tb AND NOT ta
  UNION ALL SELECT t || '.' || k, 'graphql.field_removed', 'breaking' FROM v JOIN tt USING (t) WHERE tb AND ta AND NOT ina
  UNION ALL SELECT t || '.' || k, 'graphql.return_type_narrowed', 'breaking' FROM v WHERE ina AND inb AND (k % 7 = 0 OR k % 5 = 0)
  UNION ALL SELECT t || '.' || k || '.x', 'graphql.required_argument_added', 'breaking' FROM v WHERE ina AND inb AND k % 3 <> 0 AND k % 2 = 0 AND k % 4 <> 0) {_ONCE}""",
    "event_compat": f"""WITH v AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS c, k % 10 <> 0 AS inb, k % 10 <> 1 AS ina FROM part),
f AS (SELECT c AS path, 'event.channel_removed' AS code, 'breaking' AS status FROM v WHERE NOT ina UNION ALL SELECT c, 'event.routing_key_changed', 'breaking' FROM v WHERE ina AND inb AND k % 7 = 0
  UNION ALL SELECT c, 'event.schema_version_changed', 'breaking' FROM v WHERE ina AND inb AND k % 6 = 0 UNION ALL SELECT c || '.note', 'event.field_removed', 'breaking' FROM v WHERE ina AND inb
  UNION ALL SELECT c || '.id', 'event.field_type_changed', 'breaking' FROM v WHERE ina AND inb AND k % 5 = 0 UNION ALL SELECT c || '.currency', 'event.required_field_added', 'breaking' FROM v WHERE ina AND inb AND k % 3 = 0) {_ONCE}""",
    "protobuf_compat": f"""WITH v AS (SELECT s_suppkey AS k, 'M' || s_nationkey AS m, 'S' || s_nationkey || '/' || s_suppkey AS s, k % 10 <> 0 AS inb, k % 10 <> 1 AS ina, bool_or(k % 10 <> 0) OVER w AND bool_or(k % 10 <> 1) OVER w AS kept, bool_or(k % 10 <> 1) OVER w AS ma FROM supplier WINDOW w AS (PARTITION BY s_nationkey)),
f AS (SELECT m AS path, 'protobuf.message_removed' AS code, 'breaking' AS status FROM v WHERE NOT ma UNION ALL SELECT m || '.f' || k, 'protobuf.field_removed', 'breaking' FROM v WHERE kept AND inb AND (NOT ina OR k % 7 = 0)
  UNION ALL SELECT m || '.f' || k, 'protobuf.field_wire_incompatible', 'breaking' FROM v WHERE ina AND inb AND k % 7 <> 0 AND k % 3 = 0
  UNION ALL SELECT m || '.f' || k || CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END, 'protobuf.required_field_added', 'breaking' FROM v WHERE kept AND ina AND (NOT inb OR k % 7 = 0) AND k % 2 = 0
  UNION ALL SELECT m || '#' || k, 'protobuf.field_number_reused', 'breaking' FROM v WHERE ina AND inb AND k % 7 = 0 UNION ALL SELECT m || '#' || k, 'protobuf.field_wire_incompatible', 'breaking' FROM v WHERE ina AND inb AND k % 7 = 0 AND k % 3 = 0
  UNION ALL SELECT s, 'protobuf.method_removed', 'breaking' FROM v WHERE NOT ina UNION ALL SELECT s, 'protobuf.method_signature_changed', 'breaking' FROM v WHERE ina AND inb AND k % 4 = 0) {_ONCE}""",
    "compat_rollup": f"""WITH {_DATABASE}, o AS ({_ONCE}) SELECT string_split(path, '.')[1] AS "table", ['breaking', 'potentially_breaking', 'unknown', 'incomparable', 'compatible'][min(list_position(['breaking', 'potentially_breaking', 'unknown', 'incomparable', 'compatible'], status))] AS status FROM o GROUP BY 1""",
    "compat_rollup_report": "SELECT 'incomparable' AS status",
}
