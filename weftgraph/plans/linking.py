"""Queries of incremental maintenance, routes, events and linking joins, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import routes as R
from ..operators import incremental as I
from ..operators import linking as L
from ..sources import tables as G


def _s(x):
    return (F.col(x) if isinstance(x, str) else x).cast("string")


# --- incremental ----------------------------------------------------------------------------------------------------


def _fingerprints(spark, sf, after: bool):
    d = G.table(spark, sf, "documents").where(F.col("doc_id") % 10 != (1 if after else 0))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, F.lit("!")).otherwise("")) if after else F.coalesce("text", F.lit(""))
    return d.select(F.col("source").alias("repo_id"), F.lit("main").alias("checkout_id"), F.concat(F.lit("docs/"), _s("doc_id"), F.lit(".txt")).alias("path"), F.lit("text").alias("extractor"), F.sha2(text, 256).alias("content_hash"), F.col("n_chars").alias("size_bytes"))


def incremental_plan(spark, sf):
    return I.scan_plan(_fingerprints(spark, sf, False), _fingerprints(spark, sf, True))


def batch_reuse(spark, sf):
    batches = _fingerprints(spark, sf, False).withColumn("contract", F.lit("v1")).withColumn("budgets", F.when(F.col("path").endswith("5.txt"), "b0").otherwise("b1"))
    return I.reuse(_fingerprints(spark, sf, True), batches, "v1", "b1").select("path", "reused")


def partial_scan_union(spark, sf):
    return I.partial_scan(_fingerprints(spark, sf, False), _fingerprints(spark, sf, True), ["src0", "src3", "src7"]).select("repo_id", "path", "content_hash")


def extractor_runs(spark, sf):
    after = _fingerprints(spark, sf, True)
    return I.extractor_runs(after, I.scan_plan(_fingerprints(spark, sf, False), after))


def snapshot_identity(spark, sf):
    return I.snapshot_identity(_fingerprints(spark, sf, True))


def fingerprint_dedup(spark, sf):
    e = G.table(spark, sf, "events").select(F.concat(F.lit("u"), _s("user_id")).alias("repo_id"), F.lit("main").alias("checkout_id"), F.col("event_type").alias("path"), F.lit("e").alias("extractor"), F.col("event_id").alias("seq"))
    return I.last_wins(e)


def publication_delta(spark, sf):
    n = G.nodes(spark, sf, ("service", "symbol_ref"))
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    after = n.where(k % 10 != 1).withColumn("label", F.when(k % 7 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    return I.publication_delta(n.where(k % 10 != 0), after, I.node_digest())


def query_cache_eviction(spark, sf):
    e = G.table(spark, sf, "events").select(F.concat(F.lit("w"), _s(F.col("user_id") % 5)).alias("workspace_id"), _s("event_id").alias("key"), F.unix_timestamp("ts").alias("stored_at"))
    return I.evict(e, 1024).select("workspace_id", "key")


def cache_lru_by_bytes(spark, sf):
    e = G.table(spark, sf, "events").select(F.concat(F.lit("w"), _s(F.col("user_id") % 5)).alias("workspace_id"), _s("event_id").alias("key"), F.unix_timestamp("ts").alias("accessed_at"), (F.col("event_id") % 1000 + 1).alias("bytes"))
    return I.evict_by_bytes(e, 100_000).select("workspace_id", "key", "held")


# --- routes ---------------------------------------------------------------------------------------------------------

#: (id, repo_id, method, path) of the route templates that the pages' URLs are held against.
ROUTES = [
    ("p1", "svc-a", "GET", "/en/{id}"), ("p2", "svc-b", "GET", "/fr/{id}"), ("p3", "svc-b", "GET", "/fr/825"), ("p4", "svc-c", "GET", "/{file}.html"), ("p5", "svc-d", "GET", "/de/*"),
    ("p6", "svc-a", "GET", "/es/{id}"), ("p7", "svc-e", "GET", "/es/:num"), ("p8", "svc-f", "GET", "/{rest...}"), ("p9", "svc-a", "POST", "/en/{id}"), ("p10", "svc-b", "GET", "/{page}.html"), ("p11", "svc-a", "GET", "/de/{id}"),
]
SEGMENTS = ["/a/{x}/b", "/files/{name}.json?x=1", "/p/*", "/q/{rest...}/cut", "/n/[id]/[...slug]", "/f/<int:x>", "/f/<path:x>", "/c/:id", "/c/:rest*", "//double//x/", "/", "/v{major}.{minor}/x#f", "/{a}{b}", "/plain"]


def _calls(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "^$", "/")
    return G.table(spark, sf, "pages").select(_s("page_id").alias("call"), F.lit("GET").alias("method"), path.alias("path"), host.alias("authority"), F.concat(F.lit("svc-"), F.substring(F.lit("abcdef"), (F.col("page_id") % 6 + 1).cast("int"), F.lit(1))).alias("caller_repo"))


def _providers(spark):
    return spark.createDataFrame(ROUTES, "id string, repo_id string, method string, path string")


def route_canonical(spark, sf):
    d = spark.createDataFrame([(x,) for x in SEGMENTS], "path string")
    return d.select("path", R.canonical(F.col("path")).alias("canonical"), R.classes(R.segments(F.col("path"))).alias("vector"), R.normalized_path(F.col("path")).alias("normalized"))


def route_template_join(spark, sf):
    return L.route_matches(_calls(spark, sf).select("call", "method", "path"), _providers(spark)).select("call", "provider", "vector")


def _resolved(spark, sf):
    declared = spark.createDataFrame([("https://blog.tiontion.example.com", "svc-b"), ("m.ththth.example.net:443", "svc-a")], "authority string, repo_id string")
    hosts = _calls(spark, sf).select("authority").distinct()
    # infrastructure names every .org host for one service and every www host for two
    inferred = hosts.where("authority like '%.org'").withColumn("repo_id", F.lit("svc-a")).unionByName(hosts.where("authority like 'www.%'").withColumn("repo_id", F.explode(F.array(F.lit("svc-a"), F.lit("svc-c")))))
    inferred = inferred.unionByName(hosts.where("authority like 'blog.%.net'").withColumn("repo_id", F.explode(F.array(F.lit("svc-a"), F.lit("svc-b")))))
    return L.resolved_authorities(_calls(spark, sf), declared, inferred)


def authority_resolution(spark, sf):
    return _resolved(spark, sf).select("call", "authority", "how", "target_repo", "external")


def scope_narrowing(spark, sf):
    calls = _resolved(spark, sf)
    out = L.resolved_calls(calls, _providers(spark), [])
    return out.select("call", "outcome", "provider", F.array_join("candidates", ",").alias("candidates"))


def route_coverage(spark, sf):
    return L.link_coverage(L.resolved_calls(_resolved(spark, sf), _providers(spark), []))


def route_gaps(spark, sf):
    return L.link_gaps(L.resolved_calls(_resolved(spark, sf), _providers(spark), [])).withColumn("candidates", F.array_join("candidates", ","))


# --- events ---------------------------------------------------------------------------------------------------------


def _event_edges(spark, sf):
    e = G.table(spark, sf, "events")
    pct = (100 - 5 * (F.col("event_id") % 11)) / 100.0
    status = F.when(F.col("event_id") % 13 == 0, "stale").when(F.col("event_id") % 5 == 0, "inferred").otherwise("confirmed")
    return e.select(
        F.concat(F.lit("user:"), _s("user_id")).alias("source"), F.concat(F.lit("channel:"), "event_type").alias("target"), F.when(F.col("user_id") % 2 == 0, "publishes").otherwise("subscribes").alias("kind"),
        pct.cast("float").alias("confidence"), status.alias("status"), F.array(F.concat(F.lit("ev:"), F.lpad(_s("event_id"), 8, "0"))).alias("evidence"))


def event_delivery_projection(spark, sf):
    edges = _event_edges(spark, sf)
    owners = G.table(spark, sf, "events").select(F.concat(F.lit("user:"), _s("user_id")).alias("node_id"), F.concat(F.lit("nation-"), _s(F.col("user_id") % 25)).alias("repo_id")).distinct()
    channels = G.table(spark, sf, "events").select(F.concat(F.lit("channel:"), "event_type").alias("id"), F.col("event_type").alias("label"), (F.length("event_type") % 2 == 0).alias("namespaced")).distinct()
    out = L.event_deliveries(edges, owners, channels)
    return out.withColumn("evidence", F.array_join("evidence", ",")).withColumn("confidence", F.round(F.col("confidence").cast("double"), 6))


def event_channel_resolution(spark, sf):
    e = G.table(spark, sf, "events")
    broker = F.element_at(F.array(F.lit("kafka"), F.lit("generic"), F.lit("nats")), (F.col("event_id") % 3 + 1).cast("int"))
    ends = e.select(_s("event_id").alias("endpoint"), F.col("event_type").alias("channel"), broker.alias("broker"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("ns"), _s(F.col("user_id") % 2))).alias("namespace"))
    d = e.select("event_type").distinct().select(F.col("event_type").alias("channel"), F.explode(F.array(
        F.struct(F.lit("kafka").alias("broker"), F.lit("ns0").alias("namespace"), F.lit("k0").alias("i")), F.struct(F.lit("kafka").alias("broker"), F.lit("ns1").alias("namespace"), F.lit("k1").alias("i")),
        F.struct(F.lit("nats").alias("broker"), F.lit(None).cast("string").alias("namespace"), F.lit("n").alias("i")))).alias("x"))
    d = d.select("channel", "x.broker", "x.namespace", F.concat_ws(":", "channel", "x.i").alias("id"))
    return L.resolved_channels(ends, d).select("endpoint", "channel_id")


# --- exactly one, packages, tables, keys, migrations, manual ---------------------------------------------------------


def exactly_one_link(spark, sf):
    """Consumers of a (brand, type) that exactly one package offers."""
    parts = G.table(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type", _s("p_size")).alias("field"), _s("p_partkey").alias("id"))
    return L.exactly_one(parts, ["field"])


def package_owner_link(spark, sf):
    lines = G.table(spark, sf, "lineitem").join(G.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(G.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    deps = lines.select(F.concat(F.lit("nation-"), _s("c_nationkey")).alias("source_repo"), F.concat_ws(":", "l_partkey", "l_linenumber").alias("package"))
    owners = G.table(spark, sf, "lineitem").join(G.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat_ws(":", "l_partkey", "l_linenumber").alias("package"), F.concat(F.lit("nation-"), _s("s_nationkey")).alias("repo_id")).distinct()
    return L.package_owner_links(deps, owners)


def table_alias_link(spark, sf):
    t = G.table(spark, sf, "customer").select(F.concat(F.lit("table:"), _s("c_custkey")).alias("id"), F.concat(F.lit("db"), _s(F.col("c_nationkey") % 3)).alias("db"), F.lower("c_mktsegment").alias("schema"), F.concat(F.lit("t"), _s(F.col("c_custkey") % 400)).alias("name"))
    refs = G.table(spark, sf, "orders").select(F.concat(F.lit("order:"), _s("o_orderkey")).alias("order_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("T"), _s(F.col("o_custkey") % 500))).otherwise(
        F.concat(F.lit("db0."), F.lower(F.regexp_extract("o_orderpriority", "[A-Z]+", 0)), F.lit(".t"), _s(F.col("o_custkey") % 400))).alias("reference"))
    return L.resolved_tables(refs, t)


def foreign_key_pairs(spark, sf):
    c = G.table(spark, sf, "nation").select(F.concat(F.lit("t"), _s("n_nationkey")).alias("table_id"), F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 4)).alias("i"))
    columns = c.select("table_id", F.concat(F.lit("c"), _s("i")).alias("name"), F.concat_ws(".", "table_id", F.concat(F.lit("c"), _s("i"))).alias("id"))
    cols = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("c"), i.cast("string")))
    other = F.col("n_regionkey")
    keys = G.table(spark, sf, "nation").select(
        F.concat(F.lit("fk"), _s("n_nationkey")).alias("fk"), F.concat(F.lit("t"), _s("n_nationkey")).alias("table_id"), cols(F.col("n_nationkey") % 2).alias("columns"), F.concat(F.lit("t"), _s(other)).alias("referenced_table_id"),
        F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(cols(F.col("n_nationkey") % 2)).alias("referenced_columns"))
    return L.foreign_key_links(keys, columns)


def _migrations(spark, sf):
    n = G.table(spark, sf, "orders")
    return n.select(
        _s("o_orderkey").alias("id"), F.concat(F.lit("nation-"), _s(F.col("o_custkey") % 25)).alias("repo_id"), F.concat(F.lit("migrations/"), _s(F.col("o_orderkey") % 5)).alias("directory"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 997).alias("order_hint"), _s("o_custkey").alias("family"), F.when(F.col("o_orderkey") % 2 == 0, "up").otherwise("down").alias("direction"))


def migration_lineage(spark, sf):
    return L.migration_lineage(_migrations(spark, sf))


def path_containment(spark, sf):
    a = G.evidence(spark, sf).select("repo_id", F.concat_ws("/", F.lit("src"), F.regexp_extract("file_path", "_([0-9]+)", 1), "file_path").alias("path")).distinct().withColumn("id", F.concat_ws(":", "repo_id", "path"))
    n = G.table(spark, sf, "nation")
    refs = n.select(F.concat(F.lit("r"), _s("n_nationkey")).alias("reference"), F.concat(F.lit("nation-"), _s("n_nationkey")).alias("repo_id"), F.concat(F.lit("src/"), _s("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "/").otherwise("")).alias("path"), F.lit(True).alias("directory"))
    files = n.select(F.concat(F.lit("f"), _s("n_nationkey")).alias("reference"), F.concat(F.lit("nation-"), _s("n_nationkey")).alias("repo_id"), F.concat(F.lit("src/"), _s("n_nationkey"), F.lit("/src/customer_"), _s("n_nationkey"), F.lit(".py")).alias("path"), F.lit(False).alias("directory"))
    return L.path_references(refs.unionByName(files), a)


def _manual(spark, sf):
    s = G.table(spark, sf, "supplier")
    add = s.select(F.concat(F.lit("a"), _s("s_suppkey")).alias("link"), F.lit("add").alias("action"), F.concat(F.lit("supplier:"), _s("s_suppkey")).alias("source"), F.concat(F.lit("supplier:"), _s(F.col("s_suppkey") + 1)).alias("target"), F.lit("consumes").alias("kind"))
    cut = s.select(F.concat(F.lit("s"), _s("s_suppkey")).alias("link"), F.lit("suppress").alias("action"), F.concat(F.lit("repository:nation-"), _s("s_nationkey")).alias("source"), F.concat(F.lit("supplier:"), _s("s_suppkey")).alias("target"), F.when(F.col("s_suppkey") % 2 == 0, "contains").otherwise("documents").alias("kind"))
    return add.unionByName(cut)


def manual_link_overlay(spark, sf):
    nodes, edges = G.nodes(spark, sf, ("service", "repository", "symbol_ref")), G.edges(spark, sf, ("contains",))
    return L.manual_overlay(edges, nodes, _manual(spark, sf))[0].select("id", "source", "target", "kind", F.array_join("evidence", ",").alias("evidence"))


def manual_link_problems(spark, sf):
    nodes, edges = G.nodes(spark, sf, ("service", "repository", "symbol_ref")), G.edges(spark, sf, ("contains",))
    return L.manual_overlay(edges, nodes, _manual(spark, sf))[1]


def edge_consensus_merge(spark, sf):
    lines = G.table(spark, sf, "lineitem")
    e = lines.select(
        F.concat_ws(">", F.concat(F.lit("order:"), _s("l_orderkey")), F.lit("calls_remote"), F.concat(F.lit("supplier:"), _s("l_suppkey"))).alias("id"), F.concat(F.lit("order:"), _s("l_orderkey")).alias("source"), F.concat(F.lit("supplier:"), _s("l_suppkey")).alias("target"),
        F.lit("calls_remote").alias("kind"), ((100 - 5 * F.round(F.col("l_discount") * 100)) / 100).cast("float").alias("confidence"), F.array(F.concat(F.lit("line:"), _s("l_linenumber"))).alias("evidence"))
    return L.merged_edges(e).withColumn("evidence", F.array_join("evidence", ",")).withColumn("confidence", F.round(F.col("confidence").cast("double"), 6))


def graph_assembly(spark, sf):
    """Families that share ids: the first one's edges stay, of nodes the last one's."""
    n = G.nodes(spark, sf, ("service", "symbol_ref"))
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    return L.assembled([n, n.where(k % 3 == 0).withColumn("label", F.concat("label", F.lit(" (later)")))], first_wins=False)


def graph_validation(spark, sf):
    """Services of every seventh key are missing, evidence of every fifth line range is reversed, and calls have no evidence at all."""
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    nodes = G.nodes(spark, sf, ("service", "http_operation", "symbol_ref")).where(~((F.col("kind") == "service") & (k % 7 == 0)))
    evidence = G.evidence(spark, sf).withColumn("end_line", F.when(F.col("start_line") % 5 == 0, F.col("start_line") - 1).otherwise(F.col("end_line")))
    edges = G.edges(spark, sf, ("calls_remote", "consumes")).withColumn("evidence", F.when(k % 11 == 0, F.concat("evidence", "evidence")).otherwise(F.col("evidence")))
    return L.validated(nodes, edges, evidence)


QUERIES = {f.__name__: f for f in (
    incremental_plan, batch_reuse, partial_scan_union, extractor_runs, snapshot_identity, fingerprint_dedup, publication_delta, query_cache_eviction, cache_lru_by_bytes,
    route_canonical, route_template_join, authority_resolution, scope_narrowing, route_coverage, route_gaps, event_delivery_projection, event_channel_resolution, exactly_one_link,
    package_owner_link, table_alias_link, foreign_key_pairs, migration_lineage, path_containment, manual_link_overlay, manual_link_problems, edge_consensus_merge, graph_assembly, graph_validation)}

_FP = """b AS (SELECT source AS repo_id, 'main' AS checkout_id, 'docs/' || doc_id || '.txt' AS path, 'text' AS extractor, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 10 <> 0),
a AS (SELECT source AS repo_id, 'main' AS checkout_id, 'docs/' || doc_id || '.txt' AS path, 'text' AS extractor, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS content_hash FROM documents WHERE doc_id % 10 <> 1),
plan AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.checkout_id, b.checkout_id) AS checkout_id, coalesce(a.path, b.path) AS path, coalesce(a.extractor, b.extractor) AS extractor,
  CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.content_hash <> b.content_hash THEN 'modified' END AS change
  FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.path = b.path)"""


def _route_rows() -> str:
    """The templates as anchored expressions with their class vectors, worked out by hand rules for the fixed list above."""
    rows = []
    for id_, repo, method, path in ROUTES:
        pattern, vector, branch = "", "", ""
        for seg in path.strip("/").split("/"):
            if seg == "*" or seg.endswith("...}"):
                pattern, vector = pattern + "/[^/]+(?:/[^/]+)*", vector + "3"
            elif seg[0] == ":" or re.fullmatch(r"\{[^}]*\}", seg):
                pattern, vector = pattern + "/[^/]+", vector + "2"
            elif "{" in seg:
                pattern, vector, branch = pattern + "/" + re.sub(r"\\\{[^}]*\\\}", "[^/]+", re.escape(seg)), vector + "1", re.sub(r"\{[^}]*\}", "{}", seg)
            else:
                pattern, vector = pattern + "/" + re.escape(seg), vector + "0"
        rows.append(f"('{id_}', '{repo}', '{method}', '{pattern}/?', '{vector}', '{branch}')")
    return f"(VALUES {', '.join(rows)}) AS t(provider, repo_id, method, pattern, vector, branch)"


_CALLS = """calls AS (SELECT CAST(page_id AS VARCHAR) AS call, 'GET' AS method, CASE WHEN p = '' THEN '/' ELSE p END AS path, authority, 'svc-' || substr('abcdef', CAST(page_id % 6 + 1 AS INT), 1) AS caller_repo
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority FROM pages))"""
_AUTH = f"""{_CALLS},
auth AS (SELECT *, CASE WHEN authority = 'blog.tiontion.example.com' OR authority = 'm.ththth.example.net' THEN 'declared' WHEN authority LIKE '%.org' AND authority LIKE 'www.%' THEN 'conflict' WHEN authority LIKE '%.org' THEN 'inferred'
    WHEN authority LIKE 'www.%' OR authority LIKE 'blog.%.net' THEN 'conflict' ELSE 'external' END AS how FROM calls),
target AS (SELECT *, CASE WHEN how = 'declared' THEN CASE WHEN authority LIKE 'blog%' THEN 'svc-b' ELSE 'svc-a' END WHEN how = 'inferred' THEN 'svc-a' END AS target_repo, how = 'external' AS external FROM auth)"""


def _match(calls: str, strict: bool) -> str:
    scope = "AND (c.target_repo IS NULL OR c.target_repo = r.repo_id)" if strict else ""
    return f"""m0 AS (SELECT c.*, r.provider, r.repo_id, r.vector, r.branch FROM {calls} AS c JOIN {_route_rows().replace("AS t(", "AS r(")} ON c.method = r.method AND regexp_full_match(c.path, r.pattern) {scope}),
m1 AS (SELECT *, min(vector) OVER (PARTITION BY call) AS best FROM m0),
m AS (SELECT * FROM m1 WHERE vector = best OR (instr(best, '1') > 0 AND substr(vector, 1, instr(best, '1')) = substr(best, 1, instr(best, '1'))))"""


_RESOLVED = f"""{_AUTH}, inside AS (SELECT * FROM target WHERE NOT external), {_match("inside", True)},
g AS (SELECT call, string_agg(DISTINCT provider, ',' ORDER BY provider) AS candidates, count(DISTINCT provider) AS n, count(DISTINCT provider) FILTER (repo_id = caller_repo) AS n_local, min(provider) AS one, min(provider) FILTER (repo_id = caller_repo) AS one_local FROM m GROUP BY call),
res AS (SELECT t.call, t.method, t.path, coalesce(candidates, '') AS candidates, CASE WHEN n_local = 1 THEN one_local WHEN n = 1 THEN one END AS provider,
  CASE WHEN external THEN 'external' WHEN n IS NULL THEN 'no_provider' WHEN n_local = 1 OR n = 1 THEN 'linked' ELSE 'ambiguous' END AS outcome FROM target AS t LEFT JOIN g USING (call))"""

_CANON = {
    "/a/{x}/b": ("/a/{}/b", "020", "/a/{x}/b"), "/files/{name}.json?x=1": ("/files/{}.json", "01", "/files/{name}.json?x=1"), "/p/*": ("/p/{*}", "03", "/p/*"), "/q/{rest...}/cut": ("/q/{*}", "03", "/q/{rest...}/cut"),
    "/n/[id]/[...slug]": ("/n/{}/{*}", "023", "/n/[id]/[...slug]"), "/f/<int:x>": ("/f/{}", "02", "/f/<int:x>"), "/f/<path:x>": ("/f/{*}", "03", "/f/<path:x>"), "/c/:id": ("/c/{}", "02", "/c/:id"), "/c/:rest*": ("/c/{*}", "03", "/c/:rest*"),
    "//double//x/": ("/double/x", "00", "/double/x"), "/": ("/", "", "/"), "/v{major}.{minor}/x#f": ("/v{}.{}/x", "10", "/v{major}.{minor}/x#f"), "/{a}{b}": ("/{}", "2", "/{a}{b}"), "/plain": ("/plain", "0", "/plain"),
}
_SEV = "CASE status WHEN 'confirmed' THEN 1 WHEN 'inferred' THEN 2 WHEN 'ambiguous' THEN 3 WHEN 'stale' THEN 4 ELSE 5 END"

ORACLE_SQL = {
    "incremental_plan": f"WITH {_FP} SELECT * FROM plan WHERE change IS NOT NULL",
    "batch_reuse": f"WITH {_FP} SELECT a.path, b.path IS NOT NULL AS reused FROM a LEFT JOIN b ON a.repo_id = b.repo_id AND a.path = b.path AND a.content_hash = b.content_hash AND NOT ends_with(b.path, '5.txt')",
    "partial_scan_union": f"WITH {_FP} SELECT repo_id, path, content_hash FROM b WHERE repo_id NOT IN ('src0', 'src3', 'src7') UNION ALL SELECT repo_id, path, content_hash FROM a WHERE repo_id IN ('src0', 'src3', 'src7')",
    "extractor_runs": f"WITH {_FP} SELECT a.repo_id, 'main' AS checkout_id, 'text' AS extractor, count(*) AS inputs, count(p.change) AS changed FROM a LEFT JOIN plan AS p ON a.path = p.path AND a.repo_id = p.repo_id GROUP BY 1",
    "snapshot_identity": f"WITH {_FP} SELECT count(*) AS n, bit_xor(CAST('0x' || substr(sha256(repo_id || chr(31) || checkout_id || chr(31) || path || chr(31) || extractor || chr(31) || content_hash), 1, 15) AS BIGINT)) AS digest FROM a",
    "fingerprint_dedup": "SELECT 'u' || user_id AS repo_id, 'main' AS checkout_id, event_type AS path, 'e' AS extractor, max(event_id) AS seq FROM events GROUP BY user_id, event_type",
    "publication_delta": f"""WITH {G.GRAPH}, n AS (SELECT *, CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) AS k FROM nodes WHERE kind IN ('service', 'symbol_ref'))
SELECT id, CASE WHEN k % 10 = 0 THEN 'insert' WHEN k % 10 = 1 THEN 'delete' ELSE 'update' END AS operation FROM n WHERE k % 10 IN (0, 1) OR k % 7 = 0""",
    "query_cache_eviction": "SELECT workspace_id, key FROM (SELECT 'w' || (user_id % 5) AS workspace_id, CAST(event_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id % 5 ORDER BY floor(epoch(ts)) DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) WHERE n <= 1024",
    "cache_lru_by_bytes": "SELECT workspace_id, key, held FROM (SELECT 'w' || (user_id % 5) AS workspace_id, CAST(event_id AS VARCHAR) AS key, CAST(sum(event_id % 1000 + 1) OVER (PARTITION BY user_id % 5 ORDER BY floor(epoch(ts)) DESC, CAST(event_id AS VARCHAR) DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held FROM events) WHERE held <= 100000",
    "route_canonical": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', '{v}', '{n}')" for p, (c, v, n) in _CANON.items()) + ") AS t(path, canonical, vector, normalized)",
    "route_template_join": f"WITH {_CALLS}, {_match('calls', False)} SELECT call, provider, vector FROM m",
    "authority_resolution": f"WITH {_AUTH} SELECT call, authority, how, target_repo, external FROM target",
    "scope_narrowing": f"WITH {_RESOLVED} SELECT call, outcome, provider, candidates FROM res",
    "route_coverage": f"WITH {_RESOLVED} SELECT count(*) FILTER (outcome = 'linked') AS linked, count(*) FILTER (outcome = 'no_provider') AS no_provider, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'external') AS external, count(*) AS calls FROM res",
    "route_gaps": f"WITH {_RESOLVED} SELECT call AS caller, method, path, outcome AS reason, candidates FROM res WHERE outcome <> 'linked'",
    "event_delivery_projection": f"""WITH e AS (SELECT event_type, 'nation-' || (user_id % 25) AS repo, user_id % 2 = 0 AS pub, CAST((100 - 5 * (event_id % 11)) / 100.0 AS FLOAT) AS confidence,
  CASE WHEN event_id % 13 = 0 THEN 'stale' WHEN event_id % 5 = 0 THEN 'inferred' ELSE 'confirmed' END AS status, 'ev:' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS ev FROM events),
g AS (SELECT event_type, repo, pub, max({_SEV}) AS s, min(confidence) AS c, list_sort(list_distinct(list(ev)))[1:17] AS ev FROM e GROUP BY ALL),
x AS (SELECT p.event_type, length(p.event_type) % 2 = 0 AS namespaced, p.repo AS a, q.repo AS b, greatest(p.s, q.s) AS s, least(p.c, q.c) AS c, p.ev[1] AS f1, q.ev[1] AS f2, list_sort(list_distinct(list_concat(p.ev, q.ev))) AS ev
  FROM g AS p JOIN g AS q ON p.event_type = q.event_type WHERE p.pub AND NOT q.pub),
y AS (SELECT *, list_concat(CASE WHEN f1 = f2 THEN [f1] ELSE [f1, f2] END, list_filter(ev, lambda v: v <> f1 AND v <> f2)) AS u FROM x)
SELECT 'channel:' || event_type AS channel_id, event_type AS channel_label, namespaced, a AS publisher_repository, b AS subscriber_repository,
  ['confirmed', 'inferred', 'ambiguous', 'stale', 'incomplete'][CASE WHEN namespaced THEN s ELSE greatest(s, 3) END] AS status, round(CAST(CASE WHEN namespaced THEN c ELSE least(c, CAST(0.5 AS FLOAT)) END AS DOUBLE), 6) AS confidence,
  array_to_string(u[1:16], ',') AS evidence, len(u) > 16 AS evidence_truncated FROM y""",
    "event_channel_resolution": """WITH e AS (SELECT event_id, event_type AS channel, ['kafka', 'generic', 'nats'][CAST(event_id % 3 + 1 AS INT)] AS broker, CASE WHEN event_id % 4 = 0 THEN 'ns' || (user_id % 2) END AS namespace FROM events),
d AS (SELECT * FROM (VALUES ('kafka', 'ns0', 'k0'), ('kafka', 'ns1', 'k1'), ('nats', NULL, 'n')) AS t(b, n, i)),
m AS (SELECT event_id, count(DISTINCT i) AS c, min(i) AS i FROM e JOIN d ON (broker = b OR broker = 'generic') AND (namespace IS NULL OR n IS NULL OR namespace = n) GROUP BY 1)
SELECT CAST(e.event_id AS VARCHAR) AS endpoint, CASE WHEN c = 1 THEN channel || ':' || i ELSE 'event:' || broker || ':' || coalesce(namespace, '') || ':' || channel END AS channel_id FROM e LEFT JOIN m USING (event_id)""",
    "exactly_one_link": "SELECT p_brand || '|' || p_type || '|' || p_size AS field, min(CAST(p_partkey AS VARCHAR)) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1",
    "package_owner_link": """WITH o AS (SELECT l_partkey || ':' || l_linenumber AS package, min(s_nationkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) = 1)
SELECT DISTINCT 'nation-' || c_nationkey AS source_repo, 'nation-' || n AS target_repo, o.package FROM lineitem AS l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN o ON o.package = l.l_partkey || ':' || l.l_linenumber WHERE c_nationkey <> n""",
    "table_alias_link": """WITH t AS (SELECT 'table:' || c_custkey AS id, 'db' || (c_nationkey % 3) AS db, lower(c_mktsegment) AS s, 't' || (c_custkey % 400) AS n FROM customer),
a AS (SELECT DISTINCT unnest([id, n, s || '.' || n, db || '.' || n, db || '.' || s || '.' || n]) AS alias, id FROM t),
u AS (SELECT alias, min(id) AS id FROM a GROUP BY alias HAVING count(DISTINCT id) = 1),
r AS (SELECT 'order:' || o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || (o_custkey % 500) ELSE 'db0.' || lower(regexp_extract(o_orderpriority, '[A-Z]+')) || '.t' || (o_custkey % 400) END AS reference FROM orders)
SELECT order_id, reference, u.id AS table_id FROM r LEFT JOIN u ON lower(reference) = alias""",
    "foreign_key_pairs": """WITH k AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation)
SELECT 'fk' || k AS fk, 't' || k AS source, 't' || r AS target FROM k WHERE k % 3 = 0
UNION ALL SELECT 'fk' || k, 't' || k || '.c' || i, 't' || r || '.c' || i FROM (SELECT k, r, unnest(range(0, k % 2 + 1)) AS i FROM k WHERE k % 3 <> 0 AND k % 4 >= k % 2 AND r % 4 >= k % 2)""",
    "migration_lineage": """WITH m AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 25 AS repo, o_orderkey % 5 AS dir, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 997 END AS hint, o_custkey AS family, o_orderkey % 2 = 0 AS up FROM orders),
h AS (SELECT repo, dir, hint, count(*) AS n, min(id) AS id FROM m WHERE up AND hint IS NOT NULL GROUP BY ALL),
l AS (SELECT id, n, lead(id) OVER w AS t, lead(n) OVER w AS m FROM h WINDOW w AS (PARTITION BY repo, dir ORDER BY hint))
SELECT id AS source, t AS target, 'precedes' AS kind FROM l WHERE n = 1 AND m = 1
UNION ALL SELECT min(id) FILTER (NOT up), min(id) FILTER (up), 'reverts' FROM m GROUP BY repo, dir, family HAVING count(*) FILTER (up) = 1 AND count(*) FILTER (NOT up) = 1""",
    "path_containment": f"""WITH {G.GRAPH}, a AS (SELECT DISTINCT repo_id, 'src/' || regexp_extract(file_path, '_([0-9]+)', 1) || '/' || file_path AS path FROM evidence)
SELECT 'r' || n_nationkey AS reference, repo_id || ':' || path AS artifact FROM nation JOIN a ON repo_id = 'nation-' || n_nationkey AND starts_with(path, 'src/' || n_nationkey || '/')
UNION ALL SELECT 'f' || n_nationkey, repo_id || ':' || path FROM nation JOIN a ON repo_id = 'nation-' || n_nationkey AND path = 'src/' || n_nationkey || '/src/customer_' || n_nationkey || '.py'""",
    "manual_link_overlay": """WITH e AS (SELECT 'nation:' || s_nationkey AS source, 'supplier:' || s_suppkey AS target, 'contains' AS kind FROM supplier WHERE s_suppkey % 2 <> 0 UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer)
SELECT source || '>' || kind || '>' || target AS id, source, target, kind, 'ev:' || source || '>' || kind || '>' || target AS evidence FROM e
UNION ALL SELECT 'supplier:' || s.s_suppkey || '>consumes>supplier:' || t.s_suppkey, 'supplier:' || s.s_suppkey, 'supplier:' || t.s_suppkey, 'consumes', 'manual:a' || s.s_suppkey FROM supplier AS s JOIN supplier AS t ON t.s_suppkey = s.s_suppkey + 1""",
    "manual_link_problems": """SELECT 'a' || s_suppkey AS link, 'missing_endpoint' AS problem FROM supplier WHERE s_suppkey + 1 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 's' || s_suppkey, 'missing_suppression' FROM supplier WHERE s_suppkey % 2 <> 0""",
    "edge_consensus_merge": """WITH g AS (SELECT l_orderkey, l_suppkey, max(CAST((100 - 5 * round(l_discount * 100)) / 100 AS FLOAT)) AS c, string_agg(DISTINCT 'line:' || l_linenumber, ',' ORDER BY 'line:' || l_linenumber) AS evidence FROM lineitem GROUP BY ALL)
SELECT 'order:' || l_orderkey || '>calls_remote>supplier:' || l_suppkey AS id, 'order:' || l_orderkey AS source, 'supplier:' || l_suppkey AS target, 'calls_remote' AS kind, round(CAST(c AS DOUBLE), 6) AS confidence, evidence, CASE WHEN c >= 1 THEN 'confirmed' ELSE 'inferred' END AS status FROM g""",
    "graph_assembly": f"WITH {G.GRAPH} SELECT id, kind, repo_id, stable_key, label || CASE WHEN CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 3 = 0 THEN ' (later)' ELSE '' END AS label FROM nodes WHERE kind IN ('service', 'symbol_ref')",
    "graph_validation": f"""WITH {G.GRAPH}, e AS (SELECT *, CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) AS k FROM edges WHERE kind IN ('calls_remote', 'consumes'))
SELECT 'dangling_target' AS problem, id FROM e WHERE kind = 'calls_remote' AND k % 7 = 0 UNION ALL SELECT 'repeated_evidence', id FROM e WHERE k % 11 = 0
UNION ALL SELECT 'missing_evidence', id FROM e WHERE kind = 'calls_remote' UNION ALL SELECT 'reversed_lines', id FROM evidence WHERE start_line % 5 = 0""",
}
