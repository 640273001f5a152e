"""Properties of the engine's operators: determinism, incremental equals full, ambiguity, gaps, never a number without coverage."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.extract import declared, source
from weftgraph.functions import routes as R
from weftgraph.model import EDGES, NODES
from weftgraph.operators import changes, communities, compat, impact, incremental, linking, reports, search, traverse
from weftgraph.sources import files


def graph(spark, pairs, kind="consumes", status="confirmed", confidence=1.0, kinds=None):
    names = sorted({x for p in pairs for x in p[:2]})
    nodes = spark.createDataFrame([(n, (kinds or {}).get(n, "service"), f"repo-{n[0]}", f"key:{n}", n) for n in names], NODES)
    rows = [(f"{a}>{b}", a, b, (p[2] if len(p) > 2 else kind), float(p[3] if len(p) > 3 else confidence), (p[4] if len(p) > 4 else status), ["ev"]) for p in pairs for a, b in [p[:2]]]
    return nodes, spark.createDataFrame(rows, EDGES)


CLUSTERS = [(a, b) for group in ("abc", "def") for a in group for b in group if a != b]


def test_louvain_two_clusters(spark):
    nodes, edges = graph(spark, CLUSTERS)
    bridge = spark.createDataFrame([("bridge", "c", "d", "manual_link", 0.05, "confirmed", [])], EDGES)
    accepted = communities.accepted_edges(edges.unionByName(bridge), 0.01)
    for run in (communities.louvain, communities.label_propagation):
        got = {}
        for r in run(nodes, accepted).collect():
            got.setdefault(r.community, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e", "f"]]


def test_louvain_is_deterministic(spark):
    nodes, edges = graph(spark, CLUSTERS + [("c", "d")])
    rows = edges.collect()
    random.Random(3).shuffle(rows)
    shuffled = spark.createDataFrame(rows, EDGES)
    f = lambda e: sorted(map(tuple, communities.louvain(nodes, communities.accepted_edges(e)).collect()))
    assert f(edges) == f(shuffled)


def test_components(spark):
    nodes, edges = graph(spark, [("a", "b"), ("c", "c")])
    got = {r.node: r.component for r in communities.connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components_against_union_find(spark, pairs):
    nodes, edges = graph(spark, sorted({(f"n{a:02}", f"n{b:02}") for a, b in pairs}))
    parent = {r.id: r.id for r in nodes.collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges.collect():
        a, b = sorted((root(r.source), root(r.target)))
        parent[b] = a
    assert {r.node: r.component for r in communities.connected_components(nodes, edges).collect()} == {n: root(n) for n in parent}


def test_page_rank_sums_to_one(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    ranks = communities.page_rank(nodes, communities.accepted_edges(edges), rounds=8)
    assert abs(sum(r.rank for r in ranks.collect()) - 1) < 1e-6


def test_trace_walks_every_status_but_traversal_only_confirmed(spark):
    nodes, edges = graph(spark, [("a", "b", "consumes", 1.0, "stale"), ("b", "c")])
    assert traverse.trace(edges, "a", "c").count() == 2
    assert traverse.trace(edges, "c", "a").count() == 0
    assert traverse.paths(nodes, edges, "a").count() == 0


def test_k_best_orders_by_weight(spark):
    nodes, edges = graph(spark, [("a", "b", "consumes", 0.5), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d", "consumes", 0.25)])
    got = traverse.k_best(traverse.paths(nodes, edges, "a", max_cross=9), 3).where("node = 'd'").orderBy("place").collect()
    assert [r.nodes for r in got] == [["a", "c", "d"], ["a", "b", "d"], ["a", "d"]]


def test_cross_repository_bound(spark):
    nodes, edges = graph(spark, [("a1", "a2"), ("a2", "b1"), ("b1", "c1")])
    assert {r.node for r in traverse.paths(nodes, edges, "a1", max_cross=1).collect()} == {"a2", "b1"}


def test_impact_prefers_certainty_over_distance(spark):
    nodes, edges = graph(spark, [("x", "t", "consumes", 0.5), ("y", "t"), ("x", "y"), ("v", "t", "validates")])
    got = {r.id: (r.classification, r.depth) for r in impact.impact(nodes, edges, "t").collect()}
    assert got == {"y": ("directly_dependent", 1), "x": ("transitively_affected", 2)}


def test_impact_has_no_structural_pivot(spark):
    nodes, edges = graph(spark, [("p", "t", "contains"), ("p", "sibling", "contains")])
    assert {r.id for r in impact.impact(nodes, edges, "t", direction="both").collect()} == {"p"}


def test_risk_without_coverage_has_no_number(spark):
    nodes, edges = graph(spark, [("direct", "contract"), ("transitive", "direct")])
    items = impact.impact(nodes, edges, "contract")
    factors = impact.risk_factors(items, "repo-c", n_tests=0, n_owners=0, tags=spark.createDataFrame([("direct", "security", ["ev"]), ("direct", "payment", [])], "node_id string, tag string, evidence array<string>"))
    assert impact.risk_score(factors, False).first().score is None
    r = impact.risk_score(factors, True).first()
    assert r.level == "critical" and r.score == 100.0
    bare = impact.risk_factors(items, "repo-c", n_tests=0, n_owners=0, tags=spark.createDataFrame([("direct", "security", []), ("contract", "payment", ["ev"])], "node_id string, tag string, evidence array<string>"))
    assert impact.risk_score(bare, True).first().level == "high"  # no evidence behind the tag; the target is not named
    own = impact.coverage(items.limit(0), spark.createDataFrame([("repo-c", "commits_behind")], "repo_id string, state string"), "repo-c").first()
    assert own.stale == 1 and not own.sufficient_for_score and own.gaps == ["repositories_stale"]


def test_exactly_one(spark):
    c = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "a"), ("k2", "b")], "key string, id string")
    assert [tuple(r) for r in linking.exactly_one(c, ["key"]).collect()] == [("k1", "a")]


def test_gaps_and_links_add_up(spark):
    providers = spark.createDataFrame([("p1", "a", "GET", "/x/{id}"), ("p2", "b", "GET", "/x/:id"), ("p3", "b", "GET", "/y")], "id string, repo_id string, method string, path string")
    calls = spark.createDataFrame([("c1", "GET", "/x/1", "a", None, False), ("c2", "GET", "/x/1", "z", None, False), ("c3", "GET", "/y", "z", None, False), ("c4", "GET", "/n", "z", None, False), ("c5", "GET", "/y", "z", None, True), ("c6", "GET", "/y", "z", "a", False)],
                                  "call string, method string, path string, caller_repo string, target_repo string, external boolean")
    res = linking.resolved_calls(calls, providers, [])
    assert {r.call: r.outcome for r in res.collect()} == {"c1": "linked", "c2": "ambiguous", "c3": "linked", "c4": "no_provider", "c5": "external", "c6": "no_provider"}
    c = linking.link_coverage(res).first()
    assert c.linked + c.no_provider + c.ambiguous + c.external == c.calls == 6
    assert [r.candidates for r in linking.link_gaps(res).where("reason = 'ambiguous'").collect()] == [["p1", "p2"]]


@pytest.mark.parametrize("call,want", [
    ("/a/b", ["static"]), ("/a/x.json", ["mixed"]), ("/a/x", ["param"]), ("/a/x/y", ["rest"]), ("/a", []), ("/a/{q}", ["param"]), ("/a/{n}.json", ["mixed"]),
])
def test_most_specific_template(spark, call, want):
    providers = spark.createDataFrame([("static", "r", "GET", "/a/b"), ("mixed", "r", "GET", "/a/{f}.json"), ("param", "r", "GET", "/a/{id}"), ("rest", "r", "GET", "/a/*")], "id string, repo_id string, method string, path string")
    calls = spark.createDataFrame([("c", "GET", call)], "call string, method string, path string")
    assert sorted(r.provider for r in linking.route_matches(calls, providers).collect()) == want


def test_incremental_equals_full(spark):
    rng = random.Random(5)
    key = lambda i: ("r", "main", f"f{i}", "x")
    before = spark.createDataFrame([(*key(i), str(rng.randrange(3))) for i in range(30)], "repo_id string, checkout_id string, path string, extractor string, content_hash string")
    after = spark.createDataFrame([(*key(i), str(rng.randrange(3))) for i in range(10, 40)], before.schema)
    plan = incremental.scan_plan(before, after)
    kept = before.join(plan.select("path"), "path", "left_anti").select(before.columns)
    new = after.join(plan.where("change <> 'deleted'").select("path"), "path", "left_semi").select(before.columns)
    assert sorted(map(tuple, kept.unionByName(new).collect())) == sorted(map(tuple, after.collect()))
    assert incremental.scan_plan(after, after).isEmpty()
    a, b = (incremental.snapshot_identity(x).first() for x in (after, after.orderBy(F.rand(1))))
    assert a == b


def test_publication_delta_is_what_changes(spark):
    nodes, _ = graph(spark, [("a", "b")])
    assert incremental.publication_delta(nodes, nodes, incremental.node_digest()).isEmpty()
    later = nodes.where("id <> 'a'").withColumn("label", F.lit("new"))
    assert sorted(map(tuple, incremental.publication_delta(nodes, later, incremental.node_digest()).collect())) == [("a", "delete"), ("b", "update")]


def test_compat_fixtures(spark):
    t = "table string, column string, type string, nullable boolean, has_default boolean, primary_key boolean"
    before = spark.createDataFrame([("o", "id", "BIGINT", False, False, True), ("o", "customer_id", "BIGINT", True, False, False), ("o", "total", "BIGINT", True, False, False)], t)
    after = spark.createDataFrame([("o", "id", "BIGINT", False, False, True), ("o", "total", "INTEGER", True, False, False)], t)
    got = {(r.path, r.code): r.status for r in compat.database(before, after).collect()}
    assert got[("o.customer_id", "database.column_removed")] == got[("o.total", "database.column_type_changed")] == "breaking"
    assert compat.rolled_up(compat.database(before, after)).first().status == "breaking"
    # the same versions are compatible but for what is never modelled
    assert {r.status for r in compat.database(before, before).collect()} == {"unknown"}


def test_hunks_meet_evidence(spark):
    f = spark.createDataFrame([("r", "modified", "a", "a", False, False, [(1, 1, 70, 2)]), ("r", "modified", "b", "b", True, False, [])],
                              "repo_id string, status string, old_path string, new_path string, binary boolean, untracked boolean, hunks array<struct<old_start:int,old_count:int,new_start:int,new_count:int>>")
    ev = spark.createDataFrame([("e1", "r", "a", 60, 70), ("e2", "r", "a", 72, 80), ("e3", "r", "b", 1, 1)], "id string, repo_id string, file_path string, start_line int, end_line int")
    assert {(r.evidence_id, r.exact) for r in changes.mapped(f, ev).collect()} == {("e1", True), ("e3", False)}


def test_search_absence_and_bounds(spark):
    nodes, _ = graph(spark, [("alpha", "beta")])
    assert search.search(nodes, "nothing here").isEmpty()
    r = search.search(nodes, "alpha").first()
    assert (r.id, r.lexical, r.total, r.truncated) == ("alpha", 4.0, 1, False)
    assert search.query_terms("A-b a " * 40) == ["a", "b"]
    twice, _ = graph(spark, [("log log", "log")])
    assert search.search(twice, "Log  LOG").orderBy("id").first().lexical == 4.0
    for query, page in (("?!", {}), ("a", {"limit": 0}), ("a", {"limit": 101}), ("a", {"offset": -1})):
        with pytest.raises(ValueError):
            search.search(nodes, query, **page)


def test_export_keeps_whole_edges(spark, tmp_path):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c")])
    n, e = reports.exported(nodes, edges, most_nodes=2)
    assert {r.id for r in n.collect()} == {"a", "b"} and {r.id for r in e.collect()} == {"a>b"}
    reports.write_export(nodes, edges, str(tmp_path / "x"), "graphml")
    assert spark.read.text(str(tmp_path / "x")).count() == 5


def test_manual_links(spark):
    nodes, edges = graph(spark, [("a", "b")])
    m = spark.createDataFrame([("m1", "add", "key:b", "a", "consumes"), ("m2", "suppress", "a", "b", "consumes"), ("m3", "add", "a", "a", "consumes"), ("m4", "add", "a", "gone", "consumes")], "link string, action string, source string, target string, kind string")
    out, problems = linking.manual_overlay(edges, nodes, m)
    assert {r.id for r in out.collect()} == {"b>consumes>a"}
    assert {tuple(r) for r in problems.collect()} == {("m3", "self_link"), ("m4", "missing_endpoint")}


def test_segment_classes(spark):
    d = spark.createDataFrame([("/a/${x}.json/{y}/*/cut",)], "p string").select(R.canonical(F.col("p")).alias("c"), R.classes(R.segments(F.col("p"))).alias("v")).first()
    assert tuple(d) == ("/a/{}.json/{}/{*}", "0123")


def test_settings_never_keep_values():
    rows = list(declared.config_keys("x/.env", "API_TOKEN=abc123\nPORT=80\n"))
    assert "abc123" not in repr(rows) and [r["kind"] for r in rows] == ["sensitive", "plain"]


def test_python_urls():
    rows = list(source.python("a.py", "BASE = 'https://h'\ndef f(i):\n    session.get(BASE + '/v/' + i)\n    session.get(f'/v/x{i}')\n"))
    assert [(r["method"], r["route"], r["authority"]) for r in rows] == [("GET", "/v/{}", "h")]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=120))
def test_extractors_never_fail(text):
    from weftgraph.extract.run import EXTRACTORS

    for e in EXTRACTORS.values():
        list(e.extract("x/a.py", text))


def test_globs():
    import re

    assert re.search(files.glob_pattern("src/**/*.py"), "src/a/b/c.py") and not re.search(files.glob_pattern("src/*.py"), "src/a/b.py")


def test_discovery(spark, tmp_path):
    for name, body in (("src/a.py", "x = 1\n"), ("node_modules/b.js", "no"), ("db/t.sql", "SELECT 1")):
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(body)
    found = files.discover(spark, {"r": str(tmp_path / "repo")})
    assert sorted(r.path for r in found.select("path").collect()) == ["db/t.sql", "src/a.py"]
    assert {(r.path, r.extractor) for r in files.fingerprints(found).collect()} == {("db/t.sql", "sql"), ("src/a.py", "source_python"), ("src/a.py", "events"), ("src/a.py", "literal_sql")}


def test_watch_runs_targeted_passes(spark, tmp_path):
    from weftgraph.streaming import watch

    (tmp_path / "in" / "one").mkdir(parents=True)
    (tmp_path / "in" / "one" / "a.rs").write_text("x")
    seen = []
    q = watch.watch(spark, str(tmp_path / "in"), lambda scope, repos: seen.append((scope, list(repos))), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen == [("repositories", ["one"])]


def test_watch_passes_wait_and_coalesce(spark):
    from weftgraph.streaming import watch

    runs = lambda at, **kw: [tuple(r) for r in watch.due(spark.createDataFrame([(x,) for x in at], "window_start long"), 8, **kw).orderBy("window_start").select("runs_at", "outcome").collect()]
    assert [r for r, _ in runs([0, 5, 10, 15])] == [0, 8, 16, 24]
    assert [r for r, _ in runs([0, 5, 6, 7, 40])] == [0, 8, 16, 16, 40]
    assert runs([0, 50, 51], idle_timeout=30) == [(0, "runs"), (None, "expired_idle"), (None, "expired_idle")]
    assert runs([0, 5, 10], session_limit=16) == [(0, "runs"), (8, "runs"), (None, "expired_session")]


def test_long_runs_are_cut_anew(spark):
    from weftgraph.streaming import watch

    at = [*range(0, 10), *range(11, 21), 22]
    e = spark.createDataFrame([("r", t) for t in at], "repo_id string, t long").selectExpr("repo_id", "timestamp_seconds(t) as ts")
    assert sorted(tuple(r)[1:] for r in watch.debounce_sessions(e).collect()) == [(0, 9, 10), (11, 20, 10), (22, 22, 1)]


def test_a_pair_in_a_split_and_a_merge(spark):
    before = spark.createDataFrame([("b1", f"n{i}") for i in range(8)] + [("b2", f"m{i}") for i in range(4)], "community_id string, node_id string")
    after = spark.createDataFrame([("a1", f"n{i}") for i in range(4)] + [("a1", f"m{i}") for i in range(4)] + [("a2", f"n{i}") for i in range(4, 8)], "community_id string, node_id string")
    got = sorted((r.change, r.before, r.after) for r in communities.delta(before, after).collect())
    assert got == [("merged", ["b1", "b2"], ["a1"]), ("split", ["b1"], ["a1", "a2"])]


def test_equal_weights_are_chosen_by_nodes(spark):
    nodes, edges = graph(spark, [("s", "b"), ("b", "t"), ("s", "c"), ("c", "a"), ("a", "t"), ("s", "t", "consumes", 0.5)])
    got = traverse.k_best(traverse.paths(nodes, edges, "s", max_cross=9), 1).where("node = 't'").first()
    assert got.nodes == ["s", "b", "t"]
    for only, pick in (("shortest", traverse.shortest), ("lightest", traverse.k_best)):
        all_ = {r.node: (r.depth, r.edge_ids) for r in pick(traverse.paths(nodes, edges, "s", max_cross=9)).collect()}
        assert all_ == {r.node: (r.depth, r.edge_ids) for r in pick(traverse.paths(nodes, edges, "s", max_cross=9, only=only)).collect()}


def test_commit_verdicts(spark):
    f = spark.createDataFrame([("a", "staged"), ("a", "unstaged"), ("d/x", "untracked"), ("b", "unstaged")], "path string, layer string")
    verdict = lambda mode, paths=(): tuple(changes.commit_verdict(changes.commit_gate(f, mode, paths), mode).first())
    assert verdict("default") == (True, []) and verdict("include", ["a"]) == (True, [])
    assert verdict("only", ["a"]) == (False, ["ambiguous_layers"]) and verdict("only", ["d"]) == (True, []) and verdict("only", ["z"]) == (False, ["nothing_selected"])
    with pytest.raises(ValueError):
        changes.commit_gate(f, "only", ["--all"])


def test_snapshots(spark, tmp_path):
    from weftgraph.sources import snapshots

    nodes, edges = graph(spark, [("a", "b"), ("b", "c")])
    ev = spark.createDataFrame([("ev", "f.py")], "id string, file_path string")
    root = str(tmp_path / "store")
    snapshots.publish(spark, root, "s1", nodes, edges, ev)
    with pytest.raises(RuntimeError):
        snapshots.publish(spark, root, "s2", nodes, edges, ev)  # another one is current
    with pytest.raises(ValueError):
        snapshots.publish(spark, root, "s1", nodes, edges, ev, expected="s1")
    assert snapshots.current(spark, root) == "s1"
    snapshots.publish(spark, root, "s2", nodes.limit(1), edges.limit(0), ev, expected="s1")
    assert snapshots.scan(spark, root, "nodes").count() == 1 and snapshots.scan(spark, root, "nodes", snapshot_id="s1").count() == nodes.count()
    assert all(r.ok for r in snapshots.integrity(spark, root).collect())
    nodes.write.mode("append").parquet(f"{root}/s2/nodes")
    assert [r.table for r in snapshots.integrity(spark, root).collect() if not r.ok] == ["nodes"]
    with pytest.raises(RuntimeError):
        snapshots.backup(spark, root, str(tmp_path / "saved"))


def test_all_extractors_read_a_file_once(spark):
    from weftgraph.extract import run

    text = "import requests\n@app.get('/a/{id}')\ndef read():\n    return requests.get('http://x/b')\n\ncur.execute('SELECT a FROM t')\n"
    files = spark.createDataFrame([("r", "svc/a.py", text), ("r", "db/q.sql", "CREATE TABLE t (id INT);\n"), ("r", "README.md", "see [x](y.md)\n"), ("r", "none.bin", None)], "repo_id string, path string, text string")
    found = run.everything(files)
    for name in ("source_python", "sql", "markdown", "literal_sql"):
        assert sorted(map(str, found[name].collect())) == sorted(map(str, run.extracted(files, name).collect())), name
    assert found["source_python"].count() and found["sql"].count() and found["markdown"].count()


def test_target_by_id_or_key(spark):
    nodes, _ = graph(spark, [("a", "b")])
    key = nodes.where("id = 'a'").first().stable_key
    assert impact.resolved_target(nodes, "a") == "a" and impact.resolved_target(nodes, key) == "a"
    with pytest.raises(LookupError):
        impact.resolved_target(nodes, "nobody")
