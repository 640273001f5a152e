"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from weftgraph import plans

from .conftest import SF, same

QUICK = ("search", "linking", "building", "composing", "compat", "changes", "reports", "extraction", "watch")
CASES = [(m, k) for m in plans.modules() if m.__name__.rsplit(".", 1)[1] in QUICK for k in m.QUERIES]
GRAPH = ["trace_shortest", "traverse_bfs", "k_shortest_paths", "repository_ownership_closure", "impact_items", "risk_score", "connected_components", "community_metrics", "community_labels", "community_delta", "god_nodes"]


@pytest.mark.parametrize("module,name", CASES, ids=[k for _, k in CASES])
def test_query(spark, duck, module, name):
    df = module.QUERIES[name](spark, SF)
    if name in module.ORACLE_SQL:
        same(df, duck, module.ORACLE_SQL[name])
    else:
        df.collect()


@pytest.mark.parametrize("name", GRAPH)
def test_graph_query(spark, duck, name):
    from weftgraph.plans import graph

    same(graph.QUERIES[name](spark, SF), duck, graph.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
