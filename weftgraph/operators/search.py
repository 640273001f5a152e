"""Ranked search: full-text candidates, explainable signals, total order and pages."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalized, terms
from ..model import FRESHNESS_PENALTY, NO_FRESHNESS_PENALTY
from ..sources.shared import written

MOST_TERMS, MOST_HITS, MOST_OFFSET, MOST_FTS, MOST_QUERY_BYTES = 32, 100, 1_000_000, 500, 1024
K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """At most 32 distinct lower-cased alphanumeric terms, in order."""
    out: list[str] = []
    word = ""
    for c in query.encode()[:MOST_QUERY_BYTES].decode(errors="ignore") + " ":
        if c.isalnum():
            word += c.lower()
        elif word:
            if word not in out:
                out.append(word)
            word = ""
    return out[:MOST_TERMS]


def query_text(query: str) -> str:
    """The query as labels are normalised: lower case, runs of letters and digits with one blank between, repeats kept."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in query.lower()).split())


def full_text(rows: DataFrame, query: str, key: str = "id", columns: Sequence[str] = ("label", "stable_key"), limit: int = MOST_FTS) -> DataFrame:
    """(key, bm25, rank, fts): BM25 over the columns taken together, best first, ties by key; fts is 1 / rank.

    Only rows that have a term are exploded; document counts and mean length are observed while these are written: one pass.
    """
    wanted = query_terms(query)
    words = F.array_remove(F.split(normalized(F.concat_ws(" ", *columns)), " "), "")
    docs = rows.select(key, words.alias("w"))
    stats = Observation()
    hits = docs.observe(stats, F.count(F.lit(1)).alias("n"), F.sum(F.size("w")).alias("words")).where(F.arrays_overlap("w", F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")))
    hits = written(hits.select(key, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(wanted)).alias("w")), "terms")
    tf = hits.select(key, "len", F.explode("w").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    seen = stats.get
    n, mean = float(seen["n"]), (seen["words"] or 0) / max(seen["n"], 1)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # at most 32 rows
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (mean or 1.0)))
    scored = tf.join(F.broadcast(df), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("bm25"))
    best = scored.orderBy(F.desc("bm25"), key).limit(min(limit, MOST_FTS))
    rank = F.row_number().over(Window.orderBy(F.desc("bm25"), key))  # over at most 500 rows
    return best.withColumn("rank", rank).withColumn("fts", 1.0 / F.col("rank"))


def centrality(communities: DataFrame) -> DataFrame:
    """(node_id, centrality): the best of 1 / place among the central nodes of any community."""
    return communities.select(F.posexplode("central_nodes").alias("at", "node_id")).groupBy("node_id").agg(F.max(1.0 / (F.col("at") + 1)).alias("centrality"))


def service_memberships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(service_id, node_id): nodes on either side of an edge that touches a service, and each service itself."""
    services = nodes.where("kind = 'service'").select(F.col("id").alias("service_id"))
    ends = edges.select("source", "target")
    touched = ends.join(services, F.col("source") == F.col("service_id")).select("service_id", F.col("target").alias("node_id")).unionByName(
        ends.join(services, F.col("target") == F.col("service_id")).select("service_id", F.col("source").alias("node_id")))
    return touched.unionByName(services.select("service_id", F.col("service_id").alias("node_id"))).distinct()


def node_evidence(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(node_id, evidence_id) of all edges that touch a node, distinct; of the nodes ids(id) only, if given: before anything is exploded twice."""
    e = edges.select(F.explode(F.array("source", "target")).alias("node_id"), "evidence")
    if ids is not None:
        e = e.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return e.select("node_id", F.explode("evidence").alias("evidence_id")).distinct()


def _kind_text(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def search(
    nodes: DataFrame, query: str, *, kinds: Sequence[str] = (), repos: Sequence[str] = (), workspace: DataFrame | None = None, services: DataFrame | None = None,
    communities: DataFrame | None = None, community_filter: Sequence[str] = (), fts: DataFrame | None = None, centrality: DataFrame | None = None,
    evidence: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    freshness: DataFrame | None = None, offset: int = 0, limit: int = 20,
) -> DataFrame:
    """Hits with their signals, best first: (id, kind, repo_id, stable_key, label, lexical, ..., score, total, rank).

    Side tables: workspace(node_id), services(service_id, node_id) to restrict to, communities(community_id, node_id),
    fts(id, fts), centrality(node_id, centrality), evidence(node_id, confidence), freshness(repo_id, state); evidence may be a function
    that is asked for the ids of the hits.  A node needs a lexical match, an equal kind, or a full-text hit; the side tables are
    read for such nodes only.  Filters that are empty let all pass.  An empty query or a page out of bounds is refused.
    """
    text = query_text(query)
    if not text:
        raise ValueError("the query holds no letter or digit")
    if not 1 <= limit <= MOST_HITS or not 0 <= offset <= MOST_OFFSET:
        raise ValueError(f"a page has 1 to {MOST_HITS} rows and begins at {MOST_OFFSET} at most")
    q = F.lit(text)
    rows = nodes
    if kinds:
        rows = rows.where(F.col("kind").isin(list(kinds)))
    if repos:
        rows = rows.where(F.col("repo_id").isin(list(repos)))
    if workspace is not None:
        rows = rows.join(workspace.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    if services is not None:
        rows = rows.join(services.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    if community_filter:
        rows = rows.join(communities.where(F.col("community_id").isin(list(community_filter))).select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    label, key, kind = normalized(F.col("label")), normalized(F.col("stable_key")), _kind_text(F.col("kind"))
    exact = (label == q) | (key == q)
    prefix, suffix = label.startswith(q) | key.startswith(q), label.endswith(q) | key.endswith(q)
    lexical = F.when(exact, 4.0).otherwise(F.when(prefix, 1.5).otherwise(0.0) + F.when(suffix, 1.0).otherwise(0.0))
    kind_score = F.when(kind == q, 0.5).when(kind.startswith(q) | kind.endswith(q), 0.25).otherwise(0.0)
    rows = rows.withColumns({"lexical": lexical, "kind_score": kind_score, "_kind": kind == q})
    if fts is not None:
        rows = rows.join(fts.select(F.col("id"), F.col("fts").alias("_fts")), "id", "left")
    else:
        rows = rows.withColumn("_fts", F.lit(None).cast("double"))
    rows = rows.where((F.col("lexical") > 0) | F.col("_kind") | (F.col("_fts") > 0))
    if any(x is not None for x in (fts, centrality, communities, evidence)):
        rows = written(rows, "hits")  # what follows joins the hits, not the graph
    ids = rows.select("id")
    rows = rows.withColumn("fts_score", F.least(F.coalesce("_fts", F.lit(0.0)), F.lit(1.0)) * 2)
    scope = (0.15 if repos else 0.0) + (0.10 if workspace is not None else 0.0) + (0.15 if services is not None else 0.0)
    rows = rows.withColumn("scope_score", F.lit(min(scope, 0.4)))
    if centrality is not None:
        c = centrality.select(F.col("node_id").alias("id"), F.col("centrality").alias("_c"))
        rows = rows.join(c, "id", "left").withColumn("centrality_score", F.least(F.coalesce("_c", F.lit(0.0)), F.lit(1.0)) * 0.5).drop("_c")
    else:
        rows = rows.withColumn("centrality_score", F.lit(0.0))
    if communities is not None:
        member = communities.select(F.col("node_id").alias("id")).join(ids, "id", "left_semi").distinct().withColumn("_m", F.lit(True))
        rows = rows.join(member, "id", "left").withColumn("community_score", F.when(F.col("_m"), 0.4 if community_filter else 0.1).otherwise(0.0)).drop("_m")
    else:
        rows = rows.withColumn("community_score", F.lit(0.0))
    if evidence is not None:
        e = evidence(ids) if callable(evidence) else evidence.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        e = e.groupBy(F.col("node_id").alias("id")).agg(F.avg(F.col("confidence").cast("double")).alias("_e"))
        rows = rows.join(e, "id", "left").withColumn("evidence_score", F.least(F.coalesce("_e", F.lit(0.0)), F.lit(1.0)) * 0.75).drop("_e")
    else:
        rows = rows.withColumn("evidence_score", F.lit(0.0))
    if freshness is not None:
        penalty = F.create_map(*(F.lit(x) for kv in FRESHNESS_PENALTY.items() for x in kv))
        rows = rows.join(freshness.select("repo_id", F.col("state").alias("_s")), "repo_id", "left")
        rows = rows.withColumn("penalty", F.when(F.col("repo_id").isNull(), 0.0).otherwise(F.coalesce(penalty[F.col("_s")], F.lit(NO_FRESHNESS_PENALTY)))).drop("_s")
    else:
        rows = rows.withColumn("penalty", F.lit(0.0))
    parts = ("lexical", "kind_score", "fts_score", "scope_score", "centrality_score", "community_score", "evidence_score")
    score = F.round(F.greatest(sum((F.col(p) for p in parts[1:]), F.col(parts[0])) - F.col("penalty"), F.lit(0.0)), 6)
    out = rows.select("id", "kind", "repo_id", "stable_key", "label", *parts, "penalty", score.alias("score"))
    if any(x is not None for x in (fts, centrality, communities, evidence)):
        out = written(out, "hits")  # the joins run once for the page and the total
    return page(out, [F.desc("score"), F.asc("stable_key"), F.asc("id")], offset, limit)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order, with the number of all rows, and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    some = rows.orderBy(*order).offset(offset).limit(limit)
    return some.join(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def coverage(nodes: DataFrame, eligible: DataFrame, matched: DataFrame, *, freshness: DataFrame | None = None, fts: DataFrame | None = None, fts_failed: bool = False, centrality: bool = False, evidence: bool = False, communities: bool = False) -> DataFrame:
    """One row about a search: nodes that came in, passed the filters and matched, full-text scores, repositories of matches whose
    freshness is not known, and what was missing.

    fts(id, ...): the scores; centrality, evidence and communities: whether these signals were there.
    """
    unknown = matched.select("repo_id").where("repo_id is not null").distinct()
    if freshness is not None:
        unknown = unknown.join(freshness.select("repo_id"), "repo_id", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(nodes, "input_nodes").join(count(eligible, "eligible_nodes")).join(count(matched, "matched_nodes"))
    out = out.join(count(fts, "fts_scored_nodes")) if fts is not None else out.withColumn("fts_scored_nodes", F.lit(0).cast("long"))
    out = out.join(unknown.agg(F.array_sort(F.collect_set("repo_id")).alias("freshness_unknown_repositories")))  # as many as repositories
    missing = [name for name, there in (("centrality_not_provided", centrality), ("evidence_not_provided", evidence), ("communities_not_provided", communities)) if not there]
    text = F.when(F.lit(fts_failed), "full_text_failed").when(F.col("fts_scored_nodes") == 0, "full_text_not_provided")
    gaps = F.array_compact(F.array(text, *map(F.lit, missing), F.when(F.size("freshness_unknown_repositories") > 0, "freshness_unavailable")))
    return out.withColumn("gaps", gaps)


__all__ = ["centrality", "coverage", "full_text", "node_evidence", "page", "query_terms", "search", "service_memberships", "terms"]
