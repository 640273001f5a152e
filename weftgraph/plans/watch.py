"""Queries of the watch loop, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as G
from ..streaming import watch as W


def _events(spark, sf):
    e = G.table(spark, sf, "events")
    path = F.when(F.col("event_id") % 501 == 0, ".gitignore").otherwise("src/main.rs")
    return e.select("ts", F.concat(F.lit("nation-"), (F.col("user_id") % 25).cast("string")).alias("repo_id"), path.alias("path"), (F.col("event_id") % 997 == 0).alias("rescan"))


def debounce_sessions(spark, sf):
    return W.debounce_sessions(_events(spark, sf), quiet_seconds=1800)


def watch_coalesce(spark, sf):
    return W.coalesced(_events(spark, sf), 900).withColumn("repositories", F.array_join("repositories", ","))


def watch_due(spark, sf):
    return W.due(W.coalesced(_events(spark, sf), 900), 1200).select("window_start", "runs_at")


def watch_deadlines(spark, sf):
    """Sparse passes: those of one repository; the watcher gives up after two idle hours or a day."""
    one = W.coalesced(_events(spark, sf).where("repo_id = 'nation-7'"), 60)
    return W.due(one, 300, idle_timeout=7200, session_limit=86_400).select("window_start", "runs_at", "outcome")


QUERIES = {f.__name__: f for f in (debounce_sessions, watch_coalesce, watch_due, watch_deadlines)}

_E = """e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t0, 'nation-' || (user_id % 25) AS repo_id, event_id % 501 = 0 OR event_id % 997 = 0 AS wide FROM events),
c AS (SELECT t0 // 900 * 900 AS window_start, CASE WHEN bool_or(wide) THEN 'workspace' ELSE 'repositories' END AS scope, CASE WHEN bool_or(wide) THEN '' ELSE string_agg(DISTINCT repo_id, ',' ORDER BY repo_id) END AS repositories FROM e GROUP BY 1)"""

def _due(source: str, interval: int, idle: str = "NULL", session: str = "NULL") -> str:
    """d: for every window (numbered) when it is taken up and its pass starts."""
    runs = f"greatest(CASE WHEN t0 > taken THEN greatest(t0, d.runs) ELSE taken END, d.runs + {interval})"
    new = "d.outcome = 'runs' AND w.t0 > d.taken"
    return f"""w AS (SELECT t0, row_number() OVER (ORDER BY t0) AS n FROM (SELECT DISTINCT window_start AS t0 FROM {source})),
d AS (SELECT n, t0, t0 AS first_, t0 AS taken, t0 AS runs, 'runs' AS outcome FROM w WHERE n = 1
  UNION ALL SELECT w.n, w.t0, first_, CASE WHEN {new} THEN greatest(w.t0, d.runs) ELSE taken END, CASE WHEN {new} THEN {runs.replace("t0", "w.t0")} ELSE d.runs END,
    CASE WHEN {new} AND w.t0 - d.runs > {idle} THEN 'expired_idle' WHEN {new} AND {runs.replace("t0", "w.t0")} - first_ >= {session} THEN 'expired_session' ELSE d.outcome END
  FROM d JOIN w ON w.n = d.n + 1)"""


ORACLE_SQL = {
    "debounce_sessions": f"""WITH RECURSIVE {_E}, g AS (SELECT *, CASE WHEN t0 - lag(t0) OVER (PARTITION BY repo_id ORDER BY t0) <= 1800 THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY repo_id ORDER BY t0 RANGE UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT repo_id, run, min(t0) AS started FROM r GROUP BY ALL UNION ALL SELECT s.repo_id, s.run, min(t0) FROM s JOIN r ON r.repo_id = s.repo_id AND r.run = s.run AND r.t0 >= s.started + 9000 GROUP BY s.repo_id, s.run, s.started),
p AS (SELECT r.repo_id, t0, (SELECT max(started) FROM s WHERE s.repo_id = r.repo_id AND s.run = r.run AND s.started <= r.t0) AS started FROM r)
SELECT repo_id, started, max(t0) AS ended, count(*) AS events FROM p GROUP BY repo_id, started""",
    "watch_coalesce": f"WITH {_E} SELECT * FROM c",
    "watch_due": f"WITH RECURSIVE {_E}, {_due('c', 1200)} SELECT t0 AS window_start, runs AS runs_at FROM d",
    "watch_deadlines": f"WITH RECURSIVE {_E}, o AS (SELECT t0 // 60 * 60 AS window_start FROM e WHERE repo_id = 'nation-7'), {_due('o', 300, '7200', '86400')} SELECT t0 AS window_start, CASE WHEN outcome = 'runs' THEN runs END AS runs_at, outcome FROM d",
}
