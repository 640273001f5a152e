"""Watching repositories: coalescing, debouncing, and the streaming loop that runs targeted scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A path of these makes the next pass one of the whole workspace.
WIDENING = r"(?:^|/)(?:\.gitignore|\.ignore|workspace\.ya?ml|\.git/HEAD)$"


def _in_order(rows: DataFrame, keys: list[str], columns: str, step: Callable[[dict | None, dict], tuple[dict, dict]], partitions: int | None = None) -> DataFrame:
    """Rows in the order of keys, the last of which is a time, folded with a state for each value of the others.

    Streams through a sorted partition: nothing is gathered, whatever a key's share of the rows.
    """
    own = keys[:-1]
    dealt = rows.repartition(*([partitions] if partitions else []), *own) if own else rows.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (key := [row[k] for k in own]) != now:
                    now, state = key, None
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(columns))
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, columns)


def debounce_sessions(events: DataFrame, key: str = "repo_id", quiet_seconds: int = 2, most_seconds: int | None = None) -> DataFrame:
    """(key, started, ended, events): runs of events with at most the quiet period between them.

    A run that lasts as long as the greatest wait (five quiet periods, at least ten seconds) ends; the next event begins a new one.
    Events of one second are counted before they are put in order.
    """
    most = most_seconds or max(5 * quiet_seconds, 10)
    kind = events.schema[key].dataType.simpleString()
    seconds = events.groupBy(key, F.unix_timestamp("ts").alias("at")).agg(F.count("*").alias("events"))

    def step(state, row):
        at = row["at"]
        if state is None or at - state["last"] > quiet_seconds or at - state["started"] >= most:
            state = {"started": at}
        return state | {"last": at}, {key: row[key], "started": state["started"], "at": at, "events": row["events"]}

    runs = _in_order(seconds, [key, "at"], f"`{key}` {kind}, started long, at long, events long", step)
    return runs.groupBy(key, "started").agg(F.max("at").alias("ended"), F.sum("events").alias("events"))


def coalesced(events: DataFrame, every_seconds: int) -> DataFrame:
    """(window_start, scope, repositories): one pass for each interval: of the touched repositories, or of the workspace.

    events(ts, repo_id, path, rescan): a widening path, an unknown repository or a rescan flag takes in everything.
    """
    wide = F.coalesce(F.col("rescan"), F.lit(False)) | F.col("repo_id").isNull() | F.coalesce(F.col("path").rlike(WIDENING), F.lit(False))
    start = (F.floor(F.unix_timestamp("ts") / every_seconds) * every_seconds).cast("long")
    g = events.groupBy(start.alias("window_start")).agg(F.bool_or(wide).alias("wide"), F.array_sort(F.collect_set("repo_id")).alias("repos"))
    return g.select("window_start", F.when(F.col("wide"), "workspace").otherwise("repositories").alias("scope"), F.when(F.col("wide"), F.array().cast("array<string>")).otherwise(F.col("repos")).alias("repositories"))


def due(passes: DataFrame, least_interval: int, idle_timeout: int | None = None, session_limit: int | None = None) -> DataFrame:
    """passes(window_start) with ``runs_at``: when the pass that takes a window in starts, and ``outcome``.

    Changes are taken up as soon as the pass before has started, all that are there at once; the pass then waits until the least
    interval since the pass before has gone by.  A window that comes after the idle time since the last pass finds the watcher
    expired, as does every one after it (expired_idle); so does a pass after the session's limit (expired_session).
    """

    def step(state, row):
        at = row["window_start"]
        if state is None:
            state = {"session": at, "taken": at, "runs": at, "outcome": "runs"}
        elif state["outcome"] == "runs" and at > state["taken"]:
            taken = max(at, state["runs"])
            runs = max(taken, state["runs"] + least_interval)
            outcome = "runs"
            if idle_timeout is not None and at - state["runs"] > idle_timeout:
                outcome = "expired_idle"
            elif session_limit is not None and runs - state["session"] >= session_limit:
                outcome = "expired_session"
            state = state | {"taken": taken, "runs": runs, "outcome": outcome}
        lost = state["outcome"] != "runs"
        return state, {"window_start": at, "runs_at": None if lost else state["runs"], "outcome": state["outcome"]}

    return passes.join(_in_order(passes.select("window_start").distinct(), ["window_start"], "window_start long, runs_at long, outcome string", step), "window_start")


def watch(
    spark: SparkSession, root: str, scan: Callable[[str, Sequence[str]], None], checkpoint: str, *, every: str = "10 seconds", once: bool = False, retries: int = 3,
) -> StreamingQuery:
    """Streams the files below root; each micro-batch becomes one pass: scan(scope, repositories).

    The stream's checkpoint makes sure that one watcher owns the position; the state that survives is the last published
    fingerprints, against which scan() compares.  The first folder below root names the repository.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")

    def run(batch: DataFrame, _: int) -> None:
        touched = batch.select(F.get(F.split(rel, "/"), F.lit(0)).alias("repo"), rel.rlike(WIDENING).alias("wide")).groupBy("repo").agg(F.bool_or("wide").alias("wide")).collect()  # as many rows as repositories
        if not touched:
            return
        scope = "workspace" if any(r.wide for r in touched) else "repositories"
        for left in reversed(range(retries)):
            try:
                return scan(scope, [] if scope == "workspace" else sorted(r.repo for r in touched))
            except Exception:
                if not left:
                    raise

    w = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
