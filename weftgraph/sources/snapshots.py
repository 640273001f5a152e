"""Stored graphs: snapshots in a folder that all machines share, published at once by a pointer, read by kind, checked and restored.

A snapshot is a folder of nodes, edges and evidence as Parquet, with the counts and digests of each.  CURRENT names the snapshot that
counts.  It is written beside and renamed over, so a reader sees the old or the new one, never half of one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("nodes", "edges", "evidence")


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): the same for the same rows in any order."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(text)), F.lit(0)).alias("digest"), F.coalesce(F.sum(F.xxhash64(F.lit(7), text).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))


def _put(spark: SparkSession, root: str, name: str, text: str) -> None:
    fs, path = _fs(spark, root)
    out = fs.create(path(f"{root}/{name}"), True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, root: str, name: str) -> str | None:
    fs, path = _fs(spark, root)
    at = path(f"{root}/{name}")
    if not fs.exists(at):
        return None
    return "\n".join(r.value for r in spark.read.text(f"{root}/{name}").collect())  # a file of one line


def current(spark: SparkSession, root: str) -> str | None:
    return _get(spark, root, "CURRENT")


def publish(spark: SparkSession, root: str, snapshot_id: str, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, expected: str | None = None) -> None:
    """Writes a snapshot and makes it the current one; refused if the current one is not the expected, or if the id is taken."""
    fs, path = _fs(spark, root)
    if current(spark, root) != expected:
        raise RuntimeError(f"another snapshot was published meanwhile: {current(spark, root)}")
    if fs.exists(path(f"{root}/{snapshot_id}")):
        raise ValueError(f"snapshot {snapshot_id} exists")
    told = {}
    for name, df in zip(TABLES, (nodes, edges, evidence)):
        df.write.parquet(f"{root}/{snapshot_id}/{name}")
        told[name] = digest(spark.read.parquet(f"{root}/{snapshot_id}/{name}")).first().asDict()
    _put(spark, root, f"{snapshot_id}/manifest.json", json.dumps({"id": snapshot_id, "before": expected, "tables": told}))
    swap(spark, root, snapshot_id, expected)


def swap(spark: SparkSession, root: str, snapshot_id: str, expected: str | None) -> None:
    fs, path = _fs(spark, root)
    if current(spark, root) != expected:
        raise RuntimeError(f"another snapshot was published meanwhile: {current(spark, root)}")
    _put(spark, root, "NEXT", snapshot_id)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"{root}/NEXT"), path(f"{root}/CURRENT"), options)


def scan(spark: SparkSession, root: str, table: str, kinds: tuple[str, ...] = (), snapshot_id: str | None = None) -> DataFrame:
    """A table of the current or a named snapshot; kinds reach the Parquet scan as a filter."""
    found = snapshot_id or current(spark, root)
    if found is None:
        raise LookupError(f"nothing is published below {root}")
    df = spark.read.parquet(f"{root}/{found}/{table}")
    return df.where(F.col("kind").isin(list(kinds))) if kinds else df


def integrity(spark: SparkSession, root: str, snapshot_id: str | None = None) -> DataFrame:
    """(table, rows, expected_rows, ok): whether each table is what was published."""
    found = snapshot_id or current(spark, root)
    told = json.loads(_get(spark, root, f"{found}/manifest.json") or "{}").get("tables", {})
    out = None
    for name in TABLES:
        want = told.get(name, {"rows": -1, "digest": 0, "sum": ""})
        row = digest(spark.read.parquet(f"{root}/{found}/{name}")).select(
            F.lit(name).alias("table"), "rows", F.lit(want["rows"]).cast("long").alias("expected_rows"), ((F.col("rows") == want["rows"]) & (F.col("digest") == F.lit(want["digest"]).cast("long")) & (F.col("sum") == want["sum"])).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def backup(spark: SparkSession, root: str, target: str) -> None:
    """Copies the current snapshot, checked first, to a folder of its own."""
    if not all(r.ok for r in integrity(spark, root).collect()):
        raise RuntimeError("the current snapshot is not what was published")
    found = current(spark, root)
    for name in TABLES:
        spark.read.parquet(f"{root}/{found}/{name}").write.parquet(f"{target}/{found}/{name}")
    _put(spark, target, f"{found}/manifest.json", _get(spark, root, f"{found}/manifest.json"))
    _put(spark, target, "CURRENT", found)


def restore(spark: SparkSession, saved: str, root: str) -> str:
    """Publishes a backup again under its id with -restored, after it was checked; the id."""
    if not all(r.ok for r in integrity(spark, saved).collect()):
        raise RuntimeError("the backup is not what was saved")
    name = f"{current(spark, saved)}-restored"
    publish(spark, root, name, *(scan(spark, saved, t) for t in TABLES), expected=current(spark, root))
    return name


def cached(cache: DataFrame, workspace: str, key: str, now: int, ttl: int) -> DataFrame:
    """The value of a query cache(workspace_id, key, value, stored_at) that is not older than ttl seconds, the newest of several."""
    hit = cache.where((F.col("workspace_id") == workspace) & (F.col("key") == key) & (F.lit(now) - F.col("stored_at") < ttl) & (F.col("stored_at") <= now))
    return hit.orderBy(F.desc("stored_at"), "value").limit(1).select("value", "stored_at")
