"""Incremental maintenance: what changed, what can be reused, what is published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("repo_id", "checkout_id", "path", "extractor")


def last_wins(rows: DataFrame, key: Sequence[str] = KEY, order: str = "seq") -> DataFrame:
    """One row for each key: that of the highest order."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scan_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """Key and change (added, modified, deleted) of fingerprints that differ; a full outer join on the key."""
    b = before.select(*KEY, F.col("content_hash").alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*KEY, F.col("content_hash").alias("_a"), F.lit(True).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return b.join(a, list(KEY), "full_outer").withColumn("change", change).where("change is not null").select(*KEY, "change")


def reuse(after: DataFrame, batches: DataFrame, contract: str, budgets: str) -> DataFrame:
    """Fingerprints with ``reused``: a batch of the same key, hash, contract version and budgets exists."""
    have = batches.where((F.col("contract") == contract) & (F.col("budgets") == budgets)).select(*KEY, "content_hash").distinct().withColumn("_h", F.lit(True))
    return after.join(have, [*KEY, "content_hash"], "left").withColumn("reused", F.coalesce("_h", F.lit(False))).drop("_h")


def partial_scan(previous: DataFrame, scanned: DataFrame, selected: Sequence[str]) -> DataFrame:
    """New rows of the selected repositories and the former rows of all others."""
    return previous.where(~F.col("repo_id").isin(list(selected))).unionByName(scanned.where(F.col("repo_id").isin(list(selected))))


def snapshot_identity(fingerprints: DataFrame) -> DataFrame:
    """One row that is the same exactly if the fingerprints are: their number and the exclusive or of their digests."""
    text = F.concat_ws("\x1f", *KEY, "content_hash")
    return fingerprints.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")).alias("digest"))


def extractor_runs(fingerprints: DataFrame, changes: DataFrame) -> DataFrame:
    """Inputs and changed inputs of each extractor in each checkout."""
    changed = changes.where("change <> 'deleted'").select(*KEY).withColumn("_c", F.lit(1))
    return fingerprints.join(changed, list(KEY), "left").groupBy("repo_id", "checkout_id", "extractor").agg(F.count("*").alias("inputs"), F.count("_c").alias("changed"))


def digest(columns: Sequence[str | Column]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\x00")) for c in columns)), 256)


def node_digest() -> Column:
    return digest(["kind", "repo_id", "stable_key", "label"])


def edge_digest() -> Column:
    return digest(["source", "target", "kind", F.hex(F.col("confidence").cast("double").cast("string")), "status", F.array_join(F.array_sort("evidence"), "\x1e")])


def publication_delta(published: DataFrame, candidate: DataFrame, content: Column, key: str = "id") -> DataFrame:
    """(key, operation): insert, update or delete; rows of equal content are left alone."""
    p, c = published.select(key, content.alias("_p")), candidate.select(key, content.alias("_c"))
    op = F.when(F.col("_p").isNull(), "insert").when(F.col("_c").isNull(), "delete").when(F.col("_p") != F.col("_c"), "update")
    return p.join(c, key, "full_outer").withColumn("operation", op).where("operation is not null").select(key, "operation")


def topology_unchanged(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> bool:
    """Whether communities can be reused: the same rows on either side."""
    b, a = before.select(*columns), after.select(*columns)
    return b.exceptAll(a).isEmpty() and a.exceptAll(b).isEmpty()


def evict(cache: DataFrame, keep: int = 1024) -> DataFrame:
    """The newest entries of each workspace that stay in the query cache."""
    w = Window.partitionBy("workspace_id").orderBy(F.desc("stored_at"), F.desc("key"))
    return cache.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def evict_by_bytes(cache: DataFrame, quota: int, group: str = "workspace_id") -> DataFrame:
    """Entries that stay when the least recently used go until the rest fits the quota."""
    w = Window.partitionBy(group).orderBy(F.desc("accessed_at"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cache.withColumn("held", F.sum("bytes").over(w)).where(F.col("held") <= quota)
