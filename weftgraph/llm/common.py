"""What several corpus operators share: shared-folder tables, text batches and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, removed, shared_dir, written

__all__ = ["chunks", "components", "estimated_bytes", "joined", "n_parts", "new_name", "new_path", "removed", "shared_dir", "small", "small_batches", "texts", "whole_text", "written"]

def new_name(df: DataFrame, like: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{like}_{i}" for i in range(len(taken) + 1)) if n not in taken)


#: Bytes of text that a Python worker expands at a time.
CHUNK_BYTES = 4 << 20


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch that hold whole texts; the JVM and the Python worker each hold a batch for every running task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, from here on in the whole session; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def whole_text(df: DataFrame, *keep: str, column: str = "text") -> DataFrame:
    """The named columns and the text, null as empty; batches to Python are kept small (see small_batches)."""
    small_batches(df.sparkSession)
    return df.select(*keep, F.coalesce(F.col(column), F.lit("")).alias(column))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of the column each; a longer text stands alone."""
    at, held = 0, 0
    lengths = pc.binary_length(batch.column(column).cast(pa.binary())).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size, without a job; 0 where it has none.  Good for numbers of partitions, never for results."""
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:  # a remote session
        return 0
    return size if size < 1 << 60 else 0


#: A key with more than one row in so many is hot; there are fewer than so many such keys.
HOT = 1000


def joined(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of table, which has every key once and in ``count`` how many of the ``total`` rows have it.

    Hot keys, fewer than ``HOT``, go to every task, so that their rows are not gathered in one; the others are joined as usual.
    """
    hot = F.broadcast(table.where(F.col(count) * HOT > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) * HOT <= total), key)
    return rows.join(hot, key).unionByName(rest)


#: Rows of ids and hashes up to which a table goes to every task.
SMALL_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it is checked to be small; else it is joined by a shuffle, with the same rows."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links(a, b): rows (node, label), label being the least node; only nodes with a link.

    Large-star and small-star steps until nothing changes.  The least neighbour comes from a map-side aggregation and a
    join, so that a node with very many links is not gathered anywhere.  Each round is written to the shared folder.
    """
    e = links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "links")
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        new = written(small.where("a <> b").distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
