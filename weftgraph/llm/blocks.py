"""An exchange of whole texts in the order of a key: packed, compressed blocks instead of rows.

Texts dominate what such a shuffle writes, and row-wise shuffles compress them badly.  Here every task packs the rows that go
to the same key range into Arrow blocks with zstandard, so that about half the bytes are written.  Ranges are quantiles of the
key, as many as keep a range to ``RANGE_BYTES`` on average, by Spark's own estimate of the input (shuffle partitions at least,
``MOST_RANGES`` at most); each is
put in order by the task that receives it, one range at a time in memory.  Rows that share a key lie in one range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes that a task gathers before it packs them.
PACK_BYTES = 16 << 20
#: Bytes of a range as Spark estimates them; of Parquet files, the compressed size.
RANGE_BYTES = 32 << 20
MOST_RANGES = 100_000
NULL_KEY = -(2**63)


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def gathered(batches: Iterator[pa.RecordBatch], size: int = PACK_BYTES) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for part in common.chunks(batch):
            held.append(part)
            n += part.get_total_buffer_size() if part.num_rows == batch.num_rows else part.nbytes
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def bounds(rows: DataFrame, key: str, parts: int) -> tuple[int | None, list[int]]:
    """The least key (null as NULL_KEY) and the first keys of the further ranges, all of them keys that occur."""
    k = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    shares = [i / parts for i in range(1, parts)]
    r = rows.agg(F.min(k).alias("least"), F.percentile_approx(k, shares or [0.5], max(10_000, 10 * parts)).alias("q")).first()
    if r.least is None:
        return None, []
    return r.least, [x for x in sorted(set(r.q if shares else [])) if x > r.least]


def in_ranges(
    rows: DataFrame, key: str, work: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, with_next: bool = False
) -> DataFrame:
    """work(range number, rows in the order of (key, text), first row of the next range), for every range.

    rows: the key (a long) and ``text``, no null texts.  With ``with_next`` the first row of the following range comes along, of the
    first range after the last one.
    """
    size = common.estimated_bytes(rows)
    parts = max(common.n_parts(rows.sparkSession), min(MOST_RANGES, -(-size // RANGE_BYTES)))
    least, firsts = bounds(rows, key, parts)
    edges = np.array(firsts, np.int64)
    lead = np.array(([] if least is None else [least]) + firsts, np.int64)

    def packed(batches):
        for table in gathered(batches):
            k = pc.fill_null(table.column(key).cast(pa.int64()), NULL_KEY).combine_chunks().to_numpy(zero_copy_only=False)
            to = np.searchsorted(edges, k, "right")
            out: list[tuple[int, bool, bytes]] = []
            for b in np.unique(to).tolist():
                out.append((b, False, pack(table.take(pa.array(np.flatnonzero(to == b))))))
            if with_next:
                for i in np.flatnonzero(np.isin(k, lead)).tolist():
                    out.append(((int(to[i]) - 1) % len(lead), True, pack(table.slice(i, 1))))
            for b, ahead, data in out:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([ahead]), pa.array([data], pa.binary())], ["part", "ahead", "data"])

    def order(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).sort_by([(key, "ascending"), ("text", "ascending")]) if tables else None

    def nulls_first(table: pa.Table) -> pa.Table:
        if table is None or not table.column(key).null_count:
            return table
        null = table.column(key).is_null()
        return pa.concat_tables([table.filter(null), table.filter(pc.invert(null))])

    def unpacked(batches):
        now, own, ahead = None, [], []
        for batch in batches:
            for b, is_ahead, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != now:
                    if own:
                        yield from work(now, nulls_first(order(own)), nulls_first(order(ahead)))
                    now, own, ahead = b, [], []
                (ahead if is_ahead else own).append(unpack(data.as_buffer()))
        if own:
            yield from work(now, nulls_first(order(own)), nulls_first(order(ahead)))

    rows = rows.select(key, "text")
    # every range has a partition of its own
    dealt = rows.mapInArrow(packed, "part int, ahead boolean, data binary").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(unpacked, schema)
