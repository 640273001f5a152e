"""Benchmark decontamination with suffix arrays of the training texts.

Documents are sharded as Spark reads them (no shuffle).  A shard is a few MB of whole texts: its words are numbered by the
benchmark's vocabulary, the suffixes that could carry a match are sorted by prefix doubling, and every benchmark suffix is
looked up by binary search, which gives its longest verbatim match and all places of it.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  A document word
inside any occurrence of a window is hit.

Every test suffix is looked up, compared as far as a window and then extended word by word: ``longest_matches`` gives its longest
verbatim match in the whole corpus and where it is; ``matches`` gives the spans of every document that a window covers.

The benchmark is the query set.  It is read into blocks of at most ``BLOCK_BYTES`` of text; a task passes its documents by one
block after the other in one Python worker and holds one block at a time (each is a broadcast of its own, which Spark keeps on
disk).  Only the list of blocks grows with the benchmark.

Null texts have no words.  A null item_id still hits words, but is no item in the list.  Repeated rows of documents come out
as often as they came in.  Empty tables give zero hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Every byte that is no part of a word, as a blank; capital letters as small ones.
AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Text bytes of the benchmark that a task holds at a time.
BLOCK_BYTES = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(AS_WORDS).split()


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` sorted by the words from there on, as far as ``depth`` words at least: prefix doubling."""
    rank, step = ids.astype(np.int64), 1
    while step < depth:
        ahead = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.int64)))
        rank, step = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1], step * 2
    return at[np.argsort(rank[at], kind="stable")]


class Index:
    """The windows of a block of items, with every word numbered from 1 by its rank in the block's vocabulary."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        words = [(i, words_of(t)) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, w in words for x in w}))}
        texts: dict[tuple, set] = {}
        for i, w in words:
            texts.setdefault(tuple(self.vocabulary[x] for x in w), set()).add(i)
        self.texts = [np.array(t, np.int64) for t in texts]
        # every suffix, by its first words; those as long as a window (or the whole text) are windows
        owners: dict[tuple, list[tuple[int, int]]] = {}
        whole: dict[tuple, list[tuple[int, int]]] = {}
        for k, t in enumerate(texts):
            n = min(window, len(t))
            for j in range(len(t)):
                owners.setdefault(t[j : j + window], []).append((k, j))
                if j <= len(t) - n:
                    whole.setdefault(t[j : j + n], []).append((k, j))
        keys = sorted(owners)
        self.window, self.least = window, min(map(len, whole), default=0)
        self.windows = [whole.get(k) for k in keys]
        self.is_window = np.array([x is not None for x in self.windows], bool)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.test = np.zeros((len(keys), window), np.int64)
        for r, k in enumerate(keys):
            self.test[r, : len(k)] = k
        self.owners = [owners[k] for k in keys]
        self.ids = [[x for x in i if x is not None] for i in texts.values()]

    def bounds(self, ids: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix, as far as a window, the first and the end place in the suffix array of those that begin with it."""
        padded = np.concatenate((ids, np.zeros(self.window, np.int64)))
        ranges = []
        for upper in (False, True):
            lo, hi = np.zeros(len(self.test), np.int64), np.full(len(self.test), len(sa))
            while (active := lo < hi).any():
                mid = (lo + hi) // 2
                got = padded[sa[np.minimum(mid, len(sa) - 1)][:, None] + np.arange(self.window)]
                diff = (got != self.test) & (np.arange(self.window) < self.length[:, None])
                first = diff.argmax(1)
                rows = np.arange(len(self.test))
                less = np.where(diff.any(1), got[rows, first] < self.test[rows, first], upper)
                lo = np.where(active & less, mid + 1, lo)
                hi = np.where(active & ~less, mid, hi)
            ranges.append(lo)
        return ranges[0], ranges[1]

    def _sorted(self, docs: list[bytes], least: int):
        """Word counts, first places and the suffix array of the texts: (count, begin, own, place, left, sa), or None if nothing can match.

        own: the words in runs of at least ``least`` known words; place: where they stand among all; left: known words from there on.
        """
        get = self.vocabulary.get
        split = [words_of(t) for t in docs]
        count = np.array([len(w) for w in split], np.int64)
        # a 0 after each text: no match runs over its end
        ids = np.array([k for w in split for k in (*(get(x, 0) for x in w), 0)], np.int64)
        begin = np.concatenate(([0], np.cumsum(count + 1)))
        stop = np.flatnonzero(ids == 0)
        start = np.concatenate(([0], stop[:-1] + 1))
        long = stop - start >= max(least, 1)
        start, size = start[long], (stop - start)[long] + 1
        if not len(self.test) or not len(start):
            return count, None
        place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = ids[place]
        left = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
        return count, (begin, own, place, left, suffix_array(own, np.flatnonzero(left >= max(least, 1)), self.window))

    def _extended(self, own: np.ndarray, p: int, left: int, k: int, j: int) -> int:
        """Words that the suffix at p and the test suffix (k, j) share."""
        n = min(left, len(self.texts[k]) - j)
        differ = np.flatnonzero(own[p : p + n] != self.texts[k][j : j + n])
        return int(differ[0]) if len(differ) else n

    def matches(self, docs: list[bytes]) -> list[tuple[int, list[int], list[int], set, int]]:
        """(words, first words of windows, their ends, items, words of the longest match that holds a window) for each text."""
        count, found = self._sorted(docs, self.least)
        out: list[list] = [[int(n), [], [], set(), 0] for n in count]
        if found is None:
            return out
        begin, own, place, left, sa = found
        lo, hi = self.bounds(own, sa)
        for r in np.flatnonzero((hi > lo) & self.is_window):
            for p in sa[lo[r] : hi[r]]:
                at = int(place[p])
                d = int(np.searchsorted(begin, at, "right")) - 1
                doc = out[d]
                doc[1].append(at - int(begin[d]))
                doc[2].append(at - int(begin[d]) + int(self.length[r]))
                for k, j in self.windows[r]:
                    doc[3].update(self.ids[k])
                    if min(int(left[p]), len(self.texts[k]) - j) > doc[4]:
                        doc[4] = max(doc[4], self._extended(own, p, int(left[p]), k, j))
        return out

    def longest(self, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text of the block, suffix, words, document, first word) for every test suffix: its longest match in the texts, of equal ones the first."""
        _, found = self._sorted(docs, 1)
        if found is None:
            return
        begin, own, place, left, sa = found
        lo, hi = self.bounds(own, sa)
        for r, (first, end) in enumerate(zip(lo.tolist(), hi.tolist())):
            # none begins with all of it: the longest is beside the place where it would stand
            near = sa[first:end] if end > first else sa[max(first - 1, 0) : first + 1]
            if end == first:  # all that share as much lie beside each other
                k, j = self.owners[r][0]
                most = max((self._extended(own, p, int(left[p]), k, j) for p in near), default=0)
                if not most:
                    continue
                lo2, hi2 = first, first
                while lo2 > 0 and self._extended(own, sa[lo2 - 1], int(left[sa[lo2 - 1]]), k, j) == most:
                    lo2 -= 1
                while hi2 < len(sa) and self._extended(own, sa[hi2], int(left[sa[hi2]]), k, j) == most:
                    hi2 += 1
                near = sa[lo2:hi2]
            for k, j in self.owners[r]:
                n, at = min((-self._extended(own, p, int(left[p]), k, j), int(place[p])) for p in near)
                d = int(np.searchsorted(begin, at, "right")) - 1
                yield k, j, -n, d, at - int(begin[d])


def _covered(n: int, first: list[int], end: list[int]) -> list[int]:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, end, -1)
    return np.flatnonzero(np.cumsum(mark)[:n] > 0).tolist()


def _spans(hit: list[int]) -> list[int]:
    """first, end, first, end, ... of runs."""
    if not hit:
        return []
    h = np.array(hit)
    cut = np.flatnonzero(np.diff(h) > 1)
    return np.stack([np.concatenate(([h[0]], h[cut + 1])), np.concatenate((h[cut] + 1, [h[-1] + 1]))], 1).reshape(-1).tolist()


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        data = r.text.encode()
        if block and held + len(data) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r.item_id, data))
        held += len(data)
    yield block


def _shared(docs: DataFrame, benchmark: DataFrame, window: int) -> list:
    """A broadcast for each block of the benchmark."""
    context = docs.sparkSession.sparkContext
    return [context.broadcast(Index(block, window)) for block in _blocks(benchmark)]


def _loaded(shared: list) -> Iterator[Index]:
    """The blocks one after the other; of several, only one is held at a time."""
    if len(shared) == 1:
        yield shared[0].value
        return
    for b in shared:
        yield b.load_from_path(b._path)


def _each(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.RecordBatch]:
    """Parts of a batch; more at a time where every part meets several blocks."""
    for batch in batches:
        yield from common.chunks(batch, size=16 << 20 if several else common.CHUNK_BYTES)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, spans, items, longest) for every row of docs.

    spans: runs of hit words (first, end, ...) in order; items: those with occurring windows; longest: words of the longest verbatim match that holds a window.
    """
    key, item = (x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id")))
    kind = benchmark.schema["item_id"].dataType
    out_type = pa.list_(pa.from_numpy_dtype(np.int64) if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string())
    shared = _shared(docs, benchmark, window)

    def run(batches):
        for part in _each(batches, len(shared) > 1):
            found = None
            for index in _loaded(shared):
                got = index.matches(common.texts(part))
                if found is None:
                    found = got
                else:
                    for old, new in zip(found, got):
                        old[1].extend(new[1])
                        old[2].extend(new[2])
                        old[3].update(new[3])
                        old[4] = max(old[4], new[4])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([g[0] for g in found], pa.int64()), pa.array([_spans(_covered(*g[:3])) for g in found], pa.list_(pa.int64())),
                 pa.array([sorted(g[3], key=str) for g in found], out_type), pa.array([g[4] for g in found], pa.int64())],
                ["doc_id", "n_words", "spans", "items", "longest"])

    return common.whole_text(docs, "doc_id").mapInArrow(run, f"doc_id {key}, n_words long, spans array<long>, items array<{item}>, longest long")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(item_id, at, words, doc_id, first): for every suffix of every item that has any word in docs, its longest verbatim match.

    at: the suffix's first word in the item; first: that of the match in the document.  Of equal matches that of the least doc_id,
    then of the least place (a null doc_id counts as greatest).  Items without an id are left out.
    """
    key, item = (x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id")))
    names = ["item_id", "at", "words", "doc_id", "first"]
    shared = _shared(docs, benchmark.where("item_id is not null"), window)

    def run(batches):
        best: list[dict] = [{} for _ in shared]
        schema = None
        for part in _each(batches, len(shared) > 1):
            schema = part.schema
            ids, data = part.column("doc_id").to_pylist(), common.texts(part)
            for held, index in zip(best, _loaded(shared)):
                for k, j, n, d, first in index.longest(data):
                    new = (-n, ids[d] is None, ids[d] if ids[d] is not None else 0, first)
                    if (k, j) not in held or new < held[k, j]:
                        held[k, j] = new
        for held, index in zip(best, _loaded(shared)):
            rows = [(i, j, -n, None if void else doc, first) for (k, j), (n, void, doc, first) in held.items() for i in index.ids[k]]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], schema.field("doc_id").type), pa.array(columns[4], pa.int64())], names)

    found = common.whole_text(docs, "doc_id").mapInArrow(run, f"item_id {item}, at long, words long, doc_id {key}, first long")
    order = F.struct((-F.col("words")).alias("least"), F.isnull("doc_id").alias("void"), "doc_id", "first")
    return found.groupBy("item_id", "at").agg(F.min(order).alias("x")).select("item_id", "at", (-F.col("x.least")).alias("words"), "x.doc_id", "x.first")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, and the runs of hit words as first:end, comma-joined."""
    runs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", i * 2).alias("a"), F.get("spans", i * 2 + 1).alias("b")))
    runs = F.when(F.size("spans") > 0, runs).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    items = F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string")))
    return matches(docs, benchmark, window).withColumn("runs", runs).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "longest",
        F.array_join(F.transform("runs", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",").alias("spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those in which a window occurs; rows without a doc_id are searched like the others."""
    shared = _shared(docs, benchmark, window)
    common.small_batches(docs.sparkSession)

    def run(batches):
        for part in _each(batches, len(shared) > 1):
            data = [x or b"" for x in common.texts(part)]
            keep = np.ones(len(data), bool)
            for index in _loaded(shared):
                keep &= np.array([not g[1] for g in index.matches(data)], bool)
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def oracle_sql(window: int = 10) -> str:
    """DuckDB SQL for report() over ``documents`` and ``benchmark``."""
    words = r"list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""WITH i AS (SELECT item_id, {words.format(t="coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT item_id, k AS j, w[k : k + least({window}, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {words.format(t="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, n, k, w[k : k + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
m AS (SELECT doc_id, n, k, item_id, j FROM dw JOIN iw USING (win)),
g AS (SELECT doc_id, max(z) AS longest FROM (SELECT doc_id, max(k + n) - min(k) AS z FROM (
  SELECT doc_id, item_id, k, n, k - row_number() OVER (PARTITION BY doc_id, item_id, k - j ORDER BY k) AS run, k - j AS diagonal FROM m)
  GROUP BY doc_id, item_id, diagonal, run) GROUP BY doc_id),
hp AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) - 1 AS p FROM m),
hr AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hp) GROUP BY doc_id, run),
h AS (SELECT doc_id, sum(b - a) AS n_hit, string_agg(CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a) AS spans FROM hr GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)"""
