"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Every text gets a 64-bit SimHash of its word shingles (numpy, one pass, no shuffle).
2. Equal fingerprints fold into one representative (map-side aggregation): groups of exact copies never meet in a task.
3. The 64 bits are grouped into partitions of correlated bits; correlations come from all fingerprints.
4. For each fingerprint, dynamic programming allots a threshold to every partition so that the estimated number of
   candidates and probes is least.  Thresholds add up to ``max_bits - partitions + 1``; by the generalised pigeonhole
   principle two fingerprints within ``max_bits`` then agree within the threshold of at least one partition.
5. Fingerprints are indexed under the value of every partition; probes go to all values within the threshold.  A bucket
   emits a spanning forest of its verified links, never all pairs.  Buckets over ``BLOCK`` entries are dealt out as pairs
   of blocks, so that no task holds an unbounded bucket.
6. Components of the links; the class id is the least doc_id.

Nulls and texts without words have the fingerprint 0, linked like any other.  A null doc_id keeps its row and never names
a class, unless all ids of the class are null.  Repeated rows come out as often as they came in.  Empty input, empty output.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Index entries of a bucket that one task compares; larger buckets are dealt out in pairs of blocks.
BLOCK = 50_000
#: What an entry costs to ship and to sort, in comparisons of two fingerprints.
ENTRY = 100.0
#: A bucket with more verified pairs for an entry than this emits a spanning forest.
DENSE = 2
#: Buckets up to this size are compared many at a time.
SMALL = 24
#: Texts of a dense group that one task compares; larger groups are dealt out in pairs of blocks.
TEXTS = 500
#: Members of a larger group near its middle, with which all others are compared first.
PIVOTS = 4


def fingerprint(text: bytes, words: int = 4, seed: int = 42, seen: list | None = None) -> int:
    """The SimHash of one text, as an unsigned 64-bit number; seen takes the arrays of shingle hashes."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[words - 1 :] - 1).tolist() if len(found) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + 65536], stops[at : at + 65536])], np.uint64)
        if seen is not None:
            seen.append(part)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, words) for x in common.texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return common.whole_text(docs, "doc_id").mapInArrow(run, f"doc_id {key}, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(reps: DataFrame, table) -> np.ndarray:
    """The sum over all fingerprints of table(fps), a vector of fixed length; Spark adds the partial vectors."""

    def run(batches):
        total = None
        for b in batches:
            got = table(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total = got if total is None else total + got
        if total is not None:
            keep = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(total[keep].astype(np.int64))], ["k", "v"])

    rows = reps.select("fp").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + max((r.k for r in rows), default=0), np.int64)
    for r in rows:
        out[r.k] = r.v
    return out


def grouped_bits(reps: DataFrame, parts: int) -> tuple[list[list[int]], int]:
    """The bits dealt into ``parts`` groups, correlated bits together, and the number of fingerprints."""

    def table(fp):
        b = _bits(fp).astype(np.float64)
        return np.concatenate(((b.T @ b).reshape(-1), [len(fp)])).astype(np.int64)

    got = _summed(reps, table)
    if len(got) < 4097:
        return [list(range(64))[i::parts] for i in range(parts)], 0
    n, both = int(got[4096]), got[:4096].reshape(64, 64) / got[4096]
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        own = sorted(left)
        group = [max(own, key=lambda b: corr[b, own].max())]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].mean())
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups, n


class Plan:
    """Partitions, the estimate of candidates for each value, and the allotment of thresholds."""

    def __init__(self, groups: list[list[int]], max_bits: int):
        self.groups, self.max_bits, self.total = groups, max_bits, max_bits - len(groups) + 1
        self.most = max(0, min(max_bits, self.total + len(groups) - 1))
        self.blocks = [[g[i : i + 8] for i in range(0, len(g), 8)] for g in groups]

    def _take(self, bits: np.ndarray, which: list[int]) -> np.ndarray:
        return bits[:, which].astype(np.int64) @ (1 << np.arange(len(which), dtype=np.int64))

    def histogram(self, fp: np.ndarray) -> np.ndarray:
        bits = _bits(fp)
        return np.concatenate([np.bincount(self._take(bits, b), minlength=256) for bs in self.blocks for b in bs])

    def learn(self, hist: np.ndarray, n: int) -> None:
        """hist: how often each value of each block of up to eight bits occurs.  Kept: shares by distance, 256 x 9 a block."""
        hist = np.pad(hist, (0, 256 * sum(map(len, self.blocks)) - len(hist))).reshape(-1, 256)
        away = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])
        near = np.stack([(away == d).astype(float) for d in range(9)])
        self.share, self.n = [np.einsum("dvu,u->vd", near, h / max(n, 1)) for h in hist], n

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """A row of thresholds (-1: no probe) for each fingerprint, of the least estimated cost."""
        n, m, at = len(bits), len(self.groups), 0
        span = self.most + 2
        cost = np.zeros((n, m, span))
        for i, blocks in enumerate(self.blocks):
            dist = np.zeros((n, self.most + 1))
            dist[:, 0] = 1
            for b in blocks:
                s, new = self.share[at][self._take(bits, b)], np.zeros_like(dist)
                for d in range(min(9, self.most + 1)):
                    new[:, d:] += dist[:, : self.most + 1 - d] * s[:, d : d + 1]
                dist, at = new, at + 1
            probes = np.cumsum([math.comb(len(self.groups[i]), d) for d in range(self.most + 1)])
            cost[:, i, 1:] = np.cumsum(dist, 1) * self.n + probes * ENTRY
        sums = self.total + m  # the sum of (threshold + 1)
        best = np.full((n, sums + 1), np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n, sums + 1), np.int8)
        for i in range(m):
            new = np.full_like(best, np.inf)
            for t in range(span):
                if t > sums:
                    break
                c = best[:, : sums + 1 - t] + cost[:, i, t : t + 1]
                better = c < new[:, t:]
                new[:, t:][better] = c[better]
                back[i][:, t:][better] = t
            best = new
        out, left = np.zeros((n, m), np.int64), np.full(n, sums)
        for i in reversed(range(m)):
            t = back[i][np.arange(n), left]
            out[:, i], left = t - 1, left - t
        return out

    def keys(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, position in fp) of every entry.  A key is twice its bucket, and one more for a probe."""
        bits = _bits(fp)
        allot, everyone = self.thresholds(bits), np.arange(len(fp))
        key, who = [], []
        for i, g in enumerate(self.groups):
            own = self._take(bits, g)
            key.append((own + (i << 40)) * 2)
            who.append(everyone)
            for r in range(1, int(allot[:, i].max(initial=-1)) + 1):
                some = np.flatnonzero(allot[:, i] >= r)
                masks = np.array([sum(1 << b for b in c) for c in itertools.combinations(range(len(g)), r)], np.int64)
                key.append((((own[some][:, None] ^ masks[None]) + (i << 40)) * 2 + 1).reshape(-1))
                who.append(np.repeat(some, len(masks)))
        return np.concatenate(key), np.concatenate(who)

    def masks(self) -> np.ndarray:
        """The bits of each partition."""
        return np.array([sum(1 << b for b in g) for g in self.groups], np.uint64)


def partitions_for(n: int, max_bits: int) -> int:
    """The number of partitions of the least cost, were all bits independent: fewer of them as there are more fingerprints."""

    def cost(m: int) -> float:
        best = {max_bits + 1: 0.0}  # the thresholds, plus one each, that are left
        for i in range(m):
            size = 64 // m + (i < 64 % m)
            entries = [0, *itertools.accumulate(math.comb(size, d) for d in range(min(size, max_bits) + 1))]
            each = [e * n / 2.0**size + max(e - 1, 0) * ENTRY for e in entries]
            new: dict[int, float] = {}
            for left, c in best.items():
                for t, x in enumerate(each[: left + 1]):
                    new[left - t] = min(new.get(left - t, math.inf), c + x)
            best = new
        return best.get(0, math.inf) + m * ENTRY

    return min(range(2, 9), key=cost)


def forest(fp: np.ndarray, indexed: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (positions) that join all entries of a bucket that are joined by links to indexed entries.

    Breadth first: an entry is compared with those not yet reached only, so a dense group costs little more than its size.
    """
    left = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            hit = np.bitwise_count(fp[left] ^ fp[a]) <= max_bits
            if not indexed[a]:
                hit &= indexed[left]
            for b in left[hit].tolist():
                out.append((a, b))
                queue.append(b)
            left = left[~hit]
    return out


def _some_pairs(fp: np.ndarray, n: int, max_bits: int) -> np.ndarray | None:
    """All verified pairs with one of the first n entries, in blocks; None as soon as they outnumber the entries ``DENSE`` times."""
    found, held = [], 0
    rows = max(1, (1 << 20) // n)
    for at in range(0, len(fp), rows):
        x, y = np.nonzero(np.bitwise_count(fp[at : at + rows, None] ^ fp[None, :n]) <= max_bits)
        keep = x + at > y
        found.append(np.stack([x[keep] + at, y[keep]], 1))
        held += int(keep.sum())
        if held > DENSE * len(fp):
            return None
    return np.concatenate(found)


def _met_before(a: np.ndarray, b: np.ndarray, group: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether two fingerprints are the same in a partition before the given one: there both are index entries of one bucket."""
    differ, out = a ^ b, np.zeros(len(a), bool)
    for i, m in enumerate(masks[:-1]):
        out |= (group > i) & (differ & m == 0)
    return out


def _bucket_links(bucket, kind, group, fp, max_bits, masks):
    """Links (fp, fp, 1 if of a forest) of whole buckets of partitions (group), sorted by bucket and kind.

    A pair of a bucket without forest is left to an earlier partition in which the two are the same.
    """
    cut = np.flatnonzero(np.diff(bucket)) + 1
    start, stop = np.concatenate(([0], cut)), np.concatenate((cut, [len(bucket)]))
    index = np.add.reduceat((kind == 1).astype(np.int64), start)
    size = stop - start
    a, b = [], []
    small = (index > 0) & (size > 1) & (size <= SMALL)
    rows, many = start[small], size[small]
    own = np.repeat(np.arange(small.sum()), many)
    row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + rows[own]
    times = index[small][own]
    left = np.repeat(row, times)
    right = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(rows[own], times)
    near = np.flatnonzero((left > right) & (np.bitwise_count(fp[left] ^ fp[right]) <= max_bits))
    near = near[~_met_before(fp[left[near]], fp[right[near]], group[left[near]], masks)]
    a.append(fp[left[near]])
    b.append(fp[right[near]])
    dense = [np.zeros(len(a[0]), np.int64)]
    for k in np.flatnonzero((index > 0) & (size > SMALL)):
        own, n = fp[start[k] : stop[k]], int(index[k])  # index entries come first
        own = np.concatenate((np.sort(own[:n]), np.sort(own[n:])))  # so that forests of different buckets share their links
        pairs = _some_pairs(own, n, max_bits)
        if many := pairs is None:
            pairs = np.array(forest(own, np.arange(len(own)) < n, max_bits), np.int64).reshape(-1, 2)
        else:
            pairs = pairs[~_met_before(own[pairs[:, 0]], own[pairs[:, 1]], np.full(len(pairs), group[start[k]]), masks)]
        a.append(own[pairs[:, 0]])
        b.append(own[pairs[:, 1]])
        dense.append(np.full(len(pairs), int(many), np.int64))
    a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    return np.unique(np.stack([np.maximum(a, b), np.minimum(a, b), np.concatenate(dense)], 1)[a != b], axis=0)


def links(reps: DataFrame, max_bits: int = 4, marked: bool = False) -> DataFrame:
    """(a, b): links between different fingerprints of reps(fp) within ``max_bits``, enough to join every class.

    If ``marked`` there is a column dense: every pair within ``max_bits`` is a link that is not dense, or joined by dense links.
    """
    columns = {"a": "long", "b": "long", "dense": "long"} if marked else {"a": "long", "b": "long"}
    n = reps.count()
    groups, n = grouped_bits(reps, partitions_for(n, max_bits))
    plan = Plan(groups, max_bits)
    plan.learn(_summed(reps, plan.histogram), n)

    def entries(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                key, who = plan.keys(fp[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at : at + 4096][who].view(np.int64))], ["key", "fp"])

    def own(batches):
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for i, g in enumerate(plan.groups):
                keys, many = np.unique(plan._take(bits, g) + (i << 40), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(many)], ["bucket", "n"])

    hot = reps.select("fp").mapInArrow(own, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    # fewer than partitions * fingerprints / BLOCK
    hot = common.written(hot.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    rows, sub = reps.select("fp").mapInArrow(entries, "key long, fp long"), []
    bucket = F.shiftright("key", 1)
    if not hot.isEmpty():  # a row meets every block of its bucket, as one of a pair of blocks
        me = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        sub = ["sub"]
        rows = rows.withColumn("bucket", bucket).join(hot, "bucket", "left").withColumn("sub", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.least(me, y) * F.col("blocks") + F.greatest(me, y))))).drop("blocks")

    def join(batches):
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            own = held[0] >> 1
            last = np.flatnonzero((own != own[-1]) | (held[1] != held[1][-1])) if sub else np.flatnonzero(own != own[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield emit([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield emit(held)

    def emit(x):
        new = np.diff(x[0] >> 1) != 0
        number = np.concatenate(([0], np.cumsum(new | (np.diff(x[1]) != 0) if sub else new)))
        got = _bucket_links(number, (x[0] & 1) + 1, x[0] >> 41, x[-1].view(np.uint64), max_bits, masks)
        return pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(len(columns))], list(columns))

    masks = plan.masks()
    # by bucket and sub, index entries before probes
    dealt = rows.select(*(["key", "sub", "fp"] if sub else ["key", "fp"])).repartition(bucket, *sub).sortWithinPartitions(bucket, *sub, "key")
    return dealt.mapInArrow(join, ", ".join(f"{k} {v}" for k, v in columns.items())).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) for every row of docs."""
    fps = common.written(fingerprints(docs, words), "fingerprints")
    reps = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "fingerprints")
    label = common.components(links(reps, max_bits))
    named = label.join(reps.select(F.col("fp").alias("node"), "least"), "node")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select(F.col("node").alias("fp"), "component_id")
    known = reps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n_same")
    total = reps.agg(F.sum("n_same")).first()[0] or 0
    return common.joined(fps, known, "fp", "n_same", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def shingles(text: str, words: int) -> set[int]:
    """64-bit hashes of the distinct word shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return set()
    return {xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))}


def alike(fp: np.ndarray, label: np.ndarray, sets: list[set[int]], similarity: float, max_bits: int) -> list[tuple[int, int]]:
    """Verified links (positions) that join, with the labels, all texts that are joined by pairs within both bounds.

    Breadth first: a text is compared with those not yet reached only.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate([np.fromiter(x, np.uint64, len(x)) for x in sets]), return_inverse=True)[1]
    begin = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    left, out = np.arange(len(fp)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            known = label[left] == label[a]
            near = np.flatnonzero(~known & (np.bitwise_count(fp[left] ^ fp[a]) <= max_bits) & (np.minimum(size[left], size[a]) >= similarity * np.maximum(size[left], size[a])))
            mark[flat[begin[a] : begin[a + 1]]] = True
            both = np.array([np.count_nonzero(mark[flat[begin[x] : begin[x + 1]]]) for x in left[near]], np.int64)
            mark[flat[begin[a] : begin[a + 1]]] = False
            near = near[both >= similarity * (size[left[near]] + size[a] - both)]
            out += [(a, x) for x in left[near].tolist()]
            known[near] = True
            queue += left[known].tolist()
            left = left[~known]
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the distinct hashes lie in each of 2^k bins, about eight a bin: an exact upper bound of overlaps, see may_be_alike()."""
    bins = 1 << min(12, max(0, (len(hashes) >> 3).bit_length()))
    return np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype("<u4" if len(hashes) > 65535 else "<u2").tobytes() + bytes([4 if len(hashes) > 65535 else 2])


def _bins(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:-1], f"<u{data[-1]}").astype(np.int64)


def may_be_alike(x: bytes, y: bytes, similarity: float) -> bool:
    """False only if the two sets can't have the similarity: they share at most the lesser number of every bin."""
    a, b = sorted((_bins(x), _bins(y)), key=len)
    b = b.reshape(-1, len(a)).sum(0)  # bins are the lowest bits: fewer of them are sums of others
    both, n = int(np.minimum(a, b).sum()), int(a.sum() + b.sum())
    return both >= similarity * (n - both)


def _plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) of nodes that sketches(node, sketch) do not rule out; so the texts of few others are ever shipped."""

    def run(batches):
        for batch in batches:
            keep = [may_be_alike(x, y, similarity) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs(a, b) of nodes of at least the similarity, by texts(node, text)."""

    def verify(batches):
        held = functools.lru_cache(8)(lambda x: shingles(x, words))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = held(x), shingles(y, words)
                keep.append(len(x & y) >= similarity * len(x | y))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")


def _pivots(members: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): the members(grp, fp, node) of each group of more than ``TEXTS``, b, with some near the middle of its fingerprints, a."""
    middle = members.groupBy("grp").agg(F.count("*").alias("n"), *(F.sum(F.getbit("fp", F.lit(i))).alias(f"bit{i}") for i in range(64))).where(F.col("n") > TEXTS)
    bits = (F.when(F.col(f"bit{i}") * 2 > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64))
    middle = middle.select("grp", functools.reduce(lambda x, y: x.bitwiseOR(y), bits).alias("middle"))
    away = members.join(middle, "grp").select("grp", "node", "fp", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).alias("away"))
    best = away.groupBy("grp", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct("away", "node", "fp")).alias("x")).select("grp", F.col("x.node").alias("a"), F.col("x.fp").alias("other"))
    return members.join(best, "grp").where((F.col("a") != F.col("node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)).select("a", F.col("node").alias("b")).distinct()


def _group_links(members: DataFrame, texts: DataFrame, words: int, similarity: float, max_bits: int) -> DataFrame:
    """(a, b): verified links that join, with the labels, what belongs together in each group of members(grp, fp, node, label).

    A group of one label needs none.  Of a group of more than ``TEXTS``, what has the most common label meets the others only.
    """
    labels = members.groupBy("grp", "label").agg(F.count("*").alias("c"))
    groups = labels.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    large = F.col("n") > TEXTS
    groups = groups.select(
        "grp", F.when(large, F.col("top.label")).alias("most"), F.when(large, F.ceil((F.col("n") - F.col("top.c")) / TEXTS)).otherwise(1).cast("int").alias("rest_blocks"),
        F.when(large, F.ceil(F.col("top.c") / TEXTS)).otherwise(0).cast("int").alias("most_blocks"))
    rows = members.join(groups, "grp").withColumn("of_most", F.coalesce(F.col("label") == F.col("most"), F.lit(False)))
    blocks = F.col("rest_blocks") + F.col("most_blocks")
    me = F.pmod(F.xxhash64("node", "fp"), F.when(F.col("of_most"), F.col("most_blocks")).otherwise(F.col("rest_blocks"))).cast("int") + F.when(F.col("of_most"), F.col("rest_blocks")).otherwise(0)
    meets = F.sequence(F.lit(0), F.when(F.col("of_most"), F.col("rest_blocks")).otherwise(blocks) - 1)
    rows = rows.withColumn("me", me).withColumn("sub", F.transform(meets, lambda y: F.least("me", y).cast("long") * blocks + F.greatest("me", y)))
    rows = rows.select("grp", "fp", "node", "label", "sub").join(texts, "node").select("grp", F.explode("sub").alias("sub"), "fp", "node", "label", "text")

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[:2] != now:
                    if len(held) > 1:
                        yield emit(held)
                    now, held = row[:2], []
                held.append((*row[2:5], shingles(row[5], words)))
        if len(held) > 1:
            yield emit(held)

    def emit(held):
        fp, node, label = (np.array([x[i] for x in held], np.int64) for i in range(3))
        got = np.array(alike(fp.view(np.uint64), label, [x[3] for x in held], similarity, max_bits), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[got[:, 0]]), pa.array(node[got[:, 1]])], ["a", "b"])

    return rows.repartition("grp", "sub").sortWithinPartitions("grp", "sub").mapInArrow(run, "a long, b long")


def _folded(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fp, node, sketch): node is a 64-bit hash of the sorted distinct shingles, the same for equal sets only."""

    def run(batches):
        for batch in batches:
            fp, node, bins = [], [], []
            for text in common.texts(batch):
                seen: list[np.ndarray] = []
                fp.append(fingerprint(text, words, seen=seen))
                distinct = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
                node.append(xxhash.xxh3_64_intdigest(distinct.tobytes()))
                bins.append(sketch(distinct))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, node)), pa.array(bins, pa.binary())], ["doc_id", "text_hash", "fp", "node", "sketch"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = common.whole_text(docs, "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {key}, text_hash long, fp long, node long, sketch binary")


def _classes(docs: DataFrame, words: int, similarity: float, max_bits: int) -> DataFrame:
    """(doc_id, text_hash, first): for every row of docs the first of its class, a struct (void, doc_id, text_hash)."""
    fps = common.written(_folded(docs, words), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("void"), "doc_id", "text_hash")).alias("first")
    sets = fps.groupBy("fp", "node").agg(first, F.count("*").alias("n_rows"), F.any_value("sketch").alias("sketch"))
    sets = common.written(sets, "fingerprints")
    each = common.written(sets.groupBy("fp").agg(F.count("*").alias("many")), "fingerprints")
    pairs = common.written(links(each, max_bits, marked=True), "candidates")
    several = each.where("many > 1").select("fp")
    dense = functools.reduce(DataFrame.unionByName, (pairs.join(several.withColumnRenamed("fp", x), x, "left_semi").select("a", "b") for x in "ab"), pairs.where("dense = 1").select("a", "b"))
    groups = common.components(dense).select(F.col("node").alias("fp"), F.col("label").alias("grp"))
    groups = groups.unionByName(several.join(groups, "fp", "left_anti").select("fp", F.col("fp").alias("grp")))
    grouped = common.written(sets.drop("sketch").join(groups, "fp", "left"), "groups")
    at = lambda x: grouped.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node"), F.col("grp").alias(f"{x}_grp"))
    apart = F.coalesce(F.col("a_grp") != F.col("b_grp"), F.lit(True)) & (F.col("a_node") != F.col("b_node"))
    listed = pairs.where("dense = 0").select("a", "b").join(at("a"), "a").join(at("b"), "b").where(apart).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    members = grouped.where("grp is not null").select("grp", "fp", "node")
    # texts of one set may differ in repeats, and so in their fingerprints
    sketches = sets.groupBy("node").agg(F.any_value("sketch").alias("sketch"))
    listed = common.written(_plausible(listed.unionByName(_pivots(members, max_bits)).distinct(), sketches, similarity), "candidates")
    nodes = grouped.groupBy("node").agg(F.min("first").alias("first"), F.sum("n_rows").alias("n_rows"))
    named = listed.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct().join(nodes, "node")
    # few are broadcast, so that only the texts that are needed are shuffled, once
    named = common.written(named.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "node"), "named")
    texts = common.whole_text(docs, "doc_id").withColumn("text_hash", F.xxhash64("text")).join(common.small(named), ["doc_id", "text_hash"])
    texts = common.written(texts.groupBy("node").agg(F.any_value("text").alias("text")), "texts")
    good = common.written(_verified(listed, texts, words, similarity), "verified")
    label = common.components(good)
    members = members.join(label, "node", "left").select("grp", "fp", "node", F.coalesce("label", "node").alias("label"))
    more = common.written(_group_links(members, texts, words, similarity, max_bits), "verified")
    if not more.isEmpty():
        label = common.components(good.unionByName(more))
    by = label.join(nodes.select("node", "first"), "node")
    least = by.groupBy("label").agg(F.min("first").alias("least"))
    by = by.join(least, "label").select("node", "least")
    known = common.written(nodes.join(by, "node", "left").select("node", F.coalesce("least", "first").alias("first"), "n_rows"), "classes")
    total = known.agg(F.sum("n_rows")).first()[0] or 0
    out = common.joined(fps.select("doc_id", "text_hash", "node"), known, "node", "n_rows", total).select("doc_id", "text_hash", "first")
    out = common.written(out, "classes")
    common.removed(fps, sets, each, pairs, grouped, listed, named, texts, good, more, known)
    return out


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 10) -> DataFrame:
    """(doc_id, component_id): classes of documents joined by pairs of at least the Jaccard similarity of their word shingles.

    Documents of equal shingle sets are one.  Candidates are fingerprints within ``max_bits``, equal ones among them.  Listed
    candidates that their sketches do not rule out are verified pair by pair on the whole texts.  Dense buckets, and fingerprints of several sets with what is
    near them, only tell which fingerprints make a group; inside a group the forest is built over verified pairs, so that no
    pair is lost behind one that fails.  The wide radius finds nearly all pairs from 0.9 and most from 0.8; verification
    keeps others apart.

    Null and empty texts have no shingles and make one class.  A null doc_id names a class only if all its ids are null.  Rows that
    repeat come out as often as they came in; texts that share a doc_id are told apart.  Columns other than doc_id and text are not read.
    """
    return _classes(docs, words, similarity, max_bits).select("doc_id", F.col("first.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 10) -> DataFrame:
    """docs with one document of each class of similar(): the least by (doc_id, hash of the text); of rows that repeat both, one.

    Different texts of one doc_id both stay unless they are near duplicates.  A row without a doc_id can't be named as the one that
    stays; it is kept as it is.
    """
    named = docs.where("doc_id is not null")
    own, name = F.xxhash64(F.coalesce("text", F.lit(""))), common.new_name(docs, "own")
    rows = named.withColumn(name, own)
    key = ["doc_id", name]
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    each = _classes(named, words, similarity, max_bits).groupBy("doc_id", F.col("text_hash").alias(name)).agg(F.count("*").alias("many"), F.bool_and(stays).alias("stays"))
    # what goes, and what repeats, are few beside what stays as it is
    each = common.written(each.where("many > 1 or not stays"), "decisions")
    out = rows.join(common.small(each.select(key)), key, "left_anti").select(docs.columns)
    again = each.where("many > 1 and stays").select(key)
    if not again.isEmpty():
        out = out.unionByName(rows.join(common.small(again), key, "left_semi").dropDuplicates(key).select(docs.columns))
    return out.unionByName(docs.where("doc_id is null"))
