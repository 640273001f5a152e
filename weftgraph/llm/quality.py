"""A quality classifier of supervised subword embeddings.

Hashed words, hashed byte trigrams and hashed trigrams of character shapes each have a learned vector; a document is the average
of its vectors (each of the three groups by itself), and a softmax layer gives the classes.  Plain stochastic gradient descent
in numpy trains it, in one task, on a bounded sample: at most ``per_class`` labelled documents of each class, the same ones
however the table is dealt.  A word like the one before it counts as one more, shared feature, so that repetition shows.

Scoring is one pass without a shuffle.  Averages and the softmax's product commute, so what goes to the tasks is a weight for
each bucket: as much as the buckets, whatever the corpus.

Only texts are inputs.  Null counts as empty; an empty text gets the score of the bias alone.  Repeated rows come out as often
as they came in; for learning, an id counts once: with the least text by hash if it has several, and as label 0 if its labels differ.
A null doc_id is never learnt from nor held out.  An empty table gives no rows.  Other columns are not read.  Without labels of both classes there is no model: every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
GROUPS = 3  # words, byte trigrams, shape trigrams
DIM = 8
PER_CLASS = 2000
EPOCHS = 6
BATCH = 16
RATE = 30.0
SEED = 7
THRESHOLD = 0.3
#: Bytes of a text that are turned into features at a time.
PIECE = 1 << 18

_SHAPE = np.array([1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in (9, 10, 11, 12, 13, 32) else 5 if c > 127 else c for c in range(256)], np.uint32)
_BLANK = _SHAPE == 4
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_AGAIN = 1


def _trigrams(x: np.ndarray) -> np.ndarray:
    h = x[:-2] * _M1 + x[1:-1] * _M2 + x[2:] * _M3
    return (h ^ (h >> np.uint32(15))) * _M1 >> np.uint32(16)


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(group, buckets) of a text, piece by piece; pieces end at blanks where there are any."""
    last, at = None, 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut + 1 if cut > at else end
        b = np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        blank = _BLANK[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        if len(start):
            lead = np.concatenate(([0], start))
            place = np.arange(len(b), dtype=np.uint32) - np.repeat(lead, np.diff(np.append(lead, len(b)))).astype(np.uint32)
            mixed = (b.astype(np.uint32) + np.uint32(1)) * (place * _M2 + _M1)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * _M3
            mixed[blank] = 0
            word = np.add.reduceat(mixed, start, dtype=np.uint32)
            word = (word ^ (word >> np.uint32(15))) * _M1 >> np.uint32(16)
            before = np.concatenate(([last if last is not None else BUCKETS], word[:-1]))
            again = np.full(int((word == before).sum()), _AGAIN, word.dtype)
            last = int(word[-1])
            yield 0, np.concatenate((word, again))
        if len(b) > 2:
            yield 1, _trigrams(b.astype(np.uint32))
            yield 2, _trigrams(_SHAPE[b])
        at = min(end, len(text))


def averaged(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (group * BUCKETS + bucket) and the share of each in its group."""
    found: list[list[np.ndarray]] = [[] for _ in range(GROUPS)]
    for g, h in features(text):
        found[g].append(h)
    ids, shares = [], []
    for g, parts in enumerate(found):
        if parts:
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            ids.append(u.astype(np.int64) + g * BUCKETS)
            shares.append(n / n.sum())
    return (np.concatenate(ids), np.concatenate(shares)) if ids else (np.zeros(0, np.int64), np.zeros(0))


@dataclass
class Model:
    """A weight for each bucket of each group, and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        total, n = np.zeros(GROUPS), np.zeros(GROUPS)
        for g, h in features(text):
            total[g] += self.weight[g * BUCKETS : (g + 1) * BUCKETS][h].sum(dtype=np.float64)
            n[g] += len(h)
        z = float((total / np.maximum(n, 1)).sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over documents given as averaged() buckets."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((GROUPS * BUCKETS, DIM), np.float32) - 0.5) / DIM
    layer = (rng.random((GROUPS, DIM, 2)) - 0.5).astype(np.float32)
    bias = np.zeros(2)
    steps, done = epochs * -(-len(docs) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            some = order[at : at + BATCH]
            now = rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([docs[i][0] for i in some])
            share = np.concatenate([docs[i][1] for i in some]).astype(np.float32)
            owner = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
            slot = owner * GROUPS + ids // BUCKETS
            weighted = vectors[ids] * share[:, None]
            mean = np.stack([np.bincount(slot, weighted[:, d], len(some) * GROUPS) for d in range(DIM)], 1).reshape(len(some), GROUPS, DIM)
            z = np.einsum("bgd,gdc->bc", mean, layer) + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p.copy()
            error[np.arange(len(some)), labels[some]] -= 1
            error /= len(some)
            back = np.einsum("bc,gdc->bgd", error, layer).reshape(-1, DIM).astype(np.float32)
            used, inverse = np.unique(ids, return_inverse=True)
            grown = back[slot] * share[:, None]
            step = np.stack([np.bincount(inverse, grown[:, d], len(used)) for d in range(DIM)], 1)
            layer -= (now / 30 * np.einsum("bgd,bc->gdc", mean, error)).astype(np.float32)
            bias -= now / 30 * error.sum(0)
            vectors[used] -= (now * step).astype(np.float32)
    odds = layer[:, :, 1] - layer[:, :, 0]
    weight = np.concatenate([vectors[g * BUCKETS : (g + 1) * BUCKETS] @ odds[g] for g in range(GROUPS)])
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns labels.quality from at most ``per_class`` documents of each class that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("y")).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    # the sample is bounded by 2 * per_class ids, of which each has one text; map-side, so that repeats of an id never meet
    rows = common.whole_text(docs, "doc_id").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "y", "x.text")

    def prepare(batches):
        for batch in batches:
            for part in common.chunks(batch):
                got = [averaged(t) for t in common.texts(part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("doc_id").cast(pa.string())), part.column("y").cast(pa.int32()), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                     pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))], ["id", "y", "ids", "shares"])

    def learn(batches):
        rows = sorted(((i, y, a, s) for b in batches for i, y, a, s in zip(
            b.column(0).to_pylist(), b.column(1).to_pylist(), (np.array(x.as_py(), np.int64) for x in b.column(2)), (np.array(x.as_py(), np.float32) for x in b.column(3)))),
            key=lambda r: (r[0], len(r[2])))
        y = np.array([r[1] for r in rows], np.int64)
        if len(set(y.tolist())) == 2:
            m = train([r[2:] for r in rows], y)
        else:
            share = float(y.mean()) if len(y) else 0.5
            m = Model(np.zeros(GROUPS * BUCKETS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        yield pa.RecordBatch.from_arrays([pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias])], ["weight", "bias"])

    prepared = rows.mapInArrow(prepare, "id string, y int, ids array<int>, shares array<float>")
    sample = common.written(prepared, "sample")
    r = sample.repartition(1).mapInArrow(learn, "weight binary, bias double").first()
    common.removed(sample)
    if r is None:
        return Model(np.zeros(GROUPS * BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(r.weight, np.float32), r.bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    rows = common.whole_text(docs, "doc_id")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in common.texts(batch)], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs, fit(docs, labels, per_class))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects; columns and null texts as they were."""
    model = fit(docs, labels, per_class)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([m.score(t or b"") >= threshold for t in common.texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
