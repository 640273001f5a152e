"""Page rank over packed blocks of nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .numbered import coded, codes

DAMPING = 0.85
#: Of a block: its nodes' counts of edges and 1 / weight going out (0: none), each edge's place among the block's targets and weight, the targets.
SHARE_COLUMNS = ("many", "out", "to", "weights", "code", "targets")
SHARES = "block long, " + ", ".join(f"{c} binary" for c in SHARE_COLUMNS)
RANK = "block long, rank binary"
SENT = "block long, at binary, got binary, lost double"


def _nodes(block: int, n: int, per: int) -> int:
    return min(per, n - block * per)


def shares(n: int, per: int):
    """Packs rows (i, j, weight) of a block; j is -1 for a target that is no node: it takes its share of the weight along."""

    def pack(block: int, rows: dict[str, np.ndarray]) -> dict:
        size = _nodes(block, n, per)
        i, j, w = rows["i"] - block * per, rows["j"], rows["weight"]
        out = np.bincount(i, weights=w, minlength=size)
        some = j >= 0
        i, j, w = i[some], j[some], w[some]
        targets, to = np.unique(j, return_inverse=True)
        table, code = coded(w)
        inverse = np.divide(1.0, out, out=np.zeros(size), where=out > 0)
        return {"block": block, "many": np.bincount(i, minlength=size).astype(np.int32).tobytes(), "out": inverse.tobytes(), "to": to.astype(np.int32).tobytes(), "weights": table, "code": code, "targets": targets.astype(np.int64).tobytes()}

    return pack


def _rows(batches, names):
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(None if not (x := b.column(c)[k]).is_valid else x.as_py() if not isinstance(x, pa.BinaryScalar) else x.as_buffer() for c in names)


def _given(rank, many, out, to, weights, code, targets):
    """(targets, what each gets, what nodes without edges hold)."""
    if many is None:
        return np.zeros(0, np.int64), np.zeros(0), float(rank.sum())
    inverse, many, to, table = np.frombuffer(out), np.frombuffer(many, np.int32), np.frombuffer(to, np.int32), np.frombuffer(weights)
    targets = np.frombuffer(targets, np.int64)
    each = np.repeat(rank * inverse, many) * table[codes(table, code)] if len(to) else np.zeros(0)
    return targets, np.bincount(to, weights=each, minlength=len(targets)), float(rank[inverse == 0].sum())


def _start(rank, block: int, n: int, per: int) -> np.ndarray:
    return np.full(_nodes(block, n, per), 1.0 / n) if rank is None else np.frombuffer(rank)


def sending(n: int, per: int, blocks: int):
    """A row from each block to each: what its nodes get, and what the sender's nodes without edges hold."""

    def run(batches):
        for block, rank, *edges in _rows(batches, ("block", "rank", *SHARE_COLUMNS)):
            targets, got, lost = _given(_start(rank, block, n, per), *edges)
            cuts = np.searchsorted(targets, np.arange(blocks + 1) * per)
            for b in range(blocks):
                lo, hi = cuts[b], cuts[b + 1]
                at = (targets[lo:hi] - b * per).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"block": [b], "at": pa.array([at.tobytes()], pa.binary()), "got": pa.array([got[lo:hi].tobytes()], pa.binary()), "lost": [lost]})

    return run


def _next(got: np.ndarray, lost: float, n: int) -> np.ndarray:
    return (1 - DAMPING) / n + DAMPING * (got + lost / n)


def summing(n: int, per: int):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        lost: dict[int, float] = {}
        for block, at, got, less in _rows(batches, ("block", "at", "got", "lost")):
            here = sums.setdefault(block, np.zeros(_nodes(block, n, per)))
            here[np.frombuffer(at, np.int32)] += np.frombuffer(got)
            lost[block] = lost.get(block, 0.0) + less
        for block, got in sums.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "rank": pa.array([_next(got, lost[block], n).tobytes()], pa.binary())})

    return run


def ranked(n: int, per: int, rounds: int):
    """All rounds of a graph of one block."""

    def run(batches):
        for block, rank, *edges in _rows(batches, ("block", "rank", *SHARE_COLUMNS)):
            rank = _start(rank, block, n, per)
            for _ in range(rounds):
                targets, got, lost = _given(rank, *edges)
                all_got = np.zeros(n)
                all_got[targets] = got
                rank = _next(all_got, lost, n)
            yield pa.RecordBatch.from_pydict({"block": [block], "rank": pa.array([rank.tobytes()], pa.binary())})

    return run


def unpacked(n: int, per: int):
    def run(batches):
        for block, rank in _rows(batches, ("block", "rank")):
            rank = _start(rank, block, n, per)
            for lo in range(0, len(rank), 1 << 16):
                part = rank[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"at": np.arange(len(part)) + block * per + lo, "rank": part})

    return run
