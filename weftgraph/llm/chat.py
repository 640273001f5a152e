"""Conversations as training text, assembled column by column.

Each turn becomes ``### role: text </turn>`` and a line end.  Inside texts and roles the control strings and the escape sign itself
get a backslash before them, so that the text can be read back exactly.  The loss mask covers the texts of the assistant.

Turns are dealt out by (conv_id, turn) ranges, so that a very long conversation spreads over tasks.  A task takes a few MB of
turns, computes the lengths of all segments, their cumulative offsets and the scatter indices in numpy, and copies headers and
contents into one preallocated buffer, which is the data of the Arrow column that it returns: one row for each conversation
and piece, in the order of ``part``.

A null text counts as empty, a null role as the role "".  Rows that share a turn come in the order of role and text; rows without
conv_id are a conversation of their own.  Empty input, empty output.  Digests of a conversation are sequential, so one task reads its
pieces one after the other, and holds one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD, AFTER_ROLE, TAIL = b"### ", b": ", b" </turn>\n"
#: Control strings; the escape sign comes first.
ESCAPED = ("\\", "###", "</turn>")
LEARNT = "assistant"

_TURN = re.compile(rb"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPE = re.compile(rb"\\(.)", re.S)
SCHEMA_TAIL = "part long, n_turns long, formatted binary, loss_start array<long>, loss_end array<long>"


def escaped(texts: pa.Array, more: tuple[str, ...] = ()) -> pa.Array:
    for s in (*ESCAPED, *more):
        texts = pc.replace_substring(texts, s, "\\" + s)
    return texts


def unescaped(data: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1", data)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a string column without nulls, and the length of each value."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns in one buffer, where each turn ends, and (start, end) of each text."""
    heads, head_size = _bytes(pc.binary_join_element_wise(HEAD.decode(), escaped(roles, (":",)), AFTER_ROLE.decode(), ""))
    contents, content_size = _bytes(escaped(texts))
    size = np.stack([head_size, content_size, np.full(len(head_size), len(TAIL))], 1)
    ends = np.cumsum(size.reshape(-1)).reshape(-1, 3)
    starts = ends - size
    out = np.empty(int(ends[-1, 2]) if len(ends) else 0, np.uint8)
    for k, (data, n) in enumerate(((heads, head_size), (contents, content_size))):
        out[np.repeat(starts[:, k] - np.cumsum(n) + n, n) + np.arange(len(data))] = data
    out[(starts[:, 2][:, None] + np.arange(len(TAIL))).reshape(-1)] = np.tile(np.frombuffer(TAIL, np.uint8), len(ends))
    return out, ends[:, 2], np.stack([starts[:, 1], ends[:, 1]], 1)


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_start, loss_end); offsets are bytes from the start of the row's text."""
    key = turns.schema["conv_id"].dataType.simpleString()
    blank = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in common.chunks(batch):
                ids, roles = piece.column("conv_id"), piece.column("role")
                data, ends, texts = assemble(roles, piece.column("text"))
                coded = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first = np.concatenate(([0], np.flatnonzero(np.diff(coded)) + 1))
                turns_of = np.diff(np.append(first, len(coded)))
                upto = np.concatenate(([0], ends))
                begin = upto[first]
                learnt = np.flatnonzero(pc.equal(roles, LEARNT).to_numpy(zero_copy_only=False))
                owner = np.searchsorted(first, learnt, "right") - 1
                spans = texts[learnt] - begin[owner][:, None]
                lists = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(first))))).astype(np.int32)
                bounds = np.append(begin, upto[-1]).astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                n = np.arange(part, part + len(first))
                part += len(first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first)), pa.array(n), pa.array(turns_of), text, *(pa.ListArray.from_arrays(pa.array(lists), pa.array(np.ascontiguousarray(spans[:, k]))) for k in (0, 1))],
                    ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])

    dealt = rows.repartitionByRange(common.n_parts(turns.sparkSession), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {key}, {SCHEMA_TAIL}")


def parsed(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of every turn in formatted text."""
    at = 0
    while at < len(data):
        m = _TURN.match(data, at)
        if m is None:
            raise ValueError(f"no turn begins at byte {at}")
        yield unescaped(m[1]), unescaped(m[2][:-1])
        at = m.end()


def digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from formatted(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    key = pieces.schema["conv_id"].dataType
    chars = lambda b: len(b) - int((np.frombuffer(b, np.uint8) & 0xC0 == 0x80).sum())

    def run(batches):
        now, state = None, None

        def out():
            conv, n, turns, loss_chars, loss, total = state
            return pa.RecordBatch.from_arrays(
                [pa.array([conv]).cast(kind), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([loss_chars]), pa.array([loss.hexdigest()]), pa.array([total])],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for i in range(batch.num_rows):
                conv = batch.column("conv_id")[i].as_py()
                if state is None or conv != now:
                    if state is not None:
                        yield out()
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = batch.column("formatted")[i].as_py()
                for role, text in parsed(data):
                    state[1] += 1
                    state[2].update(role + b"\n" + text + b"\n")
                for a, b in zip(batch.column("loss_start")[i].as_py(), batch.column("loss_end")[i].as_py()):
                    text = unescaped(data[a:b])
                    state[3] += chars(text)
                    state[4].update(text)
                state[5] += chars(data)
        if state is not None:
            yield out()

    rows = pieces.select("conv_id", "part", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(run, f"conv_id {key.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
