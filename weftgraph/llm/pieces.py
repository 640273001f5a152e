"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words where no piece can reach over: before a run of word marks (U+2581, written for a blank) that follows
something else, and around line ends if no piece holds one.  Distinct words go through the lattice:

1. explode the substrings of bounded length of every word: up to the longest piece with the same first three characters;
2. equi-join them to the piece table, which is broadcast: its size is that of the model, whatever the corpus;
3. group the edges by word;
4. fold: for a unigram model, Viterbi over end positions with ``aggregate``; for a BPE model, whose pieces carry merge ranks and
   no probabilities, ``aggregate`` over the edges by rank (then from the left): an edge that joins two neighbours at its turn is
   a merge, which is what such a model defines.  Some pieces have a part whose rank is not below their own and may become
   possible after their turn; the fold watches for that, and such a word goes to the library.

Texts travel in blocks: some MB of whole texts as codes of the block's own dictionary.  Words travel once for each block that has
them, packed by their part, a share of all words by hash: a row is one block's words of one part.  There are as many parts as
keep a part to some MB of text, however large the corpus is.  A part's words are made distinct, go through the lattice, and meet
the packed rows again (``cogroup``); what returns to a block is an id list for each part, in the order in which its words stood.

Words with characters outside the piece table (byte fallback), or over ``LONGEST`` characters, are encoded by the sentencepiece
library; so are words whose ids did not come back, as when a block was made anew in another order.  ``n_library`` tells for each
text how many of its words came by the library.

Null counts as empty: no ids, decoded as empty.  Repeated rows come out as often as they came in; empty input, empty output.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .tokenbin import from_planes, planes

MARK = "▁"
#: Characters of a word that a bit mask of 64 bits has room for.
LONGEST = 62
BLOCK_BYTES = 8 << 20
#: Bytes of text whose words make a partition, on average; its edges then fit a task's memory without spilling.
PARTITION_OF = 4 << 20
#: Beyond so many partitions they grow (the lattice spills), as a shuffle can't have any number of them; parts stay small.
MOST_PARTITIONS = 50_000
#: Parts of a partition: so many even out where hashes deal them unevenly.
PARTS = 4
#: Bytes of text that are cut into words at a time.
PART_BYTES = 1 << 20
#: No piece of a usual model goes from a letter to one of these; the model is asked.
CUT = "([A-Za-zÀ-ÿ])([.,|!?%$#&*])"


class Model:
    """A model file: its pieces with their kinds, and the library that reads it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.rows = [(p, i, float(sp.get_score(i))) for i, (p, ok) in enumerate(zip(self.pieces, plain)) if ok]
        rank = {p: -s for p, _, s in self.rows}
        part = lambda x: -1.0 if len(x) == 1 else rank.get(x)
        late = {p for p in rank for m in range(1, len(p)) if None not in (a := (part(p[:m]), part(p[m:]))) and max(a) >= rank[p]}
        self.rows = [(*r, r[0] in late) for r in self.rows]
        self.cuts = not any(re.search(CUT, r[0]) for r in self.rows)
        self.longest = max(len(r[0]) for r in self.rows)
        scores = [r[2] for r in self.rows]
        # BPE scores are whole numbers, minus the rank of the merge
        self.bpe = all(s == int(s) for s in scores)
        inner = any(MARK in r[0].lstrip(MARK) or "\n" in r[0] for r in self.rows)
        if inner:
            raise ValueError("a piece reaches over words")
        data = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if not ok else p.replace(MARK, " ").encode() for i, (p, ok) in enumerate(zip(self.pieces, plain))]
        self.size = np.array([len(d) for d in data], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(data), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        out = self.bytes[np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()
        return out[1:] if out[:1] == b" " else out

    def encode_word(self, word: str) -> list[int]:
        """One word by the library; the marker it puts before every text is taken off again."""
        lead = MARK if word.startswith(MARK) else ""
        if lead:
            return self.library.encode(word[1:].replace(MARK, " ")) if len(word) > 1 else [self.library.piece_to_id(MARK)]
        ids = self.library.encode(f"\n{word}")
        return ids[len(self.library.encode("\n")) :]


@functools.lru_cache(2)
def model_of(path: str) -> Model:
    return Model(path)


def words_of(texts: pa.Array, cuts: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, coded, and how many belong to each text ("" may stand among them)."""
    marked = pc.replace_substring(texts, " ", MARK)
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, marked, ""))
    sep = next(c for c in map(chr, range(0x20)) if c != "\n" and not pc.any(pc.match_substring(texts, c)).as_py())
    cut = pc.replace_substring_regex(marked, f"([^{MARK}\n])({MARK})", rf"\1{sep}\2")
    if cuts:
        cut = pc.replace_substring_regex(cut, CUT, rf"\1{sep}\2")
    split = pc.split_pattern(pc.replace_substring(cut, "\n", f"{sep}\n{sep}"), sep)
    return split.flatten().dictionary_encode(), np.diff(split.offsets.to_numpy()).astype(np.int64)


def bpe(edges: Column, n: Column) -> Column:
    """Ids of a word from its edges (rank, s, e, id, late) by merges; null if it needs other means.

    A mask holds the bounds that still stand.  ends: the bits of an edge's ends; inner: those between them.
    """
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i)
    masked = F.transform(edges, lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"), x["id"].alias("id"), bit(x["s"]).bitwiseOR(bit(x["e"])).alias("ends"), (bit(x["e"]) - bit(x["s"] + 1)).alias("inner"), x["late"].alias("late")))

    def joins(m: Column, x: Column) -> Column:
        return (m.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(m.bitwiseAND(x["inner"])) == 1)

    def folded(edges: Column) -> Column:
        def fold(late: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                new = a["m"].bitwiseAND(F.bitwise_not(x["inner"]))
                passed = F.exists(late, lambda y: (y["rank"] <= x["rank"]) & joins(new, y))
                return F.when(joins(a["m"], x), F.struct(new.alias("m"), (a["bad"] | passed).alias("bad"))).otherwise(a)

            all_bounds = (bit(n + 1) - 1).alias("m")
            return F.aggregate(F.filter(edges, lambda x: x["inner"] != 0), F.struct(all_bounds, F.lit(False).alias("bad")), step)

        def tokens(a: Column) -> Column:
            m = a["m"]
            kept = F.filter(edges, lambda x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (m.bitwiseAND(x["inner"]) == 0))
            ids = F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))), lambda x: x["id"])
            return F.when(~a["bad"] & (F.size(ids) == F.bit_count(m) - 1), ids)

        return F.get(F.transform(F.transform(F.array(F.filter(edges, lambda x: x["late"])), fold), tokens), F.lit(0))

    # made once each, as the only element of an array
    return F.get(F.transform(F.array(masked), folded), F.lit(0))


def viterbi(edges: Column, n: Column) -> Column:
    """Ids of a word from its edges (rank, s, e, id), rank being minus the score, by the best sum; null if there is no way."""
    kind = "array<struct<cost:double,ids:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("ids"))).cast(kind)

    def step(best: Column, end: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: (x["e"] == end) & F.get(best, x["s"])["cost"].isNotNull()), lambda x: F.struct(
            (F.get(best, x["s"])["cost"] + x["rank"]).alias("cost"), F.concat(F.get(best, x["s"])["ids"], F.array(x["id"])).alias("ids")))
        none = F.struct(F.lit(None).cast("double").alias("cost"), F.lit(None).cast("array<int>").alias("ids"))
        return F.concat(best, F.array(F.coalesce(F.array_min(ways), none)).cast(kind))

    return F.aggregate(F.sequence(F.lit(1), n), first, step, lambda b: F.get(b, n)["ids"])


def lattice(words: DataFrame, pieces: DataFrame, longest: int, is_bpe: bool) -> DataFrame:
    """words(word, ...), each distinct, with ids, from pieces(piece, id, score, late); a word that needs other means is missing or has null.

    No filter on the ids: Spark would fold twice, once for the filter.
    """
    n, own = F.char_length("word"), words.columns
    parts = words.where((n > 0) & (n <= LONGEST)).select(*own, F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    # how long a piece can be that begins like this: from three characters on only where some piece does
    size = F.char_length("piece")
    heads = pieces.where(size > 2).groupBy(F.substring("piece", 1, 3).alias("head")).agg(F.max(size).alias("most"))
    parts = parts.withColumn("head", F.substring("word", F.col("s") + 1, F.lit(3))).join(F.broadcast(heads), "head", "left")
    most = F.least(F.coalesce("most", F.lit(2)), F.lit(longest))
    parts = parts.select(*own, "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + most, n))).alias("e"))
    found = parts.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))).join(F.broadcast(pieces), "piece")
    edge = F.struct((-F.col("score")).alias("rank"), "s", "e", "id", "late")
    grouped = found.groupBy(*own).agg(F.collect_list(edge).alias("edges")).withColumn("edges", F.sort_array("edges"))
    return grouped.select(*own, (bpe if is_bpe else viterbi)(F.col("edges"), n).alias("ids"))


_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def part_of(words: pa.Array, parts: int) -> np.ndarray:
    """The part of every word: a hash of its bytes and their places."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(at)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    place = np.arange(len(b), dtype=np.uint32) - np.repeat(at[:-1], size).astype(np.uint32)
    mixed = (b.astype(np.uint32) + np.uint32(1)) * (place * _M2 + _M1)
    mixed = (mixed ^ (mixed >> np.uint32(13))) * _M3
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    h = (upto[at[1:]] - upto[at[:-1]]).astype(np.uint32)
    return ((h ^ (h >> np.uint32(15))) * _M1 >> np.uint32(1)).astype(np.int64) % parts


def _blocks(rows: DataFrame, what: str, schema: str, cuts: bool, parts: int) -> DataFrame:
    """Blocks of rows(doc_id, text): (block, data) with texts as codes of the words, or (part, words), the block's name first.

    No word holds a blank, so a blank parts them.
    """

    def run(batches):
        for table in blocks.gathered(batches, BLOCK_BYTES):
            coded, counts, sums = [], [], []
            for batch in table.to_batches():
                for some in common.chunks(batch, size=PART_BYTES):
                    one, n = words_of(some.column("text"), cuts)
                    coded.append(one)
                    counts.append(n)
                    sums += [hashlib.sha256(t).digest() for t in common.texts(some)]
            coded, counts = pa.chunked_array(coded).unify_dictionaries(), np.concatenate(counts)
            codes, words = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]), coded.chunk(0).dictionary
            block = np.array([xxhash.xxh64_intdigest(codes.tobytes() + b"".join(sums))], np.uint64).view(np.int64)
            if what == "words":
                to = part_of(words, parts)
                order = np.argsort(to, kind="stable")
                held, begin = np.unique(to[order], return_index=True)
                offsets = pa.array([*begin.tolist(), len(order)], pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(order))), " ")
                named = pc.binary_join_element_wise(f"{block[0]}", joined, " ")
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), named], ["part", "words"])
            else:
                data = pickle.dumps((table.column("doc_id").to_pylist(), counts.astype(np.int32), len(codes), planes(codes), blocks.pack(pa.table([words], ["word"])), sums))
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array([data], pa.binary())], ["block", "data"])
            del coded, words, codes
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def _returned(packed: pa.Table, known: pa.Table) -> pa.Table:
    """(block, part, data): for each block's words of one part, in their order, how many ids each has (plus 1; 0: none known) and the ids."""
    part, words = packed.column("part"), packed.column("words").combine_chunks()
    split = pc.split_pattern(words, " ")
    begin, flat = split.offsets.to_numpy(), split.flatten()
    table = pa.chunked_array(known.column("word").chunks, pa.string()).combine_chunks()
    ids = pa.chunked_array(known.column("ids").chunks, pa.list_(pa.int32())).combine_chunks()
    n, values = pc.fill_null(pc.list_value_length(ids), -1).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(flat, value_set=table), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    have = np.maximum(n, 0)
    n, start = np.append(n, -1), np.append(np.cumsum(have) - have, 0)  # the last for what is not known
    names, out = flat.take(pa.array(begin[:-1])).cast(pa.int64()), []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        own = at[a + 1 : b]
        size = n[own]
        many = np.maximum(size, 0)
        some = values[np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        out.append(pickle.dumps((len(own), planes((size + 1).astype(np.uint32)), len(some), planes(some.astype(np.uint32)))))
    return pa.table([names, part, pa.array(out, pa.binary())], ["block", "part", "data"])


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, lossless, n_words, n_library), and the ids if asked for, for every row of docs.

    path: the model file, at the same place on every machine.  lossless: the ids decode to the very text.
    """
    spark: SparkSession = docs.sparkSession
    model = model_of(path)
    rows = common.whole_text(docs, "doc_id")
    key = docs.schema["doc_id"].dataType
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(common.n_parts(spark), min(MOST_PARTITIONS, -(-size // PARTITION_OF)))
    parts = PARTS * max(partitions, -(-size // PARTITION_OF))
    # one shuffle serves both the lattice and the way back to the blocks
    words = _blocks(rows, "words", "part int, words string", model.cuts, parts).repartition(partitions, "part")
    split = F.split("words", " ")
    once = words.select(F.col("part").alias("of"), F.explode(F.slice(split, 2, F.size(split))).alias("word")).distinct()
    table = spark.createDataFrame(model.rows, "piece string, id int, score double, late boolean")
    known = lattice(once, table, model.longest, model.bpe)
    back = words.groupBy("part").cogroup(known.groupBy("of")).applyInArrow(_returned, "block long, part int, data binary").withColumn("kind", F.lit(0))
    texts = _blocks(rows, "texts", "block long, data binary", model.cuts, parts).select("block", F.lit(0).alias("part"), "data", F.lit(1).alias("kind"))

    def finish(got: list[tuple[int, bytes]], data: bytes) -> Iterator[pa.RecordBatch]:
        own = model_of(path)
        ids_of, counts, n_codes, codes, names, sums = pickle.loads(data)
        codes = from_planes(n_codes, codes).astype(np.int64)
        names = blocks.unpack(names).column(0).combine_chunks()
        size, start = np.full(len(names), -1, np.int64), np.zeros(len(names), np.int64)
        to = part_of(names, parts)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(parts + 1))
        flat, at = [], 0
        for part, packed in got:
            many, n, n_ids, ids = pickle.loads(packed)
            code = order[bounds[part] : bounds[part + 1]]
            n, ids = from_planes(many, n).astype(np.int64) - 1, from_planes(n_ids, ids)
            have = np.maximum(n, 0)
            size[code], start[code] = n, at + np.cumsum(have) - have
            flat.append(ids)
            at += len(ids)
        missed = np.flatnonzero(size < 0)
        for c, name in zip(missed.tolist(), names.take(pa.array(missed)).to_pylist()):
            ids = own.encode_word(name) if name else []
            size[c], start[c] = len(ids), at
            flat.append(np.array(ids, np.uint32))
            at += len(ids)
        a_word = pc.not_equal(names, "").to_numpy(zero_copy_only=False).astype(np.int64)
        by_library = np.zeros(len(names), np.int64)
        by_library[missed] = a_word[missed]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        rows_at = np.concatenate(([0], np.cumsum(counts)))
        for first in range(0, len(counts), 500):
            last = min(first + 500, len(counts))
            w = codes[rows_at[first] : rows_at[last]]
            n = size[w]
            upto = np.concatenate(([0], np.cumsum(n)))
            some = flat[np.repeat(start[w] - upto[1:] + n, n) + np.arange(upto[-1])]
            cut = rows_at[first : last + 1] - rows_at[first]
            ends = upto[cut[1:]]
            all_words, library = (np.diff(np.concatenate(([0], np.cumsum(x[w])))[cut]) for x in (a_word, by_library))
            out = []
            for i, a, b in zip(range(first, last), [0, *ends[:-1].tolist()], ends.tolist()):
                digest = hashlib.sha256(own.decode(some[a:b])).digest()
                out.append((b - a, zlib.crc32(some[a:b].astype("<u4").tobytes()), digest.hex(), digest == sums[i], some[a:b]))
            cols = [pa.array(ids_of[first : first + len(out)], arrow_key), *(pa.array([o[k] for o in out]) for k in range(4)), pa.array(all_words), pa.array(library)]
            if with_ids:
                cols.append(pa.array([o[4].astype(np.int32) for o in out], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless", "n_words", "n_library", *["ids"] * with_ids])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(key)

    def joined(batches):
        now, got = None, []
        for batch in batches:
            for block, part, data, kind in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data"), batch.column("kind").to_pylist()):
                if block != now:
                    now, got = block, []
                if kind == 0:
                    got.append((part, data.as_py()))
                else:
                    yield from finish(got, data.as_py())

    schema = f"doc_id {key.simpleString()}, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean, n_words long, n_library long" + ", ids array<int>" * with_ids
    return back.select("block", "part", "data", "kind").unionByName(texts).repartition(max(common.n_parts(spark), partitions // 8), "block").sortWithinPartitions("block", "kind").mapInArrow(joined, schema)
