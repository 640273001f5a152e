"""Token ids as bit-plane files: encode, write in doc_id order, read back.

Texts are dealt into doc_id ranges (see ``blocks``) and encoded in order.  A file row is a chunk of whole documents; its ids are
cut into blocks of ``BLOCK_IDS``; each block is transposed into byte planes (lowest byte first; planes that would be all zero
are left out) and every plane is compressed by itself with zstandard.  Beside the chunks stands an index: where each chunk
begins among all ids.  Chunks are self-contained, so that reading needs no shuffle, and any task can read any chunk.

File row: part, chunk, start (ids of the part before it), n_ids, doc_ids, doc_n, blocks of (n, planes).
Index row: part, chunk, start (ids of all parts before it), n_ids, n_docs.

Null counts as empty: a document of the end id alone.  Repeated rows are written as often as they come, in the order of their
texts; rows without doc_id come first.  Empty input gives an empty file set.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
#: Words whose ids a worker remembers, and new words that go to the tokenizer at a time.
REMEMBERED = 300_000
AT_A_TIME = 8192

FILE_SCHEMA = "part int, chunk int, start long, n_ids long, doc_ids array<long>, doc_n array<int>, blocks array<struct<n:int,planes:array<binary>>>"

#: Words of small letters that stand below U+0100.
SMALL = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of the letters up to U+00FF: printable bytes as themselves, the others,
    in order, as the code points from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    write = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return {c: "".join(write[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class Encoder:
    """The tokenizer's ids of whole texts.

    A tokenizer that splits texts at white space, takes runs of letters together and lower-cases (it is asked for these steps when
    it is read) never joins anything over a blank or line end.  So texts are cut there, and only words not met before go to the
    tokenizer; a final full stop or comma is a token of its own; a word of small letters goes to its model at once, as no other
    step changes it.  With any other tokenizer every whole text is encoded as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        before = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = (
            steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in before] == ["Split", "ByteLevel"] and before[0]["invert"]
            and before[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not before[1]["add_prefix_space"]
            and told["model"]["type"] == "BPE" and not told["model"]["dropout"])
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.met = (np.zeros(1 << 12, t) for t in (np.int32, np.int32, np.int32))
        self.punctuation = {p: self.tokenizer.encode(p, add_special_tokens=False).ids for p in ".,"}

    def _learn(self, words: list[str]) -> None:
        """Ids of new words; one that ends in a full stop or comma has the ids of the rest and of the sign."""
        signed = [w for w in words if w[-1:] in (".", ",") and w[:-1].isalpha()]
        plain = set(words).difference(signed)
        plain.update(w[:-1] for w in signed)
        plain = list(plain.difference(self.at))
        for at in range(0, len(plain), AT_A_TIME):
            some = plain[at : at + AT_A_TIME]
            ids = self._encoded(some)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self._remember(some, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size)
        for sign, own in self.punctuation.items():
            some = [w for w in signed if w[-1] == sign]
            stem = np.fromiter((self.at[w[:-1]] for w in some), np.int64, len(some))
            size = self.size[stem]
            ids = self._of(stem)
            for i in own:
                ids = np.insert(ids, np.cumsum(size), i)
                size = size + 1
            self._remember(some, ids, size)

    def _encoded(self, words: list[str]) -> list[list[int]]:
        small = [SMALL(w) is not None for w in words]
        other = iter([e.ids for e in self.tokenizer.encode_batch_fast([w for w, ok in zip(words, small) if not ok], add_special_tokens=False)])
        model = self.tokenizer.model.tokenize
        return [[t.id for t in model(w if w.isascii() else w.translate(self.letters))] if ok else next(other) for w, ok in zip(words, small)]

    def _of(self, words: np.ndarray) -> np.ndarray:
        size = self.size[words]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.start[words] - ends + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def _remember(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, first = len(self.at), self.used
        while len(self.flat) < first + len(ids):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.start) < n + len(words):
            self.start, self.size, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.met))
        self.flat[first : first + len(ids)] = ids
        self.size[n : n + len(words)], self.met[n : n + len(words)] = size, 0
        self.start[n : n + len(words)] = first + np.cumsum(size) - size
        self.used = first + len(ids)
        self.at.update(zip(words, range(n, n + len(words))))

    def _forget_rare(self) -> None:
        """Keeps the words met most, and those at least twice."""
        n = len(self.at)
        order = np.argsort(-self.met[:n], kind="stable")[: REMEMBERED // 2]
        keep = np.sort(order[self.met[order] > 1])
        words = list(self.at)
        kept, met, size, ids = [words[i] for i in keep.tolist()], self.met[keep], self.size[keep], self._of(keep)
        self.forget()
        self._remember(kept, ids, size)
        self.met[: len(kept)] = met

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each text."""
        if not self.by_words:
            ids = [e.ids for t in texts.to_pylist() for e in [self.tokenizer.encode(t, add_special_tokens=False)]]
            return np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids))), np.fromiter(map(len, ids), np.int64, len(ids))
        # where lower-casing goes letter by letter, capitals needn't be told apart
        simple = pc.invert(pc.or_(pc.match_substring_regex(texts, "[^\\x00-\\xff]"), pc.match_substring(texts, "<|")))
        split = pc.split_pattern(pc.replace_substring(pc.if_else(simple, pc.utf8_lower(texts), texts), "\n", " "), " ")
        per_text = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        if len(self.at) > REMEMBERED:
            self._forget_rare()
        distinct = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(known < 0)):
            words = [distinct[i] for i in new.tolist()]
            self._learn(words)
            known[new] = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        at = coded.indices.to_numpy(zero_copy_only=False)
        self.met[known] += np.bincount(at, minlength=len(known)).astype(np.int32)
        words = known[at]
        upto = np.concatenate(([0], np.cumsum(self.size[words])))
        return self._of(words), upto[per_text[1:]] - upto[per_text[:-1]]


def planes(ids: np.ndarray) -> list[bytes]:
    """The byte planes of a block, each compressed; trailing zero planes left out."""
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    most = int(ids.max(initial=0))
    packer = zstandard.ZstdCompressor(level=3)
    return [packer.compress(rows[k].tobytes()) for k in range(4) if k == 0 or most >> (8 * k)]


def from_planes(n: int, data: list[bytes]) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, d in enumerate(data):
        out[:, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(d, max_output_size=n), np.uint8)
    return out.reshape(-1).view("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2) -> None:
    """Writes path/chunks and path/index.  tokenizer: the file of a tokenizer of the tokenizers library."""

    def run(part: int, rows: pa.Table, _) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        start, chunk, held, docs_held, n_held = 0, 0, [], [], 0

        def out():
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            data = [{"n": len(b), "planes": planes(b)} for b in (ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS))]
            kind = pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))]))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([[d for d, _ in docs_held]], pa.list_(pa.int64())), pa.array([[n for _, n in docs_held]], pa.list_(pa.int32())), pa.array([data], kind)],
                ["part", "chunk", "start", "n_ids", "doc_ids", "doc_n", "blocks"])

        for batch in rows.to_batches():
            for piece in common.chunks(batch):
                ids, counts = encoder.encode(piece.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                at = 0
                for doc, n in zip(piece.column(0).to_pylist(), counts.tolist()):
                    held.append(ids[at : at + n])
                    docs_held.append((doc, n))
                    at, n_held = at + n, n_held + n
                    if n_held >= CHUNK_IDS:
                        yield out()
                        start, chunk, held, docs_held, n_held = start + n_held, chunk + 1, [], [], 0
        if docs_held:
            yield out()

    rows = common.whole_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks.in_ranges(rows, "doc_id", run, FILE_SCHEMA).write.parquet(f"{path}/chunks")
    spark = docs.sparkSession
    chunks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/chunks").select("part", "chunk", "start", "n_ids", F.size("doc_ids").alias("n_docs"))
    base = spark.createDataFrame(sorted(_bases(chunks).items()), "part int, base long")
    chunks.join(F.broadcast(base), "part").select("part", "chunk", (F.col("start") + F.col("base")).alias("start"), "n_ids", "n_docs").write.parquet(f"{path}/index")


@functools.lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One for each worker process, so that its words are remembered from task to task."""
    return Encoder(path)


def _bases(chunks: DataFrame) -> dict[int, int]:
    """Ids before each part; as many entries as there are key ranges."""
    out, total = {}, 0
    for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        out[r.part], total = total, total + r.n
    return out


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document in the files."""
    base = {r.part: r.base for r in spark.read.schema("part int, chunk int, start long, n_ids long, n_docs int").parquet(f"{path}/index")
            .where("chunk = 0").select("part", F.col("start").alias("base")).collect()}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("part", "start", "doc_ids", "doc_n", "blocks")}
                ids = np.concatenate([from_planes(b["n"], b["planes"]) for b in row["blocks"]]) if row["blocks"] else np.zeros(0, "<u4")
                n = np.array(row["doc_n"], np.int64)
                ends = np.cumsum(n)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["part"]] + row["start"] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([ids[e - k : e].astype(np.int64) for e, k in zip(ends.tolist(), n.tolist())], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.schema(FILE_SCHEMA).parquet(f"{path}/chunks").mapInArrow(run, schema)
