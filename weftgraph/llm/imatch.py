"""I-Match document fingerprints.

The lexicon holds the terms whose share of documents lies in a band: above it they are common everywhere, below it rare or
misspelt.  Its size is bounded by the band, not by the corpus: terms in at least a share ``least`` of the documents number at
most (mean distinct terms of a document) / least.  So it is broadcast, as 64-bit term hashes.

A fingerprint is a sequence of hashes, one for each of several randomised subsets of the lexicon, each over the sorted
distinct terms that the text has in the subset.  The subsets come in four sizes (1/16 to 1/1024 of the lexicon, 16 of each), so
that for short and long texts some of them change with every edit and some with few.  The likeness of two fingerprints is the
share of equal hashes among subsets that either text has terms in.

Texts without terms in the band are hashed over all their terms, those without any term over their bytes.  Null counts as
empty.  Terms: runs of letters a-z, digits and other than ASCII characters, A-Z lower-cased.  Repeated rows come out as often as
they came in, ordered by their text within a doc_id; a null doc_id comes first.  Empty input, empty output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .decontaminate import words_of

#: The band: shares of documents that a term occurs in.
LEAST, MOST = 0.001, 0.25
#: Subsets: (one of so many parts of the lexicon, how many of them).
LEVELS = ((16, 16), (64, 16), (256, 16), (1024, 16))
N_SUBSETS = sum(n for _, n in LEVELS)
#: Terms that a task counts before it hands them on.
COUNT_AT_A_TIME = 500_000


def term_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> tuple[np.ndarray, int]:
    """The sorted hashes of the terms in the band, and the number of documents.  Every text counts."""

    def count(batches):
        seen: dict[bytes, int] = {}
        n = 0

        def out():
            keys = np.fromiter(map(term_hash, seen), np.uint64, len(seen)).view(np.int64)
            got = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(seen.values(), pa.int64())], ["term", "n"])
            seen.clear()
            return got

        for batch in batches:
            for text in common.texts(batch):
                n += 1
                for w in set(words_of(text)):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > COUNT_AT_A_TIME:
                    yield out()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["term", "n"])

    counts = common.written(common.whole_text(docs).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    n = (counts.where("term is null").agg(F.sum("n")).first()[0]) or 0
    band = counts.where(F.col("term").isNotNull() & F.col("n").between(max(2.0, least * n), most * n)).select("term")
    got = np.sort(np.array([r.term for r in band.toLocalIterator()], np.int64).view(np.uint64))
    common.removed(counts)
    return got, n


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class Fingerprints:
    """Fingerprints over one lexicon; remembers which terms are in it."""

    def __init__(self, band: np.ndarray):
        self.band, self.known = band, {}

    def _terms(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        words = list(set(words_of(text)))
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) > 1_000_000:
                known.clear()
                new = words
            h = np.fromiter(map(term_hash, new), np.uint64, len(new))
            at = np.searchsorted(self.band, h)
            inside = self.band[np.minimum(at, len(self.band) - 1)] == h if len(self.band) else np.zeros(len(h), bool)
            known.update(zip(new, [x if ok else 0 for x, ok in zip(h.tolist(), inside.tolist())]))
        found = np.array([k for k in map(known.__getitem__, words) if k], np.uint64)
        return words, np.sort(found)

    def of(self, text: bytes) -> np.ndarray:
        """A 32-bit hash for each subset, 0 where the text has no term in it."""
        words, terms = self._terms(text)
        out = np.zeros(N_SUBSETS, np.uint32)
        at = 0
        for level, (one_of, many) in enumerate(LEVELS):
            subset = _mixed(terms, level + 1) % np.uint64(one_of)
            inside = subset < many
            order = np.argsort(subset[inside], kind="stable")
            s, t = subset[inside][order], terms[inside][order]
            cuts = np.flatnonzero(np.diff(s)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)]):
                if b > a:
                    out[at + int(s[a])] = max(1, xxhash.xxh32_intdigest(t[a:b].tobytes()))
            at += many
        if not out.any():
            whole = b"\x00".join(sorted(words)) if words else text
            out[:] = max(1, xxhash.xxh32_intdigest(whole, 1 if words else 2))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != 0) | (b != 0)
    return float(((a == b) & used).sum() / used.sum())


def text_of(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(doc_id, fingerprint) for every row of docs: one pass over the texts, no shuffle of them."""
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(lexicon(docs, least, most)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(band.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(prints.of(t)) for t in common.texts(batch)], pa.string())], ["doc_id", "fingerprint"])

    return common.whole_text(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited_report(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, in which the next document's beginning replaces the last half."""
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(lexicon(docs, least, most)[0])
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(_, rows: pa.Table, ahead: pa.Table):
        prints = Fingerprints(band.value)
        ids, last = rows.column("doc_id"), ahead.column("text")[0].as_py()
        out = []
        column = rows.column("text")
        text = column[0].as_py()
        fp = prints.of(text.encode())
        for i in range(rows.num_rows):
            following = column[i + 1].as_py() if i + 1 < rows.num_rows else last
            half = len(text) // 2
            edited = (text[: len(text) - half] + following[:half]).encode()
            fp_edited, fp_next = prints.of(edited), prints.of(following.encode())
            out.append((len(text), hashlib.sha256(edited).hexdigest(), text_of(fp), text_of(fp_edited), likeness(fp, fp_edited), likeness(fp, fp_next)))
            text, fp = following, fp_next
            if len(out) == 2000 or i + 1 == rows.num_rows:
                first = i + 1 - len(out)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(out)).combine_chunks(), *(pa.array(c) for c in zip(*out))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                out = []

    rows = common.whole_text(docs, "doc_id")
    return blocks.in_ranges(rows, "doc_id", run, schema, with_next=True)
