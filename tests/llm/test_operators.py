"""Every corpus operator against brute force, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import blocks, chat, common, decontaminate, imatch, licenses, pieces, pii, quality, queries, simhash, tokenbin, wrappers

from ..conftest import SF, same

DOC = "doc_id long, text string"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "A b"), (4, "x a B y"), (None, "a b"), (3, "A b"), (5, LONG), (6, "é😀\x00\n"), (7, "\n \t")]


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def clashing(spark):
    cols = "doc_id long, text string, fp long, pii string, w string, component_id long, block long, score double, __text string, hash long"
    return spark.createDataFrame([(1, "mail a@b.co now", 1, "x", "y", 2, 3, 0.5, "t", 4)], cols)


# --- 1 --------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(spark, odd):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted((i is not None, i or 0, f"{plain_fingerprint(t):016x}") for i, t in ODD)


def classes(fps: dict[int, int], bits: int) -> dict[int, int]:
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("bits,seed", [(4, 1), (3, 2), (6, 3)])
def test_simhash_links_are_whole(spark, bits, seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 8))) for f in fps for _ in range(4)]
    # a dense group: everything within a few low bits of one fingerprint
    fps += [fps[0] ^ (rng.getrandbits(12) << 20) for _ in range(150)]
    fps = dict(enumerate(sorted(set(fps))))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    reps = spark.createDataFrame([(signed(f),) for f in fps.values()], "fp long")
    label = {r.node: r.label for r in common.components(simhash.links(reps, bits)).collect()}
    want = classes(fps, bits)
    got = {i: label.get(signed(f), signed(f)) for i, f in fps.items()}
    assert len({(want[i], got[i]) for i in fps}) == len(set(want.values())) == len(set(got.values()))


def test_simhash_hot_buckets_are_split(spark, monkeypatch):
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(10) | (0xABCD << 40) for _ in range(300)})
    reps = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "BLOCK", 40)
    label = {r.node: r.label for r in common.components(simhash.links(reps, 4)).collect()}
    assert len({label.get(f, f) for f in fps}) == len(set(classes(dict(enumerate(fps)), 4).values()))


def test_simhash_documents(docs):
    rows = docs.collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = classes(fps, 4)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want


def plain_similar(rows: list[tuple[int, str]], words: int = 5, similarity: float = 0.8, bits: int = 10) -> dict[int, int]:
    """Classes of texts: equal fingerprints are one, others are joined within the bits and at the similarity of their least documents."""
    least: dict[int, tuple[int, str]] = {}
    fps = {}
    for i, t in sorted(rows):
        fps[i] = simhash.fingerprint((t or "").encode(), words)
        least.setdefault(fps[i], (i, t))
    parent = {f: f for f in least}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {f: simhash.shingles(t, words) for f, (_, t) in least.items()}
    keys = sorted(least)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            if (a ^ b).bit_count() <= bits and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    first: dict[int, int] = {}
    for f in keys:
        first[root(f)] = min(first.get(root(f), 1 << 62), least[f][0])
    return {i: first[root(f)] for i, f in fps.items()}


def test_similar_documents(spark, docs):
    want = plain_similar([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_similar_keeps_apart_what_is_not(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    far = [w if rng.random() > 0.2 else "x" + w for w in base]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (None, "a")], DOC)
    got = {r.doc_id: r.component_id for r in simhash.similar(df.where("doc_id is not null")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert sorted((r.doc_id or -1) for r in simhash.deduplicated(df).collect()) == [-1, 1, 3, 4]


def all_pairs(rows: list[tuple[int, str]], words: int = 5, similarity: float = 0.8, bits: int = 10) -> dict[int, int]:
    """Classes of texts joined by all pairs of documents within the bits and at the similarity."""
    name = {i: i for i, _ in rows}
    known = [(i, simhash.fingerprint(t.encode(), words), simhash.shingles(t, words)) for i, t in sorted(rows)]
    for k, (i, a, x) in enumerate(known):
        for j, b, y in known[:k]:
            if name[i] != name[j] and (a ^ b).bit_count() <= bits and len(x & y) >= similarity * len(x | y):
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = {d: new if n == old else n for d, n in name.items()}
    return name


@pytest.mark.parametrize("most", [500, 40])
def test_similar_joins_edited_copies(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "TEXTS", most, raising=False)
    rng = random.Random(11)
    rows = []
    for g in range(2):
        base = [f"{g}w{rng.randrange(5000)}" for _ in range(300)]
        for i in range(220):
            copy, edits = list(base), 0 if i == 110 else 5 if i % 20 else 12
            for at in rng.sample(range(300), edits):
                copy[at] = f"e{rng.randrange(10**6)}"
            rows.append((g * 1000 + i, " ".join(copy)))
    want = all_pairs(rows)
    assert max(map(list(want.values()).count, set(want.values()))) > 100 and len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, DOC)).collect()} == want


def test_similar_verifies_equal_fingerprints(spark):
    said = "same " * 150
    rows = [(i, said + " ".join(f"{i}w{k}" for k in range(120))) for i in range(1, 4)]
    near = rows[1][1].replace("2w7 ", "")  # alike to text 2 only, which is not the least of its fingerprint
    rows += [(4, near), (5, rows[2][1]), (6, rows[2][1] + " 3w118 3w119")]
    assert len({simhash.fingerprint(t.encode(), 5) for _, t in rows[:3]}) == 1
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 2, 5: 3, 6: 3}
    assert sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, DOC)).collect()) == [1, 2, 3]


def test_sketches_rule_out_nothing_alike():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 700, 9000, 70_000):
        x = rng.integers(0, 2**63, n, np.uint64)
        for changed in (0.0, 0.05, 0.1, 0.2, 0.5, 1.0):
            k = int(n * changed)
            y = np.unique(np.concatenate((x[k:], rng.integers(0, 2**63, int(k * rng.random()), np.uint64))))
            xs = np.unique(x)
            same_share = len(np.intersect1d(xs, y)), len(np.union1d(xs, y))
            if same_share[0] >= 0.8 * same_share[1]:
                assert simhash.may_be_alike(simhash.sketch(xs), simhash.sketch(y), 0.8)
            elif changed == 1.0 and n >= 40:
                assert not simhash.may_be_alike(simhash.sketch(xs), simhash.sketch(y), 0.8)


def test_two_texts_of_one_id(spark):
    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(3, words("a")), (3, words("b")), (3, words("a")), (5, words("b")), (6, words("c")), (6, None), (7, ""), (None, words("a"))]
    df = spark.createDataFrame(rows, DOC)
    got = sorted(((r.doc_id or -1), r.text or "") for r in simhash.deduplicated(df).collect())
    assert got == sorted([(3, words("a")), (3, words("b")), (6, words("c")), (6, ""), (-1, words("a"))])
    named = df.where("doc_id is not null")
    assert sorted((r.doc_id, r.component_id) for r in simhash.similar(named).collect()) == [(3, 3), (3, 3), (3, 3), (5, 3), (6, 6), (6, 6), (7, 6)]


def test_one_set_of_several_fingerprints(spark):
    loop = [f"w{i}" for i in range(40)]
    once, more = " ".join(loop + loop[:4]), " ".join(loop + loop[:20] + loop[20:] + loop[:4])
    assert simhash.shingles(once, 5) == simhash.shingles(more, 5)
    uneven = " ".join(loop + loop[:4] + ["x"] + (loop[:8] + ["x"]) * 6)
    even = " ".join(loop + loop[:4] + ["x"] + loop[:8] + ["x"] + loop[:4])
    assert simhash.fingerprint(uneven.encode(), 5) != simhash.fingerprint(even.encode(), 5)
    rows = [(1, once), (2, more), (3, uneven), (4, even), (4, even)]
    got = sorted((r.doc_id, r.component_id) for r in simhash.similar(spark.createDataFrame(rows, DOC)).collect())
    assert len(got) == 5 and got[:2] == [(1, 1), (2, 1)]


def test_simhash_hot_fingerprints(spark, monkeypatch):
    rows = [(i, "one and the same text of many copies" if i % 3 else f"text {i} is by itself, number {i * 7}") for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    want = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(common, "HOT", 4)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want and len(want) == 60
    assert simhash.similar(df).count() == 60
    kept = sorted(map(tuple, simhash.deduplicated(df).collect()))
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    assert sorted(map(tuple, simhash.deduplicated(df).collect())) == kept and len(kept) == 21


def test_number_of_partitions():
    got = [simhash.partitions_for(10**k, 10) for k in range(3, 12)]
    assert got == sorted(got, reverse=True) and got[0] > 4 and got[-1] < 5
    assert simhash.partitions_for(1000, 4) == 5


def test_simhash_empty_and_clashing(spark, odd, clashing):
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    assert simhash.deduplicated(clashing).collect() == clashing.collect()


# --- 2 --------------------------------------------------------------------------------------------------------------


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(t: str) -> str:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


PII = ["a@b.com_x@y.org", "1.2.3.4.5.6.7.8 300.1.2.3.4 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111", "x 4111111111111111 1 2 3 4", "+1 (555) 123-4567 ext +44 20 7946 0958", "é😀 a@b.co 😀 1.1.1.1", "a@b@c.d a@@b.c .@-.- a@b..c",
       "1--23 4-5 4111111111111111", "GB82 WEST 1234 5698 7654 32 and iban DE89370400440532013000 x", "", "+1 ((( +12345678 9", "5" * 30 + " 0000000000000", None, "1 " * 20_000, "a" * 50_000 + "@b.co", "7.7.7.7 " * 300]


def test_pii_base_and_method(spark):
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(PII)), DOC)).collect()}
    for i, t in enumerate(PII):
        base = plain_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("iban")] == [s for s in base.split(",") if s]
    assert got[8].n_iban == 2 and got[8].scores == "80,100"


def test_pii_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789 .-+()@a") for _ in range(rng.randrange(60))) for _ in range(400)]
    got = {r.doc_id: r.base_sha256 for r in pii.report(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert got == {i: hashlib.sha256(plain_base(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_pii_redaction(spark, clashing, odd):
    r = pii.redacted(clashing).first()
    assert r.text == "mail [EMAIL] now" and r["__text"] == "t" and r.pii == "x"
    assert sorted(map(str, pii.redacted(odd).collect())) == sorted(map(str, odd.collect()))
    assert pii.report(odd.limit(0)).collect() == []


# --- 3 --------------------------------------------------------------------------------------------------------------

PIECES = [*(t for _, t in ODD), "Hello  world", " a", "a ", "a\nb", "\n\n  x\n", "日本 ñ 𐍈", "▁x", "a▁b", "x" * 100 + " y", " " * 40 + "q", "<s> </s> <0x0A>", "".join(map(chr, range(1, 400)))]


def test_pieces_are_the_librarys(spark, docs):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = PIECES + [r.text for r in docs.limit(60).collect()]
    rows = pieces.encoded(spark.createDataFrame(list(enumerate(texts)), DOC), path, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = sp.encode(t)
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest() and r.lossless == (sp.decode(ids) == t)
    assert sum(r.n_library for r in rows[len(PIECES):]) <= 0.05 * sum(r.n_words for r in rows[len(PIECES):])  # the lattice does the work
    assert pieces.encoded(spark.createDataFrame([], DOC), path).collect() == []


def test_pieces_odd(spark, odd, clashing):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encoded(odd, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((i is not None, i or 0) for i, _ in ODD)
    assert len({tuple(r) for r in rows if r.doc_id == 3}) == 1 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert [r.doc_id for r in pieces.encoded(clashing, path).collect()] == [1]


def test_unigram_lattice(spark):
    rng = random.Random(2)
    table = {p: -rng.random() * 9 for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "aab", "cab"]}
    p = spark.createDataFrame([(k, i, v, False) for i, (k, v) in enumerate(table.items())], "piece string, id int, score double, late boolean")
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["axb"]
    got = {r.word: sum(list(table.values())[i] for i in r.ids) for r in pieces.lattice(spark.createDataFrame([(w,) for w in set(words)], "word string"), p, 3, False).where("ids is not null").collect()}

    def best(w):
        return 0.0 if not w else max((table[w[:k]] + best(w[k:]) for k in range(1, 4) if w[:k] in table and len(w) >= k), default=-1e9)

    assert set(got) == set(words) - {"axb"} and all(abs(got[w] - best(w)) < 1e-9 for w in got)


# --- 4 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, docs, tmp_path, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    tok = Tokenizer.from_file(path)
    texts = [*(t for _, t in ODD), "It's", "a<|endoftext|>b <|ENDOFTEXT|>", "İx ΑΣ. ΑΣ,b", "é́x é. é,", "x\x1fy a\u0085b \xa0a,", ".", ",", "..", "don't. can't, X. Y,", "ÀÉß. µ, ª.", "x.́", "ﬁ. ①, ²", *(r.text for r in docs.limit(40).collect())]
    d = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (3, "again"), (3, "again"), (None, "first")], DOC)
    tokenbin.write(d, str(tmp_path / "t"), path)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in tokenbin.read(spark, str(tmp_path / "t"), with_ids=True).collect())
    want, at = [], 0
    for i, t in sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in d.collect()):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes()), tuple(ids.tolist())))
        at += len(ids)
    assert got == sorted(want)
    index = spark.read.parquet(str(tmp_path / "t" / "index")).collect()
    assert sum(r.n_ids for r in index) == at and min(r.start for r in index) == 0


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for most in (1, 200, 70_000, 2**32 - 1):
        ids = rng.integers(0, most, 5000, np.uint32)
        assert (tokenbin.from_planes(len(ids), tokenbin.planes(ids)) == ids).all()


def test_token_files_empty(spark, odd, tmp_path):
    tokenbin.write(odd.limit(0), str(tmp_path / "e"), queries.tokenizer_path("word_bpe_49k.json"))
    assert tokenbin.read(spark, str(tmp_path / "e")).collect() == []


def test_token_files_in_ranges_by_bytes(spark, clashing, monkeypatch, tmp_path):
    path = queries.tokenizer_path("word_bpe_49k.json")
    d = spark.createDataFrame([(i * 3 % 50, f"text {i} of some") for i in range(50)], DOC)
    tokenbin.write(d, str(tmp_path / "a"), path)
    want = sorted(map(tuple, tokenbin.read(spark, str(tmp_path / "a")).collect()))
    monkeypatch.setattr(blocks, "RANGE_BYTES", 40)
    tokenbin.write(d, str(tmp_path / "b"), path)
    assert sorted(map(tuple, tokenbin.read(spark, str(tmp_path / "b")).collect())) == want and len(want) == 50
    tokenbin.write(clashing, str(tmp_path / "c"), path)
    assert [r.doc_id for r in tokenbin.read(spark, str(tmp_path / "c")).collect()] == [1]
    assert imatch.edited_report(d).count() == 50 and imatch.edited_report(clashing).count() == 1


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_wrappers_on_pages(spark):
    pages = queries.table(spark, SF, "pages")

    def plain(page):
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
        blocks = re.split(r"<[^>]+>", re.sub(r"</?b>", "", re.sub(r"<[^>]*\Z", "", m[1]))) if m else []
        return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)

    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = wrappers.extracted(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


HTML = [
    ('<header><h1>Site</h1></header><nav>m</nav><div class="cookie-notice">we</div><main><article><header><h1>T&amp;x</h1></header><p>a<b>b</b> c\n d</p><aside>s</aside><ul><li>x<li>y</ul><form>f</form></article></main><section class="comments"><p>1st</p></section><footer>f</footer>', "T&x ab c d x y"),
    ('<div id="content"><p>one</p><p>two <i>th</i>ree<p>four<div class="share-buttons">tw</div></div><div class="comment-list">c</div>', "one two three four"), ("<p>bare <a href=x>link</a> text", "bare text"), (None, ""), ("", ""),
    ("<p>a < b &lt; c &nbsp; d &#233; &bogus; &amp", "a < b < c d é &bogus; &"), ("<article><p>t<script>if (a</script>u<!-- x --><style>p{}</style>v<p", "tuv"), ("plain &copy", "plain ©"), ("<article>" + "<p>x " * 3000, " ".join(["x"] * 3000)),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_wrappers_odd_pages(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    rows = [(i, f"http://h{i}/x", p) for i, (p, _) in enumerate(HTML)] + [(99, None, "<p>no url"), (98, "http://[bad", "<p>x")]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(HTML)} | {99: "no url", 98: "x"}
    assert wrappers.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_wrappers_odd_hosts(spark, monkeypatch):
    urls = ["http://[::1]:80/a", "http://u@h.example:port/b", "http://[bad/c", " https://H.example/d", "//h2.example\n/e", "h3.example/f", None, "http://h4.example:8/g"]
    rows = [(i, u, f"<html><body><nav>menu</nav><article><p>text {i}</p></article></body></html>") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, wrappers.extracted(pages).collect()))
    assert all(f"text {i}" in text for i, _, text, _ in want)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    for hot in (500, 5):  # every host is hot, or none
        monkeypatch.setattr(wrappers, "HOT", hot)
        assert sorted(map(tuple, wrappers.extracted(pages).collect())) == want


def test_wrapper_tells_what_a_host_repeats(spark):
    page = lambda i: f"<body><p>Menu of the site</p><div><p>{' '.join(f'w{i}x{j}' for j in range(9))}</p>" + "<p>more</p>" * i + "</div></body>"
    rows = [(i, f"http://same/{i}", page(i)) for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Menu" not in t and f"w{i}x0" in t for i, t in got.items())


def test_wrapper_tells_by_alignment_where_names_say_nothing(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    inside = lambda i: f'<body><div class="q1">top</div><article><h1>Title {i}</h1><div class="q7"><span>House style of this site</span></div><p>{words(i, 9)}</p><div class="q8">one {i}</div></article></body>'
    bare = lambda i: f'<body><div class="q1"><a href="/">home</a></div><div class="q2"><p>{words(i, 9)}</p><p>more {i}</p></div><div class="q3">Made with care</div></body>'
    rows = [(i, f"http://inside/{i}", inside(i)) for i in range(4)] + [(10 + i, f"http://bare/{i}", bare(i)) for i in range(4)]
    rows += [(20, "http://one/1", inside(1)), (21, "http://two/1", inside(1)), (22, "http://two/2", inside(1)), (23, "http://two/3", inside(1))]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"Title {i} {words(i, 9)} one {i}" and got[10 + i] == f"{words(i, 9)} more {i}"
    # a page alone, or pages that are all the same, can't tell: nothing is dropped
    assert {got[k] for k in (20, 21, 22, 23)} == {f"Title 1 House style of this site {words(1, 9)} one 1"}


def test_wrappers_repeats_and_other_columns(spark):
    rows = [(1, "http://h/1", "<article><p>a</article>", "s", 1, "w"), (1, "http://h/1", "<article><p>a</article>", "s", 1, "w"), (None, "http://h/1", "<p>" + "b " * 60_000, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text long, slots string")
    got = [tuple(r) for r in wrappers.extracted(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "http://h/1", "a", 1)] * 2 + [(None, "http://h/1", ("b " * 60_000).strip(), 119_999)], key=repr)


# --- 6 --------------------------------------------------------------------------------------------------------------

TURNS = [(1, 0, "us:er\\", "a\\"), (1, 1, "assistant", None), (1, 2, None, " </turn>\n### x: "), (1, 2, "assistant", "é😀### ####"), (2, 0, "assistant", ""), (None, 0, "assistant", "n"), (None, None, "user", "\n"), (3, 1, "assistant", "\\\\###\\"), (3, 1, "assistant", "\\\\###\\"),
         *((9, i, "assistant" if i % 2 else "user", f"t{i} ") for i in range(3000)), (10, 0, "user", LONG)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    want = {}
    for c, _, role, text in sorted(TURNS, key=lambda r: tuple((x is not None, x or (0 if i < 2 else "")) for i, x in enumerate(r))):
        w = want.setdefault(c, ["", "", 0])
        w[0] += f"{role or ''}\n{text or ''}\n"
        w[1] += (text or "") if role == "assistant" else ""
        w[2] += 1
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.formatted(df)).collect()}
    assert got == {c: (n, digest(t), len(x), digest(x)) for c, (t, x, n) in want.items()}
    assert chat.digests(chat.formatted(df.limit(0))).collect() == []


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    d, y = queries.table(spark, SF.replace("0.001", "0.01"), "documents"), queries.table(spark, SF.replace("0.001", "0.01"), "labels")
    rows = quality.report(d, y, per_class=200).join(y, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_odd(spark, odd, docs):
    y = queries.table(spark, SF, "labels")
    assert quality.report(odd, y).count() == len(ODD) and quality.report(odd.limit(0), y).collect() == []
    assert {r.score for r in quality.report(odd, y.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, y.limit(0)).count() == len(ODD)


def plain_score(m: quality.Model, text: str) -> float:
    """The score by the text's averages, one bucket at a time."""
    ids, shares = quality.averaged((text or "").encode())
    return 1 / (1 + np.exp(-(m.bias + sum(float(m.weight[i]) * float(s) for i, s in zip(ids, shares)))))


def test_quality_scores_are_the_models(spark, docs, odd):
    y = queries.table(spark, SF, "labels")
    m = quality.fit(docs, y)
    for df in (docs, odd):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.scored(df.dropDuplicates(["doc_id"]), m).collect():
            assert abs(r.score - plain_score(m, texts[r.doc_id])) < 1e-5


def test_quality_learns_an_id_once(spark, docs, clashing):
    y = queries.table(spark, SF, "labels")
    d, y = docs.select("doc_id", "text"), y.select("doc_id", "quality")
    m = quality.fit(d, y)
    again = quality.fit(d.unionByName(d).unionByName(d.limit(20)), y.unionByName(y))
    assert (m.weight == again.weight).all() and m.bias == again.bias
    assert quality.report(clashing, y).columns == ["doc_id", "held_out", "score", "predicted"] and quality.accepted(clashing, y.limit(0)).collect() == clashing.collect()


# --- 8, 9: SQL ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])


def test_decontamination_odd(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, "a b"), (2, None), (None, "x"), (3, "!!"), (4, "A  b"), (5, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(odd, bench).collect())
    # the long text runs through its 997 words 30 times and 90 words further: 31 passages of the eleven words
    assert got == sorted([(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 2, 2, 2, True), (3, 2, 2, 2, True), (4, 4, 3, 2, True), (-1, 2, 2, 2, True), (5, 30_000, 31 * 11, 1, True), (6, 1, 0, 0, False), (7, 0, 0, 0, False)])
    assert sorted(r.doc_id for r in decontaminate.decontaminated(odd, bench).collect()) == [1, 2, 6, 7]
    assert not any(r.contaminated for r in decontaminate.report(odd, bench.limit(0)).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4)
    assert {r.doc_id: r.n_hit for r in decontaminate.report(odd.dropDuplicates(), bench).collect()}[4] == 3


def test_decontamination_is_the_same_by_blocks(spark, odd, monkeypatch):
    more = odd.unionByName(spark.createDataFrame([(None, "q r s"), (None, None), (3, "x a b y r")], DOC))
    bench = spark.createDataFrame([(1, "a b"), (2, "x a"), (3, "r"), (None, "s"), (4, "word5 word6 word7")], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.report(more, bench).collect()), key=repr)
    assert len(want) == more.count()
    for size in (1, 6):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(map(tuple, decontaminate.report(more, bench).collect()), key=repr) == want


def test_decontamination_longest_matches(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    docs = [(i, word(rng.randrange(30))) for i in range(25)] + [(None, word(20)), (3, "a b"), (90, None)]
    bench = [(i, word(rng.randrange(1, 14))) for i in range(6)] + [(6, "zz a"), (7, None), (None, "a b c")]
    want = {}
    for i, t in bench:
        if i is None or not t:
            continue
        w = t.split()
        for j in range(len(w)):
            best = None
            for d, text in docs:
                v = (text or "").split()
                for p in range(len(v)):
                    n = next((x for x in range(min(len(v) - p, len(w) - j)) if v[p + x] != w[j + x]), min(len(v) - p, len(w) - j))
                    new = (-n, d is None, d or 0, p)
                    if n and (best is None or new < best):
                        best = new
            if best:
                want[i, j] = (-best[0], None if best[1] else best[2], best[3])
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert {(r.item_id, r["at"]): (r.words, r.doc_id, r["first"]) for r in decontaminate.longest_matches(d, b, window=4).collect()} == want


def test_licenses_odd(spark, odd):
    texts = ["mit license mit license MIT-License", "İmit license", "the general public license general public license x", "mit", None, "K mit licenseé mit license", "released under under the mit license", "this work is licensed in the gnu general public license version 3"]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].last_word) for i in range(8)] == [(3, 0, 4), (0, None, None), (2, 1, 4), (0, None, None), (0, None, None), (1, 3, 3), (1, 4, 4), (1, 7, 7)]
    notice = "x y " + licenses.TEMPLATES["bsd"][0].replace("source and", "source or else and") + " z"
    r = licenses.report(spark.createDataFrame([(1, notice)], DOC)).first()
    assert r.base_labels == "" and r.labels == "bsd" and 0.6 <= r.score < 1
    assert licenses.report(odd).count() == len(ODD) and licenses.report(odd.limit(0)).collect() == []


def test_licenses_count_positions_once(spark):
    half = " ".join(licenses.TEMPLATES["bsd"][0].split(" ")[:9])
    whole = licenses.TEMPLATES["bsd"][1]
    rows = [(1, half), (1, half), (2, "a copy of the license " * 20), (None, whole), (None, whole), (None, half), (3, whole), (3, "x"), (4, None), (5, ""), (6, "x " * 40_000 + whole)]
    got = sorted(((r.doc_id or -1, r.n_words, r.labels, r.score) for r in licenses.report(spark.createDataFrame(rows, DOC)).collect()))
    n = len(whole.split(" "))
    want = [(1, 9, "", 0.0)] * 2 + [(2, 100, "", 0.0)] + [(-1, n, "bsd", 1.0)] * 2 + [(-1, 9, "", 0.0), (3, n, "bsd", 1.0), (3, 1, "", 0.0), (4, 0, "", 0.0), (5, 0, "", 0.0), (6, 40_000 + n, "bsd", 1.0)]
    assert got == sorted(want)


def test_licenses_clashing_columns(spark, clashing):
    more = clashing.withColumns({"label": F.lit("x"), "template": F.lit(1), "mask": F.lit(2), "text_hash": F.lit("y"), "found_id": F.lit(3)})
    assert licenses.report(more).collect() == licenses.report(clashing.select("doc_id", "text")).collect()


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_imatch_edits(spark, docs, odd):
    for df in (docs, odd):
        rows = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect())
        want = []
        for k, (i, t) in enumerate(rows):
            h = len(t) // 2
            want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h]).encode()).hexdigest()))
        got = imatch.edited_report(df).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs).collect()}
    by = {}
    for i, t in texts.items():
        by.setdefault(t, set()).add(prints[i])
    assert all(len(x) == 1 for x in by.values())
    got = imatch.edited_report(docs).collect()
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)
    assert imatch.edited_report(odd.limit(0)).collect() == []


def test_imatch_fingerprints_by_hand(spark, docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    terms = {i: {x for x in re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t))} for i, t in rows}
    count: dict[bytes, int] = {}
    for ts in terms.values():
        for t in ts:
            count[t] = count.get(t, 0) + 1
    n = len(rows)
    band = {t: xxhash.xxh64_intdigest(t) for t, c in count.items() if max(2, imatch.LEAST * n) <= c <= imatch.MOST * n}
    least, size = imatch.lexicon(docs)
    assert size == n and sorted(band.values()) == least.tolist()

    def mixed(h, salt):
        m = 2**64 - 1
        x = (h ^ salt * 0x9E3779B97F4A7C15 & m) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 29) * 0x94D049BB133111EB & m
        return x ^ x >> 32

    def by_hand(text, own):
        out = []
        for level, (one_of, many) in enumerate(imatch.LEVELS):
            for k in range(many):
                held = sorted(band[t] for t in own if t in band and mixed(band[t], level + 1) % one_of == k)
                out.append(max(1, xxhash.xxh32_intdigest(np.array(held, np.uint64).tobytes())) if held else 0)
        if not any(out):
            out = [max(1, xxhash.xxh32_intdigest(b"\0".join(sorted(own)) if own else text, 1 if own else 2))] * len(out)
        return out

    want = {i: by_hand(t, terms[i]) for i, t in rows}
    got = {r.doc_id: r for r in imatch.edited_report(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: "".join(f"{x:08x}" for x in f) for i, f in want.items()}
    ids = sorted(want)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        used = [(a, b) for a, b in zip(want[i], want[j]) if a or b]
        assert abs(got[i].near_next - sum(a == b for a, b in used) / len(used)) < 1e-12
