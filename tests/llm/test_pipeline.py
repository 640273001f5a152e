"""The pipeline's stages, one after the other, against what each must keep."""

from __future__ import annotations

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import common, decontaminate, pii, quality, queries

from ..conftest import SF
from .test_operators import DOC, ODD, plain_base, plain_score, plain_similar


def test_stages(spark):
    assert len(corpus_pipeline.STAGES) == 5
    docs = queries.table(spark, SF, "documents")
    columns, seen = docs.columns, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    assert not [i for i in ids["start"] if labels.get(i) == 1 and i not in set(ids["quality"])]
    kept = [(r.doc_id, r.text) for r in seen["quality"].collect()]
    assert ids["near_duplicates"] == sorted(set(plain_similar(kept).values()))
    assert set(ids["decontamination"]) < set(ids["near_duplicates"]) and ids["pii"] == ids["decontamination"] == ids["pieces"]
    assert not seen["pii"].where("text rlike '[A-Za-z0-9]@mail[0-9]'").count()
    assert seen["pii"].where("text is not null and n_chars <> char_length(text)").isEmpty()
    assert seen["pieces"].where("not lossless").isEmpty()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == ids["pieces"]


def test_empty_documents(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "empty")
    assert docs.isEmpty()


def test_odd_rows_and_columns_go_through_all_stages(spark):
    docs = queries.table(spark, SF, "documents")
    odd = spark.createDataFrame([r for r in ODD if r[0] != 5], DOC).withColumn("doc_id", F.col("doc_id") + 10**6)
    extra = {c: F.lit(c) for c in ("fp", "node", "own_0", "score", "spans", "block", "part", "word", "hash", "first", "label", "k")}
    more = docs.unionByName(odd, allowMissingColumns=True).withColumns(extra)
    columns = more.columns
    now = more
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns and now.where(" or ".join(f"{c} <> '{c}' or {c} is null" for c in extra)).isEmpty()
    # what the pipeline keeps of the others is what it keeps without the odd ones
    plain = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    ids = [r.doc_id for r in now.collect()]
    assert {i for i in ids if i is not None and i < 10**6} == plain and len([i for i in ids if i is None]) <= 1


def test_pipeline_against_brute_force(spark):
    """Every stage done by hand over the rows; the quality scores are the model's, one bucket at a time."""
    rows = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    model = quality.fit(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    scores = {i: plain_score(model, t) for i, t in rows.items()}
    assert not [s for s in scores.values() if abs(s - quality.THRESHOLD) < 1e-6]
    rows = {i: t for i, t in rows.items() if scores[i] >= quality.THRESHOLD}
    first = plain_similar(list(rows.items()))
    rows = {i: t for i, t in rows.items() if first[i] == i}
    words = lambda t: decontaminate.words_of((t or "").encode())
    windows = set()
    for r in queries.table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    rows = {i: t for i, t in rows.items() if not any(tuple(w[j : j + n]) in windows for w in [words(t)] for n in sizes for j in range(len(w) - n + 1))}
    redacted = {r.doc_id: r.text for r in pii.redacted(queries.table(spark, SF, "documents")).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = {i: sp.encode(redacted[i] or "") for i in rows}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.ids for i, r in got.items()} == want and all(r.lossless for r in got.values())
    # personal data is gone: what the base finds in the texts before and not after
    kept = [i for i in rows if plain_base(rows[i] or "")]
    assert kept and not any(plain_base(redacted[i]) for i in kept)
