"""License scans by diagonal voting, with Spark SQL functions only.

Rolling hashes of ``K`` words of every text are joined to the positions of the same hashes in license templates.  Hits with the
same difference of positions lie on one diagonal: hits are added up by document, template and diagonal, diagonals within
``DRIFT`` words of each other are merged (words put in or left out).  A merged span is verified: the words of its hits must be the
template's own, and enough of the template's positions must be covered, each counted once however often its words repeat.

Apart from these, the base: places where the words of a phrase stand consecutively.  They give the base labels and stay,
whatever the votes say.

The template table is made from the constants below, so its size is fixed and it is broadcast; hashes that are in no template are
left out of the array before it is exploded.  Only votes are shuffled, and they are added up per diagonal before the shuffle.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  Null counts as empty: no words, score 0.
Rows are told apart by doc_id and text, so rows that share a doc_id or have none keep their own votes; rows that repeat both
have the same result each.  Empty input, empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 4
DRIFT = 8
#: Share of a template's hashes that must vote for a span.
VERIFY = 0.6

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed texts: well-known notices, as published with the licenses, in lower case and without punctuation.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "released under the mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _SPLIT), "")


def _hash(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(K)))


def templates(docs: DataFrame) -> DataFrame:
    """(hash, gram, template, label, at, grams): every K-gram of every template."""
    rows = [(n, label, text.split(" ")) for n, (label, text) in enumerate((x, t) for x, ts in TEMPLATES.items() for t in ts)]
    if any(len(w) - K + 1 > 63 for _, _, w in rows):
        raise ValueError("a template has more positions than a mask has bits")
    t = docs.sparkSession.createDataFrame(rows, "template int, label string, w array<string>")
    t = t.withColumn("grams", F.size("w") - K + 1)
    t = t.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)))
    return t.select(_hash(F.col("w"), F.col("at")).alias("hash"), F.slice("w", F.col("at") + 1, K).alias("gram"), "template", "label", "at", "grams")


def matched_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, first, last, share): verified spans of words that follow a template, once for rows that repeat."""
    table = templates(docs)
    known = [r.hash for r in table.select("hash").distinct().collect()]  # fixed in number, as the templates are
    w = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.coalesce("text", F.lit(""))).alias("w"))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - K), lambda i: F.struct(i.alias("place"), _hash(F.col("w"), i).alias("hash")))
    found = F.transform(F.filter(grams, lambda g: g["hash"].isin(known)), lambda g: F.struct(g["place"].alias("place"), g["hash"].alias("hash"), F.slice("w", g["place"] + 1, K).alias("words")))
    hits = w.where(F.size("w") >= K).select("doc_id", "text_hash", F.explode(found).alias("g")).select("doc_id", "text_hash", "g.*").join(F.broadcast(table), "hash")
    hits = hits.where(F.col("words") == F.col("gram"))
    key = ["doc_id", "text_hash", "template", "label", "grams"]
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("mask")
    votes = hits.groupBy(*key, (F.col("place") - F.col("at")).alias("diagonal")).agg(mask, F.min("place").alias("first"), (F.max("place") + K - 1).alias("last"))
    # neighbouring diagonals: one list for each document and template, merged by a fold in the order of the diagonals
    one = F.struct("diagonal", "first", "last", "mask")
    lists = votes.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("d"))
    empty = F.array().cast("array<struct<diagonal:int,first:int,last:int,mask:bigint>>")

    def merge(acc: Column, x: Column) -> Column:
        end = F.get(acc, F.size(acc) - 1)
        near = (F.size(acc) > 0) & (x["diagonal"] - end["diagonal"] <= DRIFT)
        joined = F.struct(x["diagonal"].alias("diagonal"), F.least(end["first"], x["first"]).alias("first"), F.greatest(end["last"], x["last"]).alias("last"), end["mask"].bitwiseOR(x["mask"]).alias("mask"))
        plain = F.struct(x["diagonal"].alias("diagonal"), x["first"].alias("first"), x["last"].alias("last"), x["mask"].alias("mask"))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(plain)))

    merged = lists.select("doc_id", "text_hash", "label", "grams", F.explode(F.aggregate("d", empty, merge)).alias("m"))
    share = F.bit_count("m.mask") / F.col("grams")
    return merged.select("doc_id", "text_hash", "label", F.col("m.first").alias("first"), F.col("m.last").alias("last"), F.round(share, 6).alias("share")).where(F.col("share") >= VERIFY)


def _starts(joined: Column, phrase: str) -> Column:
    """Word numbers at which the phrase stands in words joined by single blanks, one at either end."""
    gaps = F.split(joined, f"(?<= ){phrase}(?= )", -1)
    blanks = lambda g: F.char_length(g) - F.char_length(F.replace(g, F.lit(" "), F.lit("")))
    n = len(phrase.split(" "))
    # a gap holds one blank for each word before the phrase, and from the second on that after the last phrase too
    empty = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("o"))

    def step(a: Column, g: Column) -> Column:
        at = a["p"] + blanks(g) - 1
        return F.struct((at + n).alias("p"), F.concat(a["o"], F.array(at)).alias("o"))

    found = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), empty, step, lambda a: a["o"])
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: words, base places and labels, all labels, score.

    score: 1 with a base place; else the best share of a verified span; else 0.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    base = base.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("j"))
    base = base.withColumns({f"s{i}": _starts(F.col("j"), p) for i, p in enumerate(PHRASES)}).drop("j")
    places = F.concat(*(F.col(f"s{i}") for i in range(len(PHRASES))))
    labels = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"s{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())))))
    base = base.select("doc_id", "text_hash", "n_words", places.alias("p"), labels.alias("l"))
    found = matched_spans(docs).groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count("*").alias("n_spans"))
    none = F.array().cast("array<string>")
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left").select(
        "doc_id", "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p").cast("long").alias("first_word"), F.array_max("p").cast("long").alias("last_word"),
        F.array_join("l", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("l", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("p") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))


def oracle_sql() -> str:
    """DuckDB SQL for report() over ``documents``."""
    rows = ", ".join(f"({n}, '{label}', string_split('{text}', ' '))" for n, (label, text) in enumerate((x, t) for x, ts in TEMPLATES.items() for t in ts))
    phrases = ", ".join(f"({n}, '{x}', string_split('{p}', ' '))" for n, (p, x) in enumerate(PHRASES.items()))
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) AS x(template, label, w)),
p AS (SELECT * FROM (VALUES {phrases}) AS x(n, label, w)),
b AS (SELECT doc_id, label, (k - 1) AS pos FROM (SELECT doc_id, p.label, p.w AS pw, d.w[k : k + len(p.w) - 1] AS dw, k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) AS d, p WHERE d.w[k] = p.w[1]) WHERE dw = pw),
tg AS (SELECT template, label, len(w) - {K - 1} AS grams, (k - 1) AS pos, w[k : k + {K - 1}] AS g FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS k FROM t)),
dg AS (SELECT doc_id, k - 1 AS place, w[k : k + {K - 1}] AS g FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS k FROM d WHERE len(w) >= {K})),
v AS (SELECT DISTINCT doc_id, template, label, grams, (place - pos) AS diagonal, pos FROM dg JOIN tg USING (g)),
r AS (SELECT *, sum(CASE WHEN diagonal - before <= {DRIFT} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos) AS run
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos) AS before FROM v)),
s AS (SELECT doc_id, label, round(count(DISTINCT pos) / grams, 6) AS share FROM r GROUP BY doc_id, template, label, grams, run),
m AS (SELECT doc_id, label, share FROM s WHERE share >= {VERIFY}),
bb AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
mm AS (SELECT doc_id, max(share) AS share, count(*) AS n_spans FROM m GROUP BY doc_id),
ll AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN mm USING (doc_id) LEFT JOIN ll USING (doc_id)"""
