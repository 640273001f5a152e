"""Personal data in texts, with Spark SQL functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for IBANs) and value ranges confirm them, and words
near a span adjust its score.  Everything is one projection: no shuffle, no Python.

Kinds: email, ip, card and phone, each the leftmost non-overlapping matches of its expression, a match that fails its check
being dropped without a retry; the method adds iban.  Positions are code points, the end exclusive.

A null text counts as empty and has no spans.  Repeated rows come out as often as they came in; empty input, empty output.
Work for a text is linear in its length; for the positions it is square in the number of that text's matches (a copy of
one pointer each).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The expressions say the same as the plain ones beside them, but start only where a run starts and never back up, so that
# long runs cost linear time and no stack.  \G: a run may also start where the last match ended.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ ; matches are whole runs, so those of other lengths can be left out at once
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
}
#: A text without a match of this is not searched for the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
#: Score without context in percent, and the words that raise it if they stand within NEAR code points before the span.
BASE_SCORE = {"email": 80, "ip": 50, "card": 70, "phone": 60, "iban": 80}
CONTEXT = {
    "email": r"e-?mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|\btel\b|call|mobile|fax",
    "iban": r"iban|account|bank|konto|compte|cuenta",
}
CONTEXT_SCORE = 20
NEAR = 40
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:4]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        d2 = d * 2
        return acc + F.when(i % 2 == 0, F.when(d2 > 9, d2 - 9).otherwise(d2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def _mod97(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _confirming(kind: str) -> Callable[[Column], Column]:
    return lambda m: _confirmed(kind, m)


def _scoring(kind: str, t: Column) -> Callable[[Column], Column]:
    def scored(x: Column) -> Column:
        before = F.lower(F.substring(t, F.greatest(x["s"] - NEAR, F.lit(0)) + 1, F.least(x["s"], F.lit(NEAR))))
        score = F.lit(BASE_SCORE[kind]) + F.when(before.rlike(CONTEXT[kind]), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"))

    return scored


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        return F.char_length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.char_length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(m)


def _placed(gaps: Column, found: Column) -> Column:
    """Matches with their places: the lengths of what stands between and of the matches, added up."""
    empty = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("o"))

    def step(a: Column, x: Column) -> Column:
        s = a["p"] + F.char_length(x["g"])
        e = s + F.char_length(x["m"])
        return F.when(x["m"].isNull(), a).otherwise(
            F.struct(e.alias("p"), F.concat(a["o"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("o")))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(pairs, empty, step, lambda a: a["o"])


def spans(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """docs with a column ``to``: array of (kind, start, end, score), by kind as listed, then start.  text: never null."""
    out, t = docs, F.col(text)
    for k in KINDS:
        found = F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0))
        out = out.withColumn(f"__m_{k}", F.when(F.contains(t, F.lit(NEEDS[k])), found).otherwise(F.array().cast("array<string>")) if NEEDS[k] else found)
    kinds = []
    for k in KINDS:
        m = F.col(f"__m_{k}")
        placed = F.when(F.exists(m, _confirming(k)), _placed(F.split(t, PATTERNS[k], -1), m)).otherwise(
            F.array().cast("array<struct<s:int,e:int,m:string>>"))
        good = _confirming(k)
        kinds.append(F.transform(F.filter(placed, lambda x: good(x["m"])), _scoring(k, t)))
    return out.withColumn(to, F.concat(*kinds)).drop(*(f"__m_{k}" for k in KINDS))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts, all spans and the digest of the base ones."""
    found = spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "pii")
    of = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"))


def redacted(docs: DataFrame, least_score: int = 50) -> DataFrame:
    """docs with every span that reaches the score replaced by its kind in brackets; columns and other rows as they were.

    Spans that overlap become one, named by the kind of the first.  Null texts stay null.
    """
    # the row goes along as one column, so that no name of it can clash
    found = spans(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("whole")), "whole")
    firm = F.filter("pii", lambda x: x["score"] >= least_score)
    ordered = F.array_sort(F.transform(firm, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    empty = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("o"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("whole"), a["p"] + 1, x["s"] - a["p"])
        return F.when(x["s"] < a["p"], F.struct(F.greatest(a["p"], x["e"]).alias("p"), a["o"].alias("o"))).otherwise(
            F.struct(x["e"].alias("p"), F.concat(a["o"], F.array(F.concat(gap, F.lit("["), F.upper(x["k"]), F.lit("]")))).alias("o")))

    def whole(a: Column) -> Column:
        return F.concat(F.array_join(a["o"], ""), F.substring(F.col("whole"), a["p"] + 1, F.char_length("whole")))

    text = F.when(F.size(firm) > 0, F.aggregate(ordered, empty, step, whole)).otherwise(F.col("row.text"))
    return found.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL for report() over ``documents``."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+", "phone": PATTERNS["phone"], "iban": PATTERNS["iban"]}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum([CASE WHEN i % 2 = 0 THEN (CASE WHEN 2 * CAST(reverse({digits})[i] AS INT) > 9
      THEN 2 * CAST(reverse({digits})[i] AS INT) - 9 ELSE 2 * CAST(reverse({digits})[i] AS INT) END)
      ELSE CAST(reverse({digits})[i] AS INT) END FOR i IN range(1, CAST(length({digits}) AS BIGINT) + 1)]) % 10 = 0"""
    iban = "replace(m, ' ', '')"
    turned = f"(substr({iban}, 5) || substr({iban}, 1, 4))"
    number = f"""list_aggregate([CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END FOR c IN string_split({turned}, '')], 'string_agg', '')"""
    mod97 = f"""list_reduce([CAST(c AS BIGINT) FOR c IN string_split({number}, '')], lambda a, b: (a * 10 + b) % 97) = 1"""
    good = {
        "email": "true",
        "ip": r"regexp_full_match(m, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({iban}) BETWEEN 15 AND 34 AND {mod97}"}
    parts = []
    for n, k in enumerate(KINDS):
        parts.append(f"""
SELECT doc_id, {n} AS k, '{k}' AS kind, s, s + length(m) AS e,
  {BASE_SCORE[k]} + CASE WHEN regexp_matches(lower(substr(t, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR}))), '{CONTEXT[k]}')
    THEN {CONTEXT_SCORE} ELSE 0 END AS score
FROM (SELECT doc_id, t, ms[i] AS m,
    CAST(coalesce(list_sum([length(x) FOR x IN gs[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN ms[1:i-1]]), 0) AS INT) AS s
  FROM (SELECT doc_id, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, t, regexp_extract_all(t, '{plain[k]}') AS ms, string_split_regex(t, '{plain[k]}') AS gs FROM d) WHERE len(ms) > 0))
WHERE {good[k]}""")
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in KINDS)
    item = "kind || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts},
  sha256(coalesce(string_agg({item}, ',' ORDER BY k, s) FILTER (k < 4), '')) AS base_sha256,
  coalesce(string_agg({item}, ',' ORDER BY k, s), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s), '') AS scores
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""
