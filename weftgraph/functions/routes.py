"""Route shapes: segments and their classes, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the frameworks write a segment that takes the rest of a path, and one parameter.
CATCH_ALL = r"^(?:\*\*?|\{\*.*\}|\{.*\.\.\.\}|\{[^}]*:(?:path|\.\*|\.\+)\}|\[\.\.\..*\]|\[\[\.\.\..*\]\]|<path:.*>|:.*[*+]|\*.+)$"
PARAM = r"^(?:\{[^{}]*\}|\[[^\]]*\]|<[^<>]*>|:.+)$"
MIXED = r"\$?\{[^{}]*\}"


def segments(path: Column) -> Column:
    """The segments before a query string or fragment; a segment that takes the rest is the last one."""
    all_ = F.filter(F.split(F.regexp_extract(path, r"^[^?#]*", 0), "/"), lambda s: s != "")
    cut = F.array_position(F.transform(all_, lambda s: s.rlike(CATCH_ALL)), F.lit(True)).cast("int")
    return F.when(cut > 0, F.slice(all_, 1, F.greatest(cut, F.lit(1)))).otherwise(all_)


def classes(segs: Column) -> Column:
    """One digit for each segment: 0 static, 1 mixed, 2 parameter, 3 the rest."""
    return F.array_join(F.transform(segs, lambda s: F.when(s.rlike(CATCH_ALL), "3").when(s.rlike(PARAM) | (F.regexp_replace(s, MIXED, "") == ""), "2").when(s.rlike(MIXED), "1").otherwise("0")), "")


def canonical_segment(s: Column) -> Column:
    return F.when(s.rlike(CATCH_ALL), "{*}").when(s.rlike(PARAM), "{}").when(s.rlike(MIXED), F.when(F.regexp_replace(s, MIXED, "") == "", "{}").otherwise(F.regexp_replace(s, MIXED, "{}"))).otherwise(s)


def canonical(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(path), canonical_segment), "/"))


def normalized_path(path: Column) -> Column:
    """One leading slash, no doubled and no trailing ones."""
    p = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def mixed_pattern(canonical_seg: Column) -> Column:
    """An anchored expression for a mixed segment: literals as they are, each parameter at least one character."""
    parts = F.transform(F.split(canonical_seg, r"\{\}", -1), lambda x: F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    return F.concat(F.lit("^"), F.array_join(parts, ".+?"), F.lit("$"))


def normalized_authority(authority: Column) -> Column:
    """Host and port in lower case, user part and default ports left out."""
    a = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[/?#].*$", ""))
    return F.regexp_replace(F.regexp_replace(a, r"^[^@]*@", ""), r":(?:80|443)$", "")


def is_loopback(authority: Column) -> Column:
    return F.regexp_replace(normalized_authority(authority), r":[0-9]+$", "").rlike(r"^(?:localhost|127(?:\.[0-9]{1,3}){3}|0\.0\.0\.0|\[?::1\]?)$")
