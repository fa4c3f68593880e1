"""Regular expressions of the RE2 dialect as Java patterns, so that both engines give the same matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "word": r"\w", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}"}
REFUSED = re.compile(r"\(\?(?:=|!|<=|<!|>)|[*+?}]\+|\\[1-9]|\\C")


def java(pattern: str, fold: bool = False, whole: bool = False) -> str:
    """The pattern for Java; ValueError for constructs that RE2 doesn't have (they would match something else, or blow up)."""
    bare = re.sub(r"\\\\", "", pattern)
    if m := REFUSED.search(bare):
        raise ValueError(f"not in the dialect: {m[0]}")
    p = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", pattern)
    p = re.sub(r"\[:(\w+):\]", lambda m: POSIX[m[1]], p)
    if "(?m" not in p:
        p = re.sub(r"(\\.)|(\[(?:\\.|[^\]\\])*\])|\$", lambda m: m[1] or m[2] or r"\z", p)
    p = f"(?d{'iu' if fold else ''})" + (rf"\A(?:{p})\z" if whole else p)
    return p


def match(x: Column, *patterns: str, fold: bool = False) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(x, F.lit(java(p, fold, whole=True)))
    return out


def search(x: Column, *patterns: str, fold: bool = False) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(x, F.lit(java(p, fold)))
    return out


def count(x: Column, pattern: str, fold: bool = False) -> Column:
    return F.regexp_count(x, F.lit(java(pattern, fold)))


def extract(x: Column, pattern: str, fold: bool = False) -> Column:
    """array of struct(full_match, groups array): an absent group is ''."""
    p = java(pattern, fold)
    n = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups
    parts = [F.regexp_extract_all(x, F.lit(p), F.lit(i)).alias(f"g{i}") for i in range(n + 1)]
    return F.transform(F.arrays_zip(*parts), lambda m: F.struct(m["g0"].alias("full_match"), (F.array(*[F.coalesce(m[f"g{i}"], F.lit("")) for i in range(1, n + 1)]) if n else F.array().cast("array<string>")).alias("groups")))
