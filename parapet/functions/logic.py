"""Answers of rules: a value that may be null, and the names of evidence that could not be had.

An `Answer` is a pair of Columns, so a rule is an ordinary projection that Catalyst optimises. "Could not check" is never taken
for "false": `and`/`or`/`of` keep the names of missing evidence unless a part that comes before already decides the outcome.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = None  # statically no missing evidence; costs nothing in the plan


def _names(m: Column | None) -> Column:
    return F.array().cast("array<string>") if m is None else m


def _union(*parts: Column | None) -> Column | None:
    real = [p for p in parts if p is not None]
    return reduce(F.array_union, real) if real else NOTHING


def _unless(decided: Column, m: Column | None) -> Column | None:
    return NOTHING if m is None else F.when(F.coalesce(decided, F.lit(False)), _names(None)).otherwise(m)


@dataclass(frozen=True)
class Answer:
    value: Column
    missing: Column | None = NOTHING

    def __and__(self, other: Answer) -> Answer:
        other = answer(other)
        return Answer(self.value & other.value, _union(self.missing, _unless(~self.value, other.missing)))

    def __or__(self, other: Answer) -> Answer:
        other = answer(other)
        return Answer(self.value | other.value, _union(self.missing, _unless(self.value, other.missing)))

    def __invert__(self) -> Answer:
        return Answer(~self.value, self.missing)

    @property
    def names(self) -> Column:
        return F.array_sort(_names(self.missing))

    @property
    def verdict(self) -> Column:
        """match if true, whatever is missing; else indeterminate if something is missing; else no-match."""
        gap = F.lit(False) if self.missing is None else F.size(self.missing) > 0
        return F.when(F.coalesce(self.value, F.lit(False)), "match").when(gap, "indeterminate").otherwise("no-match")


def answer(x: Answer | Column) -> Answer:
    return x if isinstance(x, Answer) else Answer(x)


def unavailable(capability: str, kind: str = "boolean") -> Answer:
    """An answer that nothing here can give."""
    return Answer(F.lit(None).cast(kind), F.array(F.lit(capability)))


def replayed(evidence: Column, key: str, capability: str, kind: str) -> Answer:
    """A frozen answer from a map of key -> struct(value string, unavailable boolean); a miss is unavailable, never a fact."""
    found = F.try_element_at(evidence, F.lit(key))
    gone = found.isNull() | F.coalesce(found["unavailable"], F.lit(False))
    value = F.when(~gone, found["value"]).try_cast(kind)
    return Answer(value, F.when(gone, F.array(F.lit(capability))).otherwise(_names(None)))


def part(enrichment: Column, field: str, capability: str) -> Answer:
    """A field of an answer that came in parts: missing evidence, under that field's name, only if it is listed in `unavailable` and read."""
    gone = F.coalesce(F.array_contains(enrichment["unavailable"], field), F.lit(False))
    return Answer(enrichment[field], F.when(gone, F.array(F.lit(f"{capability}.{field}"))).otherwise(_names(None)))


def at_least(n: int, *parts: Answer | Column) -> Answer:
    """n of the parts: true once n are true, else null if any is null, else false."""
    parts = [answer(p) for p in parts]
    true = lambda ps: reduce(lambda a, b: a + b, [F.coalesce(p.value, F.lit(False)).cast("int") for p in ps], F.lit(0))
    nulls = reduce(lambda a, b: a | b, [p.value.isNull() for p in parts], F.lit(False))
    value = F.when(true(parts) >= n, F.lit(True)).when(nulls, F.lit(None).cast("boolean")).otherwise(False)
    return Answer(value, _union(*[_unless(true(parts[:i]) >= n, p.missing) for i, p in enumerate(parts)]))


def any_of(*parts: Answer | Column) -> Answer:
    return at_least(1, *parts)


def all_of(*parts: Answer | Column) -> Answer:
    return at_least(len(parts), *parts)


def none_of(*parts: Answer | Column) -> Answer:
    return ~any_of(*parts)


def between(low: Column, x: Column, high: Column, low_in: bool = False, high_in: bool = True) -> Column:
    """low < x <= high, the lower side first: null if that is null."""
    a, b = (low <= x if low_in else low < x), (x <= high if high_in else x < high)
    return F.when(a.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def one_of(x: Column, *values) -> Column:
    return x.isin(*values)


def in_array(x: Column, array: Column) -> Column:
    """Null x or array -> null; a true comparison wins; else a null element -> null."""
    return F.when(x.isNotNull(), F.exists(array, lambda e: e == x))


def in_list(x: Column, values: list[str] | None, name: str) -> Answer:
    """Membership in a named list, without case; an unknown list is missing evidence, a null x is in no list. For short lists; see
    operators.lists.flag_members for long ones."""
    if values is None:
        return unavailable(f"${name}")
    return Answer(F.coalesce(F.lower(x).isin(*sorted({v.lower() for v in values})), F.lit(False)) if values else F.lit(False))


#: Letters that Unicode's simple case folding joins with another small letter.
FOLDED = {"ſ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "ẛ": "ṡ", "\u1fbe": "ι", "\u0345": "ι", "µ": "μ"}


def folded(x: Column) -> Column:
    return F.translate(F.lower(x), "".join(FOLDED), "".join(FOLDED.values()))


def same_text(a: Column, b: Column) -> Column:
    """Equality by simple case folding."""
    return folded(a) == folded(b)


def int_div(a: Column, b: Column) -> Column:
    """Truncating division; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def int_mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def ratio_of(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))
