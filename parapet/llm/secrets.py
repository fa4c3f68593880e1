"""Secret scans by a trigram inverted index. The main path is DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived on the driver: every clause must hold, a clause
holds if all trigrams of one of its alternatives stand in the (lower-cased) text. The index is a bitmap index of the trigrams that the
rules' queries name: each document holds its bit of every posting list, beside its text, so that nothing has to be joined back to the
texts and no text is shuffled. Posting lists are intersected and united bit by bit as each rule's query says; only the candidates of
a rule are verified with its regular expression. A rule without mandatory trigrams (a run of hex digits) scans every text in full.

Spans are counted in code points, end exclusive, leftmost and non-overlapping within a kind. Null texts are empty and have no
spans. Repeated rows are answered each; doc_id may be null or repeated. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re._constants as K
import re._parser as regex_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import free_name, let


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # read alike by Java and Python
    group: int = 0
    least: int = 0  # code points of that group


#: The three base rules, in the order in which kinds are listed, then the rules that this operator adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses of alternatives of trigrams; [] if a match needs no trigram. Strings are lower-cased."""
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> set[str]:
        alternatives = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        if all(alternatives):
            clauses.append(sorted(set(alternatives), key=sorted))
        return {""}

    def characters(items) -> set[str] | None:
        out = set()
        for what, value in items:
            if what is K.LITERAL:
                out.add(chr(value).lower())
            elif what is K.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None

    def exact(nodes) -> set[str] | None:
        """All strings that the nodes match, if they are few."""
        out = {""}
        for what, value in nodes:
            if what is K.LITERAL:
                more = {chr(value).lower()}
            elif what is K.IN:
                more = characters(value)
            elif what is K.SUBPATTERN:
                more = exact(value[3])
            elif what is K.BRANCH:
                parts = [exact(x) for x in value[1]]
                more = None if None in parts else set().union(*parts)
            elif what is K.MAX_REPEAT and value[1] != K.MAXREPEAT and value[1] <= 3:
                one = exact(value[2])
                more = None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
            else:
                more = None
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(nodes) -> None:
        strings = {""}
        for node in nodes:
            more = exact([node])
            if more is not None and len(strings) * len(more) <= MOST_STRINGS:
                strings = {a + b for a in strings for b in more}
                continue
            strings = flush(strings)
            if more is not None:
                strings = more
            elif node[0] is K.SUBPATTERN:
                walk(node[1][3])
            elif node[0] is K.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
        flush(strings)

    walk(regex_parser.parse(pattern))
    return clauses


def _queries(rules: tuple[Rule, ...]) -> tuple[list[str], dict[str, list[list[int]]]]:
    """The trigrams that the rules name, and each rule's query with a bit mask for each alternative."""
    needs = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in needs.values() for clause in q for alternative in clause for t in alternative})
    bit = {t: i for i, t in enumerate(trigrams)}
    return trigrams, {kind: [[sum(1 << bit[t] for t in alternative) for alternative in clause] for clause in q] for kind, q in needs.items()}


def postings(text: Column, trigrams: list[str]) -> Column:
    """The document's column of the inverted index: a bit for each named trigram whose posting list it is in, 63 bits to a long."""
    low = lambda x: [F.when(F.contains(x, F.lit(t)), F.lit(1 << (i % 63))).otherwise(F.lit(0)) for i, t in enumerate(trigrams)]

    def words(x: Column) -> Column:
        bits = low(x)
        return F.array(*[reduce(lambda a, b: a + b, bits[i : i + 63]).cast("long") for i in range(0, len(bits), 63)])

    return let(F.lower(text), words)  # lower-cased once


def _is_candidate(index: Column, query: list[list[int]]) -> Column:
    """Posting lists intersected within an alternative, united over alternatives, intersected over clauses."""

    def held(mask: int) -> Column:
        parts = [(i, mask >> (63 * i) & (1 << 63) - 1) for i in range(-(-mask.bit_length() // 63))]
        return reduce(lambda a, b: a & b, [F.get(index, F.lit(i)).bitwiseAND(F.lit(part)) == F.lit(part) for i, part in parts if part])

    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [held(m) for m in clause]) for clause in query])


def _spans(number: int, rule: Rule, text: Column) -> Column:
    """Array of (start, number, end, kind): the texts between matches and the matches give the positions."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    steps = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))
    span = lambda a, b: F.struct(a.cast("long").alias("start"), F.lit(number).alias("number"), b.cast("long").alias("end"), F.lit(rule.kind).alias("kind"))
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["out"], F.array(span(start, end)))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)["out"]


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, name: str = "spans") -> DataFrame:
    """docs, its text without nulls, with the column `name`: array of (start, number, end, kind), by start, then kind as listed."""
    trigrams, queries = _queries(rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string>>")

    def verified(index: Column) -> Column:
        parts = [F.when(_is_candidate(index, queries[r.kind]) if r.kind in queries else F.rlike(text, F.lit(r.pattern)), _spans(i, r, text)).otherwise(none) for i, r in enumerate(rules)]
        return F.sort_array(F.concat(*parts))

    # exploded, so that the plan can't write the spans out again wherever they are used
    return docs.withColumn("text", text).select("*", F.explode(F.array(let(postings(text, trigrams), verified))).alias(name))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["number"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["number"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with each stretch covered by spans replaced by [kind of its first span]; n_chars, if there, follows."""
    name = free_name(docs, "spans")
    found = with_spans(docs, name=name)

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(name, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    out = found.withColumn("text", F.when(F.size(name) > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
