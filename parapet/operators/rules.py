"""Rule sets: every rule in one projection, then one verdict for each message."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.logic import Answer, answer

SEVERITIES = ("critical", "high", "medium", "low", "informational")
TYPES = ("rule", "query", "dlp", "exclusion", "triage_rule")


@dataclass(frozen=True)
class Rule:
    """`test` gives an Answer or a boolean Column for a table's columns."""

    name: str
    test: Callable[[DataFrame], Answer | Column]
    severity: str = "medium"
    type: str = "rule"
    needs: tuple[str, ...] = field(default=())  # capabilities

    def __post_init__(self):
        if self.severity not in SEVERITIES or self.type not in TYPES:
            raise ValueError(f"{self.name}: unknown severity or type")


def load(table: DataFrame, rules: list[Rule]) -> tuple[list[tuple[Rule, Answer]], dict[str, str]]:
    """Rules that compile against the table, by severity; broken ones are reported and the others still load."""
    good, broken = [], {}
    for r in sorted(rules, key=lambda r: (SEVERITIES.index(r.severity), r.name)):
        if r.type == "triage_rule":
            continue
        try:
            a = answer(r.test(table))
            kind = table.select(a.value.alias("v")).schema["v"].dataType.simpleString()
            if kind != "boolean" and r.type != "query":
                raise TypeError(f"gives {kind}, not boolean")
            good.append((r, a))
        except Exception as e:  # a broken rule is a finding, not a failure of the set
            broken[r.name] = str(e).splitlines()[0]
    return good, broken


def evaluate(table: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """keep + verdict, matched, excluded_by, indeterminate, missing (arrays, rules by severity).

    An exclusion that matches suppresses the verdict but not the list of matches. Rules that don't compile are left out, with a warning
    that names them (`load` gives the reasons); they don't change what the others find.
    """
    good, broken = load(table, rules)
    if broken:
        warnings.warn(f"rules left out: {broken}", stacklevel=2)
    boolean = [(r, a) for r, a in good if r.type != "query"]
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.type).alias("type"), a.verdict.alias("verdict"), a.names.alias("missing")) for r, a in boolean]
    judged = table.select(*keep, F.array(*rows).cast("array<struct<name:string,type:string,verdict:string,missing:array<string>>>").alias("_r"))
    named = lambda test: F.transform(F.filter("_r", test), lambda x: x["name"])
    out = judged.select(
        *keep,
        named(lambda x: (x["verdict"] == "match") & (x["type"] != "exclusion")).alias("matched"),
        named(lambda x: (x["verdict"] == "match") & (x["type"] == "exclusion")).alias("excluded_by"),
        named(lambda x: (x["verdict"] == "indeterminate") & (x["type"] != "exclusion")).alias("indeterminate"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("_r", lambda x: x["verdict"] == "indeterminate"), lambda x: x["missing"])))).alias("missing"),
    )
    verdict = F.when((F.size("matched") > 0) & (F.size("excluded_by") == 0), "malicious").when(F.size("indeterminate") > 0, "indeterminate").otherwise("clean")
    return out.withColumn("verdict", verdict)


def coverage(rules: list[Rule], verdicts: DataFrame) -> DataFrame:
    """Per capability that rules need: how many rules name it, how many messages were left undecided for want of it, and the share of all
    messages. verdicts: missing (array of capabilities, of indeterminate rules)."""
    needs = verdicts.sparkSession.createDataFrame([(c, r.name) for r in rules for c in r.needs], "capability string, rule string")
    wanted = needs.groupBy("capability").agg(F.count("*").alias("n_rules"))
    gaps = verdicts.select(F.explode(F.array_distinct("missing")).alias("capability")).groupBy("capability").agg(F.count("*").alias("n"))
    out = wanted.join(F.broadcast(gaps.join(wanted.select("capability"), "capability", "left_semi")), "capability", "left")  # a row for each capability of the rules at most
    total = verdicts.agg(F.count("*").alias("total"))
    n = F.coalesce("n", F.lit(0))
    return out.join(F.broadcast(total)).select("capability", "n_rules", n.alias("n_undecided"), F.try_divide(n.cast("double"), F.col("total").cast("double")).alias("share"))
