"""Public suffixes: how many labels of a host's end are one, by a trie of reversed labels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS, EXCEPT = " ends", " except"  # marks in a node; no label holds a space


def _label(x: str) -> str:
    """Lower case, and as it goes over the wire."""
    x = x.lower()
    if x.isascii():
        return x
    try:
        return x.encode("idna").decode()
    except UnicodeError:
        return x


def trie(rules: list[str]) -> dict:
    """Of rules as they are published: labels, `*` for any label, and `!` before a name that a `*` doesn't cover."""
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.removeprefix("!").strip(".").split(".")):
            node = node.setdefault(_label(label), {})
        node[EXCEPT if rule.startswith("!") else ENDS] = True
    return root


def labels_of_suffix(root: dict, host: str) -> int:
    """The longest rule wins; an exception gives its parent; without any rule the last label is the suffix."""
    best, nodes = 1, [root]
    for depth, label in enumerate(map(_label, reversed(host.split("."))), 1):
        nodes = [n[k] for n in nodes for k in (label, "*") if k in n]
        if any(EXCEPT in n for n in nodes):
            return depth - 1
        if any(ENDS in n for n in nodes):
            best = depth
        if not nodes:
            break
    return best


def suffix_labels(host: Column, rules: list[str]) -> Column:
    """Number of labels of the host's public suffix; null for null. The trie is built once for each task."""
    built: list[dict] = []

    @F.arrow_udf("int")
    def count(x: pa.Array) -> pa.Array:
        if not built:
            built.append(trie(rules))
        return pa.array([None if h is None else labels_of_suffix(built[0], h) for h in x.to_pylist()], pa.int32())

    return count(host)
