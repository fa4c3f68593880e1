"""Addresses in ranges."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def ip_number(x: Column) -> Column:
    """An IPv4 address (also mapped into IPv6) as a number; null if it is none."""
    x = F.regexp_replace(F.trim(x), "(?i)^::ffff:", "")
    parts = F.split(x, r"\.")
    return F.when(F.rlike(x, F.lit(V4)), reduce(lambda a, b: a * 256 + b, [F.get(parts, i).try_cast("bigint") for i in range(4)]))


V6_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once for all its uses in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip6_text(x: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, whose order is that of the addresses; null if it is none (or is mapped IPv4). Each step reads
    the one before it once or twice only, so the expression stays small."""

    def hexed(low: Column) -> Column:
        """A dotted end as two groups; null if it is no IPv4 address."""
        tail = F.regexp_extract(low, r"(\d+\.\d+\.\d+\.\d+)$", 1)
        group = lambda v: F.lower(F.hex(v))
        pair = _bound(ip_number(tail), lambda n: F.concat(group(F.shiftright(n, 16)), F.lit(":"), group(n.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(F.contains(low, F.lit(".")), F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(tail)), pair)).otherwise(low)

    def digits(low: Column) -> Column:
        given = F.regexp_count(low, F.lit("[0-9a-f]+"))
        right = F.when(F.contains(low, F.lit("::")), (given < 8) & F.rlike(low, F.lit(rf"^(?:{V6_GROUPS})?::(?:{V6_GROUPS})?\z"))).otherwise((given == 8) & F.rlike(low, F.lit(rf"^{V6_GROUPS}\z")))
        whole = F.replace(low, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.greatest(8 - given, F.lit(0)))))
        padded = F.regexp_replace(whole, "([0-9a-f]+)", "000$1")
        return F.when(right, F.regexp_replace(padded, "[0-9a-f]*?([0-9a-f]{4})(?::|$)|:", "$1"))

    plain = F.when(F.contains(x, F.lit(":")) & ip_number(x).isNull(), F.lower(F.trim(x)))
    return _bound(plain, lambda low: _bound(hexed(low), digits))


def networks(cidrs: list[str]) -> list:
    """Merged ranges of both versions; texts that are no range are skipped."""
    nets: dict[int, list] = {4: [], 6: []}
    for c in cidrs:
        try:
            net = ipaddress.ip_network(c, strict=False)
        except ValueError:
            continue
        if net.version == 6 and net.network_address.ipv4_mapped and net.prefixlen >= 96:
            net = ipaddress.ip_network((int(net.network_address.ipv4_mapped), net.prefixlen - 96))
        nets[net.version].append(net)
    return [n for v in (4, 6) for n in ipaddress.collapse_addresses(nets[v])]


def ranges(cidrs: list[str]) -> list[tuple[int, int]]:
    """Merged IPv4 ranges as numbers."""
    return [(int(n[0]), int(n[-1])) for n in networks(cidrs) if n.version == 4]


def ip_in(x: Column, *cidrs: str) -> Column:
    """Whether an address lies in any of the ranges; IPv4 mapped into IPv6 counts as IPv4. Null if it is no address."""
    nets = networks(list(cidrs))

    def held(ip: Column) -> Column:
        n, t = ip["n"], ip["t"]
        tests = [n.between(int(r[0]), int(r[-1])) if r.version == 4 else t.between(f"{int(r[0]):032x}", f"{int(r[-1]):032x}") for r in nets]
        return F.when(n.isNotNull() | t.isNotNull(), reduce(lambda a, b: a | b, [F.coalesce(test, F.lit(False)) for test in tests], F.lit(False)))

    return _bound(x, lambda text: _bound(F.struct(ip_number(text).alias("n"), ip6_text(text).alias("t")), held))


def flag_in_ranges(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """For many ranges: table(low, high) as numbers. Both sides meet on the address's first 16 bits, so no pair of all rows is made."""
    cells = table.select("low", "high", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))).alias("_cell"))
    numbered = df.withColumn("_n", ip_number(F.col(column))).withColumn("_cell", F.shiftright("_n", 16))
    hits = numbered.select("_n", "_cell").distinct().join(cells, "_cell").where(F.col("_n").between(F.col("low"), F.col("high"))).select("_n").distinct().withColumn("_hit", F.lit(True))
    return numbered.join(hits, "_n", "left").withColumn(out, F.when(F.col("_n").isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_n", "_cell", "_hit")
