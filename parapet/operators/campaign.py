"""Groups of near-duplicate messages: SimHash fingerprints, band join, connected components."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.operators.graph import components
from parapet.sources.shared import stored


def normalised(x: Column) -> Column:
    """Lower case, digits as one mark, other signs as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\d+", "0"), r"[^\p{L}0]+", " "))


def features(subject: Column, sender: Column, roots: Column | None = None, hosts: Column | None = None, files: Column | None = None) -> Column:
    """array of struct(feature, weight): subject 3-word shingles 3, sender name 5, link root domains 7, hosts 2, attachments 8 by digest or
    3 by name. files: array of struct(md5, name). What a message lacks has no vote."""
    words = F.split(normalised(subject), " ")

    def named(prefix: str, x: Column, weight: int) -> Column:
        return F.struct(F.concat(F.lit(prefix), x).alias("feature"), F.lit(weight).alias("weight"))

    def each(prefix: str, xs: Column | None, weight: int) -> list[Column]:
        return [] if xs is None else [F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: named(prefix, F.lower(x), weight))]

    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: named("s:", F.array_join(F.slice(words, i + 1, F.lit(3)), " "), 3))
    parts = [shingles, F.array(named("n:", normalised(sender), 5)), *each("l:", roots, 7), *each("h:", hosts, 2)]
    if files is not None:
        parts.append(F.transform(files, lambda f: F.when(f["md5"].isNotNull(), named("a:", f["md5"], 8)).otherwise(named("f:", F.lower(f["name"]), 3))))
    return F.filter(F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<struct<feature:string,weight:int>>")) for p in parts])), lambda x: x["feature"].isNotNull())


def simhash(hashed: Column) -> Column:
    """64 weighted votes, one for each bit of the features' digests, as a long. hashed: array of struct(h, w), best a column already made: it
    is read for each bit."""
    bit = lambda b: F.aggregate(hashed, F.lit(0), lambda s, x: s + F.when(F.getbit(x["h"], F.lit(b)) == 1, x["w"]).otherwise(-x["w"]))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(bit(b) > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)])


def _digest(x: Column) -> Column:
    """The first 64 bits of a text's MD5."""
    half = lambda i: F.conv(F.substring(F.md5(x), i, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def fingerprints(messages: DataFrame) -> DataFrame:
    """message_id, fingerprint: of subject and sender, and of link_roots, link_hosts and files where the table has these columns."""
    more = [F.col(c) if c in messages.columns else None for c in ("link_roots", "link_hosts", "files")]
    hashed = F.transform(features(F.col("subject"), F.col("sender_domain"), *more), lambda f: F.struct(_digest(f["feature"]).alias("h"), f["weight"].alias("w")))
    bound = messages.select("message_id", F.explode(F.array(hashed)).alias("hashed"))  # made once, not once for each bit
    return bound.select("message_id", simhash(F.col("hashed")).alias("fingerprint"))


CROWD = 1000  # prints in a band from which it is split further


def _masks(most: int) -> list[tuple[int, list[int]]]:
    """Of most + 3 blocks of the 64 bits, each choice of three, and most + 1 parts of the other bits. Two prints that differ in `most` bits
    agree in all three blocks of one choice, and there in one of the parts."""
    n = most + 3
    cuts = [64 * i // n for i in range(n + 1)]
    signed = lambda bits: (x := sum(1 << b for b in bits)) - (1 << 64 if x >> 63 else 0)
    out = []
    for chosen in combinations(range(n), 3):
        held = {b for i in chosen for b in range(cuts[i], cuts[i + 1])}
        rest = [b for b in range(64) if b not in held]
        out.append((signed(held), [signed(rest[len(rest) * i // (most + 1) : len(rest) * (i + 1) // (most + 1)]) for i in range(most + 1)]))
    return out


def near_prints(nodes: DataFrame, most: int, crowd: int = CROWD) -> DataFrame:
    """a < b: distinct fingerprints that differ in 1 to `most` bits. Prints meet where three of most + 3 blocks (some 32 bits) are equal, so
    that chance meetings stay rare among 10^8 prints. In a band with more than `crowd` prints they only meet where a part of the other
    bits is equal as well; no pair is lost."""
    masks = _masks(most)
    bands = nodes.select("fingerprint", F.posexplode(F.array(*[F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(m))) for k, (m, _) in enumerate(masks)])).alias("k", "band"))
    crowded = bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    rest = F.get(F.array(*[F.array(*map(F.lit, r)) for _, r in masks]), F.col("k"))
    parts = F.transform(rest, lambda m, i: F.xxhash64(F.col("band"), i, F.col("fingerprint").bitwiseAND(m)))
    met = bands.join(crowded, "band", "left").select("fingerprint", F.explode(F.when(F.col("n").isNull(), F.array("band")).otherwise(parts)).alias("meets"))
    apart = F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint")))
    pairs = met.alias("x").join(met.alias("y"), (F.col("x.meets") == F.col("y.meets")) & (F.col("x.fingerprint") < F.col("y.fingerprint")) & (apart <= most))
    return pairs.select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b")).distinct()


def campaigns(prints: DataFrame, most: int = 3, least: int = 3, crowd: int = CROWD) -> DataFrame:
    """message_id, campaign_id (smallest fingerprint), size: groups of messages linked by at most `most` differing bits. Messages with one
    fingerprint are one node; a print of 0 is none."""
    prints = stored(prints.select("message_id", "fingerprint").where("fingerprint != 0"), "prints")
    nodes = stored(prints.groupBy("fingerprint").agg(F.count("*").alias("n")), "nodes")
    found = components(near_prints(nodes, most, crowd))
    named = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "n", F.coalesce("label", "fingerprint").alias("campaign_id"))
    sizes = stored(named.groupBy("campaign_id").agg(F.sum("n").alias("size")).where(F.col("size") >= least), "sizes")
    return prints.join(named.join(sizes, "campaign_id").select("fingerprint", "campaign_id", "size"), "fingerprint").select("message_id", "campaign_id", "size")


def campaign_totals(members: DataFrame, messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per campaign: size, first and last, how many are malicious, and how many an analyst left unreviewed, called benign or to remediate."""
    rows = members.join(messages.select("message_id", "received_at", "triage"), "message_id").join(verdicts.select("message_id", "verdict"), "message_id", "left")
    state = F.coalesce("triage", F.lit("unreviewed"))
    return rows.groupBy("campaign_id").agg(
        F.count("*").alias("size"), F.min("received_at").alias("first"), F.max("received_at").alias("last"), F.count_if(F.col("verdict") == "malicious").alias("malicious"),
        *[F.count_if(state == s).alias(s) for s in ("unreviewed", "benign", "needs_remediation")],
    )


def response(members: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: messages considered, messages grouped, campaigns."""
    grouped = members.agg(F.count("*").alias("grouped"), F.count_distinct("campaign_id").alias("campaigns"))
    return messages.agg(F.count("*").alias("considered")).join(F.broadcast(grouped))  # one row each
