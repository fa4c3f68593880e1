"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A text's set is its distinct 5-word shingles (64-bit codes); a shingle's inverted list is the texts that have it. Texts of n1 and n2
shingles link if they share T = ceil(threshold * (n1 + n2) / (1 + threshold)) lists.

1. Lists are ordered by length: a first pass counts the shingles that each task meets more than once; the most frequent ones (a bounded
   table) come last by their counts, all others first by their code. Any order that all texts share gives the same result, so these
   counts only decide how much work there is. Each text sets its ceil(threshold * n) - 1 last, longest lists apart.
2. The other lists are dealt out by shingle and merged over the cluster: the hits of each pair of texts are counted. Whatever two similar
   texts share beyond these lists is bounded by what they set apart, so a pair needs T - ceil(threshold * max(n1, n2)) + 1 hits there.
3. Lists that are too long for pairs (more than `longest` texts; dealt out with a salt if known to be long) are not expanded. A star
   from each list's smallest text is a candidate first.
4. Candidates whose signatures (counts of shingles by their low bits) don't rule out T common ones are searched in blocks: a query text, and an inverted index of up to `BLOCK` candidates over the query's shingles.
   DivideSkip takes the L longest lists of the block apart, heap-merges the short ones, and probes the long ones by binary search for the
   texts with T - L hits; those that reach their own T are linked.
5. Links join texts to components. What is left are pairs that share long lists and lie in different components: only texts outside a
   list's largest component are compared with the rest of that list.

Texts with equal sets are one class from the start and are never compared with each other. Classes are told apart by set size and a
64-bit digest of the set. Words are the whitespace-separated byte strings after lower-casing A-Z; a text of 1-4 words has one
shingle, a text without words (or null) has none and links with nothing. doc_ids may repeat or be null (such rows count as texts;
a component without any doc_id has a null id). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.llm._shared import free_name, grams, is_marked, marked_bits, mix, most_frequent, stored, texts_of, word_codes
from parapet.operators.graph import components

WORDS = 5
KNOWN_LONG = 65_536  # shingles whose list length is kept: at most a megabyte for each executor
SALTS = 64


def shingles(text: str) -> np.ndarray:
    code = word_codes(text.encode().lower())
    if len(code) < WORDS:
        return mix(grams(code, len(code)) ^ np.uint64(len(code))) if len(code) else code
    found = np.sort(grams(code, WORDS))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def signature(found: np.ndarray) -> bytes | None:
    """How many shingles fall on each value of their low bits, in as many cells as the power of two below their number."""
    cells = 1 << (len(found).bit_length() - 1)
    n = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def most_common(x: bytes, y: bytes) -> int:
    """Two sets share no more than this."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    cells = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, cells).sum(0), b.reshape(-1, cells).sum(0)).sum())


BITS = [f"b{i}" for i in range(4)]


def bitmap(found: np.ndarray) -> np.ndarray:
    """256 bits as four longs: which values of eight other bits of the codes occur."""
    bits = np.zeros(256, bool)
    bits[(found >> np.uint64(40)).astype(np.int64) & 255] = True
    return np.packbits(bits).view(np.int64)


def digest(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (with its class), and rows with the shingles that stand in several of the task's classes."""
    pending, size, seen = [], 0, set()

    def repeated() -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(pending), return_counts=True)
        value, n = value[n > 1].astype(np.int64), n[n > 1]
        none = pa.nulls(len(value), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(value), pa.binary()), pa.array(value), pa.array(n, pa.int64()), *[none] * 4], names=names)

    names = ["doc_id", "text_key", "n", "h", "signature", "shingle", "count", *BITS]
    for b in batches:
        n, h, marks, bits = [], [], [], []
        for text in texts_of(b.column(2)):
            found = shingles(text)
            n.append(len(found))
            h.append(digest(found) if len(found) else None)
            marks.append(None)
            bits.append((None,) * 4)
            if len(found) and h[-1] not in seen:
                seen.add(h[-1])
                marks[-1], bits[-1] = signature(found), bitmap(found).tolist()
                pending.append(found)
                size += len(found)
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(marks, pa.binary()), none, none, *[pa.array(x, pa.int64()) for x in zip(*bits, strict=True)]], names=names)
        if size > 4_000_000:
            yield repeated()
            pending, size, seen = [], 0, set()
    if pending:
        yield repeated()


def _sets(marked):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(n, h, set) of the texts whose key is marked."""
        seen = set()
        for b in batches:
            hit = pa.array(is_marked(marked.value, b.column(0).to_numpy()))
            rows = []
            for text in texts_of(b.column(1).filter(hit)):
                found = shingles(text)
                key = (len(found), digest(found)) if len(found) else None
                if key and key not in seen:
                    seen.add(key)
                    rows.append((*key, found.tobytes()))
            for i in range(0, len(rows), 500):
                n, h, data = zip(*rows[i : i + 500], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(data, pa.binary())], names=["n", "h", "set"])

    return sets


PAIR = "shingle long, place int, n1 long, h1 long, n2 long, h2 long, hits long"


def _reachable(percent: int, n1, i, n2, j, least, most):
    """Whether two sets whose first common list stands at places i and j of their orders can be similar enough: what comes before is not
    shared. Tested at every common list; at the first it drops no similar pair."""
    return 100 * least(n1 - i, n2 - j) >= percent * (i + j + most(n1 - i, n2 - j))


def _merger(percent: int, longest: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of a partition: pairs with their hits from short ones, the rows themselves of long ones."""
        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(5)] for b in batches if b.num_rows]
        if not parts:
            return
        shingle, h, n, place, salt = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        names, kinds = ["shingle", "place", "n1", "h1", "n2", "h2", "hits"], [pa.int64(), pa.int32(), *[pa.int64()] * 5]

        def rows(*columns) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(columns[2]), 50_000):
                size = len(columns[2][i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c[i : i + 50_000], k) for c, k in zip(columns, kinds, strict=True)], names=names)

        order = np.lexsort((n, h, shingle))
        shingle, h, n, place, salt = (x[order] for x in (shingle, h, n, place, salt))
        first = np.ones(len(h), bool)  # copies have the same class
        first[1:] = (shingle[1:] != shingle[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])
        shingle, h, n, place, salt = (x[first] for x in (shingle, h, n, place, salt))
        n, place = n.astype(np.int64), place.astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        lengths = np.diff(np.append(starts, len(shingle)))
        marked = salt[starts] >= 0
        long = (marked | (lengths > longest)).repeat(lengths)
        yield from rows(shingle[long], place[long], n[long], h[long], None, None, None)
        starts, lengths = starts[~marked & (lengths > 1) & (lengths <= longest)], lengths[~marked & (lengths > 1) & (lengths <= longest)]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.unique(lengths):
            i, j = np.triu_indices(k, 1)
            at = starts[lengths == k][:, None]
            x, y = (at + i).ravel(), (at + j).ravel()
            fit = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            a.append(x[fit])
            b.append(y[fit])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs, hits = np.unique(np.stack([n[a], h[a], n[b], h[b]], 1), axis=0, return_counts=True)
            yield from rows(None, None, *pairs.T, hits)

    return merge


def _possible(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (n1, h1, n2, h2, star, signatures) whose signatures don't rule out that they share T shingles; null rules out nothing."""
        for b in batches:
            x, y = b.column(5).to_pylist(), b.column(6).to_pylist()
            sizes = b.column(0).to_numpy() + b.column(2).to_numpy()
            keep = [not p or not q or (100 + percent) * most_common(p, q) >= percent * n for p, q, n in zip(x, y, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(5)], names=["n1", "h1", "n2", "h2", "star"]).filter(pa.array(keep, pa.bool_()))

    return check


BLOCK, PROBE = 256, 0.01  # texts of a block; a probe's cost against that of a merge step


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[bool]:
    """Which sets share enough of the query's inverted lists. Sets and query are sorted."""
    n, k = len(query), len(sets)
    sizes = np.array([len(x) for x in sets])
    code, owner = np.concatenate(sets), np.repeat(np.arange(k), sizes)
    at = np.minimum(np.searchsorted(query, code), n - 1)
    posting = np.sort((at * k + owner)[query[at] == code])  # the index: by list, then by text
    need = -(-percent * (n + sizes) // (100 + percent))
    lengths = np.bincount(posting // k, minlength=n)
    least = int(need.min())
    apart = min(int(least / (PROBE * log2(lengths.max() + 2) + 1)), least - 1)
    order = np.argsort(-lengths, kind="stable")
    long, short = order[:apart], np.sort(order[apart:])
    ends = np.cumsum(lengths)
    lists = [(posting[ends[i] - lengths[i] : ends[i]] - i * k).tolist() for i in short.tolist() if lengths[i]]
    hits = np.zeros(k, np.int64)
    for text, found in groupby(heapq.merge(*lists)):
        hits[text] = sum(1 for _ in found)
    found = np.flatnonzero(hits >= np.maximum(need - apart, 1))
    if len(found) and apart:
        probe = (long[:, None] * k + found).ravel()
        there = np.minimum(np.searchsorted(posting, probe), len(posting) - 1)
        hits[found] += (posting[there] == probe).reshape(apart, len(found)).sum(0)
    enough = np.zeros(k, bool)
    enough[found] = hits[found] >= need[found]
    return enough.tolist()


def _search(percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (n1, h1, salt, n2, h2, set) by query, the query's own set first -> the linked pairs."""
        now, query, block = None, None, []

        def linked_pairs() -> list[tuple]:
            keep = divide_skip(query, [x for _, _, x in block], percent) if block else []
            out = [(now[0], now[1], n, h) for (n, h, _), k in zip(block, keep, strict=True) if k]
            block.clear()
            return out

        for b in batches:
            rows, sets = [], b.column(5)
            for i, (n1, h1, salt, n2, h2) in enumerate(zip(*(b.column(j).to_pylist() for j in range(5)), strict=True)):
                if (n1, h1, salt) != now or len(block) == BLOCK:
                    rows += linked_pairs()
                own = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if n2 is None:
                    now, query = (n1, h1, salt), own.copy()
                else:
                    block.append((n2, h2, own.copy()))
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 5000], strict=True)], names=["n1", "h1", "n2", "h2"])
        if rows := linked_pairs():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["n1", "h1", "n2", "h2"])

    return search


def linked(docs: DataFrame, percent: int = 80, longest: int = 64) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), text_key."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = plain.withColumn("text_key", F.xxhash64("text"))
    first = stored(keyed.select("doc_id", "text_key", "text").mapInArrow(_count, "doc_id long, text_key long, n long, h long, signature binary, shingle long, count long, b0 long, b1 long, b2 long, b3 long"), "counted")
    texts = first.where("n is not null").select("doc_id", "text_key", "n", "h")
    frequent = stored(first.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("n")).where(F.col("n") > longest // 2), "frequent")
    rows = sorted((s, n) for s, n in most_frequent(frequent, "n", KNOWN_LONG).collect())
    known = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))

    def merged_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, h, n, place in the order, salt) for the lists that a text merges; salt is -1 unless the list is known to be long."""
        value, count = known.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for text in texts_of(b.column(0)):
                found = shingles(text)
                key = (len(found), digest(found))
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                short = len(found) - (percent * len(found) + 99) // 100 + 1
                found = found.astype(np.int64)
                length = np.zeros(len(found), np.int64)
                if len(value):
                    at = np.minimum(np.searchsorted(value, found), len(value) - 1)
                    length = np.where(value[at] == found, count[at], 0)
                pick = np.lexsort((found, length))[:short]
                salt = np.where(length[pick] > longest, key[1] % SALTS, -1)
                out.append((found[pick], np.full(short, key[1]), np.full(short, key[0], np.int32), np.arange(short, dtype=np.int32), salt.astype(np.int8)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["shingle", "h", "n", "place", "salt"])

    dealt = keyed.select("text").mapInArrow(merged_lists, "shingle long, h long, n int, place int, salt byte").repartition("shingle", "salt")
    lists = stored(dealt.mapInArrow(_merger(percent, longest), PAIR), "lists")
    pairs = lists.where("shingle is null").groupBy("n1", "h1", "n2", "h2").agg(F.sum("hits").alias("hits"))
    long = stored(lists.where("shingle is not null").select("shingle", F.col("place").cast("long").alias("place"), F.col("n1").alias("n"), F.col("h1").alias("h")).distinct(), "long")

    def other(df: DataFrame) -> DataFrame:
        return df.select("shingle", *[F.col(c).alias(f"{c}2") for c in df.columns if c != "shingle"])

    reach = _reachable(percent, F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), F.least, F.greatest)
    lower = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("h") < F.col("h2")))

    def as_pairs(df: DataFrame) -> DataFrame:
        """Each pair once, the smaller class first."""
        sides = [F.when(lower, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("n", "n2", "n1"), ("h", "h2", "h1"), ("n2", "n", "n2"), ("h2", "h", "h2"))]
        return df.where("h != h2 or n != n2").select(*sides).distinct()

    # the star of a long list: around the text with the fewest shingles of its own, for each band of set sizes
    own = F.min("place").over(Window.partitionBy("n", "h"))  # over a text's lists
    banded = long.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.12)))).withColumn("own", own)
    centre = banded.groupBy("shingle", "band").agg(F.min(F.struct("own", "n", "h", "place")).alias("c"))
    centre = stored(centre.select("shingle", "band", F.col("c.place").alias("place2"), F.col("c.n").alias("n2"), F.col("c.h").alias("h2")), "centres")  # stored: a long list's part of the join can be split
    stars = as_pairs(banded.join(centre, ["shingle", "band"]).where(reach))

    heads = stored(texts.where("h is not null").groupBy("n", "h").agg(F.min("doc_id").alias("head"), F.min("text_key").alias("text_key")), "heads")
    longs = stored(long.groupBy("n", "h").agg(F.count("*").alias("longs")), "longs")  # how many long lists a class merges
    bound = lambda n: F.ceil(percent * F.col(n) / 100)
    least_hits = F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent)) - F.greatest(bound("n1"), bound("n2")) + 1

    def ends(candidates: DataFrame) -> DataFrame:
        return candidates.select(F.col("n1").alias("n"), F.col("h1").alias("h")).unionByName(candidates.select(F.col("n2").alias("n"), F.col("h2").alias("h"))).distinct()

    def with_both(candidates: DataFrame, table: DataFrame, column: str) -> DataFrame:
        left = table.select(F.col("n").alias("n1"), F.col("h").alias("h1"), F.col(column).alias("x"))
        right = table.select(F.col("n").alias("n2"), F.col("h").alias("h2"), F.col(column).alias("y"))
        return candidates.join(left, ["n1", "h1"], "left").join(right, ["n2", "h2"], "left")

    def possible(candidates: DataFrame, name: str) -> DataFrame:
        """Candidates (n1, h1, n2, h2, star) less those that a signature, an eighth of a set in size, rules out."""
        marks = first.where("signature is not null").select("n", "h", "signature").join(ends(candidates), ["n", "h"], "left_semi")
        own = stored(marks.groupBy("n", "h").agg(F.any_value("signature").alias("signature")), f"{name}-signatures")
        pairs = with_both(candidates, own, "signature").select("n1", "h1", "n2", "h2", "star", "x", "y")
        return stored(pairs.mapInArrow(_possible(percent), "n1 long, h1 long, n2 long, h2 long, star boolean"), name)

    def checked(candidates: DataFrame, name: str) -> DataFrame:
        keys = heads.join(ends(candidates), ["n", "h"], "left_semi").select("text_key")
        own = keyed.select("text_key", "text").mapInArrow(_sets(marked_bits(keys, "text_key", 26)), "n long, h long, set binary")
        own = stored(own.join(ends(candidates), ["n", "h"], "left_semi").groupBy("n", "h").agg(F.any_value("set").alias("set")), f"{name}-sets")
        blocks = candidates.groupBy("n1", "h1").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a query with many candidates is dealt out
        dealt = stored(candidates.join(blocks, ["n1", "h1"]).select("n1", "h1", F.pmod("h2", "blocks").alias("salt"), "n2", "h2"), f"{name}-dealt")
        index = dealt.join(own.select(F.col("n").alias("n2"), F.col("h").alias("h2"), "set"), ["n2", "h2"])
        queries = dealt.select("n1", "h1", "salt").distinct().join(own.select(F.col("n").alias("n1"), F.col("h").alias("h1"), "set"), ["n1", "h1"])
        none = F.lit(None).cast("long")
        rows = index.select("n1", "h1", "salt", "n2", "h2", "set").unionByName(queries.select("n1", "h1", "salt", none.alias("n2"), none.alias("h2"), "set"))
        ordered = rows.repartition("n1", "h1", "salt").sortWithinPartitions("n1", "h1", "salt", "n2", "h2")
        return stored(ordered.mapInArrow(_search(percent), "n1 long, h1 long, n2 long, h2 long"), name)

    def nodes(links: DataFrame) -> DataFrame:
        h1 = heads.select(F.col("n").alias("n1"), F.col("h").alias("h1"), F.col("head").alias("a"))
        h2 = heads.select(F.col("n").alias("n2"), F.col("h").alias("h2"), F.col("head").alias("b"))
        return links.join(h1, ["n1", "h1"]).join(h2, ["n2", "h2"]).where("a is not null and b is not null").select("a", "b")

    def hopeful_pairs(counted: DataFrame) -> DataFrame:
        """Pairs (n1, h1, n2, h2, hits) whose hits, with the long lists that they may share besides, are enough for merged lists."""
        more = F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))
        return with_both(counted, longs, "longs").where(F.col("hits") + more >= least_hits).select("n1", "h1", "n2", "h2")

    # first the stars and one more candidate for each text, its smallest partner; what these links join needs no further check
    both = hopeful_pairs(pairs).withColumn("star", F.lit(False)).unionByName(stars.withColumn("star", F.lit(True)))
    candidates = possible(stored(both.groupBy("n1", "h1", "n2", "h2").agg(F.bool_or("star").alias("star")), "candidates"), "possible")
    least = candidates.groupBy("n2", "h2").agg(F.min(F.struct("n1", "h1")).alias("c")).select("c.n1", "c.h1", "n2", "h2")
    trial = candidates.where("star").select("n1", "h1", "n2", "h2").unionByName(least).distinct()
    links = stored(nodes(checked(stored(trial, "trial"), "links")), "link-nodes")
    found = components(links)
    part = heads.join(found, F.col("head") == F.col("node"), "left").select("n", "h", F.coalesce("label", "head").alias("part"))
    apart = with_both(candidates, part, "part").where("x != y").select("n1", "h1", "n2", "h2")
    if not long.isEmpty():
        marks = first.where("b0 is not null").groupBy("n", "h").agg(*[F.max(b).alias(b) for b in BITS])
        named = stored(long.join(part, ["n", "h"]).join(marks, ["n", "h"]), "named")
        sizes = named.groupBy("shingle", "part").agg(F.count("*").alias("size"), F.min("place").alias("place"), F.min("n").alias("n"))
        main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "part")).alias("m"), F.count("*").alias("parts"), F.min("place").alias("place0"), F.min("n").alias("n0")).where("parts > 1")
        main = stored(main.select("shingle", F.col("m.part").alias("main"), "place0", "n0"), "main")
        hopeful = 100 * (F.col("n") - F.col("place")) >= percent * (F.col("place") + F.col("place0") + F.greatest(F.col("n") - F.col("place"), F.col("n0") - F.col("place0")))
        outside = named.join(main, "shingle").where((F.col("part") != F.col("main")) & hopeful).select(named.columns)
        # a bit that only one of two sets has stands for a shingle at least that they don't share
        only = lambda a, b: reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}{a}").bitwiseAND(F.bitwise_not(f"{x}{b}"))) for x in BITS])
        enough = lambda n, a, b: (100 + percent) * (F.col(n) - only(a, b)) >= percent * (F.col("n") + F.col("n2"))
        others = outside.join(other(named), "shingle").where((F.col("part") != F.col("part2")) & reach & enough("n", "", "2") & enough("n2", "2", ""))
        apart = apart.unionByName(possible(stored(as_pairs(others).withColumn("star", F.lit(False)), "others"), "possible-others").drop("star")).distinct()
    apart = stored(apart, "apart")
    if not apart.isEmpty():
        found = components(links.unionByName(nodes(checked(apart, "more"))))
    whole = texts.join(heads.drop("text_key"), ["n", "h"], "left").join(found, F.col("head") == F.col("node"), "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "head", "doc_id").alias("component_id"), "text_key")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the row of the smallest doc_id of each component only (all rows, if several share it); rows without a doc_id stay.
    Columns stay as they are."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    name = free_name(docs, "row_key")
    kept = linked(docs, percent).where("doc_id = component_id or doc_id is null").select(F.xxhash64("doc_id", "text_key").alias(name)).distinct()
    return docs.withColumn(name, key).join(kept, name, "left_semi").select(docs.columns)
