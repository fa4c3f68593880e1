"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

1. Each distinct text is the sequence of the IDs (64-bit codes) of its lines that have a word. Of texts that are wholly equal only the
   one with the smallest doc_id is searched; in the others the whole sequence is one run that was there before.
2. The suffixes of all sequences are ranked by their first line, then by their first `least`, 2 `least`, 4 `least`, ... lines: a
   suffix's pair of ranks (its own and that of the suffix so many lines on) is sorted over the cluster, and equal pairs form one
   interval of the suffix array, whose start is the new rank. Suffixes that are alone in their interval, or end before, drop out, so
   later rounds are small. Doubling goes on until no interval has two members.
3. In each interval the earliest suffix, by doc_id and line, is the original. A later suffix keeps the original of the deepest interval
   that it shares with an earlier one, and the common prefix of the two is measured to the line by going down the ranks of the smaller
   depths. That is its repeated run; a run is maximal if the suffix a line before doesn't reach as far.
4. A run of `least` lines counts, and so does a line of `words` words by itself. The lines of later copies are deleted; lines without a
   word stay. Every line that lies in an earlier-seen sequence of `least` lines, or is such a long line, is in a run that counts.

Null texts have no lines. Rows without a doc_id are left whole and are no original. Rows alike in doc_id and text are judged as one;
rows that share only their doc_id come in the order of a hash of their text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import is_marked, marked_bits, running_total, stored, texts_of

KEY = ["doc_id", "text_key", "place"]
LEAST, WORDS = 2, 10
RUNS = "doc_id long, text_key long, start long, n_lines long, first_id long, first_start long"


def _sequences(words: int, heads):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(is_marked(heads.value, b.column(3).to_numpy())))
            docs, keys, places, ids, long = [], [], [], [], []
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                sizes = [(x, n) for x in text.encode().split(b"\n") if (n := len(x.split()))]
                docs += [doc] * len(sizes)
                keys += [key] * len(sizes)
                places += range(len(sizes))
                ids += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, _ in sizes]
                long += [n >= words for _, n in sizes]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (docs, keys, places, ids)], pa.array(long, pa.bool_())], names=[*KEY, "rank", "long"])

    return cut


def _intervals(suffixes: DataFrame, by: list[str], name: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Suffixes with the rank of their interval and the place of its original, without those that are alone in theirs."""
    groups = stored(suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("first")).where("n > 1"), f"{name}-groups")
    starts = running_total(groups, by, "n", "start", f"{name}-starts")
    joined = suffixes.join(starts.select(*by, "start", "first"), by)
    return stored(joined.select(*KEY, *more, F.col("start").alias("rank"), F.col("first.doc_id").alias("f_doc"), F.col("first.text_key").alias("f_key"), F.col("first.place").alias("f_place")), name)


def _originals(keyed: DataFrame) -> DataFrame:
    """doc_id, text_key, copy: of wholly equal texts, the one with the smallest doc_id is no copy."""
    rows = keyed.where("doc_id is not null").select("doc_id", "text_key", F.xxhash64(F.lit(7), "text").alias("text_key2")).distinct()
    rows = stored(rows, "texts")
    first = stored(rows.groupBy("text_key", "text_key2").agg(F.min("doc_id").alias("first_id")), "first-texts")
    return rows.join(first, ["text_key", "text_key2"]).select("doc_id", "text_key", (F.col("doc_id") != F.col("first_id")).alias("copy"))


def levels(keyed: DataFrame, heads, least: int, words: int) -> list[tuple[int, DataFrame]]:
    """(depth, intervals) for each depth: the ladder of the suffix array."""
    marked = keyed.where("doc_id is not null").select("doc_id", "text_key", "text", F.xxhash64("doc_id", "text_key").alias("row_key"))
    suffixes = stored(marked.mapInArrow(_sequences(words, heads), "doc_id long, text_key long, place long, rank long, long boolean").distinct(), "lines")
    depth, out = 1, [(1, _intervals(suffixes, ["rank"], "depth-1", ("long",)))]
    while True:
        ranked = out[-1][1]
        on = min(depth, least - depth) if depth < least else depth  # the step to `least` may overlap
        after = ranked.select("doc_id", "text_key", (F.col("place") - on).alias("place"), F.col("rank").alias("rank2"))
        pairs = stored(ranked.select(*KEY, "rank").join(after, KEY), "pairs")
        deeper = _intervals(pairs, ["rank", "rank2"], f"depth-{depth + on}")
        if deeper.isEmpty():
            return out
        depth += on
        out.append((depth, deeper))


def _at(level: DataFrame, doc: str, key: str, place: str, name: str) -> DataFrame:
    return level.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("place").alias(place), F.col("rank").alias(name))


def repeated_runs(keyed: DataFrame, originals: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, start, n_lines, first_id, first_start: the maximal repeated runs of each text that is no copy, places counted
    over lines with a word, and where the original stands. keyed: doc_id, text_key, text; originals as from `_originals`.

    The bitmap of the texts to search has a fixed size of 8 MB; where it fills up, copies are searched too, with the same result."""
    heads = marked_bits(originals.where("not copy").select(F.xxhash64("doc_id", "text_key").alias("row_key")), "row_key", 26)
    ladder = levels(keyed, heads, least, words)
    later = None
    for i, (depth, level) in enumerate(ladder):
        counts = F.col("long") if i == 0 else F.lit(depth >= least)
        first = F.struct("f_doc", "f_key", "f_place")
        found = level.where(F.struct(*KEY) != first).select(*KEY, F.lit(i).alias("level"), F.lit(depth).cast("long").alias("n"), "f_doc", "f_key", "f_place", counts.alias("counts"))
        later = found if later is None else later.unionByName(found)
    deepest = F.max_by(F.struct("n", "f_doc", "f_key", "f_place"), "level")
    pairs = later.groupBy(*KEY).agg(F.max("level").alias("level"), deepest.alias("d"), F.bool_or("counts").alias("counts")).where("counts")
    pairs = stored(pairs.select(*KEY, "level", "d.*"), "later")
    for i in range(len(ladder) - 2, -1, -1):  # what is left beyond a depth is less than the next smaller depth can tell in one step
        depth, level = ladder[i]
        own = _at(level, "doc_id", "text_key", "p1", "r1")
        original = _at(level, "f_doc", "f_key", "p2", "r2")
        open_ = pairs.where(F.col("level") > i).withColumn("p1", F.col("place") + F.col("n")).withColumn("p2", F.col("f_place") + F.col("n"))
        met = open_.join(own, ["doc_id", "text_key", "p1"], "left").join(original, ["f_doc", "f_key", "p2"], "left")
        n = F.when(F.col("r1") == F.col("r2"), F.col("n") + depth).otherwise(F.col("n"))
        pairs = stored(met.select(*KEY, "level", n.alias("n"), "f_doc", "f_key", "f_place").unionByName(pairs.where(F.col("level") <= i)), "later")
    n = F.when(F.col("n") >= least, F.col("n")).otherwise(1)
    runs = pairs.select("doc_id", "text_key", F.col("place").alias("start"), n.alias("n_lines"), F.col("f_doc").alias("first_id"), F.col("f_place").alias("first_start"))
    return runs.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "start").mapInArrow(_maximal, RUNS)


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by text and start -> those that reach further than every run before them in their text."""
    now, reach = None, -1
    for b in batches:
        keep = []
        for doc, key, start, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (doc, key) != now:
                now, reach = (doc, key), -1
            keep.append(start + n > reach)
            reach = max(reach, start + n)
        yield b.filter(pa.array(keep, pa.bool_()))


def _deleted(least: int, words: int):
    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, runs, copy in zip(texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                lines = text.split("\n")
                worded = [(i, k) for i, x in enumerate(lines) if (k := len(x.encode().split()))]
                marked = np.zeros(len(worded), bool)
                for run in runs or ():
                    marked[run["start"] : run["start"] + run["n_lines"]] = True
                if copy:
                    marked |= np.array([len(worded) >= least or k >= words for _, k in worded], bool)
                drop = {i for (i, _), m in zip(worded, marked.tolist(), strict=True) if m}
                n.append(len(worded))
                gone.append(len(drop))
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_text"])

    return delete


def without_repeated_runs(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_lines (with a word), n_removed, kept_text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = stored(_originals(keyed), "originals")
    runs = repeated_runs(keyed, texts, least, words).select("doc_id", "text_key", F.struct("start", "n_lines").alias("run"), F.lit(False).alias("copy"))
    copies = texts.where("copy").select("doc_id", "text_key", F.lit(None).cast("struct<start:bigint,n_lines:bigint>").alias("run"), "copy")
    marks = runs.unionByName(copies).groupBy("doc_id", "text_key").agg(F.collect_list("run").alias("runs"), F.bool_or("copy").alias("copy"))  # no more than the text has lines
    joined = keyed.join(marks, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs", F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(_deleted(least, words), "doc_id long, n_lines long, n_removed long, kept_text string")


def report(docs: DataFrame) -> DataFrame:
    return without_repeated_runs(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
