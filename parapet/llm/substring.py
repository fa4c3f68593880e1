"""Substring dedup by suffix automata: words in 13-word windows that also start in a document with a smaller doc_id are removed.

The named method broadcasts automata of reference shards and streams every document past each of them. Here every document is
reference for all later ones, and streaming it past the automata of the whole corpus would read the corpus once for each shard. So the
reference is split: what very many documents share is one shard of bounded size whose automaton is broadcast; the rest is cut into
shards by content, and documents stream only past the shards that can match them.

0. Of texts that are wholly equal only the one with the smallest doc_id is searched; the others lose every word that has a window.
1. Each 13-word window has an anchor, the smallest of the codes of its nine 5-word runs. Equal windows have equal anchors. Anchors
   are counted over the corpus and those of several documents are marked in a bitmap of fixed size (2**28 bits, built from sums over
   the cluster). When it fills up, more stretches go on to the next step; the result stays the same.
2. The windows at the most frequent anchors (at most `HOT`) are counted too. Anchors whose repeated windows have room, most frequent first
   and at most `HOT_WINDOWS` windows, are hot: these windows with their first documents make up the broadcast automaton. Documents stream
   their hot stretches past it: where the matching statistic is 13 or more, the state names the first document; a window that it doesn't
   know stands nowhere else.
3. The stretches of words whose windows share another marked anchor (13 to 21 words) are sent to the shard of that anchor: a task sends
   each distinct stretch once, with its smallest doc_id.
4. A shard takes its stretches by anchor and rising doc_id. Each is streamed through the shard's suffix automaton; where the matching
   statistic is 13 or more, the state of the 13-word suffix names the first document that had it. Then it is added. An automaton that
   has grown to `MOST_WORDS` is begun anew with the next anchor, which loses nothing.
5. The first documents go back to all documents that have the stretch, which mark their windows; marked words are removed.

Null texts have no words. Rows without a doc_id are left whole and are no reference. Rows that share a doc_id are judged against
smaller doc_ids, not against each other. Windows are judged on the input. An empty table gives no rows. Other columns are ignored.
Words are compared by 64-bit codes, 13 at a time and below a common 64-bit anchor: two windows that differ in one word are taken for
equal with probability 2**-64 for each such pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import grams, is_marked, marked_bits, most_frequent, slices, stored, texts_of, word_codes

RUN, BITS = 5, 28
HOT = 1_024  # anchors, most of whose windows have room in the broadcast automaton
HOT_WINDOWS = 16_384  # windows of the broadcast automaton: some 400,000 states at most, 60 MB for each Python worker
MOST_WORDS = 100_000  # of a shard's automaton


def anchors(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: position and code of its anchor."""
    g = grams(codes, RUN)
    span = window - RUN + 1
    if len(g) < span:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(len(g) - span + 1) + np.lib.stride_tricks.sliding_window_view(g, span).argmin(1)
    return at, g[at].astype(np.int64)


class SuffixAutomaton:
    """Of several word sequences, added by rising doc_id; a state keeps the first document that reached it."""

    def __init__(self):
        self.next, self.link, self.length, self.doc = [{}], [-1], [0], [None]

    def _state(self, edges: dict, link: int, length: int, doc) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.link) - 1

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w, doc)

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the longest string of p followed by w, apart from the longer strings of q."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.doc[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, doc: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # known from an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state({}, 0, self.length[last] + 1, doc), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def first_documents(self, words: list[int], window: int) -> list:
        """For each window of the sequence: the first document that has it, or None."""
        out, state, length = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            if i >= window - 1:
                if length >= window:
                    at = state
                    while self.length[self.link[at]] >= window:
                        at = self.link[at]
                    out.append(self.doc[at])
                else:
                    out.append(None)
        return out


class FrozenAutomaton:
    """The same as sorted arrays, to be broadcast: edges by (state, word number), links, lengths and first documents."""

    def __init__(self, machine: SuffixAutomaton):
        words = sorted({w for edges in machine.next for w in edges})
        self.words = np.array(words, np.uint64)
        number = {w: i for i, w in enumerate(words)}
        edges = sorted((state << 32 | number[w], to) for state, out in enumerate(machine.next) for w, to in out.items())
        self.key, self.to = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        self.link, self.length = np.array(machine.link, np.int32), np.array(machine.length, np.int32)
        self.doc = np.array([-1 if d is None else d for d in machine.doc], np.int64)
        self.tables: tuple | None = None

    def first_documents(self, code: np.ndarray, window: int) -> list:
        """For each window of the sequence: the first document that has it, or None."""
        if not len(self.words):
            return [None] * (len(code) - window + 1)
        if self.tables is None:  # once for each worker
            self.tables = dict(zip(self.key.tolist(), self.to.tolist(), strict=True)), self.link.tolist(), self.length.tolist(), self.doc.tolist()
        edges, link, lengths, docs = self.tables
        at = np.minimum(np.searchsorted(self.words, code), len(self.words) - 1)
        out, state, length = [], 0, 0
        for i, w in enumerate(np.where(self.words[at] == code, at, -1).tolist()):
            to = edges.get(state << 32 | w) if w >= 0 else None
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = edges.get(state << 32 | w) if w >= 0 else None
            if to is not None:
                state, length = to, length + 1
            if i >= window - 1:
                at = state
                while length >= window and lengths[link[at]] >= window:
                    at = link[at]
                out.append(docs[at] if length >= window else None)
        return out


def _hot_windows(window: int, heads, hot):
    names = ["anchor", "code", "n", "doc_id", "words"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, code, n, doc_id, words) of the windows at given anchors: how many texts of the task have them, and the smallest doc_id."""
        pending: list[tuple] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            anchor, code, doc, words = (np.concatenate([x[k] for x in pending]) for k in range(4))
            order = np.lexsort((doc, code))
            first = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
            n = np.diff(np.append(first, len(order)))
            for i in range(0, len(first), 20_000):
                at = order[first[i : i + 20_000]]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * window), len(at), [None, pa.py_buffer(np.ascontiguousarray(words[at]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(code[at]), pa.array(n[i : i + 20_000], pa.int64()), pa.array(doc[at]), packed], names=names)

        for b in slices(batches):
            b = b.filter(pa.array(is_marked(heads.value, b.column(2).to_numpy())))
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                code = word_codes(text.encode())
                anchor = anchors(code, window)[1]
                at = np.flatnonzero(np.isin(anchor, hot.value))
                if len(at):
                    own, first = np.unique(grams(code, window)[at].astype(np.int64), return_index=True)
                    at = at[first]
                    pending.append((anchor[at], own, np.full(len(at), doc, np.int64), np.lib.stride_tricks.sliding_window_view(code, window)[at]))
                    size += len(at)
                    if size > 200_000:
                        yield from rows()
                        pending, size = [], 0
        if pending:
            yield from rows()

    return count


def hot_automaton(judged: DataFrame, window: int, heads, frequent: list[int], most: int) -> tuple[FrozenAutomaton, np.ndarray]:
    """Of all repeated windows at the first of the `frequent` anchors that have room, and these anchors. Any choice of anchors gives the same
    result; what is left out goes to the shards."""
    machine, hot = SuffixAutomaton(), []
    if frequent:
        asked = judged.sparkSession.sparkContext.broadcast(np.array(frequent, np.int64))
        counts = judged.select("doc_id", "text", "row_key").mapInArrow(_hot_windows(window, heads, asked), "anchor long, code long, n long, doc_id long, words binary")
        summed = counts.groupBy("anchor", "code").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"), F.any_value("words").alias("words"))
        windows = stored(summed.where("n > 1"), "hot-windows")
        sizes, left = {r["anchor"]: r["count"] for r in windows.groupBy("anchor").count().collect()}, most  # a row for each of the anchors
        for a in frequent:
            if sizes.get(a, 0) <= left:
                left -= sizes.get(a, 0)
                hot.append(a)
        rows = windows.where(F.col("anchor").isin(hot)).select("doc_id", "words").collect() if hot else []  # `most` rows of 13 words at most
        for doc, words in sorted(rows, key=lambda r: r["doc_id"]):
            machine.add(np.frombuffer(words, "<u8").tolist(), doc)
    return FrozenAutomaton(machine), np.array(sorted(hot), np.int64)


def _anchor_counts(window: int, heads):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0

        def rows() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(pending), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value), pa.array(n, pa.int64())], names=["anchor", "n"])

        for b in slices(batches):
            head = pa.array(is_marked(heads.value, b.column(0).to_numpy()))
            for text in texts_of(b.column(1).filter(head)):
                _, code = anchors(word_codes(text.encode()), window)
                if len(code):
                    pending.append(np.unique(code))
                    size += len(pending[-1])
            if size > 2_000_000:
                yield rows()
                pending, size = [], 0
        if pending:
            yield rows()

    return count


PARTS = "doc_id long, text_key long, start int, anchor long, stretch long, words binary"


def _stretches(window: int, heads, marked, hot, machine):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a place (doc_id, text_key, start) for each stretch, rows with the words and smallest doc_id of each distinct one, and
        places alone of windows that the broadcast automaton knows from a smaller doc_id."""
        known, bits = {}, marked.value
        names = ["doc_id", "text_key", "start", "anchor", "stretch", "words"]

        def distinct() -> Iterator[pa.RecordBatch]:
            items = list(known.items())
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for _, v in part], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int64()), pa.array([v[1] for _, v in part], pa.binary())], names=names)

        for b in slices(batches):
            docs, keys, starts, codes_out, hashes = [], [], [], [], []
            b = b.filter(pa.array(is_marked(heads.value, b.column(3).to_numpy())))
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                code = word_codes(text.encode())
                at, anchor = anchors(code, window)
                if not len(at):
                    continue
                hit = is_marked(bits, anchor)
                if not hit.any():
                    continue
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                last = np.append(first[1:], len(at))
                data = code.tobytes()
                past = hit & np.isin(anchor, hot.value)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], past, [False]])))
                for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # runs of windows at hot anchors
                    for k, doc1 in enumerate(machine.value.first_documents(code[i : j + window - 1], window), i):
                        if doc1 is not None and doc1 < doc:
                            docs.append(doc)
                            keys.append(key)
                            starts.append(k)
                            codes_out.append(None)
                            hashes.append(None)
                plain = (hit & ~past)[first]  # an anchor's windows are all hot or none is
                parts = [(i, j, int(anchor[i])) for i, j in zip(first[plain].tolist(), last[plain].tolist(), strict=True)]
                for i, j, shard in parts:
                    words = data[8 * i : 8 * (j + window - 1)]
                    k = (shard, xxhash.xxh3_64_intdigest(words) - (1 << 63))
                    had = known.get(k)
                    if had is None or doc < had[0]:
                        known[k] = (doc, words)
                    docs.append(doc)
                    keys.append(key)
                    starts.append(i)
                    codes_out.append(k[0])
                    hashes.append(k[1])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(codes_out, pa.int64()), pa.array(hashes, pa.int64()), pa.nulls(len(docs), pa.binary())], names=names)
            if len(known) > 300_000:
                yield from distinct()
                known = {}
        yield from distinct()

    return cut


def _shard(window: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (anchor, stretch, doc_id, words) by anchor and doc_id -> for each stretch the first document of each of its windows."""
        now, held, done, machine, size = None, None, set(), SuffixAutomaton(), 0  # held: an anchor's first stretch, not yet in the automaton
        for b in batches:
            rows = []
            for anchor, stretch, doc, words in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if anchor != now:
                    if size > MOST_WORDS:
                        machine, size = SuffixAutomaton(), 0
                    now, held, done = anchor, (words, doc), {stretch}
                    rows.append((anchor, stretch, [doc] * (len(words) // 8 - window + 1)))
                    continue
                if stretch in done:  # sent by another task as well
                    continue
                done.add(stretch)
                if held:
                    machine.add(np.frombuffer(held[0], "<u8").tolist(), held[1])
                    size, held = size + len(held[0]) // 8, None
                sequence = np.frombuffer(words, "<u8").tolist()
                found = machine.first_documents(sequence, window)
                if None in found:
                    machine.add(sequence, doc)
                    size += len(sequence)
                rows.append((anchor, stretch, [doc if x is None else x for x in found]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["anchor", "stretch", "firsts"])

    return match


def _removed(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, gone, kept = [], [], []
            for text, starts, copy in zip(texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts or [], np.int64))
                if copy and len(words) >= window:
                    at = np.arange(len(words) - window + 1)
                step[at] += 1
                np.add.at(step, at + window, -1)
                cover = np.cumsum(step[:-1]) > 0
                n.append(len(words))
                gone.append(int(cover.sum()))
                kept.append(b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c] if gone[-1] else words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return remove


def without_repeats(docs: DataFrame, window: int = 13, hot: int = HOT, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = plain.withColumn("text_key", F.xxhash64("text"))
    # of texts that are wholly equal only the first is searched; in the others every window has been there before
    rows = stored(keyed.where("doc_id is not null").select("doc_id", "text_key", F.xxhash64(F.lit(7), "text").alias("text_key2")), "rows")
    whole = stored(rows.groupBy("text_key", "text_key2").agg(F.min("doc_id").alias("first_id")), "whole")
    heads = marked_bits(whole.select(F.xxhash64("first_id", "text_key").alias("row_key")), "row_key", 26)
    copies = rows.join(whole, ["text_key", "text_key2"]).where("doc_id > first_id").select("doc_id", "text_key", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy"))

    judged = keyed.where("doc_id is not null").withColumn("row_key", F.xxhash64("doc_id", "text_key"))
    counts = judged.select("row_key", "text").mapInArrow(_anchor_counts(window, heads), "anchor long, n long")
    repeated = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = stored(repeated, "repeated")
    marked = marked_bits(repeated, "anchor", BITS)  # 32 MB, whatever the corpus
    frequent = [r["anchor"] for r in sorted(most_frequent(repeated, "n", hot).collect(), key=lambda r: (-r["n"], r["anchor"]))]  # `hot` rows at most
    machine, hot_anchors = map(docs.sparkSession.sparkContext.broadcast, hot_automaton(judged, window, heads, frequent, hot_windows))

    parts = stored(judged.select("doc_id", "text_key", "text", "row_key").mapInArrow(_stretches(window, heads, marked, hot_anchors, machine), PARTS), "stretches")
    sent = parts.where("words is not null").select("anchor", "stretch", "doc_id", "words")
    shards = sent.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "stretch")
    firsts = shards.mapInArrow(_shard(window), "anchor long, stretch long, firsts array<long>")
    places = parts.where("words is null and anchor is not null").select("doc_id", "text_key", "start", "anchor", "stretch")
    known = parts.where("words is null and anchor is null").select("doc_id", "text_key", F.array("start").alias("starts"), F.lit(False).alias("copy"))
    late = F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = places.join(firsts, ["anchor", "stretch"]).select("doc_id", "text_key", late.alias("starts"), F.lit(False).alias("copy")).where(F.size("starts") > 0)
    # no more than the text's windows, for each row of that id and text
    per_text = hits.unionByName(known).unionByName(copies).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.bool_or("copy").alias("copy"))
    marked_texts = keyed.join(per_text, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts", "copy")
    return marked_texts.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_text string")


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
