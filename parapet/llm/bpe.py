"""Byte-level BPE by merge replay over the distinct pieces of the corpus.

1. Texts are cut at single spaces. The pieces are counted over the corpus; the most frequent ones, at most `FREQUENT`, are dealt out
   over the cluster, and each task replays the merges for its share of them: their distinct words are laid out as one array of byte
   tokens with links to the neighbours, an inverted index leads from a token pair (by its rank) to all positions where it stands in any
   word, merges are applied in rank order, each to all its positions at once, and only the pairs with the touched neighbours enter the
   index anew. The table of their ids is broadcast; its bound is `FREQUENT` short pieces.
2. Whole texts are put together from their pieces. What the table lacks (rare pieces, whatever lies between odd white space) is replayed
   in the same way for a block of texts at a time: joining a table of all pieces back would shuffle every word of every text. The ids
   of a word don't depend on where it is replayed.

Null texts are empty: no ids, the digest of nothing. Rows keep their doc_id, null or repeated. A text without single spaces is one
piece. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import most_frequent, stored, texts_of
from parapet.llm.tokens import byte_vocabulary

#: The characters with Unicode's White_Space property, as a regular expression class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
FREQUENT, LONGEST = 131_072, 64  # pieces of the broadcast table, and their characters at most: some 10 MB
MOST_PIECES = 600_000  # pieces that a worker remembers, those of the table included
BLOCK_ROWS, BLOCK_BYTES = 4_000, 24_000_000


class MergeReplay:
    def __init__(self, ranks_path: str):
        import re

        import regex

        ranks = byte_vocabulary(ranks_path)
        self.token = {i: b for b, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted((ranks[b[:i]] << 32 | ranks[b[i:]], rank) for b, rank in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks)
        self.pair, self.rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.coarse = re.compile(f"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]")
        self.words = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.digits = {i: str(i) for i in self.token}
        self.table: dict[str, tuple[str, bytes]] | None = None
        self.known: dict[str, tuple[str, bytes]] = {}  # pieces that follow a space: the table's, and rare ones
        self.whole: dict[str, tuple[str, bytes]] = {}  # of this block, with their white space

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        return [np.array(x, np.int64) for x in self.replay(words)]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, none of them empty."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n  # no neighbour beyond a word
        before[np.concatenate([[0], ends[:-1]])] = -1
        after, before = np.append(after, n), np.append(before, -1)
        token = np.append(token, -1)
        index: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def post(at: np.ndarray) -> None:
            """Enter the pairs that start at these positions into the index."""
            at = at[(at >= 0) & (after[at] < n)]
            rank = self.ranks_of(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            cuts = [0, *starts.tolist(), len(rank)]
            for i, j, r in zip(cuts, cuts[1:], rank[[0, *starts]].tolist() if len(rank) else (), strict=False):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(due, r)

        post(np.arange(n))
        while due:
            r = heapq.heappop(due)
            found = index.pop(r)
            at = np.sort(np.concatenate(found) if len(found) > 1 else found[0])
            once = token[at] >= 0
            once[1:] &= at[1:] != at[:-1]
            at = at[once]
            at = at[after[at] < n]
            at = at[self.ranks_of(token[at], token[after[at]]) == r]  # still there
            if len(at) > 1:
                linked = after[at[:-1]] == at[1:]
                if linked.any():  # overlapping matches: every second one of a chain, from the left
                    start = np.concatenate([[True], ~linked])
                    first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            token[at] = r
            token[gone] = -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left = before[at]
            post(np.concatenate([left, at]))  # what is entered twice is merged once
        live = token[:n] >= 0
        upto, ids = np.cumsum(live)[ends - 1].tolist(), token[:n][live].tolist()
        return [ids[i:j] for i, j in zip([0, *upto], upto, strict=False)]

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[str, bytes]]:
        """(ids joined by spaces, decoded bytes) of each piece."""
        split = [[p] if p[1:].isalpha() and p.isascii() and p[0] == " " else self.words(p) for p in pieces]
        words = list(set(chain.from_iterable(split)))
        number, token, done = self.digits.__getitem__, self.token.__getitem__, {}
        for w, ids in zip(words, self.replay([w.encode() for w in words]), strict=True):
            done[w] = (" ".join(map(number, ids)), b"".join(map(token, ids)))
        return {p: done[ws[0]] if len(ws) == 1 else (" ".join([done[w][0] for w in ws]), b"".join([done[w][1] for w in ws])) for p, ws in zip(pieces, split, strict=True)}

    def learn(self, texts: list[str], table: dict[str, tuple[str, bytes]]) -> list[list[str]]:
        """Cuts the texts into pieces that nothing spans, all of them known afterwards: at single spaces where that is plain to see,
        else by the coarse pattern, after an empty piece."""
        if self.table is not table or len(self.known) > MOST_PIECES:
            self.table, self.known = table, dict(table)
        cut = [t.split(" ") for t in texts]
        new: set[str] = set()
        for parts in cut:
            new.update(parts[1:])
        new.difference_update(self.known)
        odd = {p for p in new if not is_plain(p)}
        new -= odd
        pieces = {" " + p for p in new}
        for i, parts in enumerate(cut):
            if parts[0] and not parts[0][-1].isspace() and odd.isdisjoint(parts[1:]):
                pieces.add(parts[0])
            else:
                cut[i] = ["", *self.coarse.findall(texts[i])]
                pieces.update(cut[i][1:])
        self.whole = self.encode_pieces(list(pieces))
        self.known.update((p, self.whole[" " + p]) for p in new)
        return cut

    def look_up(self, parts: list[str]) -> list[tuple[str, bytes]]:
        if parts[0]:
            return [self.whole[parts[0]], *map(self.known.__getitem__, parts[1:])]
        return [self.whole[p] for p in parts[1:]]


def is_plain(piece: str) -> bool:
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


@lru_cache(maxsize=2)
def merge_replay(ranks_path: str) -> MergeReplay:
    return MergeReplay(ranks_path)


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        """What was met once among so many is left out: counts only decide which pieces the table has."""
        items = [(p, n) for p, n in found.items() if n > 1 and len(p) <= LONGEST and is_plain(p)]
        found.clear()
        for i in range(0, len(items), 50_000):
            pieces, n = zip(*items[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(n, pa.int64())], names=["piece", "n"])

    for b in batches:
        for text in texts_of(b.column(0)):
            found.update(text.split(" ")[1:])
            if len(found) > 200_000:
                yield from rows()
    yield from rows()


def frequent_pieces(docs: DataFrame, ranks_path: str, most: int = FREQUENT) -> dict[str, tuple[str, bytes]]:
    """The most frequent pieces of the corpus, replayed once over the cluster."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_piece_counts, "piece string, n long")
    counts = stored(counts.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [p for b in batches for p in b.column(0).to_pylist()]  # a share of at most `most`
        done = merge_replay(ranks_path).encode_pieces([" " + p for p in pieces])
        if pieces:
            ids, raw = zip(*(done[" " + p] for p in pieces), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(ids, pa.string()), pa.array(raw, pa.binary())], names=["piece", "ids", "raw"])

    table = most_frequent(counts, "n", most).select("piece").repartition("piece").mapInArrow(replayed, "piece string, ids string, raw binary")
    return {p: (ids, bytes(raw)) for p, ids, raw in table.collect()}  # at most `most` rows


def encode_and_decode(docs: DataFrame, ranks_path: str, most: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the bytes decoded from the ids)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, ranks_path, most))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, frequent = merge_replay(ranks_path), table.value
        gc.disable()  # millions of small values and no cycles
        try:
            for whole in batches:
                rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES * whole.num_rows // (whole.nbytes + 1)))
                for at in range(0, whole.num_rows, rows):
                    b = whole.slice(at, rows)
                    texts = texts_of(b.column(1))
                    n, ids_sha, raw_sha = [], [], []
                    cut = replay.learn(texts, frequent)
                    for parts in cut:
                        both = replay.look_up(parts)
                        ids = " ".join([x for x, _ in both])
                        n.append(ids.count(" ") + 1 if ids else 0)
                        ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                        raw_sha.append(hashlib.sha256(b"".join([x for _, x in both])).hexdigest())
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(blocks, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def production(docs: DataFrame) -> DataFrame:
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
