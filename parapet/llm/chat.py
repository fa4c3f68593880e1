"""Chat formatting over a prefix tree.

Conversations that share their initial turns share nodes of one tree: a node is a turn after a given sequence of turns (its id is
the digest of that sequence). Each node is formatted and tokenised once. Nodes are emitted depth-first, which is the order of their
paths, by a sort over the cluster; a running total over that order gives each node its place in the token stream. The position id
of a node's first token is the number of tokens of its ancestors, and its tokens attend to themselves and to the intervals of the
stream that its ancestors fill (joined where they follow each other). A first turn that many conversations share is one node, so no key carries their texts.

The template writes a turn as

    ### role: text </turn>\\n

with a backslash before every backslash, `###` and `</turn>` inside texts and roles and before every colon inside roles, so that the
turns can be read back. The loss mask covers the text of assistant turns.

A conversation's turns stream through one task in order, with running digests; only its path (16 characters a turn) is held whole.

Turns are ordered by `turn` (null first; ties by role, then text). Null roles and texts are empty. Rows without a conv_id are one
conversation. Repeated rows are turns of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import running_total, stored

OPEN, CLOSE, MASKED = "### ", " </turn>\n", "assistant"
CONTROL = re.compile(r"\\|###|</turn>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where the text stands in it."""
    head = OPEN + escape(role).replace(":", "\\:") + ": "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<#]|\\(?:###|</turn>|\\)|<(?!/turn>)|#(?!##))*) </turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


STEP = ["conv_id", "leaf", "depth", "path", "node", "parent", "role", "text"]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns by conversation and order -> a row for each, and after the last one a row with the conversation's last node and its path.
    Only the path and the last node of one conversation are held at a time."""
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 5]
    now, depth, node, path = None, 0, "", []
    started = False

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=STEP)

    def whole() -> tuple:
        return (now, node, None, "".join(path), None, None, None, None)

    for b in batches:
        rows = []
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if not started or conv != now:
                if started:
                    rows.append(whole())
                started, now, depth, node, path = True, conv, 0, "", []
            parent, node = node, hashlib.sha256(f"{node}\x00{role}\x00{text}".encode()).hexdigest()[:32]
            path.append(node[:16])
            rows.append((conv, None, depth, None, node, parent, role, text))
            depth += 1
        if rows:
            yield rows_of(rows)
    if started:
        yield rows_of([whole()])


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each walk (leaf, depth, node, stream_start, n_tokens), by leaf and depth -> for each: tokens before it, and the
    intervals of the stream that it attends to. In depth-first order a node's first child follows it at once, so intervals join and a
    conversation that shares nothing has a single one."""
    names = ["node", "position_start", "attention"]
    kind = pa.list_(pa.struct([("stream_start", pa.int64()), ("stream_end", pa.int64())]))
    now, before, spans = None, 0, []
    for b in batches:
        rows = []
        for leaf, _, node, start, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if leaf != now:
                now, before, spans = leaf, 0, []
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + n)
            else:
                spans.append((start, start + n))
            rows.append((node, before, [{"stream_start": x, "stream_end": y} for x, y in spans]))
            before += n
            if len(rows) * len(spans) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), kind), strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), kind), strict=True)], names=names)


def _emitted(path: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch
        for b in batches:
            done = [format_turn(r, t) for r, t in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            ids = [x.ids for x in encode([x for x, _, _ in done], add_special_tokens=False)]
            masked = [r == MASKED for r in b.column(4).to_pylist()]
            lo = pa.array([x if m else None for (_, x, _), m in zip(done, masked, strict=True)], pa.int32())
            hi = pa.array([x if m else None for (_, _, x), m in zip(done, masked, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), lo, hi], names=["node", "parent", "depth", "rank", "ids", "n_tokens", "loss_from", "loss_to"])

    return emit


def prefix_tree(conversations: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members).

    nodes: node, parent, depth, rank, ids, n_tokens, loss_from, loss_to (code points of the masked text in the formatted turn),
    stream_start (place of the first token in the depth-first stream), position_start, attention (intervals of the stream, root first,
    the last ends with the node's own tokens; neighbours are joined). members: conv_id, depth, node.
    """
    order = ["conv_id", "turn", "role", "text"]
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    sorted_turns = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    steps = stored(sorted_turns.mapInArrow(_paths, "conv_id long, leaf string, depth int, path string, node string, parent string, role string, text string"), "turns")
    ends = steps.where("leaf is not null").select("conv_id", "leaf", "path")
    members = steps.where("leaf is null").select("conv_id", "depth", "node", "parent", "role", "text")
    # depth-first: conversations by their paths; a node comes where the first conversation that has it comes, by depth
    paths = stored(ends.groupBy("leaf").agg(F.min("path").alias("path"), F.min(F.struct("conv_id")).alias("c")).withColumn("one", F.lit(1).cast("long")), "paths")
    ranks = running_total(paths.drop("c"), ["path", "leaf"], "one", "rank", "ranks").select("leaf", "rank")
    of_conv = ends.select("conv_id", "leaf").join(ranks, "leaf").select(F.struct("conv_id").alias("c"), "rank")
    of_conv = of_conv.select(F.xxhash64("c.conv_id").alias("k"), "c", "rank")
    ranked = members.withColumn("k", F.xxhash64("conv_id")).join(of_conv, "k").where(F.struct("conv_id").eqNullSafe(F.col("c")))
    distinct = ranked.groupBy("node", "parent", "depth").agg(F.min("rank").alias("rank"), F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    distinct = distinct.select("node", "parent", "depth", "rank", "role", "text")
    schema = "node string, parent string, depth int, rank long, ids array<int>, n_tokens long, loss_from int, loss_to int"
    emitted = stored(distinct.mapInArrow(_emitted(tokenizer_path), schema), "emitted")  # stored: range partitioning reads it twice
    starts = running_total(emitted.select("node", "rank", "depth", "n_tokens"), ["rank", "depth"], "n_tokens", "stream_start", "stream").select("node", "stream_start")
    emitted = stored(emitted.join(starts, "node"), "nodes")
    # one walk for each leaf: that of its smallest conversation
    walks = paths.select("leaf", F.xxhash64("c.conv_id").alias("k"), "c").join(members.withColumn("k", F.xxhash64("conv_id")), "k").where(F.struct("conv_id").eqNullSafe(F.col("c")))
    places = walks.select("leaf", "depth", "node").join(emitted.select("node", "stream_start", "n_tokens"), "node")
    ordered = places.select("leaf", "depth", "node", "stream_start", "n_tokens").repartition("leaf").sortWithinPartitions("leaf", "depth")
    seen = ordered.mapInArrow(_attention, "node string, position_start long, attention array<struct<stream_start:bigint,stream_end:bigint>>")
    nodes = emitted.join(seen.groupBy("node").agg(F.any_value("position_start").alias("position_start"), F.any_value("attention").alias("attention")), "node")
    return nodes, members.select("conv_id", "depth", "node")


def _read_back(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of the turns (conv_id, depth, ids, loss_from, loss_to) by conversation and depth -> a row for each conversation; digests
        run along, so that one batch of turns is held at a time."""
        decode = tokenizer(path).decode_batch
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        started, now, n, chars, loss_chars, turns_digest, loss_digest = False, None, 0, 0, 0, None, None

        def row() -> tuple:
            return (now, n, turns_digest.hexdigest(), loss_chars, loss_digest.hexdigest(), chars)

        for b in batches:
            rows = []
            pieces = decode(b.column(2).to_pylist(), skip_special_tokens=False)
            for conv, piece, lo, hi in zip(b.column(0).to_pylist(), pieces, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if not started or conv != now:
                    if started:
                        rows.append(row())
                    started, now, n, chars, loss_chars, turns_digest, loss_digest = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(piece):
                    turns_digest.update(f"{role}\n{text}\n".encode())
                    n += 1
                if lo is not None:
                    loss = unescape(piece[lo:hi])
                    loss_digest.update(loss.encode())
                    loss_chars += len(loss)
                chars += len(piece)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names=names)

    return read


def read_back(nodes: DataFrame, members: DataFrame, tokenizer_path: str) -> DataFrame:
    """Conversations put together again from the emitted tokens: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = members.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node").select("conv_id", "depth", "ids", "loss_from", "loss_to")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(_read_back(tokenizer_path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The contract's own conversation.
EXTRA = [(-7, 0, role, "\\### Assistant: </turn> ok") for role in ("user", "assistant")]


def report(conversations: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = conversations.sparkSession.createDataFrame([(c, i, r, t) for i, (c, _, r, t) in enumerate(EXTRA)], "conv_id long, turn long, role string, text string")
    nodes, members = prefix_tree(conversations.select("conv_id", "turn", "role", "text").unionByName(extra), path)
    return read_back(nodes, members, path)
