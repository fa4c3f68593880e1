"""Office documents: what container a file is, whether it is encrypted, its macros' source, and where its relationships lead.

Containers are taken apart inside tasks, a file at a time: a zip's manifests and macro projects, or the streams of a compound file, by its
chains of sectors. What is found are rows (parts); relationships, keywords and risk are DataFrame work on them.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import strings as S
from parapet.operators import macros
from parapet.sources.shared import stored

ZIP, COMPOUND = b"PK\x03\x04", bytes.fromhex("d0cf11e0a1b11ae1")
LARGEST = 256 << 20  # bytes of one part; a document with a larger one is reported as unreadable
#: Fixed values of the compound file format: ends of chains begin here; kinds of directory entries.
SPECIAL, STORAGE, STREAM, ROOT = 0xFFFFFFFA, 1, 2, 5
#: Streams of a macro project that hold structure rather than code, and names that a project has.
METADATA = {"dir", "_vba_project", "project", "projectwm", "projectlk", "compobj", "summaryinformation", "documentsummaryinformation"}
PROJECT = {"vba", "_vba_project", "dir", "thisdocument"}


class Compound:
    """Streams of a compound file. A chain ends where it leaves the file or meets itself, so a broken file gives short streams."""

    def __init__(self, raw: bytes) -> None:
        if len(raw) < 512 or raw[:8] != COMPOUND:
            raise ValueError("no compound file")
        self.words = lambda at, n: np.frombuffer(raw, "<u4", n, at)
        shift = int.from_bytes(raw[30:32], "little")
        if shift not in (9, 12):
            raise ValueError("no such sector size")
        self.raw, self.size = raw, 1 << shift
        head = self.words(44, 8)
        n_tables, first_entry, self.cutoff, first_mini, first_more = int(head[0]), int(head[1]), int(head[3]), int(head[4]), int(head[6])
        tables, more, seen = self.words(76, 109).tolist(), first_more, set()
        while more < SPECIAL and more not in seen and (x := self._sector(more)):
            seen.add(more)
            *found, more = np.frombuffer(x, "<u4").tolist()
            tables += found
        parts = [np.frombuffer(x, "<u4") for t in tables[:n_tables] if t < SPECIAL and len(x := self._sector(t)) == self.size]
        self.next = np.concatenate(parts) if parts else np.empty(0, "<u4")
        self.entries = [e for e in self._entries(self._chain(first_entry)) if e[1]]
        root = next((e for e in self.entries if e[1] == ROOT), None)
        self.mini = self._chain(root[2]) if root else b""
        table = self._chain(first_mini)
        self.mini_next = np.frombuffer(table[: len(table) // 4 * 4], "<u4")

    def _sector(self, n: int) -> bytes:
        return self.raw[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, at: int, small: bool = False) -> bytes:
        step, next_, out = (64, self.mini_next, []) if small else (self.size, self.next, [])
        for _ in range(len(next_)):
            if at >= len(next_):
                break
            out.append(self.mini[at * 64 : at * 64 + 64] if small else self._sector(at))
            if len(out[-1]) < step:
                break
            at = int(next_[at])
        return b"".join(out)

    def _entries(self, data: bytes) -> Iterator[tuple[str, int, int, int]]:
        for i in range(0, len(data) - 127, 128):
            e = data[i : i + 128]
            n = int.from_bytes(e[64:66], "little")
            size = int.from_bytes(e[120 : 128 if self.size > 512 else 124], "little")
            yield e[: max(min(n, 64) - 2, 0)].decode("utf-16-le", "replace"), e[66], int.from_bytes(e[116:120], "little"), size

    def streams(self) -> Iterator[tuple[str, bytes]]:
        for name, kind, start, size in self.entries:
            if kind == STREAM and 0 < size <= len(self.raw):
                yield name, self._chain(start, size < self.cutoff)[:size]


def chunk(data: bytes, at: int) -> tuple[bytes, int]:
    """One chunk of a compressed container, and where the next one begins. The split of a copy token moves with what the chunk holds."""
    head = int.from_bytes(data[at : at + 2], "little")
    end, at = min(at + (head & 0xFFF) + 3, len(data)), at + 2
    if not head & 0x8000:
        return data[at:end], end
    out = bytearray()
    while at < end:
        flags, at = data[at], at + 1
        for bit in range(8):
            if at >= end:
                break
            if not flags >> bit & 1:
                out.append(data[at])
                at += 1
                continue
            if at + 2 > end:
                return bytes(out), end
            token, at = int.from_bytes(data[at : at + 2], "little"), at + 2
            split = min(max((len(out) - 1).bit_length(), 4), 12)
            back, n = (token >> 16 - split) + 1, (token & 0xFFFF >> split) + 3
            if back > len(out):
                raise ValueError("copies from before the chunk")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out), end


def decompressed(data: bytes) -> bytes:
    """A compressed container: a signature byte, then chunks. What is broken ends it."""
    out, at = [], 1
    try:
        while data[:1] == b"\x01" and at + 2 < len(data):
            made, at = chunk(data, at)
            out.append(made)
    except ValueError:
        pass
    return b"".join(out)


def _is_text(data: bytes) -> bool:
    plain = np.frombuffer(data, np.uint8)
    return len(data) >= 16 and ((plain >= 0x20) & (plain < 0x7F) | np.isin(plain, (9, 10, 13))).mean() > 0.9


def module_source(stream: bytes) -> str:
    """The source of a module: the first container in its stream that holds text. Containers show by their signature and the mark in the
    first chunk's header; a first chunk that is no text is no source."""
    x = np.frombuffer(stream, np.uint8)
    for at in np.flatnonzero((x[:-2] == 1) & (x[2:] & 0x70 == 0x30)).tolist() if len(x) > 2 else []:
        try:
            if _is_text(chunk(stream, at + 1)[0]):
                return decompressed(stream[at:]).decode("latin-1")
        except ValueError:
            continue
    return ""


def _modules(project: Compound) -> Iterator[tuple[str, str]]:
    for name, data in project.streams():
        if name.lower() not in METADATA and name[:1] not in ("\x01", "\x05") and (text := module_source(data)):
            yield name, text


def parts(raw: bytes | None) -> Iterator[tuple[str, str | None, str | None, bool | None, bool | None]]:
    """(kind, name, text, encrypted, known): first `file` with its container as name, encrypted, and whether its macros can be told; then a row
    for each `rels` manifest and each `module`. A file that is neither container has a name of null and says nothing."""
    raw = raw or b""
    found: list[tuple] = []
    if raw[:4] == ZIP:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                known = True
                for info in z.infolist():
                    base, rels = info.filename.rsplit("/", 1)[-1].lower(), info.filename.endswith(".rels") and "_rels/" in info.filename
                    if not (rels or base == "vbaproject.bin"):
                        continue
                    with z.open(info) as f:
                        data = f.read(LARGEST + 1)
                    if len(data) > LARGEST:
                        raise ValueError("too large")
                    if rels:
                        found.append(("rels", info.filename, data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace"), None, None))
                        continue
                    try:
                        found += [("module", name, text, None, None) for name, text in _modules(Compound(data))]
                    except ValueError:  # a project that can't be read is not "no macros"
                        known = False
            yield "file", "OpenXML", None, False, known
        except (zipfile.BadZipFile, ValueError, OSError, RuntimeError, NotImplementedError, EOFError):
            yield "file", None, None, None, None
            return
    elif raw[:8] == COMPOUND:
        try:
            c = Compound(raw)
        except ValueError:
            yield "file", "OLE", None, None, False
            return
        names = {e[0].lower() for e in c.entries}
        if "encryptedpackage" in names:
            yield "file", "OLE", None, True, False
            return
        found = [("module", name, text, None, None) for name, text in _modules(c)]
        yield "file", "OLE", None, False, bool(found) or not names & PROJECT
    else:
        yield "file", None, None, None, None
    yield from found


def taken_apart(files: DataFrame, key: str, content: str) -> DataFrame:
    """row (unique), _key, ordinal, kind, name, text, encrypted, known: see `parts`."""
    schema = f"row long, _key {files.schema[key].dataType.simpleString()}, ordinal int, kind string, name string, text string, encrypted boolean, known boolean"
    key_type = files.select(key).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for k, raw in zip(b.column(0), b.column(1), strict=True):
                rows = list(parts(raw.as_py()))
                columns = zip(*rows, strict=True)
                kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
                arrays = [pa.array([row] * len(rows), pa.int64()), pa.array([k.as_py()] * len(rows), key_type), pa.array(range(len(rows)), pa.int32()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "_key", "ordinal", "kind", "name", "text", "encrypted", "known"])
                row += 1

    return files.select(key, F.col(content).cast("binary")).mapInArrow(run, schema)


def relationships(manifest: Column) -> Column:
    """array of struct(name, type, target, external, target_url) of a manifest's XML; null if it isn't well-formed. Only what lies outside the
    package is a URL; the target stays as written."""
    found = F.from_xml(manifest, "Relationship array<struct<_Id:string,_Type:string,_Target:string,_TargetMode:string>>", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})["Relationship"]

    def one(r: Column) -> Column:
        external = F.coalesce(F.lower(r["_TargetMode"]) == "external", F.lit(False))
        return F.struct(r["_Id"].alias("name"), r["_Type"].alias("type"), r["_Target"].alias("target"), external.alias("external"), F.when(external, S.parse_url(r["_Target"])).alias("target_url"))

    return F.transform(F.filter(found, lambda r: r["_Target"].isNotNull() & (r["_Target"] != "")), one)


def examine(files: DataFrame, key: str, content: str) -> DataFrame:
    """Per file: key, format (OpenXML, OLE, or null for anything else), encrypted, macros (null where that can't be told), risk, keywords, source,
    behaviour, relationships, external (how many lead outside; null if none). Nothing is claimed of a file that is no document."""
    table = stored(taken_apart(files, key, content), "parts")
    facts = table.where("kind = 'file'").select("row", "_key", F.col("name").alias("format"), "encrypted", "known")
    modules = table.where("kind = 'module'").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("m"))
    modules = modules.select("row", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("source")).withColumn("_signs", macros.signs("source"))
    modules = modules.select("row", "source", macros.keywords(F.col("_signs")).alias("keywords"), macros.behaviour(F.col("source"), F.col("_signs")).alias("behaviour"))
    rels = table.where("kind = 'rels'").select("row", "ordinal", F.explode(relationships(F.col("text"))).alias("r"))
    rels = rels.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "r"))), lambda x: x["r"]).alias("relationships"), F.count_if(F.col("r.external")).alias("n"))
    macros_ = F.when(F.col("known"), F.col("source").isNotNull())
    risk = F.when(macros_, macros.risk(F.col("keywords"))).when(~macros_, "none")
    return facts.join(modules, "row", "left").join(rels, "row", "left").select(
        F.col("_key").alias(key), "format", "encrypted", macros_.alias("macros"), risk.alias("risk"), "keywords", "source", "behaviour",
        "relationships", F.when(F.col("n") > 0, F.col("n")).alias("external"),
    )
