"""Files inside attachments: zip, tar and gzip to a depth, one row for each file found."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBERS, BYTES = 10_000, 256 << 20  # of an archive; what goes beyond is reported, not read


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and contents; nothing for a file that is no archive. Raises if the archive is broken or too large."""
    left = BYTES
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
                left -= info.file_size
                if left < 0 or i >= MEMBERS:
                    raise ValueError("too large")
                yield info.filename, z.read(info)
    elif data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
            inner = g.read(BYTES + 1)
        if len(inner) > BYTES:
            raise ValueError("too large")
        yield "content", inner
    elif data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for i, info in enumerate(x for x in t if x.isfile()):
                left -= info.size
                if left < 0 or i >= MEMBERS:
                    raise ValueError("too large")
                yield info.name, t.extractfile(info).read()


def _walk(data: bytes, path: str, depth: int, most: int) -> Iterator[tuple]:
    try:
        for name, inner in members(data):
            here = f"{path}/{name}" if path else name
            yield here, depth, len(inner), hashlib.sha256(inner).hexdigest(), re.sub(r"^.*\.|^[^.]*$", "", name).lower(), inner[:16], None
            if depth < most:
                yield from _walk(inner, here, depth + 1, most)
    except Exception as e:  # a broken archive is a finding
        yield path, depth, None, None, None, None, f"{type(e).__name__}: {e}"


def expand(files: DataFrame, key: str, content: str, max_depth: int = 5) -> DataFrame:
    """key, path, depth, size, sha256, extension, head, error: a row for each file in the archives of `content`."""
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, path string, depth int, size long, sha256 string, extension string, head binary, error string"
    kind = files.select(key).limit(0).toArrow().schema.field(0).type
    kinds = [kind, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = [key, "path", "depth", "size", "sha256", "extension", "head", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(k, *r) for r in _walk(data.as_py() or b"", "", 1, max_depth)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select(key, F.col(content).cast("binary")).mapInArrow(run, schema)


def office_signs(found: DataFrame, key: str) -> DataFrame:
    """Per file: whether an OOXML file holds a macro project, external targets' parts, embedded objects or ActiveX."""
    has = lambda pattern: F.bool_or(F.rlike("path", F.lit(pattern)))
    return found.groupBy(key).agg(has(r"(?i)vbaProject\.bin$").alias("macros"), has(r"(?i)externalLinks/").alias("external_links"), has(r"(?i)embeddings/").alias("embedded"), has(r"(?i)activeX/").alias("activex"))
