"""Office documents: compound files written here from the format's description, macros, relationships, and what can't be told."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from parapet.operators import macros
from parapet.sources import office

END, TABLE = 0xFFFFFFFE, 0xFFFFFFFD


def compressed(data: bytes) -> bytes:
    """A compressed container, with copy tokens for whatever stood in the chunk before."""
    out = b"\x01"
    for start in range(0, len(data), 3600):
        part, at, body = data[start : start + 3600], 0, b""
        while at < len(part):
            flags, items = 0, b""
            for bit in range(8):
                if at >= len(part):
                    break
                split = min(max((at - 1).bit_length() if at else 0, 4), 12)
                best = (0, 0)
                for back in range(1, min(at, 300, 1 << split) + 1):
                    n = 0
                    while n < min(60, (0xFFFF >> split) + 3) and at + n < len(part) and part[at + n - back] == part[at + n]:
                        n += 1
                    best = max(best, (n, -back))
                if best[0] >= 3:
                    items += struct.pack("<H", (-best[1] - 1) << (16 - split) | best[0] - 3)
                    flags |= 1 << bit
                    at += best[0]
                else:
                    items += part[at : at + 1]
                    at += 1
            body += bytes([flags]) + items
        out += struct.pack("<H", 0xB000 | len(body) - 1) + body
    return out


def compound(streams: dict[str, bytes], storages: tuple[str, ...] = (), shift: int = 9) -> bytes:
    size, sectors, table = 1 << shift, [], []
    step = size // 4

    def put(data: bytes) -> int:
        first = len(sectors)
        n = max(1, -(-len(data) // size))
        sectors.extend(data[i * size : (i + 1) * size].ljust(size, b"\0") for i in range(n))
        table.extend([*range(first + 1, first + n), END])
        return first

    mini, mini_table, entries = b"", [], []
    for name, data in streams.items():
        if len(data) < 4096:
            first, n = len(mini_table), max(1, -(-len(data) // 64))
            mini_table += [*range(first + 1, first + n), END]
            mini += data.ljust(64 * n, b"\0")
        else:
            first = put(data)
        entries.append((name, 2, first, len(data)))
    entries = [("Root Entry", 5, put(mini) if mini else END, len(mini)), *[(s, 1, 0, 0) for s in storages], *entries]
    pack = lambda e: e[0].encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(e[0]) + 2, e[1], 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", e[2], e[3])
    first_entry = put(b"".join(map(pack, entries)))
    first_mini = put(struct.pack(f"<{len(mini_table)}I", *mini_table).ljust(size, b"\xff")) if mini_table else END
    n = 1
    while len(table) + n + (more := max(0, -(-(n - 109) // (step - 1)))) > n * step:
        n += 1
    at = len(sectors)
    table += [TABLE] * n + [0xFFFFFFFC] * more
    data = struct.pack(f"<{len(table)}I", *table).ljust(n * size, b"\xff")
    sectors += [data[i * size : (i + 1) * size] for i in range(n)]
    places = [*range(at, at + n)]
    for i in range(more):
        held = places[109 + i * (step - 1) : 109 + (i + 1) * (step - 1)]
        sectors.append(struct.pack(f"<{step}I", *held, *[0xFFFFFFFF] * (step - 1 - len(held)), at + n + i + 1 if i + 1 < more else END))
    head = office.COMPOUND + bytes(16) + struct.pack("<HHHHH", 0x3E, 3 if shift == 9 else 4, 0xFFFE, shift, 6) + bytes(6)
    head += struct.pack("<9I", 0, n, first_entry, 0, 4096, first_mini, 1, at + n if more else END, more)
    head += struct.pack("<109I", *[*places, *[0xFFFFFFFF] * 109][:109])
    return head.ljust(size, b"\0") + b"".join(sectors)


def package(**members: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def rels(*rows: tuple) -> bytes:
    inner = "".join(f'<Relationship Id="{i}" Type="http://x/{t}" Target="{target}"{" TargetMode=" + chr(34) + mode + chr(34) if mode else ""}/>' for i, t, target, mode in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'.encode()


def module(source: str) -> bytes:
    return b"\x16\x01\x00\x01\x01\x30cache" + compressed(f'Attribute VB_Name = "M"\r\n{source}'.encode("latin-1"))


def project(*sources: str) -> bytes:
    return compound({"dir": compressed(b"x" * 40), **{f"Module{i}": module(s) for i, s in enumerate(sources)}}, ("VBA",))


OPENS = 'Sub AutoOpen()\r\nSet o = CreateObject("WScript.Shell")\r\no.Run "cmd.exe /c x"\r\nShell ("calc")\r\nu = "http://e.test/a"\r\nEnd Sub\r\n'
FORMATS = "Sub Formatting()\r\nTable.Width = 3\r\nEnd Sub\r\n" * 3


@pytest.fixture(scope="module")
def seen(spark):
    out = lambda target, mode="External", kind="attachedTemplate": {"word/_rels/settings.xml.rels": rels(("r1", kind, target, mode), ("r2", "styles", "styles.xml", None))}
    files = {
        "remote": package(**{"[Content_Types].xml": b"<Types/>"}, **out("http://198.51.100.9/t.dotm")),
        "unc": package(**out("file://203.0.113.5/share/t.dotm")),
        "mhtml": package(**out("mhtml:http://e.test/a.html!x-usc:http://e.test/a.html")),
        "inside": package(**{"_rels/.rels": rels(("r1", "doc", "word/document.xml", None))}),
        "utf16": package(**{"_rels/.rels": rels(("r1", "doc", "http://u.test/", "external")).decode().replace("UTF-8", "UTF-16").encode("utf-16")}),
        "not xml": package(**{"_rels/.rels": b"<Relationships><Relationship"}),
        "macro": package(**{"word/vbaProject.bin": project(OPENS, FORMATS)}),
        "benign": package(**{"xl/vbaProject.bin": project(FORMATS)}),
        "no project": package(**{"word/vbaProject.bin": b"garbage"}),
        "old": compound({"WordDocument": bytes(5000), "ThisDocument": module(OPENS)}, ("VBA",)),
        "old, plain": compound({"WordDocument": bytes(9000), "\x05SummaryInformation": b"x" * 100}),
        "old, unreadable": compound({"WordDocument": bytes(5000), "Module1": b"\xff" * 300}, ("VBA",)),
        "encrypted": compound({"EncryptedPackage": bytes(6000), "EncryptionInfo": bytes(200)}),
        "broken": office.COMPOUND + bytes(600),
        "png": b"\x89PNG\r\n\x1a\n",
        "nearly": b"PK\x03\x04\x00",
        "empty": b"",
        "null": None,
    }
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()] + [("macro", bytearray(files["macro"]))], "name string, raw binary").repartition(3)
    return {r["name"]: r for r in office.examine(df, "name", "raw").collect()}


def test_relationships(seen):
    remote = seen["remote"]
    assert (remote.format, remote.encrypted, remote.macros, remote.risk, remote.external) == ("OpenXML", False, False, "none", 1)
    first, second = remote.relationships
    assert (first.name, first.target, first.target_url.scheme, first.target_url.ip) == ("r1", "http://198.51.100.9/t.dotm", "http", "198.51.100.9")
    assert (second.target, second.external, second.target_url) == ("styles.xml", False, None)
    assert (seen["unc"].relationships[0].target_url.scheme, seen["unc"].relationships[0].target_url.host) == ("file", "203.0.113.5")
    assert seen["mhtml"].relationships[0].target.startswith("mhtml:http://") and "x-usc:" in seen["mhtml"].relationships[0].target
    assert seen["inside"].external is None and len(seen["inside"].relationships) == 1
    assert seen["utf16"].external == 1
    assert seen["not xml"].relationships is None and seen["not xml"].macros is False


def test_macros(seen):
    macro = seen["macro"]
    assert (macro.macros, macro.risk, macro.encrypted) == (True, "high", False)
    assert macro.source == f'Attribute VB_Name = "M"\r\n{OPENS}\nAttribute VB_Name = "M"\r\n{FORMATS}'
    assert {(k.type, k.keyword) for k in macro.keywords} >= {("AutoExec", "AutoOpen"), ("Suspicious", "Shell"), ("Suspicious", "WScript.Shell"), ("Suspicious", "Run"), ("Suspicious", "cmd.exe")}
    assert (macro.behaviour.families, macro.behaviour.score, macro.behaviour.malicious, macro.behaviour.confidence) == (["autorun", "execution", "network"], 8.0, True, "high")
    assert (seen["benign"].macros, seen["benign"].risk, seen["benign"].behaviour.malicious) == (True, "none", False)
    assert (seen["old"].format, seen["old"].macros, seen["old"].risk) == ("OLE", True, "high")


def test_what_cannot_be_told_is_not_denied(seen):
    assert (seen["encrypted"].encrypted, seen["encrypted"].macros, seen["encrypted"].risk) == (True, None, None)
    assert (seen["old, plain"].encrypted, seen["old, plain"].macros) == (False, False)
    assert (seen["old, unreadable"].encrypted, seen["old, unreadable"].macros) == (False, None)
    assert (seen["no project"].format, seen["no project"].macros) == ("OpenXML", None)
    assert (seen["broken"].format, seen["broken"].macros, seen["broken"].encrypted) == ("OLE", None, None)
    for name in ("png", "nearly", "empty", "null"):
        r = seen[name]
        assert (r.format, r.encrypted, r.macros, r.risk, r.relationships, r.source) == (None,) * 6


def test_repeated_files_and_none(spark, seen):
    df = spark.createDataFrame([], "name string, raw binary")
    assert office.examine(df, "name", "raw").collect() == []
    twice = spark.createDataFrame([("a", bytearray(b"x"))] * 2, "name string, raw binary")
    assert len(office.examine(twice, "name", "raw").collect()) == 2


def test_copy_tokens():
    body = b"\x08abc\x00\x20"  # three literals, then back 3 for 3
    head = struct.pack("<H", 0xB000 | len(body) - 1)
    assert office.decompressed(b"\x01" + head + body) == b"abcabc"
    body = b"\x02x\x03\x00"  # back 1 for 6 reads what it writes
    assert office.decompressed(b"\x01" + struct.pack("<H", 0xB000 | len(body) - 1) + body) == b"xxxxxxx"
    for bad in (b"", b"\x02\0\0", b"\x01\xff", b"\x01\x83\xb0\x02x\xff\xff", b"\x01\xff\xbf\0"):
        office.decompressed(bad)
    raw = b"\x01" + struct.pack("<H", 0x3000 | 4096 - 1) + bytes(range(256)) * 16
    assert office.decompressed(raw) == bytes(range(256)) * 16


@pytest.mark.parametrize("seed", range(4))
def test_containers_round_trip(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abcab Sub\r\n") for _ in range(rng.randint(0, 9000)))
    assert office.decompressed(compressed(data)) == data
    streams = {f"s{i}": rng.randbytes(rng.choice([1, 63, 64, 65, 4095, 4096, 4097, 20_000])) for i in range(9)}
    for shift in (9, 12):
        assert dict(office.Compound(compound(streams, ("VBA",), shift)).streams()) == streams
    big = {"big": rng.randbytes(8_000_000), "small": b"x"}  # more tables than the header names
    assert dict(office.Compound(compound(big)).streams()) == big
    broken = bytearray(compound(streams))
    for _ in range(200):
        broken[rng.randrange(512, len(broken))] = rng.randrange(256)
    list(office.parts(bytes(broken)))  # ends, whatever it finds


def test_word_edges_and_risk(spark):
    sources = ["Dim Runtime As String\nDim OpenAIKey As String\n", "Sub Formatting()\nEnd Sub", 'Sub AutoOpen()\nMsgBox "hi"\nEnd Sub', 'Sub AutoOpen()\nShell "cmd"\nEnd Sub', "Sub Go()\nShell x\nCreateObject y\nURLDownloadToFile z\nEnd Sub", "sub DOCUMENT_OPEN()", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string").withColumn("found", macros.signs("s")).withColumn("k", macros.keywords(F.col("found")))
    got = [(r.risk, None if r.k is None else [k.keyword for k in r.k]) for r in df.select("i", "k", macros.risk(F.col("k")).alias("risk")).orderBy("i").collect()]
    assert got == [("none", []), ("none", []), ("medium", ["AutoOpen"]), ("high", ["AutoOpen", "Shell"]), ("high", ["Shell", "CreateObject", "URLDownloadToFile"]), ("medium", ["Document_Open"]), ("none", []), (None, None)]
