"""Raw RFC 5322 messages to nested records, in Arrow batches beside the raw bytes.

A malformed message still gives a record, with what went wrong in `errors`; only an empty one gives null.
"""

from __future__ import annotations

import email
import email.headerregistry
import email.policy
import email.utils
import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAILBOX = "struct<display_name:string,email:string>"
SCHEMA = (
    f"message_id string, sent_at timestamp, sender {MAILBOX}, reply_to array<{MAILBOX}>, recipients array<{MAILBOX}>, subject string, return_path string, in_reply_to string, refs array<string>, "
    "hops array<struct<index:int,received:string,authentication_results:string>>, text string, html string, "
    "current_text string, previous array<string>, links array<struct<display_text:string,href:string>>, "
    "attachments array<struct<file_name:string,content_type:string,size:bigint,md5:string,sha1:string,sha256:string,head:binary>>, errors array<string>"
)
QUOTE_HEAD = re.compile(r"^(?:On .{4,200} wrote:|Am .{4,200} schrieb.{0,80}:|Le .{4,200} a écrit ?:|El .{4,200} escribió:|-{2,} ?(?:Original Message|Forwarded message|Ursprüngliche Nachricht) ?-{2,})\s*$", re.M | re.I)


class _Headers(email.headerregistry.HeaderRegistry):
    """Headers as the registry reads them, each (name, value) once: else a header is read again whenever it is asked for. What is kept has a
    fixed size; long values are read each time."""

    def __init__(self) -> None:
        super().__init__()
        self.kept = functools.lru_cache(4096)(super().__call__)

    def __call__(self, name: str, value: str):
        return self.kept(name, value) if len(value) <= 1000 else super().__call__(name, value)


POLICY = email.policy.default.clone(header_factory=_Headers())


def split_thread(text: str) -> tuple[str, list[str]]:
    """The newest part, and the quoted parts, newest first: at quote headers, else at a run of two or more lines that start with >."""
    cuts = [m.start() for m in QUOTE_HEAD.finditer(text)]
    if not cuts and (m := re.search(r"(?:^>.*\n?){2,}", text, re.M)):
        cuts = [m.start()]
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    return parts[0].strip(), [re.sub(r"^> ?", "", p, flags=re.M).strip() for p in parts[1:]]


def _boxes(values) -> list[dict]:
    return [{"display_name": n or None, "email": a.lower() or None} for n, a in email.utils.getaddresses([str(v) for v in values or []]) if n or a]


LINK = re.compile(r"""<a\b[^>]*?href\s*=\s*["']?([^"'\s>]+)[^>]*>(.*?)</a>""", re.I | re.S)
BARE = re.compile(r"https?://[^\s<>\"')]+")


def links_of(text: str, html: str) -> list[dict]:
    """Links of the HTML and bare addresses of the text, each (text, target) once."""
    found = [(" ".join(re.sub(r"<[^>]+>", " ", t).split()), h) for h, t in LINK.findall(html)] + [(u, u) for u in BARE.findall(text)]
    return [{"display_text": t, "href": h} for t, h in dict.fromkeys(found)]


def parse_message(raw: bytes | None) -> dict | None:
    if not raw:
        return None
    errors: list[str] = []

    def tried(what, f, default=None):
        try:
            return f()
        except Exception as e:  # whatever a broken header does is recorded, the rest is still read
            errors.append(f"{what}: {type(e).__name__}")
            return default

    m = email.message_from_bytes(raw, policy=POLICY)
    header = lambda name: tried(name, lambda: str(m[name]) if m[name] is not None else None)
    text, html, attached = [], [], []
    for part in tried("parts", lambda: [p for p in m.walk() if not p.is_multipart()], []):
        data = tried("body", lambda p=part: p.get_payload(decode=True) or b"", b"")
        kind = part.get_content_type()
        if part.get_filename() or part.get_content_disposition() == "attachment":
            attached.append({"file_name": part.get_filename(), "content_type": kind, "size": len(data), "md5": hashlib.md5(data).hexdigest(), "sha1": hashlib.sha1(data).hexdigest(), "sha256": hashlib.sha256(data).hexdigest(), "head": data[:16]})
        elif kind in ("text/plain", "text/html"):
            body = tried("charset", lambda p=part, d=data: d.decode(p.get_content_charset() or "utf-8", "replace"), data.decode("utf-8", "replace"))
            (html if kind == "text/html" else text).append(body)
    plain, marked = "\n".join(text).replace("\x00", ""), "\n".join(html).replace("\x00", "")
    current, previous = split_thread(plain)
    sent = tried("date", lambda: email.utils.parsedate_to_datetime(header("Date")) if m["Date"] else None)
    received, results = tried("received", lambda: [str(x) for x in m.get_all("Received", [])], []), tried("auth", lambda: [str(x) for x in m.get_all("Authentication-Results", [])], [])
    senders = _boxes(tried("from", lambda: m.get_all("From"), []))
    errors += [type(d).__name__ for d in m.defects]
    return {
        "message_id": (header("Message-ID") or "").strip(" <>\r\n") or None,
        "sent_at": pd.Timestamp(sent).tz_convert("UTC").tz_localize(None) if sent is not None and sent.tzinfo else (pd.Timestamp(sent) if sent is not None else None),
        "sender": senders[0] if senders else None,
        "reply_to": _boxes(tried("reply-to", lambda: m.get_all("Reply-To"), [])),
        "recipients": _boxes(tried("to", lambda: [*m.get_all("To", []), *m.get_all("Cc", []), *m.get_all("Bcc", [])], [])),
        "subject": header("Subject"),
        "return_path": (header("Return-Path") or "").strip(" <>").lower() or None,
        "in_reply_to": (header("In-Reply-To") or "").strip(" <>") or None,
        "refs": re.findall(r"<([^>]+)>", header("References") or ""),
        "hops": [{"index": i, "received": r, "authentication_results": results[i] if i < len(results) else None} for i, r in enumerate(received)],
        "text": plain,
        "html": marked,
        "current_text": current,
        "previous": previous,
        "links": links_of(plain, marked),
        "attachments": attached,
        "errors": errors,
    }


def parse(raw: DataFrame, column: str = "raw", out: str = "mdm") -> DataFrame:
    """raw with a struct column of the parsed message; null for an empty one."""

    def batches(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in frames:
            yield pd.DataFrame([parse_message(bytes(x)) if x is not None and len(x) else dict.fromkeys(names) for x in s], columns=names)

    kind = T.StructType.fromDDL(SCHEMA)
    names = kind.names
    parsed = F.pandas_udf(batches, kind)
    with_struct = raw.withColumn("_mdm", parsed(F.col(column)))
    return with_struct.withColumn(out, F.when(F.length(column) > 0, F.col("_mdm"))).drop("_mdm")


SUBJECT = r"^\s*((?:\[[^\]]*\]\s*)*)((?:(?:re|aw|sv|fwd?|wg|tr)(?:\[\d+\])?\s*:\s*)*)(.*?)\s*$"


def subject_parts(subject: Column) -> Column:
    """struct(base, tags, is_reply, is_forward, is_auto_reply)."""
    p = "(?is)" + SUBJECT
    prefix = F.lower(F.regexp_extract(subject, p, 2))
    tags = F.regexp_extract_all(F.regexp_extract(subject, p, 1), F.lit(r"\[([^\]]*)\]"), F.lit(1))
    auto = F.rlike(subject, F.lit(r"(?i)^\s*(automatic reply|auto(?:mated)? reply|out of office|abwesenheit)"))
    return F.when(subject.isNotNull(), F.struct(F.regexp_extract(subject, p, 3).alias("base"), tags.alias("tags"), F.rlike(prefix, F.lit(r"\b(re|aw|sv)\b")).alias("is_reply"), F.rlike(prefix, F.lit(r"\b(fwd?|wg|tr)\b")).alias("is_forward"), auto.alias("is_auto_reply")))


def auth_summary(hops: Column, check: str) -> Column:
    """pass of spf, dkim or dmarc at the newest hop that reported it; null if none did. bestguesspass is no pass."""
    said = F.filter(F.transform(hops, lambda h: F.regexp_extract(F.coalesce(h["authentication_results"], F.lit("")), rf"(?i)\b{check}=(\w+)", 1)), lambda x: x != "")
    first = F.lower(F.get(said, F.lit(0)))
    return F.when(first.isNotNull(), first == "pass")


#: First bytes of file types.
MAGIC = {"pdf": "25504446", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1", "png": "89504E47", "gif": "47494638", "jpg": "FFD8FF", "gz": "1F8B", "exe": "4D5A", "rar": "526172211A07", "7z": "377ABCAF271C", "rtf": "7B5C727466"}
OFFICE = {"docx", "docm", "xlsx", "xlsm", "pptx", "pptm", "jar", "apk", "odt", "ods"}


def file_type(name: Column, head: Column) -> Column:
    """By first bytes; a zip is refined by its extension; else the extension."""
    extension = F.lower(F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]{1,8})$", 1), F.lit("")))
    start = F.hex(head)
    out = F.when(F.startswith(start, F.lit(MAGIC["zip"])) & extension.isin(*OFFICE), extension)
    for kind, magic in MAGIC.items():
        out = out.when(F.startswith(start, F.lit(magic)), F.lit(kind))
    return out.otherwise(extension)


def mismatched(display: Column, target_root: Column) -> Column:
    """Whether a link's text names another root domain than its target; null if the text names none."""
    shown = F.nullif(F.regexp_extract(F.lower(display), r"(?:^|[\s/@.])([a-z0-9-]+\.[a-z]{2,})(?:[/:?#\s]|$)", 1), F.lit(""))
    return F.when(shown.isNotNull(), shown != target_root)
