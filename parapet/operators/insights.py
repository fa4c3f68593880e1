"""Ready-made observations about a message: each is an expression, kept if it is true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import logic as L
from parapet.functions import strings as S
from parapet.sources.mail import auth_summary, mismatched, subject_parts


def catalogue(mdm: Column) -> dict[str, tuple[str, Column]]:
    """name -> (warn or context, condition) for a parsed message (sources.mail)."""
    domain = S.parse_domain(S.parse_email(mdm["sender"]["email"])["domain"])
    subject = subject_parts(mdm["subject"])
    body = F.coalesce(mdm["current_text"], F.lit(""))
    links, files = mdm["links"], mdm["attachments"]
    reply_domains = F.transform(mdm["reply_to"], lambda r: S.parse_domain(S.parse_email(r["email"])["domain"])["root_domain"])
    root_of = lambda href: S.parse_url(href)["domain"]["root_domain"]
    return {
        "spf_fail": ("warn", ~auth_summary(mdm["hops"], "spf")),
        "dkim_fail": ("warn", ~auth_summary(mdm["hops"], "dkim")),
        "dmarc_fail": ("warn", ~auth_summary(mdm["hops"], "dmarc")),
        "no_authentication": ("context", auth_summary(mdm["hops"], "spf").isNull() & auth_summary(mdm["hops"], "dkim").isNull()),
        "reply_to_elsewhere": ("warn", F.exists(reply_domains, lambda d: d != domain["root_domain"])),
        "punycode_sender": ("warn", domain["punycode"]),
        "confusable_name": ("warn", S.replace_confusables(mdm["sender"]["display_name"]) != mdm["sender"]["display_name"]),
        "address_in_name": ("warn", F.contains(mdm["sender"]["display_name"], F.lit("@")) & ~F.contains(F.lower(mdm["sender"]["display_name"]), F.lower(mdm["sender"]["email"]))),
        "fake_reply": ("warn", subject["is_reply"] & mdm["in_reply_to"].isNull() & (F.size(mdm["refs"]) == 0)),
        "auto_reply": ("context", subject["is_auto_reply"]),
        "mismatched_link": ("warn", F.exists(links, lambda x: mismatched(x["display_text"], root_of(x["href"])))),
        "link_to_address": ("warn", F.exists(links, lambda x: S.parse_url(x["href"])["ip"].isNotNull())),
        "many_links": ("context", F.size(links) > 20),
        "encrypted_archive_words": ("warn", S.contains(body, "password is", "password:", fold=True) & (F.size(files) > 0)),
        "urgent_payment": ("warn", S.contains(body, "urgent", "immediately", fold=True) & S.contains(body, "payment", "invoice", "transfer", fold=True)),
        "program_attached": ("warn", F.exists(files, lambda f: F.rlike(f["file_name"], F.lit(r"(?i)\.(exe|scr|js|vbs|bat|cmd|lnk|iso|img|hta)$")))),
        "macro_document": ("warn", F.exists(files, lambda f: F.rlike(f["file_name"], F.lit(r"(?i)\.(docm|xlsm|pptm)$")))),
        "html_attachment": ("warn", F.exists(files, lambda f: F.rlike(f["file_name"], F.lit(r"(?i)\.(html?|shtml|svg)$")))),
        "double_extension": ("warn", F.exists(files, lambda f: F.rlike(f["file_name"], F.lit(r"(?i)\.(pdf|docx?|xlsx?|jpg|png)\.[a-z]{2,4}$")))),
        "quoted_thread": ("context", F.size(mdm["previous"]) > 0),
        "parse_errors": ("context", F.size(mdm["errors"]) > 0),
        "empty_body": ("context", (F.trim(body) == "") & (F.coalesce(mdm["html"], F.lit("")) == "")),
    }


def insights(messages: DataFrame, keep: list[str], mdm: str = "mdm") -> DataFrame:
    """keep + warnings, context and unknown: names of the observations that hold, and of those whose fields are not there to tell."""
    held = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(kind).alias("kind"), c.alias("held")) for n, (kind, c) in catalogue(F.col(mdm)).items()])
    rows = messages.select(*keep, held.alias("_h"))
    named = lambda test: F.transform(F.filter("_h", test), lambda x: x["name"])
    of_kind = lambda kind: named(lambda x: F.coalesce(x["held"], F.lit(False)) & (x["kind"] == kind))
    return rows.select(*keep, of_kind("warn").alias("warnings"), of_kind("context").alias("context"), named(lambda x: x["held"].isNull()).alias("unknown"))


def facts(mdm: Column, profile: Column | None = None, whois: Column | None = None, link_days: Column | None = None, nlu: Column | None = None, shorteners: list[str] | None = None) -> list[tuple[str, str, bool, L.Answer]]:
    """(group, label, warn, answer) of what is shown beside a message. A source that isn't given is missing evidence, by name, and what it
    would have answered is unknown, not "no". profile: struct as of profile.as_of_events; whois: struct(days_old, registrar, registrant,
    country) of the sender's domain; link_days: array of the ages of the links' domains, null where the age is not known; nlu: struct as
    of scoring.understood."""
    address = lambda x: S.parse_email(x)["domain"]
    sender, links = mdm["sender"]["email"], mdm["links"]
    domain = address(sender)
    hosts = F.transform(links, lambda x: S.parse_url(x["href"])["host"])
    roots = F.transform(links, lambda x: S.parse_url(x["href"])["domain"]["root_domain"])

    def of(source: Column | None, name: str, value, kind: str) -> L.Answer:
        return L.unavailable(name, kind) if source is None else L.Answer(value(source), F.when(source.isNull(), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))

    def young(days: Column) -> Column:
        return F.exists(days, lambda d: d < 30)

    aged = L.unavailable("whois") if link_days is None else L.Answer(young(link_days), F.when(F.exists(link_days, lambda d: d.isNull()) & ~F.coalesce(young(link_days), F.lit(False)), F.array(F.lit("whois"))).otherwise(F.array().cast("array<string>")))
    short = L.unavailable("$url_shorteners") if shorteners is None else L.Answer(F.exists(roots, lambda r: L.in_list(r, shorteners, "url_shorteners").value))
    model = lambda field, kind, value: L.unavailable("nlu", kind) if nlu is None else L.Answer(value(nlu[field]), L.part(nlu, field, "nlu").missing)
    sure = lambda *levels: lambda xs: F.transform(F.filter(xs, lambda x: x["confidence"].isin(*levels)), lambda x: x["name"])
    a = L.Answer
    # The names and order of groups and labels, which readers of insights know
    return [
        ("identity", "Sender", False, a(sender)),
        ("identity", "Sender display name", False, a(mdm["sender"]["display_name"])),
        ("identity", "Sender domain", False, a(domain)),
        ("identity", "Return path", False, a(mdm["return_path"])),
        ("identity", "Reply-to", False, a(F.transform(mdm["reply_to"], lambda r: r["email"]))),
        ("identity", "Reply-to differs from sender", True, a(F.exists(mdm["reply_to"], lambda r: address(r["email"]) != domain))),
        ("identity", "Return path differs from sender", True, a(address(mdm["return_path"]) != domain)),
        ("identity", "Message-ID", False, a(mdm["message_id"])),
        ("identity", "Recipients", False, a(F.size(mdm["recipients"]))),
        ("identity", "Sender is also the only recipient", True, a((F.size(mdm["recipients"]) == 1) & F.exists(mdm["recipients"], lambda r: r["email"] == sender))),
        ("reputation", "Sender prevalence", False, of(profile, "profile", lambda p: p["prevalence"], "string")),
        ("reputation", "You have written to them before", False, of(profile, "profile", lambda p: p["prior_solicited"], "boolean")),
        ("reputation", "Previously judged benign", False, of(profile, "profile", lambda p: p["prior_any_benign"], "boolean")),
        ("reputation", "Previously judged malicious", True, of(profile, "profile", lambda p: p["prior_any_malicious"], "boolean")),
        ("reputation", "Sender domain age (days)", False, of(whois, "whois", lambda w: w["days_old"], "long")),
        ("reputation", "Sender domain registered in the last 30 days", True, of(whois, "whois", lambda w: w["days_old"] < 30, "boolean")),
        ("reputation", "Registrar", False, of(whois, "whois", lambda w: w["registrar"], "string")),
        ("reputation", "Registrant", False, of(whois, "whois", lambda w: w["registrant"], "string")),
        ("reputation", "Registrant country", False, of(whois, "whois", lambda w: w["country"], "string")),
        ("content", "Links in body", False, a(F.size(links))),
        ("content", "Link domains", False, a(F.array_distinct(hosts))),
        ("content", "A link domain is newly registered", True, aged),
        ("content", "A link uses a URL shortener", True, short),
        ("content", "Link text disagrees with its destination", True, a(F.exists(links, lambda x: F.contains(x["display_text"], F.lit("://")) & ~F.contains(F.lower(x["display_text"]), S.parse_url(x["href"])["host"])))),
        ("content", "Attachments", False, a(F.size(mdm["attachments"]))),
        ("content", "Language", False, model("language", "string", lambda x: x)),
        ("content", "Intent", False, model("intents", "string", sure("high", "medium"))),
        ("content", "Topic", False, model("topics", "string", sure("high"))),
        ("content", "Urgency or financial language", True, model("entities", "boolean", lambda xs: F.exists(xs, lambda e: e["name"].isin("urgency", "financial")))),
    ]


def shown(messages: DataFrame, keep: list[str], mdm: str = "mdm", **sources) -> DataFrame:
    """keep, group, label, warn, value (JSON text), unknown, missing: a row for each fact that has a value or could not be established. A
    warning is shown if it holds or is unknown."""

    def row(group: str, label: str, warn: bool, x: L.Answer) -> Column:
        value = F.to_json(F.struct(x.value.alias("v")))  # '{}' for null
        text = F.when(x.value.isNotNull(), F.substring(value, F.lit(6), F.length(value) - 6))
        unknown = x.value.isNull() & (F.size(x.names) > 0)
        return F.struct(F.lit(group).alias("group"), F.lit(label).alias("label"), F.lit(warn).alias("warn"), text.alias("value"), unknown.alias("unknown"), F.when(unknown, x.names).otherwise(F.array().cast("array<string>")).alias("missing"))

    rows = F.array(*[row(*f) for f in facts(F.col(mdm), **sources)])
    wanted = F.filter(rows, lambda r: r["unknown"] | (r["value"].isNotNull() & (~r["warn"] | (r["value"] == "true"))))
    return messages.select(*keep, F.explode(wanted).alias("f")).select(*keep, "f.*")


def origin(received: Column) -> Column:
    """The address that a message first came from: the earliest hop with a public IPv4 address."""
    found = F.flatten(F.transform(F.reverse(received), lambda r: F.regexp_extract_all(r, F.lit(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), F.lit(0))))
    return F.get(F.filter(found, lambda ip: ~F.rlike(ip, F.lit(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)"))), F.lit(0))


def registration_of_links(links: DataFrame, whois: DataFrame) -> DataFrame:
    """links(message_id, href) with the registration of their host, else of their root domain. whois: domain, registered_at (unique)."""
    u = S.parse_url(F.col("href"))
    hosts = links.select("message_id", "href", u["host"].alias("host"), u["domain"]["root_domain"].alias("root"))
    a = whois.select(F.lower("domain").alias("host"), F.col("registered_at").alias("_a"))
    b = whois.select(F.lower("domain").alias("root"), F.col("registered_at").alias("_b"))
    out = hosts.join(a, "host", "left").join(b, "root", "left")
    return out.select("message_id", "href", "host", "root", F.coalesce("_a", "_b").alias("registered_at"), F.when(F.coalesce("_a", "_b").isNull(), "whois").alias("missing"))
