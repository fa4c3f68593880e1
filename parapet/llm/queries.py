"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from parapet.llm import bpe, chat, exact, html, jaccard, lines, middle, neighbours, packing, quality, resample, secrets, substring
from parapet.llm._shared import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.production(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.production(read_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read_table(spark, sf_dir, "conversations"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(read_table(spark, sf_dir, "documents")).drop("text_key")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents")).drop("row_key")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.report(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_packing, op2_bpe, op3_secret_scan, op4_chat_format, op5_ngram_jaccard, op6_substring_dedup, op7_exact_dedup, op8_quality_rules, op9_html_extraction, op10_line_dedup),
        *(op11_importance_resampling, op12_nearest_neighbours, op13_fill_in_middle),
    )
}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op7_exact_dedup": f"""
with t as (select doc_id, sha256({LOWER.format("coalesce(text, '')")}) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""",
    "op8_quality_rules": r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
g as (select r, i, word || ' ' || lead(word, 1) over s || ' ' || lead(word, 2) over s || ' ' || lead(word, 3) over s || ' ' || lead(word, 4) over s as gram from w window s as (partition by r order by i)),
t as (select r, i from (select r, i, count(*) over (partition by r, gram) as n from g where gram is not null) where n > 1),
rep as (select r, count(distinct i + k) as n_repeat_words from t, (select unnest([0, 1, 2, 3, 4]) as k) group by r),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
f as (select r, line, regexp_matches(line, '[^\x20\x09-\x0D]') as has_word, length(line) as chars,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
    len(regexp_extract_all(line, '[#*$%&|<>{}\[\]~^=_\\]|!!|\?\?')) as marks,
    len(regexp_extract_all(line, '[|\x{bb}\x{203a}\x{2022}\x{b7}]')) as bars,
    regexp_matches(line, '\p{L}') as letter,
    len(regexp_extract_all(lower(line), '(?:{phrases})')) as stock from l),
h as (select *, (has_word and not letter) or (marks >= 3 and 10 * marks > 3 * words) or (bars >= 3 and 10 * bars > 2 * words) or (stock > 0 and words <= 12 * stock) as fails from f),
v as (select r, sum(chars) as chars, count(*) filter (where has_word) - count(distinct line) filter (where has_word) as n_dup_lines,
    sum(case when fails then chars else 0 end) as lost, count(*) filter (where has_word and not fails) as good from h group by r),
q as (select d.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, v.n_dup_lines, coalesce(rep.n_repeat_words, 0) as n_repeat_words, v.lost, v.chars, v.good from d join v using (r) left join rep using (r)),
z as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost <= 20 * chars and good > 0 as kept from z""".replace(
        "{phrases}",
        # fixed values: the operator's stock phrases, written out
        "cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|lorem ipsum|click here|subscribe to our|sign up for|share this|licensed under|"
        "alle rechte vorbehalten|datenschutzerklärung|cookie-richtlinie|nutzungsbedingungen|hier klicken|klicken sie hier|newsletter abonnieren|javascript aktivieren|"
        "tous droits réservés|politique de confidentialité|mentions légales|conditions d''utilisation|cliquez ici|abonnez-vous|activer javascript|"
        "todos los derechos reservados|política de privacidad|aviso legal|términos de uso|haga clic aquí|suscríbete a|habilite javascript",
    ),
    "op5_ngram_jaccard": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
    from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as x from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * p.x >= 80 * (x.n + y.n - p.x)),
e as (select a, b from l union select b, a from l),
r as (select a as node, a as root from e union select e.b, r.root from r join e on r.node = e.a where r.root < e.b),
c as (select node, min(root) as root from r group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.root, d.doc_id) as component_id from d left join n using (doc_id) left join c on c.node = d.doc_id""",
    "op6_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as gram from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13)),
m as (select gram, min(doc_id) as first from g group by gram),
x as (select distinct doc_id, i + k as i from g join m using (gram), (select unnest(generate_series(0, 12)) as k) where first < doc_id),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
k as (select u.doc_id, count(*) filter (where x.i is not null) as n_removed, string_agg(u.word, ' ' order by u.i) filter (where x.i is null) as kept from u left join x on x.doc_id = u.doc_id and x.i = u.i group by u.doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op4_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length(regexp_replace(role, '\\|###|</turn>|:', '!\0', 'g')) + length(regexp_replace(text, '\\|###|</turn>', '!\0', 'g')) + 15)::bigint as formatted_chars
from c group by conv_id""",
    "op11_importance_resampling": r"""
with d as (select row_number() over () as r, doc_id, text from documents),
w as (select r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from d
    union all select -row_number() over (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as (select r, unnest(w) as f from w union all select r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w),
x as (select f, hex(f) as h from (select distinct f from f)),
c as (select f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
    lambda c, b: xor(c >> 8, [{crc}][(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket from x),
b as (select r, bucket, count(*) as n from f join c using (f) group by all),
t as (select bucket, coalesce(sum(n) filter (where r > 0), 0) as s, coalesce(sum(n) filter (where r < 0), 0) as t from b group by bucket),
z as (select sum(s) as s, sum(t) as t from t),
g as (select bucket, floor(1000 * ln((t.t + 1)::double * (z.s + 10000)::double / ((t.s + 1)::double * (z.t + 10000)::double)))::bigint as gain from t, z),
k as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as gain from b join g using (bucket) where r > 0 group by r),
v as (select d.r, d.doc_id, len(w.w) as n_words, coalesce(n_features, 0) as n_features,
    case when k.n_features is null then 0 else (gain - ((gain % n_features) + n_features) % n_features) // n_features end::bigint as weight,
    ('0x' || substr(sha256('7:' || coalesce(d.doc_id::varchar, 'null')), 1, 8))::bigint as h from d join w using (r) left join k using (r)),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from v),
o as (select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from y where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end as rank from y left join o using (r)""".replace("{crc}", ", ".join(str(zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000) for b in range(256))),
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, 'null')) as x from documents),
h as (select *, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4,
    regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t from d),
f as (select *, len(t) as n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form,
    least(h1 % (len(t) + 1), h2 % (len(t) + 1)) as a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) as b from h),
p as (select *, array_to_string(t[1:a], '') as prefix, array_to_string(t[a + 1:b], '') as middle, array_to_string(t[b + 1:], '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256 from p""",
    "op10_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
u as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from d),
w as (select *, row_number() over (partition by doc_id order by i) as k from u where regexp_matches(line, '[^\x20\x09-\x0D]')),
g as (select doc_id, k, line, lead(line) over (partition by doc_id order by k) as line2 from w),
o as (select doc_id, k, row_number() over (partition by line, line2 order by doc_id, k) as nth from g where line2 is not null),
n as (select doc_id, k, row_number() over (partition by line order by doc_id, k) as nth from g where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 10),
x as (select doc_id, k + s as k from o, (select unnest([0, 1]) as s) where nth > 1 union select doc_id, k from n where nth > 1),
z as (select u.doc_id, u.i, u.line, w.k is not null as worded, x.k is not null as gone from u left join w using (doc_id, i) left join x on x.doc_id = u.doc_id and x.k = w.k)
select doc_id, count(*) filter (where worded) as n_lines, count(*) filter (where gone) as n_removed,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from z group by doc_id""",
}


def _secret_sql() -> str:
    def both(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    words = "|".join(both(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
    kinds = [
        ("assign", f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]{24,}", 0, 0),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 0),
        ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ]
    parts = " union all ".join(f"select r, '{k}' as kind, {n} as number, {least} as least, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{p}', {g}) as v, string_split_regex(text, '{p}') as gaps from d" for n, (k, p, g, least) in enumerate(kinds))
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
f as ({parts}),
u as (select r, kind, number, least, generate_subscripts(m, 1) as i, unnest(m) as match, unnest(v) as value, unnest(gaps[1:len(m)]) as gap from f where len(m) > 0),
p as (select *, sum(length(gap) + length(match)) over (partition by r, number order by i) as stop from u),
s as (select r, number, kind, (stop - length(match))::bigint as start, kind || ':' || (stop - length(match))::bigint || ':' || stop::bigint as span from p where length(value) >= least),
g as (select r, count(*) filter (where number = 0) as n_assign, count(*) filter (where number = 1) as n_access, count(*) filter (where number = 2) as n_hex,
    string_agg(span, ',' order by start, number) filter (where number < 3) as base, string_agg(span, ',' order by start, number) as spans from s group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (r)"""


ORACLE_SQL["op3_secret_scan"] = _secret_sql()
