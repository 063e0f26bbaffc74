"""SQL of the registered queries, for another engine over the same tables."""

from __future__ import annotations

from ..functions import text as T
from ..operators import chunk as C
from .queries import COLLECTION, HINTS, LABEL, LONG_CAP, K

SP = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
NSP = "[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalized(x: str) -> str:
    out = f"regexp_replace({x}, 'ا([أإآ])ل', 'ال\\1', 'g')"
    out = f"regexp_replace({out}, 'اال([؀-ۿ])', 'الا\\1', 'g')"
    out = f"regexp_replace(translate({out}, '{T.ARABIC_DIGITS}', '0123456789'), '[\\x{{64b}}-\\x{{652}}\\x{{670}}\\x{{640}}]', '', 'g')"
    out = f"lower(regexp_replace(translate({out}, 'أإآٱؤئةى', 'ااااويهي'), '[\\x{{fffd}}\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g'))"
    return f"trim(regexp_replace({out}, '{SP}+', ' ', 'g'))"


def lines(x: str) -> str:
    return normalized(f"regexp_replace({x}, '[\\r\\n\\t]+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{T.MARKED}', '{T.UNMARKED}'), '[\\p{{L}}\\p{{N}}]+')"


STOP = "[" + ", ".join(map(quote, T.STOP_WORDS)) + "]"


def stripped(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w <> '' and not list_contains({STOP}, w)), ' ')"


BLANK = "not regexp_matches(coalesce({0}, ''), '" + NSP.replace("{", "{{").replace("}", "}}") + "')"
ARABIC = "\\x{600}-\\x{6ff}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{fefc}"


def ratio(x: str) -> str:
    arabic = f"length(regexp_replace({x}, '[^{ARABIC}]', '', 'g'))"
    other = f"length(regexp_replace(regexp_replace({x}, '[{ARABIC}]', '', 'g'), '[^\\p{{L}}]', '', 'g'))"
    return f"round(coalesce({arabic}::double / nullif({arabic} + {other}, 0), 0.0), 3)"


def page_reason(x: str) -> str:
    lost = f"(length({x}) - length(replace({x}, chr(65533), '')))"
    return f"case when {BLANK.format(x)} then 'blank_or_no_text' when length(coalesce({x}, '')) < 50 then 'too_short' when {lost}::double / nullif(length({x}), 0) > 0.02 then 'high_replacement_ratio' else '' end"


def ocr_reason(x: str) -> str:
    return f"case when length(coalesce(error, '')) > 0 then split_part(error, ':', 1) when {BLANK.format(x)} then 'ocr_blank_or_no_text' when length(coalesce({x}, '')) < 50 then 'ocr_too_short' when coalesce(words, 0) < 5 then 'ocr_too_few_words' when coalesce(mean_conf, 0) < 60 then 'ocr_low_confidence' else '' end"


def choice(a: str, b: str) -> str:
    return f"case when not ({BLANK.format(a)}) and ({ratio(a)} >= 0.5 or {BLANK.format(b)}) then 'a' else 'b' end"


def estimate(x: str) -> str:
    return f"list_sum(list_transform(list_filter(regexp_split_to_array({x}, '{SP}+'), lambda w: length(w) > 0), lambda w: ceil(length(w) / 4.0)::int))"


PAGES = "pg as (select distinct doc_id, pdf_page, engine, raw_text, raw_chars, alt_chars, printed_label, status, exclude_reason from pages)"
PASSAGES = "ps as (select distinct pid, doc_id, pdf_page, ordinal, text_raw, text_search, text_reviewed, derivation, content_hash, tokens, region, topic, lang from passages)"
CATALOG = "ct as (select * from doc_catalog qualify row_number() over (partition by doc_id order by imported_at desc, source_url_status desc, source_url desc nulls last) = 1)"
TITLE = "coalesce(ct.title, regexp_replace(ct.filename, '\\.[^.]*$', '')) as title"
SHOWN = "case when length(coalesce(text_reviewed, '')) > 0 then text_reviewed else text_raw end"
LABEL_ = "case when length(coalesce(text_reviewed, '')) > 0 then 'reviewed_transcription' else coalesce(nullif(derivation, ''), 'extracted') end"
TEXTS = f"tx as (select doc_id, pdf_page, string_agg(t, chr(10) order by ordinal, pid) as other_text from (select distinct pid, doc_id, pdf_page, ordinal, {SHOWN} as t from passages) group by all)"
RECOGNIZED = f"""{PAGES}, {CATALOG}, {TEXTS},
oc as (select stem, pdf_page, max(case when ok then words end) as words, max(case when ok then mean_conf end) as mean_conf, bool_or(ok) as ok, max(checksum12) as c from (select o.*, coalesce(substring(ct.checksum, 1, 12) = o.checksum12, false) as ok from ocr_cache o left join ct on ct.doc_id = o.stem) group by all),
rc as (select pg.*, oc.words, oc.mean_conf, tx.other_text as ocr_text, case when oc.stem is null then null when not oc.ok then 'stale_checksum: ' || c when oc.mean_conf = 0 then 'no_confidence: ' || c end as error from pg left join oc on pg.doc_id = oc.stem and pg.pdf_page = oc.pdf_page left join tx on pg.doc_id = tx.doc_id and pg.pdf_page = tx.pdf_page where pg.engine like 'ocr%')"""
TOKENS = f"tk as (select pid, {tokens('text_search')} as t from (select distinct pid, text_search from passages))"

def keyword(asked: str) -> str:
    return f"""
tk as materialized (select doc_id as pid, {tokens(lines('text'))} as t from documents),
n as (select count(*) as n_docs, avg(len(t)) as avgdl from tk),
qs as ({asked}),
ph as (select qid, {tokens('w')} as phrase from (select qid, unnest(list_slice(list_filter(list_transform(regexp_split_to_array(q, '{SP}+'), lambda x: trim(x, chr(34))), lambda x: x <> '' and length(replace(x, chr(34), chr(34) || chr(34))) <= 64), 1, 32)) as w from qs)),
wq as (select qid, phrase, count(*) as weight from ph where len(phrase) > 0 group by all),
po as materialized (select pid, t, len(t) as dl, unnest(t) as term, generate_subscripts(t, 1) as i from tk),
dp as (select distinct phrase from wq),
tf as materialized (select phrase, pid, dl, count(*) as tf from dp join po on po.term = dp.phrase[1] where len(phrase) = 1 or t[i : i + len(phrase) - 1] = phrase group by all),
df as (select phrase, count(*) as df from tf group by all),
idf as (select phrase, avgdl, case when ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_docs - df + 0.5) / (df + 0.5)) end as idf from df, n),
sc as (select qid, pid, round(-sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score from wq join tf using (phrase) join idf using (phrase) group by all),
kw as materialized (select qid, pid, score, row_number() over (partition by qid order by score, pid) - 1 as rank from sc qualify rank < 100)"""

KEYWORD = keyword(f"select doc_id as qid, {stripped(lines('substring(title, 1, 500)'))} as q from documents where doc_id % 20 = 0 and title is not null")
VECTOR = """
va as (select q.vec_id as qid, r.vec_id as pid, round(list_dot_product(q.embedding::double[], r.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])), 9) as sim from embeddings q, embeddings r where q.vec_id % 20 = 0),
ve as materialized (select qid, pid, sim, row_number() over (partition by qid order by sim desc, pid) - 1 as rank from va qualify rank < 300)"""
def fused(words: str) -> str:
    return f"""{words},{VECTOR},
pt as (select qid, pid, (case when min(score) over (partition by qid) = 0 then 1.0 else score / min(score) over (partition by qid) end) / (60 + rank) as part, rank as fts_rank, null as vec_rank from kw union all select qid, pid, 1.0::double / (60 + rank), null, rank from ve),
fs as (select qid, pid, round(sum(part), 12) as score, max(fts_rank) as fts_rank, max(vec_rank) as vec_rank from pt group by all),
fu as materialized (select *, row_number() over (partition by qid order by score desc, fts_rank nulls last, vec_rank nulls last) - 1 as rank from fs),
so as (select doc_id as pid, source as doc_id, lang, topic, substring(sha256(text), 1, 32) as ch, concat_ws(' p', source, doc_id::varchar) as label from documents),
hi as materialized (select fu.*, so.doc_id, so.lang, so.topic, so.ch, so.label from fu join so using (pid))"""

FUSED = fused(KEYWORD)
FOLDED = "fo as (select *, array_to_string(list(label) over (partition by qid, coalesce(ch, chr(1) || pid) order by rank rows between 1 following and unbounded following), ',') as alternates, row_number() over (partition by qid, coalesce(ch, chr(1) || pid) order by rank) as n from hi)"


def diverse(table: str) -> str:
    return f"dv as (select *, row_number() over (partition by qid order by (nd > 2)::int, rank) as place from (select *, row_number() over (partition by qid, doc_id order by rank) as nd from {table}) qualify place <= {K})"


def chunked(source: str, keys: str, cap: int) -> str:
    """Greedy packing as a recursive walk over each page's lines; for texts without a line above the cap."""
    return f"""
src as ({source}),
un as materialized (select {keys}, i, u, {estimate('u')} as n from (select {keys}, unnest(list_filter(list_transform(regexp_split_to_array(raw_text, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')), lambda x: x <> '')) as u, generate_subscripts(list_filter(list_transform(regexp_split_to_array(raw_text, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')), lambda x: x <> ''), 1) as i from src)),
wk as (
  select {keys}, i, u as cur, n as cn, 0 as ordinal from un where i = 1
  union all
  select {', '.join('un.' + k.strip() for k in keys.split(','))}, un.i,
    case when wk.cn + un.n <= {cap} and not (regexp_matches(wk.cur, '[.!?؟…:][''"”’)]*$') and wk.cn * 2 >= {cap}) then wk.cur || ' ' || un.u else un.u end,
    case when wk.cn + un.n <= {cap} and not (regexp_matches(wk.cur, '[.!?؟…:][''"”’)]*$') and wk.cn * 2 >= {cap}) then wk.cn + un.n else un.n end,
    case when wk.cn + un.n <= {cap} and not (regexp_matches(wk.cur, '[.!?؟…:][''"”’)]*$') and wk.cn * 2 >= {cap}) then wk.ordinal else wk.ordinal + 1 end
  from wk join un on {' and '.join(f'un.{k.strip()} = wk.{k.strip()}' for k in keys.split(','))} and un.i = wk.i + 1),
ck as (select {keys}, ordinal, arg_max(cur, i) as text, arg_max(cn, i)::int as tokens from wk group by {keys}, ordinal)"""


def chunked_long(source: str, key: str, cap: int) -> str:
    """As ``chunked``, for texts whose lines may be above the cap: these are units of sentences, and sentences above it units of words."""
    trimmed = f"list_filter(list_transform(regexp_split_to_array(raw_text, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')), lambda x: x <> '')"
    sentences = f"list_filter(string_split(regexp_replace(u, '([.!?؟…:]){SP}+', '\\1' || chr(30), 'g'), chr(30)), lambda x: trim(x) <> '')"
    words = f"list_filter(regexp_split_to_array(s, '{SP}+'), lambda x: x <> '')"
    opens = f"(wk.ended or wk.cn + un.n > {cap} or un.heads or (not un.alone and regexp_matches(wk.cur, '[.!?؟…:][''\"”’)]*$') and wk.cn * 2 >= {cap}))"
    return f"""
src as ({source}),
ln as (select {key}, li, u, {estimate('u')} as n from (select {key}, unnest({trimmed}) as u, generate_subscripts({trimmed}, 1) as li from src)),
se as (select {key}, li, si, ns, s, {estimate('s')} as n from (select {key}, li, unnest(ss) as s, generate_subscripts(ss, 1) as si, len(ss) as ns from (select {key}, li, {sentences} as ss from ln where n > {cap}))),
wo as (select {key}, li, si, ns, unnest(ws) as w, generate_subscripts(ws, 1) as wi, len(ws) as nw from (select {key}, li, si, ns, {words} as ws from se where n > {cap})),
ua as (select {key}, li, 0 as si, 0 as wi, u, n, false as alone, false as heads, false as tails from ln where n <= {cap} union all select {key}, li, si, 0, s, n, true, si = 1, si = ns from se where n <= {cap} union all select {key}, li, si, wi, w, {estimate('w')}, true, wi = 1, si = ns and wi = nw from wo),
un as materialized (select *, row_number() over (partition by {key} order by li, si, wi) as i from ua),
wk as (
  select {key}, i, u as cur, n as cn, 0 as ordinal, tails as ended from un where i = 1
  union all
  select un.{key}, un.i, case when {opens} then un.u else wk.cur || ' ' || un.u end, case when {opens} then un.n else wk.cn + un.n end, case when {opens} then wk.ordinal + 1 else wk.ordinal end, un.tails
  from wk join un on un.{key} = wk.{key} and un.i = wk.i + 1),
ck as (select {key}, ordinal, arg_max(cur, i) as text, arg_max(cn, i)::int as tokens from wk group by {key}, ordinal)"""


CHUNKS = chunked("select distinct doc_id, pdf_page, raw_text from pages where raw_text is not null", "doc_id, pdf_page", 300)
BUILT = chunked(f"select doc_id, pdf_page, engine, raw_text from (select distinct doc_id, pdf_page, engine, raw_text from pages) where {page_reason('raw_text')} = ''", "doc_id, pdf_page, engine", C.CAP)
DERIVED = "case when engine like 'ocr%' then 'ocr' else 'extracted' end"
PID = "doc_id || ':p' || lpad(pdf_page::varchar, greatest(3, length(pdf_page::varchar))::int, '0') || ':' || lpad(ordinal::varchar, greatest(2, length(ordinal::varchar))::int, '0')"
USD = "coalesce(sum(case when kind = '{0}' then ({1})::decimal(18,8) end), 0::decimal(18,8))"
TOTALS = f"""round({USD.format('commit', 'coalesce(cost_reported_usd, cost_est_usd)')}, 6)::double as committed_usd,
round({USD.format('reserve', 'cost_est_usd')} - {USD.format('release', 'cost_est_usd')}, 6)::double as reserved_usd,
coalesce(sum(case when kind = 'commit' then coalesce(tokens_reported, tokens_est) end), 0)::bigint as tokens from (select distinct * from usage_log)"""


COVERED = f"with {CATALOG}, s as (select doc_id, count(*) filter (status = 'approved') as a, count(*) filter (status = 'excluded') as e, count(*) filter (status = 'pending') as p from (select distinct doc_id, pdf_page, status from pages) group by all), t as (select doc_id, count(*) as n, count(*) filter (v) as v from (select doc_id, pid, bool_or(content_hash = substring(sha256(concat_ws(chr(10), derivation, text_raw)), 1, 32)) as v from passages group by all) group by all)"
LANGUAGE = f"case when {ratio('text')} >= 0.5 then 'ar' else 'en' end"
RESOLVED = f"""{RECOGNIZED},
rw as (select distinct pid, doc_id, pdf_page, ordinal, text_reviewed, region, topic, lang from passages where derivation = 'reviewed_transcription'),
r1 as (select pg.doc_id, pg.pdf_page, pg.engine, case when {choice('pg.raw_text', 'tx.other_text')} = 'a' then pg.raw_text else tx.other_text end as text, rc.ocr_text, rc.words, rc.mean_conf, rc.error, rv.doc_id is not null as reviewed from pg left join tx on pg.doc_id = tx.doc_id and pg.pdf_page = tx.pdf_page left join rc on pg.doc_id = rc.doc_id and pg.pdf_page = rc.pdf_page left join (select distinct doc_id, pdf_page from rw) rv on pg.doc_id = rv.doc_id and pg.pdf_page = rv.pdf_page),
r2 as (select *, {page_reason('text')} as r, {ocr_reason('ocr_text')} as o from r1),
r3 as (select *, r <> '' and (words is not null or error is not null) and (o = '' or error is null) as used from r2)"""
REVIEWED = chunked("select doc_id, pdf_page, ordinal as para, text_reviewed as raw_text from (select distinct pid, doc_id, pdf_page, ordinal, text_reviewed from passages where derivation = 'reviewed_transcription')", "doc_id, pdf_page, para", C.CAP).replace("src as", "v_src as").replace("from src", "from v_src").replace("un as", "v_un as").replace("un.", "v_un.").replace("from un ", "from v_un ").replace("join un ", "join v_un ").replace("wk as", "v_wk as").replace("wk.", "v_wk.").replace("from wk ", "from v_wk ").replace("ck as", "v_ck as")
IMPORTED = chunked("select doc_id, pdf_page, case when used or engine like 'ocr%' then 'ocr' else 'extracted' end as derivation, case when used then ocr_text else text end as raw_text from r3 where not reviewed and case when used then o else r end = ''", "doc_id, pdf_page, derivation", C.CAP)
NUMBERED = "v_nu as (select *, row_number() over (partition by doc_id, pdf_page order by para, ordinal) - 1 as place from v_ck)"
GLOSSARY = f"gt as (select doc_id, unnest(string_split(topics, ', ')) as topic from ct where topics is not null), gp as (select distinct a.topic as key, {normalized('b.topic')} as term, b.topic as raw from gt a join gt b using (doc_id) where a.topic <> b.topic), gl as (select {normalized('key')} as key, list(term order by raw) as terms from gp group by key)"
ASKED = f"""qr as (select doc_id as qid, concat_ws(' ', title, topic) as raw, case when doc_id % 40 = 0 then topic end as topic, 1 + (doc_id // 20) % 10 as k, HINT as lang from documents where doc_id % 20 = 0 and title is not null),
qn as (select *, {normalized('substring(raw, 1, 500)')} as norm from qr),
qx as (select qid, string_agg(key, ',' order by key, terms) as keys, string_agg(array_to_string(terms, ' '), ' ' order by key, terms) as extra from qn join gl on case when contains(key, ' ') then contains(norm, key) else list_contains(string_split(norm, ' '), key) end group by qid),
qb as materialized (select qn.*, coalesce(keys, '') as keys, trim({stripped('norm')} || ' ' || coalesce(extra, '')) as bag from qn left join qx using (qid))"""


def searched() -> str:
    asked = ASKED.replace("HINT", hint("concat_ws(' ', title, topic)"))
    filtered = "hf as (select hi.*, qb.k from hi join qb using (qid) where (qb.lang is null or hi.lang = qb.lang) and (coalesce(qb.topic, '') = '' or lower(coalesce(hi.topic, '')) = lower(qb.topic)))"
    folded = FOLDED.replace("from hi)", "from hf)")
    return f"{CATALOG}, {GLOSSARY}, {asked}, {fused(keyword('select qid, bag as q from qb'))}, {filtered}, {folded}, f1 as (select * from fo where n = 1), dv as (select *, row_number() over (partition by qid order by (nd > 2)::int, rank) as place from (select *, row_number() over (partition by qid, doc_id order by rank) as nd from f1) qualify place <= k)"


def hint(x: str = "title") -> str:
    return "case " + " ".join(f"when regexp_matches(lower({x}), {quote(p)}) then {quote(lang)}" for lang, p in HINTS.items()) + " end"


def oracle_sql() -> dict[str, str]:
    return {
        "normalize_text": f"select pid, {lines('text_raw')} as normalized from (select distinct pid, text_raw from passages)",
        "normalize_glued": f"select doc_id, pdf_page, {normalized('raw_text')} as normalized from (select distinct doc_id, pdf_page, raw_text from pages)",
        "stopword_strip": f"select doc_id, {stripped(lines('title'))} as terms from documents where title is not null",
        "language_hint_filter": f"select doc_id, lang, {hint()} as hint from documents where {hint()} is not null",
        "script_ratio": f"select doc_id, pdf_page, {ratio('raw_text')} as ratio, case when {ratio('raw_text')} >= 0.5 then 'ar' else 'en' end as label, (length(raw_text) - length(replace(raw_text, chr(65533), '')))::int as lost from (select distinct doc_id, pdf_page, raw_text from pages) where raw_text is not null",
        "content_hash": "select pid, substring(sha256(concat_ws(chr(10), derivation, text_raw)), 1, 32) as hash, content_hash from (select distinct pid, derivation, text_raw, content_hash from passages)",
        "page_gate": f"with {PAGES} select doc_id, pdf_page, case when {page_reason('raw_text')} = '' then 'approved' else 'excluded' end as status, {page_reason('raw_text')} as reason, case when coalesce(raw_chars, 0) <= 0 then 'blank_or_no_text' when raw_chars < 50 then 'too_short' else '' end as inventory_reason from pg",
        "gate_summary": f"select doc_id, case when reason = '' then 'approved' else 'excluded' end as status, reason, count(*) as pages from (select doc_id, {page_reason('raw_text')} as reason from (select distinct doc_id, pdf_page, raw_text, raw_chars from pages)) group by all",
        "ocr_gate": f"with {RECOGNIZED} select doc_id, pdf_page, case when {ocr_reason('ocr_text')} = '' then 'approved' else 'excluded' end as status, {ocr_reason('ocr_text')} as reason from rc",
        "ocr_resolve": f"with {RECOGNIZED}, g as (select doc_id, pdf_page, {page_reason('raw_text')} as r, {ocr_reason('ocr_text')} as o, words is not null or error is not null as has, error from rc), u as (select *, r <> '' and has and (o = '' or error is null) as used from g) select doc_id, pdf_page, case when case when used then o else r end = '' then 'approved' else 'excluded' end as status, case when used then o when r <> '' and has then 'ocr_' || r else r end as reason, used as used_ocr from u",
        "ocr_clean": f"with p as (select pid, regexp_extract_all(text_raw, '{SP}+|{NSP}+') as p from (select distinct pid, text_raw, derivation from passages) where derivation = 'ocr') select pid, array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: not (regexp_matches(p[i], '^[^A-Za-z0-9]*[A-Za-z]{{1,3}}[^A-Za-z0-9]*$') and not regexp_matches(coalesce(case when i > 2 then p[i - 2] end, ''), '[A-Za-z]{{4,}}') and not regexp_matches(coalesce(p[i + 2], ''), '[A-Za-z]{{4,}}'))), lambda i: p[i]), '') as cleaned from p",
        "engine_choice": f"with {PAGES}, {TEXTS}, c as (select distinct pg.doc_id, pg.pdf_page, engine, raw_text, other_text, {choice('raw_text', 'other_text')} as choice from pg left join tx on pg.doc_id = tx.doc_id and pg.pdf_page = tx.pdf_page where engine not like 'ocr%') select doc_id, pdf_page, engine, choice, length(coalesce(case when choice = 'a' then other_text else raw_text end, ''))::int as alt_chars from c",
        "label_parse": f"select p.doc_id, p.pdf_page, coalesce(case when r.doc_id is not null then nullif(printed_label, '') end, case when try_cast(x as int) between 1 and 999 then try_cast(x as int)::varchar end) as label, printed_label from (select doc_id, pdf_page, printed_label, regexp_extract(translate(array_to_string(list_slice(string_split(raw_text, chr(10)), 1, 3), ' '), '{T.ARABIC_DIGITS}', '0123456789'), '{LABEL}', 1) as x from (select distinct doc_id, pdf_page, raw_text, printed_label from pages) where raw_text is not null) p left join (select distinct doc_id, pdf_page from passages where derivation = 'reviewed_transcription') r on p.doc_id = r.doc_id and p.pdf_page = r.pdf_page",
        "document_listing": f"with {CATALOG} select doc_id, filename, {TITLE}, source_url_status from ct",
        "metadata_left_join": f"with {CATALOG} select p.doc_id, p.pdf_page, p.engine, ct.title, ct.publisher, ct.geography, coalesce(ct.geography_provenance, 'unverified') as geography_provenance from (select distinct doc_id, pdf_page, engine from pages) p left join ct using (doc_id)",
        "coverage_catalog": f"{COVERED} select doc_id, filename, {TITLE}, geography, source_url_status, pdf_pages, coalesce(a, 0) as approved_pages, coalesce(e, 0) as excluded_pages, coalesce(p, 0) as pending_pages, coalesce(n, 0) as passages, coalesce(v, 0) as vectors from ct left join s using (doc_id) left join t using (doc_id)",
        "coverage_totals": f"with {CATALOG}, s as (select doc_id, count(*) filter (status = 'approved') as a from (select distinct doc_id, pdf_page, status from pages) group by all), t as (select doc_id, count(*) as n from (select distinct doc_id, pid from passages) group by all) select geography, count(*) as documents, sum(coalesce(a, 0))::bigint as approved_pages, sum(coalesce(n, 0))::bigint as passages from ct left join s using (doc_id) left join t using (doc_id) group by all",
        "excluded_pages": "select distinct doc_id, pdf_page, engine, exclude_reason from pages where status = 'excluded' order by doc_id, pdf_page limit 200",
        "neighbors": "with p as (select distinct pid, doc_id, pdf_page, ordinal from passages) select pid, lag(pid) over w as prev_pid, lead(pid) over w as next_pid from p window w as (partition by doc_id order by pdf_page, ordinal, pid)",
        "passage_fetch": f"with {CATALOG}, p as (select distinct pid, doc_id, pdf_page, ordinal, text_raw, text_reviewed, derivation, content_hash from passages), q as (select *, {SHOWN} as text, {LABEL_} as label, lag(pid) over w as prev_pid, lead(pid) over w as next_pid from p window w as (partition by doc_id order by pdf_page, ordinal, pid)) select q.pid, q.doc_id, {TITLE}, q.pdf_page, g.printed_label, q.label as derivation, q.text, case when q.label = 'reviewed_transcription' then g.raw_text end as raw_extraction, q.prev_pid, substring(a.text, 1, 600) as prev_text, q.next_pid, substring(b.text, 1, 600) as next_text from q join ct using (doc_id) left join (select distinct doc_id, pdf_page, printed_label, raw_text from pages) g on q.doc_id = g.doc_id and q.pdf_page = g.pdf_page left join q a on q.prev_pid = a.pid left join q b on q.next_pid = b.pid",
        "hit_projection": f"with {CATALOG}, {PASSAGES} select ps.pid, ps.doc_id, {TITLE}, ct.filename, ct.publisher, ps.pdf_page, g.printed_label, ps.region, ps.topic, ps.lang, ct.source_url, coalesce(ct.source_url_status, 'unresolved') as source_url_status, {quote(COLLECTION[0])} as collection_url, {quote(COLLECTION[1])} as collection_provenance, {quote(COLLECTION[2])} as corpus_revision, ps.content_hash, {LABEL_} as derivation, substring({SHOWN}, 1, 1500) as text, length({SHOWN}) > 1500 as text_truncated from ps join ct using (doc_id) left join (select distinct doc_id, pdf_page, printed_label from pages) g on ps.doc_id = g.doc_id and ps.pdf_page = g.pdf_page",
        "filter_search_params": "select distinct pid, doc_id, region, topic, lang from passages where lower(region) = 'jabal ruqishir' and lang = 'en'",
        "page_selection": f"with {CATALOG}, r as (select doc_id, unnest(range(1, least(3, pdf_pages) + 1)) as pdf_page from ct where pdf_pages >= 1 union select doc_id, pdf_pages from ct where pdf_pages >= 1) select distinct doc_id, p.pdf_page, engine from pages p semi join r on p.doc_id = r.doc_id and p.pdf_page = r.pdf_page",
        "error_histogram": f"with {RECOGNIZED} select split_part(error, ':', 1) as error, count(*) as pages from rc where error is not null group by all",
        "tokenize": f"with {TOKENS} select pid, len(t)::int as dl, len(list_distinct(t))::int as terms from tk",
        "doc_frequency": f"with {TOKENS} select term, count(*) as df from (select pid, unnest(list_distinct(t)) as term from tk) group by all",
        "corpus_stats": f"with {TOKENS} select count(*) as n_docs, round(avg(len(t)), 6) as avgdl from tk",
        "bm25_topk": f"with {KEYWORD} select qid, pid as doc_id, score, rank::int as rank from kw",
        "phrase_match": f"with {TOKENS}, r as (select distinct lower(region) as qid from passages), ph as (select qid, {tokens(lines('qid'))} as phrase from r), po as materialized (select pid, t, unnest(t) as term, generate_subscripts(t, 1) as i from tk) select qid, pid, count(*) as occurrences from ph join po on po.term = phrase[1] where len(phrase) > 0 and t[i : i + len(phrase) - 1] = phrase group by all",
        "alias_expand": f"with {CATALOG}, {GLOSSARY}, q as (select doc_id as qid, {lines("'' || concat_ws(' ', title, topic)")} as query from documents) select qid, key, array_to_string(terms, ',') as terms from q join gl on case when contains(key, ' ') then contains(query, key) else list_contains(string_split(query, ' '), key) end",
        "vector_topk": f"with {VECTOR} select qid, pid as vec_id, sim, rank::int as rank from ve",
        "rrf_fuse": f"with {FUSED} select qid, pid as doc_id, round(score, 9) as score, fts_rank::int as fts_rank, vec_rank::int as vec_rank, rank::int as rank from fu",
        "post_filter": f"with {FUSED} select qid, pid, rank::int as rank from hi where lang = 'ar'",
        "dedup_alt_provenance": f"with {FUSED}, {FOLDED} select qid, pid, rank::int as rank, coalesce(alternates, '') as alternates from fo where n = 1",
        "diversity_topk": f"with {FUSED}, {diverse('hi')} select qid, pid, place::int as place from dv",
        "hybrid_topk": f"with {FUSED}, {FOLDED}, f1 as (select * from fo where n = 1), {diverse('f1')} select qid, pid, doc_id as source, lang, coalesce(alternates, '') as alternates, place::int as place from dv",
        "eval_hit_at_k": f"with {FUSED}, {diverse('hi')}, cs as (select doc_id as qid, lang as kind, topic, source from documents where doc_id % 20 = 0 and title is not null and topic is not null and lang is not null), ev as (select cs.qid, d.source as doc_id, d.doc_id as pid from cs join documents d on d.topic = cs.topic and d.source = cs.source where d.title is not null), ht as (select distinct dv.qid from dv join ev on dv.qid = ev.qid and dv.doc_id = ev.doc_id and dv.pid = ev.pid) select kind, count(*) as n, count(ht.qid) as hits, round(count(ht.qid) / count(*), 6) as rate from cs left join ht using (qid) group by all",
        "chunk_lines": f"with recursive {CHUNKS} select doc_id, pdf_page, ordinal::int as ordinal, text, tokens from ck",
        "chunk_stats": f"with recursive {CHUNKS} select doc_id, count(*) as chunks, sum(tokens)::bigint as tokens, max(tokens) as most from ck group by all",
        "build_passages": f"with recursive {BUILT} select {PID} as pid, doc_id, pdf_page, ordinal::int as ordinal, text as text_raw, {normalized('text')} as text_search, {DERIVED} as derivation, substring(sha256(concat_ws(chr(10), {DERIVED}, text)), 1, 32) as content_hash, tokens, case when {ratio('text')} >= 0.5 then 'ar' else 'en' end as lang from ck",
        "import_upsert_merge": f"with {CATALOG} select doc_id, filename, title, source_url_status, imported_at::date as imported from ct",
        "stale_anti_join": f"with recursive {BUILT}, b as (select distinct doc_id, pdf_page, {PID} as pid from ck) select distinct pid, doc_id, pdf_page from passages p where exists (select 1 from b where b.doc_id = p.doc_id and b.pdf_page = p.pdf_page) and not exists (select 1 from b where b.pid = p.pid)",
        "embed_cache_anti": "select distinct pid, content_hash from passages where content_hash <> substring(sha256(concat_ws(chr(10), derivation, text_raw)), 1, 32)",
        "cache_validity": "select distinct stem, pdf_page, mean_conf, words from ocr_cache o where langs = 'ara+eng' and clean = 1 and exists (select 1 from doc_catalog c where c.doc_id = o.stem and substring(c.checksum, 1, 12) = o.checksum12)",
        "dry_run_estimate": f"with recursive {BUILT}, b as (select doc_id, count(*) as chunks, sum(tokens)::bigint as tokens from ck group by all), g as (select doc_id, count(*) filter ({page_reason('raw_text')} = '') as approved, count(*) filter ({page_reason('raw_text')} <> '') as excluded from (select distinct doc_id, pdf_page, raw_text, raw_chars from pages) group by all) select doc_id, approved, excluded, coalesce(chunks, 0) as chunks, coalesce(tokens, 0) as tokens, round(coalesce(tokens, 0) / 1e6 * 0.02, 9) as usd, round(coalesce(tokens, 0) / 1e6 * 0.02 * 1.5, 9) as worst_usd from g left join b using (doc_id)",
        "batch_packing": "with recursive p as materialized (select doc_id, tokens, row_number() over (partition by doc_id order by pdf_page, ordinal, pid) as i from (select distinct doc_id, pdf_page, ordinal, pid, tokens from passages)), w as (select doc_id, i, 0 as batch, 1 as n, tokens::bigint as total, tokens from p where i = 1 union all select p.doc_id, p.i, case when w.n >= 20 or w.total + p.tokens > 2000 then w.batch + 1 else w.batch end, case when w.n >= 20 or w.total + p.tokens > 2000 then 1 else w.n + 1 end, case when w.n >= 20 or w.total + p.tokens > 2000 then p.tokens else w.total + p.tokens end, p.tokens from w join p on p.doc_id = w.doc_id and p.i = w.i + 1) select doc_id, batch::int as batch, count(*) as items, sum(tokens)::bigint as tokens from w group by doc_id, batch",
        "budget_admission": "with d as (select ts::timestamp::date as day, round(sum(cost_est_usd::decimal(18,8)), 6)::double as cost from (select distinct id, ts, kind, cost_est_usd from usage_log) where kind = 'commit' group by all), s as (select *, round(coalesce(sum(cost) over (order by day rows between unbounded preceding and 1 preceding), 0), 9) as b, (select sum(cost) / 2 from d) as cap from d) select day, cost, round(b, 6) as spent_before, max(case when b + 1.5 * cost <= cap then 0 else 1 end) over (order by day) = 0 as admitted from s",
        "ledger_totals": f"select {TOTALS}",
        "ledger_by_note": f"select note, {TOTALS} group by note",
        "open_reserves": "select ts::timestamp::date as day, count(*) filter (kind = 'reserve') as reserves, count(*) filter (kind = 'release') as releases, count(*) filter (kind = 'commit') as commits, count(*) filter (kind = 'reserve') - count(*) filter (kind = 'release') as open from (select distinct * from usage_log) group by day",
        "coverage_of_region": f"{COVERED} select doc_id, filename, {TITLE}, geography, source_url_status, pdf_pages, coalesce(a, 0) as approved_pages, coalesce(e, 0) as excluded_pages, coalesce(p, 0) as pending_pages, coalesce(n, 0) as passages from ct left join s using (doc_id) left join t using (doc_id) where lower(geography) = 'inland district' and list_contains(string_split(lower(topics), ', '), 'food')",
        "coverage_report": f"{COVERED}, m as ({'select ' + TOTALS}), d as (select coalesce(max(len(embedding)), 0)::int as dims, count(*) as vectors_indexed from embeddings), c as (select count(*) as documents, sum(coalesce(a, 0))::bigint as approved_pages, sum(coalesce(e, 0))::bigint as excluded_pages, sum(coalesce(p, 0))::bigint as pending_pages, sum(coalesce(n, 0))::bigint as passages, sum(coalesce(v, 0))::bigint as vectors from ct left join s using (doc_id) left join t using (doc_id)) select c.*, d.*, committed_usd, reserved_usd, case when vectors_indexed > 0 then 'hybrid' else 'keyword_only' end as search_mode from c, d, m",
        "chunk_long_lines": f"with recursive {chunked_long('select doc_id, text as raw_text from documents where text is not null', 'doc_id', LONG_CAP)} select doc_id, ordinal::int as ordinal, text, tokens from ck",
        "search_batch": f"with {searched()} select qid, pid, doc_id as source, lang, coalesce(alternates, '') as alternates, place::int as place from dv",
        "search_answers": f"with {searched()}, s as (select dv.qid, count(*) as n, bool_or(length(d.text) > 1500) as cut from dv join documents d on d.doc_id = dv.pid group by all), v as (select distinct qid from ve) select qb.qid, case when v.qid is null then 'keyword_only' else 'hybrid' end as mode, concat_ws(',', case when qb.lang is not null then 'language_hint' end, case when v.qid is null then 'keyword_only' end, case when s.qid is null then 'no_match' end, case when s.cut then 'truncated' end) as warnings, qb.keys as expansions, coalesce(s.n, 0) as n_results from qb left join s using (qid) left join v using (qid)",
        "reviewed_passages": f"with recursive {CATALOG}, {REVIEWED}, {NUMBERED}, m as (select distinct pid, doc_id, pdf_page, ordinal as para, region, topic from passages where derivation = 'reviewed_transcription'), l as (select doc_id, pdf_page, min(lang) as lang from passages where derivation = 'reviewed_transcription' group by all) select {PID.replace('ordinal', 'place').replace('doc_id', 'n.doc_id').replace('pdf_page', 'n.pdf_page')} as pid, n.doc_id, n.pdf_page, place::int as ordinal, {normalized('text')} as text_search, text as text_reviewed, 'reviewed_transcription' as derivation, substring(sha256('reviewed_transcription' || chr(10) || text), 1, 32) as content_hash, tokens, coalesce(m.region, ct.geography) as region, coalesce(m.topic, string_split(ct.topics, ', ')[1]) as topic, coalesce(l.lang, {LANGUAGE}) as lang from v_nu n join m on n.doc_id = m.doc_id and n.pdf_page = m.pdf_page and n.para = m.para join l on n.doc_id = l.doc_id and n.pdf_page = l.pdf_page left join ct on ct.doc_id = n.doc_id",
        "import_result": f"with recursive {RESOLVED}, {IMPORTED}, {REVIEWED}, u as (select doc_id, derivation, tokens from ck union all select doc_id, 'reviewed_transcription', tokens from v_ck) select doc_id, derivation, count(*) as passages, sum(tokens)::bigint as tokens from u group by all",
        "expired_reserves": "with u as (select distinct * from usage_log), d as (select ts::timestamp::date as day, sum(case when kind = 'reserve' then cost_est_usd::decimal(18,8) when kind = 'release' then -(cost_est_usd::decimal(18,8)) end) as o from u group by all) select day, round(o, 6)::double as open_usd from d where o > 0 and day < (select max(day) from d)",
        "hit_json": f"with {CATALOG}, {PASSAGES} select ps.pid, to_json(struct_pack(pid := ps.pid, title := {TITLE.removesuffix(' as title')}, pdf_page := ps.pdf_page, lang := ps.lang, derivation := {LABEL_}, text_truncated := length({SHOWN}) > 1500))::varchar as hit from ps join ct using (doc_id)",
    }
