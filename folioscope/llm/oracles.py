"""SQL of the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

from .p05_repeated_lines import MIN_CHARS, MIN_CLUSTERS
from .p10_shared_spans import LEAST


def bare(x: str) -> str:
    return f"replace(lower(upper(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))), 'ß', 'ss')"


PARTS = "list_filter(regexp_split_to_array(regexp_replace(t, '[,،]([^,،:：=]+[:：=])', chr(30) || '\\1', 'g'), '[;؛；•·●▪|¦｜\\n\\r\\t\\x{1e}]|\\s[/–—-]\\s'), lambda p: length(regexp_replace(p, '[^\\p{L}\\p{N}]+', '', 'g')) > 0)"
FIELD = f"{bare('''regexp_extract(p, '^([^:：=]+)[:：=]', 1)''')} || chr(31) || {bare('''regexp_replace(p, '^[^:：=]*[:：=]', '')''')}"
RECORDS = f"""
r as (select distinct pid, text_search as t from passages where text_search is not null),
f as (select pid, t, list_sort(list_transform({PARTS}, lambda p: {FIELD})) as f from r),
k as materialized (select pid, t, {bare('t')} as plain, case when regexp_matches(t, '[:：=]') and len(f) >= 2 and not list_bool_or(list_transform(f, lambda x: x[1] = chr(31))) then array_to_string(f, chr(30)) end as record from f)"""
LINE = "regexp_replace(regexp_replace(line, '^[^\\p{L}\\p{N}]*\\p{N}+[^\\p{L}\\p{N}\\s\\p{Z}]*([\\s\\p{Z}]|$)', '\\1'), '(^|[\\s\\p{Z}])[^\\p{L}\\p{N}\\s\\p{Z}]*\\p{N}+[^\\p{L}\\p{N}]*$', '\\1')"
LINES = f"""
p as (select distinct doc_id, pdf_page, raw_text from pages where doc_id is not null and raw_text is not null),
l as (select doc_id, pdf_page, unnest(string_split(raw_text, chr(10))) as line, generate_subscripts(string_split(raw_text, chr(10)), 1) as line_no from p),
k as materialized (select doc_id, pdf_page, line_no, {bare(LINE)} as key from l),
c as (select doc_id, key from k where length(key) >= {MIN_CHARS} group by all having count(distinct pdf_page) >= {MIN_CLUSTERS})"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {RECORDS}, e as (select pid, 'p' || plain as key from k union all select pid, 'r' || record from k where record is not null) select distinct a.pid as pid_a, b.pid as pid_b from e a join e b on a.key = b.key and a.pid < b.pid",
        "p1_records": f"with {RECORDS} select min(pid) as record_id, count(*) as copies, count(distinct t) as spellings from k group by coalesce(record, plain)",
        "p5_found": f"with {LINES} select distinct doc_id, pdf_page, line_no::int as line_no from k join c using (doc_id, key)",
        "p5_clean_pages": f"with {LINES}, f as (select doc_id, pdf_page, list(distinct line_no) as gone from k join c using (doc_id, key) group by all) select p.doc_id, p.pdf_page, case when gone is null then raw_text else array_to_string(list_filter(string_split(raw_text, chr(10)), lambda x, i: not list_contains(gone, i)), chr(10)) end as clean_text, coalesce(len(gone), 0)::int as removed_lines from p left join f on p.doc_id = f.doc_id and p.pdf_page = f.pdf_page",
        "p5_source_lines": f"with d as (select source, text, (min(created_at) at time zone 'UTC')::date as day from documents where text is not null group by all), l as (select source, text, day, unnest(string_split(text, chr(10))) as line from d), k as (select source, text, day, line, {bare(LINE)} as key from l) select source, min(line) as line, count(distinct text)::int as clusters, count(distinct day)::int as dates from k where length(key) >= {MIN_CHARS} group by source, key having count(distinct text) >= {MIN_CLUSTERS} and count(distinct day) >= 2",
        "p5_clean_documents": f"with r as (select doc_id, source, text, created_at from documents where text is not null), d as (select source, text, (min(created_at) at time zone 'UTC')::date as day from r group by all), l as (select source, text, day, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from d), k as materialized (select source, text, day, line_no, {bare(LINE)} as key from l), c as (select source, key from k where length(key) >= {MIN_CHARS} group by all having count(distinct text) >= {MIN_CLUSTERS} and count(distinct day) >= 2), g as (select k.source, k.text, list(distinct line_no) as gone from k join c on k.key = c.key and k.source is not distinct from c.source group by all) select distinct r.doc_id, case when gone is null then r.text else array_to_string(list_filter(string_split(r.text, chr(10)), lambda x, i: not list_contains(gone, i)), chr(10)) end as clean_text, coalesce(len(gone), 0)::int as removed_lines from r left join g on r.text = g.text and r.source is not distinct from g.source",
        "p10_found": f"with d as (select distinct doc_id, text from documents where length(text) >= {LEAST}), w as (select distinct doc_id, md5(substring(text, i::int, {LEAST})) as h from (select doc_id, text, unnest(range(1, length(text) - {LEAST} + 2)) as i from d)), s as (select h from w group by h having count(*) > 1), x as materialized (select w.* from w join s using (h)) select distinct a.doc_id as doc_a, b.doc_id as doc_b from x a join x b on a.h = b.h and a.doc_id < b.doc_id",
    }
