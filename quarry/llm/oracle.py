"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from quarry.llm.url_reputation import SUFFIXES

SQL: dict[str, str] = {}

SQL["op6_quality_rules"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as g
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
rep as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, sum(least(3, coalesce(nxt - i, 3))) as n
        from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by doc_id),
lines as (select doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') as lw from (select doc_id, unnest(ls) as l from w)),
judged as (select doc_id, length(l) as n,
    (len(lw) < 5 and not regexp_matches(l, '[.!?:;…。！？][\]\["''”’»)]*[\x20\x09-\x0D]*$'))
    or len(list_filter(lw, lambda x: translate(x, '#*$%&|<>', '') <> x)) > 0.3 * len(lw)
    or (len(string_split_regex(l, '[|»›•·]')) >= 3 and len(lw) <= 8 * len(string_split_regex(l, '[|»›•·]')))
    or (len(lw) <= 20 and regexp_matches(l, '(?i)\b(?:cookies?|javascript|lorem ipsum|all rights reserved|privacy policy|terms of (?:use|service)|sign (?:in|up)|log ?in|subscribe|newsletter|click here|read more|copyright|©)')) as bad
  from lines),
lost as (select doc_id, coalesce(sum(n) filter (where bad), 0) / greatest(sum(n), 1) as share from judged group by doc_id),
b as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
   (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
   coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(lost.share, 0) as share
  from w left join cov on cov.doc_id = w.doc_id left join lost on lost.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and share <= 0.5 as kept from b
"""

_SUFFIXES = ", ".join(f"'{x}'" for x in SUFFIXES)


def _level(key: str, before: str, after: str) -> str:
    """Counts of a level, the strength of its prior, and the posterior rates of the labelled and of all sites."""
    return f"""
c_{after} as (select {key}, sum(n) as cn, sum(bad) as cbad, any_value(mean) as cmean from k_{before} group by {key}),
s_{after} as (select case when g < 2 or free = 0 or (off - g) / free <= 0 then 1000.0 else least(1000.0, greatest(1.0, free / (off - g) - 1)) end as k
  from (select count(*) as g, sum(cn - 1)::double as free, sum(cn * (cbad / cn - cmean) * (cbad / cn - cmean) / (cmean * (1 - cmean))) as off
        from c_{after} where cmean > 0 and cmean < 1)),
k_{after} as (select t.* exclude (mean), (cbad + k * mean) / (cn + k) as mean from k_{before} t join c_{after} using ({key}) cross join s_{after}),
p_{after} as (select t.* exclude (mean, a, b), coalesce(cbad, 0) + k * mean as a, coalesce(cn, 0) - coalesce(cbad, 0) + k * (1 - mean) as b,
  (coalesce(cbad, 0) + k * mean) / (coalesce(cn, 0) + k) as mean from p_{before} t left join c_{after} using ({key}) cross join s_{after})"""


SQL["op1_url_reputation"] = rf"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
q as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as site from p),
named as (select site, case when two in ({_SUFFIXES}) then two else labels[-1] end as suffix,
    case when two in ({_SUFFIXES}) then list_aggregate(labels[-3:], 'string_agg', '.') else two end as domain
  from (select distinct site, string_split(site, '.') as labels, list_aggregate(string_split(site, '.')[-2:], 'string_agg', '.') as two from q)),
marks as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
counts as (select site, count(*) as n, sum(bad) as bad from q join marks on doc_id = page_id group by site),
total as (select (coalesce(sum(bad), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) as mean from counts),
k_all as (select counts.*, suffix, domain, mean from counts join named using (site) cross join total),
p_all as (select named.*, mean, 0.0::double as a, 0.0::double as b from named cross join total),
""" + ",".join([_level("suffix", "all", "suffix"), _level("domain", "suffix", "domain"), _level("site", "domain", "site")]) + r"""
, bound as (select site, mean - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from p_site),
fit as (select q.*, low,
   case when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
   from q left join bound using (site))
select page_id, host, path, rule,
  case rule when 'example.com/de/' then 'block' when 'net/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
  else case when low > 0.3 then 'block' else 'allow' end end as verdict from fit
"""

SQL["op7_decontaminate"] = r"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select item_id, m, list_aggregate(ws[i:i+m-1], 'string_agg', ' ') as g
        from (select item_id, ws, least(13, len(ws)) as m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)),
lens as (select distinct m from win),
dw as (select doc_id, m, i, list_aggregate(ws[i:i+m-1], 'string_agg', ' ') as g
       from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from t, lens where len(ws) >= m)),
hit as (select distinct dw.doc_id, dw.i, dw.m, win.item_id from dw join win on win.m = dw.m and win.g = dw.g),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + m)) as p from (select distinct doc_id, i, m from hit)) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select t.doc_id, len(ws)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(x.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(c.n, 0) > 0 and 20 * coalesce(c.n, 0) >= len(ws) as contaminated
from t left join covered c on c.doc_id = t.doc_id left join items x on x.doc_id = t.doc_id
"""

SQL["op3_warc_zstd"] = """
with p as (select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
  case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first_id then first_id end as refers_to
from p left join f on f.d = p.d
"""
