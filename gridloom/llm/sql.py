"""DuckDB SQL for the queries that SQL can express."""

from gridloom.llm import licenses

WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

MIXING = rf"""
with sized as (
  select doc_id, source, {WORDS}::bigint as size, md5(coalesce(doc_id::varchar, '')) as shuffle, coalesce(md5(text), '-') as text_key from documents
), listed as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as ord from sized group by source
), weighed as (
  select *, (ord % 3 + 1)::bigint as weight, sum(source_size) over ()::bigint as total, sum(ord % 3 + 1) over ()::bigint as weight_total from listed
), filled as (
  select *, coalesce(sum(3 * source_size) over before, 0)::bigint as b, coalesce(sum(weight) over before, 0)::bigint as wb from weighed
  window before as (order by source_size / weight, ord rows between unbounded preceding and 1 preceding)
), capped as (
  select *, 3 * source_size * (weight_total - wb) <= (total - b) * weight as capped from filled
), shared as (
  select *, coalesce(sum(3 * source_size) filter (capped) over (), 0)::bigint as cw, coalesce(sum(weight) filter (capped) over (), 0)::bigint as cweight from capped
), goals as (
  select source, source_size, case when capped then (3 * source_size)::double
    else (weight * (total - cw))::double / (weight_total - cweight)::double end as target from shared
), placed as (
  select s.doc_id, s.size, g.source_size, g.target, floor(g.target + 0.5)::bigint as words,
    coalesce(sum(s.size) over (partition by s.source order by s.shuffle, s.doc_id, s.size, s.text_key rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target, (
    greatest(0, least(start + size, words) - start)
  + greatest(0, least(start + size + source_size, words) - start - source_size)
  + greatest(0, least(start + size + 2 * source_size, words) - start - 2 * source_size))::bigint as taken
from placed
"""

TOPK = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from usable q join usable c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from scored
)
select * from ranked where rank <= 5
"""

QUALITY = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce('=' || source, '-') as host, coalesce(text, '') as text from documents
), words as (
  select r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from docs
), windows as (
  select r, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] as g from words, unnest(range(len(ws) - 2)) t(i) where len(ws) > 2
), repeats as (
  select r, i, count(*) over (partition by r, g) as n from windows
), covered as (
  select r, count(distinct p)::bigint as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from repeats where n > 1) group by r
), lines as (
  select r, unnest(string_split(text, chr(10))) as line from docs
), folded as (
  select r, line, len(ws)::bigint as w, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') as norm
  from (select r, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from lines) where len(ws) > 0
), dups as (
  select r, (count(*) - count(distinct line))::bigint as n_dup_lines from folded group by r
), firsts as (
  select min(r) as r, host from docs group by host, text
), common as (
  select f.host, norm from firsts f join folded using (r) group by f.host, norm having count(distinct f.r) > 10
), gone as (
  select r, sum(w)::bigint as removed from folded join docs using (r) join common using (host, norm) group by r
), counted as (
  select d.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(removed, 0) as removed_words
  from docs d join words using (r) left join covered using (r) left join dups using (r) left join gone using (r)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - removed_words >= 0.3 * n_words as kept
from counted
"""

URLS = r"""
with parsed as (
  select page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), rules(rhost, rpath, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits as (
  select page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
  from parsed join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all
)
select page_id, p.host, p.path, rule, coalesce(verdict, 'allow') as verdict from parsed p left join fits using (page_id)
"""



def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '(?m){licenses.COPYRIGHT}', '', 'g')"
    for spelling, usual in licenses.SPELLINGS:
        out = f"replace({out}, '{spelling}', '{usual}')"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _whole(canonical: str) -> str:
    return f"trim(regexp_replace(replace({canonical}, chr(10), ' '), ' +', ' ', 'g'))"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in [*licenses.KNOWN, *licenses.whole_texts()])

LICENSES = f"""
with known as (
  select min(license) as license, canon from (select license, {_whole(_canonical("text"))} as canon from (values {_KNOWN}) k(license, text)) group by canon
), docs as (
  select row_number() over () as r, doc_id, {_canonical("text")} as canon from documents
), lines as (
  select r, string_agg(distinct license, ',' order by license) as notices from (select r, trim(unnest(string_split(canon, chr(10)))) as line from docs) join known on line = known.canon group by r
)
select doc_id, license, coalesce(notices, '') as notices from docs d left join known k on k.canon = {_whole("d.canon")} and k.canon <> '' left join lines using (r)
"""

SQL = {
    "op10_license_scan": LICENSES,
    "op3_mixing": MIXING,
    "op4_topk": TOPK,
    "op7_quality": QUALITY,
    "op8_url_filter": URLS,
}
