"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES
from .quality_rules import BOILERPLATE, LETTERS_A_WORD, LINE_END, NO_END, UNSPACED

SQL: dict[str, str] = {}

_FURNITURE = " or ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
SQL["op10_quality_rules"] = rf"""
with base as (
  select row_number() over () as rid, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (select rid, unnest(range(0, len(w) - 2)) as i, w from base),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, w[i + 1], w[i + 2], w[i + 3]) as n from grams) where n > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid),
firsts as (
  select rid, list_filter(lines, lambda x, k: list_position(lines, x) = k) as uniq from base),
good as (
  select rid, list_filter(uniq, lambda x: not (
      len(regexp_extract_all(x, '\||\x{{00BB}}|\x{{203A}}| > ')) > 2
      or 100 * len(regexp_extract_all(x, '[#*$%&|<>]')) > 10 * length(x)
      or (not (regexp_matches(x, '{LINE_END}') and not regexp_matches(x, '{NO_END}')) and len(regexp_split_to_array(trim(x, ' '), ' +')) < 12
          and len(regexp_split_to_array(trim(x, ' '), ' +')) + len(regexp_extract_all(x, '[{"".join(rf"\p{{{x}}}" for x in UNSPACED)}]')) // {LETTERS_A_WORD} < 12)
      or {_FURNITURE})) as good
  from firsts),
counted as (
  select doc_id, len(w)::bigint as n_words,
         list_sum(list_transform(w, lambda x: length(x))) as word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols,
         (len(lines) - len(uniq))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words,
         len(lines)::bigint as n_lines, len(good)::bigint as n_good_lines,
         list_sum(list_transform(good, lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))) as chars_left,
         text, good
  from base join firsts using (rid) join good using (rid) left join covered using (rid)),
judged as (
  select doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_good_lines,
         n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         coalesce(chars_left, 0)::bigint as chars_left,
         case when text is null then null else md5(array_to_string(good, chr(10))) end as cleaned_md5
  from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * (word_chars - chars_left) <= 50 * word_chars as kept,
       n_lines, n_good_lines, cleaned_md5
from judged
"""

SQL["op8_line_dedup"] = r"""
with base as (select row_number() over () as rid, doc_id, text, coalesce('s' || source, '') as site, string_split(text, chr(10)) as ls from documents),
l as (select rid, doc_id, site, unnest(ls) as line, unnest(range(len(ls))) as pos from base),
k as (select *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as key from l where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 2),
s as (select key, min({'d': doc_id, 'p': pos}) as first from k group by key having count(distinct site) >= 6),
gone as (select rid, pos from k join s using (key) where {'d': doc_id, 'p': pos} != first),
held as (select rid, string_agg(line, chr(10) order by pos) as text from l anti join gone using (rid, pos) group by rid)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed, md5(case when b.text is null then null else coalesce(h.text, '') end) as text_md5
from base b left join held h using (rid) left join (select rid, count(*) as n from gone group by rid) using (rid)
"""

_NOTICES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in sorted(TEMPLATES.items()))
_BIGRAMS = r"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
_CUT = r"list_filter(string_split(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x != '')"
SQL["license_lines"] = f"""
with notices(licence, notice) as (values {_NOTICES}),
tw as (select licence, {_CUT.format(t="notice")} as w from notices), t as (select licence, {_BIGRAMS.format(w="w")} as b from tw),
l as (select row_number() over () as rid, * from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents)),
lw as (select rid, doc_id, line_no, {_CUT.format(t="line")} as w from l), a as (select rid, doc_id, line_no, {_BIGRAMS.format(w="w")} as a from lw where len(w) >= 2),
m as (select rid, doc_id, line_no, licence, len(list_intersect(a, b)) as n_shared, len(a) as n_line, len(b) as n_template from a, t where 80 * len(b) <= 120 * len(a) and 80 * len(a) <= 120 * len(b)),
r as (select *, row_number() over (partition by rid order by 2.0::double * n_shared / (n_line + n_template) desc, licence) as nth from m where 200 * n_shared >= 80 * (n_line + n_template))
select doc_id, line_no, licence, n_shared::bigint as n_shared, n_line::bigint as n_line, n_template::bigint as n_template, 2.0::double * n_shared / (n_line + n_template) as dice from r where nth = 1
"""


def _tier(size: str) -> str:
    return f"cast(greatest(0, floor(ln(greatest({size}, 1) / 1048576.0::double) / ln(4.0::double) + 1e-9)) as int)"


def _rounds(n: int) -> str:
    out = f"l0 as (select arrival as run, {_tier('n_bytes')} as tier, n_bytes from a), n0 as (select run, run as dest from l0)"
    for i in range(n):
        out += f""", p{i} as (select run, tier, n_bytes, case when count(*) over (partition by tier, g) = 4 then min(run) over (partition by tier, g) else run end as dest
          from (select *, (row_number() over (partition by tier order by run) - 1) // 4 as g from l{i})),
        l{i + 1} as (select dest as run, case when count(*) > 1 then greatest({_tier("sum(n_bytes)")}, max(tier) + 1) else max(tier) end as tier, sum(n_bytes) as n_bytes from p{i} group by dest),
        n{i + 1} as (select n{i}.run, p{i}.dest from n{i} join p{i} on n{i}.dest = p{i}.run)"""
    return out


# sixteen loads, and one of rows without an id, leave at most two rounds of merging by four
SQL["op1_sharding"] = f"""
with d as (select coalesce(cast(floor(doc_id * 16 / (1 + (select max(doc_id) from documents))) as bigint), -1) as arrival, doc_id, cast(strlen(text) as bigint) as n_bytes, md5(text) as text_md5 from documents),
a as (select arrival, sum(coalesce(n_bytes, 0)) as n_bytes from d group by arrival), {_rounds(3)},
r as (select n3.dest as run_id, sum(a.n_bytes) as run_bytes, count(*) > 1 as merged from a join n3 on a.arrival = n3.run group by 1),
s as (select run_id, merged, l3.tier, cast(greatest(1, ceil(run_bytes / least(134217728, ceil(greatest(run_bytes, 1) / 16.0::double)))) as int) as n_files from r join l3 on l3.run = run_id)
select d.arrival, doc_id, d.n_bytes, text_md5, run_id, tier, case when merged then n_files else 0 end as n_files,
       case when merged then ('0x' || md5(doc_id::varchar)[1:8])::bigint % n_files end as file_no
from d join n3 on d.arrival = n3.run join s on s.run_id = n3.dest
"""

SQL["op11_fill_in_middle"] = r"""
with base as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines,
         sha256('7:' || coalesce(doc_id::varchar, '')) as d
  from documents),
drawn as (
  select *, len(lines)::bigint as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from base),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, array_to_string(lines[1:low], '') as prefix, array_to_string(lines[low + 1:high], '') as middle, array_to_string(lines[high + 1:], '') as suffix from cut)
select doc_id, n, form, case when form != 'plain' then length(prefix) end::bigint as prefix_chars, case when form != 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts"""

SQL["op12_embedding_dedup"] = """
with recursive sound as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id != b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
found as (select a, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join found on a = vec_id"""

# crc32 as a fold over the bits of the decimal doc_id's bytes: a step of 0 or more brings in a byte, one below 0 shifts
SQL["op13_periodic_runs"] = r"""
with base as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as steps
  from documents),
hashed as (
  select rid, doc_id, w, len(w)::bigint as n,
         xor(list_reduce(list_prepend(4294967295::bigint, steps), lambda c, s: case when s >= 0 then xor(c, s) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295::bigint) as h
  from base),
parted as (select *, h // 10 as g, case when n > 0 then (h // 10) % n else 0 end as a from hashed),
looped as (
  select rid, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w
  from parted),
placed as (select rid, n, unnest(w) as word, unnest(range(0, n)) as i from looped),
pairs as (
  select y.rid, y.i, y.i - x.i as lag from placed x join placed y on x.rid = y.rid and x.word = y.word and x.i < y.i and y.i - x.i <= x.n // 4),
isles as (select rid, lag, i, i - row_number() over (partition by rid, lag order by i) as isle from pairs),
long as (
  select rid, min(i) - lag as start, max(i) + 1 as stop, lag from isles group by rid, lag, isle
  having count(*) + lag >= greatest(6, 4 * lag)),
runs as (select rid, start, stop - start as length, min(lag) as period from long group by rid, start, stop),
told as (
  select rid, count(*)::bigint as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as told,
         arg_min(struct_pack(start := start, length := length, period := period), struct_pack(l := -length, s := start, p := period)) as best from runs group by rid),
gone as (select distinct rid, unnest(range(start + period, start + length)) as i from runs),
dropped as (select rid, list(i) as gone from gone group by rid),
kept as (
  select rid, doc_id, array_to_string(list_filter(w, lambda x, k: gone is null or not list_contains(gone, k - 1)), ' ') as collapsed
  from looped left join dropped using (rid))
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
       (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(told, '')) as runs_sha256, sha256(collapsed) as collapsed_sha256
from kept left join told using (rid)"""
