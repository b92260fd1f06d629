"""DuckDB SQL for those corpus queries that SQL can express, written without the operators' short cuts."""

from __future__ import annotations

from . import mixing, near_dups, quality, urls

_WORD = r"[^\x20\x09-\x0D]+"
_FIVE = "word || ' ' || " + " || ' ' || ".join(f"lead(word, {k}) over (partition by r order by i)" for k in range(1, 5))


def _values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


_CLASSES = ["[^a-z]", "[^A-Z]", "[^0-9]", r"""[^.,;:!?''"()\-]""", r"[^#*$%&|<>]", None, r"[\x00-\x7F]"]
_COUNTS = [f"length(regexp_replace(text, '{c}', '', 'g'))" if c else None for c in _CLASSES]
_COUNTS[5] = "length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) - " + " - ".join(c for c in _COUNTS[:5] if c)

QUALITY = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '{_WORD}') as ws from d),
tok as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
win as (select r, i, {_FIVE} as win from tok),
twice as (select r, i from (select r, i, count(*) over (partition by r, win) as c from win where win is not null) where c > 1),
cover as (select r, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(5)) as k) group by r),
lns as (select r, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as x from d),
base as (
  select d.r, doc_id, len(ws) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
         {_COUNTS[4]} as n_symbols, len(x) - len(list_distinct(x)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d join w using (r) join lns using (r) left join cover using (r)
),
lex(lang_no, w) as {_values([(i, w) for i, words in enumerate(quality.COMMON.values()) for w in words])},
hit as (select r, w, count(*) as n from (select r, lower(trim(word, '.,;:!?')) as w from tok) where w in (select w from lex) group by 1, 2),
lang as (select r, lang_no from (select r, lang_no, row_number() over (partition by r order by sum(n) desc, lang_no) as k from hit join lex using (w) group by r, lang_no) where k = 1),
feat as (
  select r, 'c' as kind, unnest(['1', '2', '3', '4', '5', '6', '7']) as bin, unnest([{", ".join(_COUNTS)}]) as n from d
  union all select r, 'w', w, n from hit
  union all select r, 'w', '', n_words - coalesce(h, 0) from base left join (select r, sum(n) as h from hit group by r) using (r)
),
ref as (select lang_no, kind, bin, sum(n) as n from feat join lang using (r) group by all),
good as (select lang_no from ref where kind = 'w' and bin <> '' group by 1 having sum(n) >= {quality.MIN_REFERENCE_HITS}),
q as (select lang_no, kind, bin, n / sum(n) over (partition by lang_no, kind) as q from ref join good using (lang_no)),
p as (select r, kind, bin, n / sum(n) over (partition by r, kind) as p from feat where r in (select r from base where n_words >= {quality.MIN_WORDS_CHARS})),
bins as (select distinct kind, bin from feat),
pq as (
  select k.r, k.lang_no, b.kind, b.bin, coalesce(p.p, 0) as p, coalesce(q.q, 0) as q
  from (select distinct r, lang_no from p, good) k cross join bins b left join p on p.r = k.r and p.kind = b.kind and p.bin = b.bin left join q on q.lang_no = k.lang_no and q.kind = b.kind and q.bin = b.bin
),
js as (select r, lang_no, kind, sqrt(greatest(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2, 0)) as js from pq group by all),
near as (select r, min(js) filter (where kind = 'c') as c, min(js) filter (where kind = 'w') as w from js group by r),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (n_words < {quality.MIN_WORDS_CHARS} or coalesce(c, 0) <= {quality.MAX_CHARS}) and (n_words < {quality.MIN_WORDS_COMMON} or coalesce(w, 0) <= {quality.MAX_COMMON}) as kept
from judged left join near using (r)
"""

MIXING = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) as size, md5('mix' || coalesce(cast(doc_id as varchar), 'null')) as ord from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) as no from d group by source),
w as (select *, list_extract([{", ".join(f"{x}::double" for x in mixing.WEIGHTS)}], (no - 1) % {len(mixing.WEIGHTS)} + 1) as weight, sum(source_size) over ()::double as total, source_size * {mixing.MAX_REPEATS}::double as lim from s),
l as (
  select *, lim / weight as level,
         (total - coalesce(sum(lim) over (order by lim / weight, no rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by lim / weight, no rows between current row and unbounded following) as common
  from w
),
t as (select *, least(lim, coalesce((select common from l where level > common order by level, no limit 1), level) * weight) as target from l),
k as (select *, cast(least(floor(target + 0.5), source_size * {mixing.MAX_REPEATS}) as bigint) as take from t),
b as (select *, cast(ceil(take / {mixing.BLOCK_WORDS}) as bigint) as blocks, sum(cast(ceil(take / {mixing.BLOCK_WORDS}) as bigint)) over (order by no) as high from k),
points as (select i as slot, row_number() over (order by (i % {mixing.PERIOD} * {mixing.STEP}) % {mixing.PERIOD}, i) - 1 as place from range((select cast(max(high) as bigint) from b)) g(i)),
hits as (select no, slot, row_number() over (partition by no order by slot) - 1 as block from points join b on place >= high - blocks and place < high),
placed as (select d.*, row_number() over () as r, coalesce(sum(size) over (partition by source order by ord, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start from d),
seen as (
  select r, no, take, size, start + pass * source_size as a, least(start + pass * source_size + size, take) as z
  from placed p join b on p.source is not distinct from b.source, (select unnest(range({mixing.MAX_REPEATS})) as pass) where size > 0 and start + pass * source_size < take
),
parts as (select *, unnest(range(cast(a // {mixing.BLOCK_WORDS} as bigint), cast((z - 1) // {mixing.BLOCK_WORDS} + 1 as bigint))) as block from seen),
taken as (
  select r, sum(least(z, (block + 1) * {mixing.BLOCK_WORDS}) - greatest(a, block * {mixing.BLOCK_WORDS})) as taken, arg_min(slot, block) as slot
  from parts join hits using (no, block) group by r
)
select doc_id, cast(size as bigint) as size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken, cast(start as bigint) as start, slot
from placed p join b on p.source is not distinct from b.source left join taken using (r)
"""

def near_dups_sql(threshold: int) -> str:
    return f"""
with recursive d as materialized (select doc_id as r, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_WORD}') as ws from documents),
tok as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
sh as materialized (
  select distinct r, s from (select r, {_FIVE} as s from tok) where s is not null
  union all select r, array_to_string(ws, ' ') from d where len(ws) between 1 and {near_dups.SHINGLE - 1}
),
n as materialized (select r, count(*) as n from sh group by r),
both_ as materialized (select a.r as a, b.r as b, count(*) as c from sh a join sh b on a.s = b.s and a.r < b.r group by all),
links as materialized (select a, b from both_ join n x on x.r = a join n y on y.r = b where 100 * c >= {threshold} * (x.n + y.n - c)),
sides as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select r, r from d union select reach.a, sides.b from reach join sides on sides.a = reach.b)
select d.r as doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.r = c.component_id as kept
from d left join n using (r) join (select a, min(b) as component_id from reach group by a) c on c.a = d.r
"""

NEAR_DUPS = near_dups_sql(near_dups.THRESHOLD)

SQL = {"op6_quality": QUALITY, "op8_mixing": MIXING, "op9_urls": urls.ORACLE_SQL, "op10_near_dups": NEAR_DUPS}
