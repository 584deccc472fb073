"""DuckDB SQL of the corpus operators that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, {_WORDS}) as ws from d),
b as (
  select *, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2]) as ts
  from w),
trig as (select doc_id, unnest(ts) as t, unnest(range(len(ts))) as i from b),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as c from trig) where c > 1),
cov as (select doc_id, count(distinct p)::bigint as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
base as (
  select b.*, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
    (n_words < 50 or 100 * coalesce(cov.n, 0) > 50 * n_words) as base_failed,
    [length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')),
     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g')),
     length(regexp_replace(text, '[^!-~]|[A-Za-z0-9#*$%&|<>]', '', 'g'))]::double[] as cls,
    regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D.,;:!?"''()]+') as fw
  from b left join cov using (doc_id)),
words as (select lang, x as item, count(*)::double as n from (select lang, unnest(fw) as x from base where not base_failed) group by all),
totals as (select lang, sum(n) as words from words group by lang),
large as (select * from totals where words >= 0.01::double * (select sum(words) from totals)),
common as (select w.lang, w.item, w.n / l.words as share from words w join large l using (lang) where w.n >= 0.005::double * l.words),
other as (select lang, greatest(0, 1 - sum(share)) as share from common group by lang),
classes as (select lang, [sum(cls[1]), sum(cls[2]), sum(cls[3]), sum(cls[4]), sum(cls[5]), sum(cls[6]), sum(cls[7])] as c from base where not base_failed group by lang),
dc as (
  select doc_id, list_transform(cls, lambda x: x / list_sum(cls)) as p, list_transform(k.c, lambda x: x / list_sum(k.c)) as q
  from base join classes k using (lang) where list_sum(cls) >= 200 and list_sum(k.c) > 0),
cd as (
  select doc_id, sqrt(greatest(0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as dist
  from (select doc_id, unnest(p) as p, unnest(q) as q from dc) group by doc_id),
dw as (select doc_id, lang, unnest(fw) as item from base where n_words >= 100 and lang in (select lang from common)),
dn as (select doc_id, lang, count(*)::double as n from dw group by all),
own as (select dw.doc_id, dw.item, count(*)::double as n from dw join common c on c.lang = dw.lang and c.item = dw.item group by all),
wp as (
  select dn.doc_id, coalesce(o.n, 0) / dn.n as p, c.share as q from dn join common c on c.lang = dn.lang left join own o on o.doc_id = dn.doc_id and o.item = c.item
  union all
  select dn.doc_id, 1 - coalesce((select sum(o.n) from own o where o.doc_id = dn.doc_id), 0) / dn.n, r.share from dn join other r on r.lang = dn.lang),
wd as (
  select doc_id, sqrt(greatest(0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as dist
  from wp group by doc_id)
select base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and coalesce(cd.dist, 0) <= 0.33 and coalesce(wd.dist, 0) <= 0.45) as kept
from base left join cd using (doc_id) left join wd using (doc_id)
"""

_ITEM_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
with d as (select doc_id, coalesce({_ITEM_WORDS}, []) as ws from documents),
b as (select item_id, {_ITEM_WORDS} as ws from benchmark where text is not null),
lens as (select distinct least(13, len(ws))::bigint as m from b where len(ws) > 0),
bw as (select item_id, least(13, len(ws))::bigint as m, unnest(list_transform(range(0, len(ws) - least(13, len(ws)) + 1), lambda i: array_to_string(ws[i + 1 : i + least(13, len(ws))], ' '))) as g from b where len(ws) > 0),
dg as (select doc_id, m, unnest(range(0, len(ws) - m + 1)) as i, unnest(list_transform(range(0, len(ws) - m + 1), lambda i: array_to_string(ws[i + 1 : i + m], ' '))) as g from d join lens on len(ws) >= m),
hit as (select doc_id, dg.m, i, item_id from dg join bw on dg.m = bw.m and dg.g = bw.g),
nh as (select doc_id, count(distinct p)::bigint as n from (select doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id),
ni as (select doc_id, count(*)::bigint as n, string_agg(x, ',' order by x) as s from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(nh.n, 0)::bigint as n_hit, coalesce(ni.n, 0)::bigint as n_items,
  sha256(coalesce(ni.s, '')) as items_sha256, (coalesce(nh.n, 0) > 0 and 20 * coalesce(nh.n, 0) >= len(ws)) as contaminated
from d left join nh using (doc_id) left join ni using (doc_id)
"""

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as m, count(*) as n from p where strlen(h) >= 1000 group by h having count(*) > 1)
select p.page_id, strlen(p.h)::bigint as payload_bytes, sha1(p.h) as payload_digest,
  case when g.m is not null and p.page_id is distinct from g.m then 'revisit' else 'response' end as record_type,
  case when g.m is not null and p.page_id is distinct from g.m then g.m end as refers_to
from p left join g on p.h = g.h
"""

SUBSTRING = rf"""
with d as (select doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) as ws from documents),
w as (select doc_id, unnest(range(0, len(ws) - 19)) as i, unnest(list_transform(range(0, len(ws) - 19), lambda k: md5(array_to_string(ws[k + 1 : k + 20], ' ')))) as g from d where len(ws) >= 20),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from w) where r > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from later)),
words as (select doc_id, unnest(ws) as x, unnest(range(0, len(ws))) as p from d),
kept as (select w.doc_id, string_agg(x, ' ' order by w.p) as s, count(*) as n from words w left join gone g on g.doc_id = w.doc_id and g.p = w.p where g.p is null group by w.doc_id)
select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.s, '')) as kept_sha256
from d left join kept using (doc_id)
"""

SUFFIXES = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) as g from (select doc_id, h, unnest(range(0, length(h) // 2 - 399)) as i from d where length(h) >= 800)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from w) where c > 1),
v as (select doc_id, i, md5(substr(h, 2 * i + 1, 480)) as g from (select doc_id, h, unnest(range(0, length(h) // 2 - 239)) as i from d where length(h) >= 480)),
q as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from v) where c > 1),
p as (select doc_id, unnest(range(0, length(h) // 2)) as p from d),
m as (select p.doc_id, p.p, max(r.i) over (partition by p.doc_id order by p.p) as last, max(q.i) over (partition by p.doc_id order by p.p) as short from p left join r on r.doc_id = p.doc_id and r.i = p.p left join q on q.doc_id = p.doc_id and q.i = p.p),
c as (select doc_id, p, coalesce(last > p - 400, false) as gone, coalesce(short > p - 240, false) as told from m),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as opens from c),
k as (select e.doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, count(*) filter (told) as n_passage, coalesce(string_agg(substr(h, 2 * p + 1, 2), '' order by p) filter (not gone), '') as kept from e join d using (doc_id) group by e.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256, coalesce(n_passage, 0)::bigint as n_passage
from d left join k using (doc_id)
"""

NEAR = rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, {_WORDS}), []) as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) as g from d where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
t as (select doc_id as a, doc_id as b from d union select t.a, e.b from t join e on e.a = t.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from t group by a) m using (doc_id)
"""

AUDIT = rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
w as (select *, regexp_extract_all(text, {_WORDS}) as ws, min(doc_id) over (partition by text) as first_id from d),
f as (
  select part, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
    {{'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, false)}} as x
  from w left join l on l.doc_id = w.doc_id),
m as (
  select part, x.A as fa, x.B as fb, x.C as fc, x.D as fd, x.E as fe, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where toxic) as n_toxic
  from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
perms as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from letters a, letters b, letters c, letters d, letters e
  where length(regexp_replace(a.c || b.c || c.c || d.c || e.c, 'A', '')) = 4 and length(regexp_replace(a.c || b.c || c.c || d.c || e.c, 'B', '')) = 4
    and length(regexp_replace(a.c || b.c || c.c || d.c || e.c, 'C', '')) = 4 and length(regexp_replace(a.c || b.c || c.c || d.c || e.c, 'D', '')) = 4
    and length(regexp_replace(a.c || b.c || c.c || d.c || e.c, 'E', '')) = 4),
steps as (select filter_order, s::integer as step, substr(filter_order, s::integer, 1) as c, substr(filter_order, 1, s::integer - 1) as before from perms, range(1, 6) as r(s)),
failing as (select *, case when fa then 'A' else '' end || case when fb then 'B' else '' end || case when fc then 'C' else '' end || case when fd then 'D' else '' end || case when fe then 'E' else '' end as fails from m),
e as (
  select part, filter_order, step, n, n_good, n_toxic, contains(fails, c) as here, length(fails) as n_fails,
    (fa and contains(before, 'A')) or (fb and contains(before, 'B')) or (fc and contains(before, 'C')) or (fd and contains(before, 'D')) or (fe and contains(before, 'E')) as earlier
  from failing, steps)
select part, filter_order, step, coalesce(sum(n) filter (where not here and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (where here and not earlier), 0)::bigint as removed,
  coalesce(sum(n) filter (where here and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (where here and n_fails = 1), 0)::bigint as unique_fails,
  coalesce(sum(n_good) filter (where here and not earlier), 0)::bigint as good_lost, coalesce(sum(n_toxic) filter (where here and not earlier), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(n_fails, 1)) filter (where here), 0)::bigint as shapley
from e group by part, filter_order, step
"""

_DEPTH = 4


def _url_level(k: int) -> str:
    """The tree's level k of op13, of the table tree{k - 1}."""
    outcomes = [(f"{label}_{at}", n, f"len(segs) {op} {k}") for label, n in (("bad", "bad"), ("good", "good"), ("open", "n - bad - good")) for at, op in (("end", "="), ("on", ">"))]
    counts = ", ".join(f"sum(case when {where} then {n} else 0 end)::double as {name}" for name, n, where in outcomes)
    chi = " + ".join(f"(case when p.{c} > 0 then (n.{c} - n.n * p.{c} / p.n) * (n.{c} - n.n * p.{c} / p.n) / (n.n * p.{c} / p.n) else 0::double end)" for c, _, _ in outcomes)
    return f"""
node{k} as (select host, made, segs[{k}] as seg, sum(n)::double as n, {counts} from tree{k - 1} where len(segs) >= {k} group by all),
parent{k} as (select host, made, count(*) as kids, sum(n) as n, sum((n = 1)::bigint) as single, {", ".join(f"sum({c}) as {c}" for c, _, _ in outcomes)} from node{k} group by all),
name{k} as (
  select n.host, n.made, n.seg, case when n.seg in ('*', '**') or not ((kids >= 12 and 2 * single > kids) or (kids > 1 and {chi} <= 7.815::double)) then n.seg else '*' end as name
  from node{k} n join parent{k} p on n.host = p.host and n.made = p.made),
tree{k} as (
  select host, segs, n, bad, good, made from tree{k - 1} where len(segs) < {k}
  union all
  select t.host, t.segs, t.n, t.bad, t.good, t.made || '/' || m.name from tree{k - 1} t join name{k} m on m.host = t.host and m.made = t.made and m.seg = t.segs[{k}] where len(t.segs) >= {k}),"""


URLS = rf"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
p as (
  select page_id, {_LOWER.format("coalesce(regexp_extract(rest, '^[^/?#]*'), '')")} as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r as (
  select *, case when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/' when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/' when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule
  from p),
s as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from r),
g as (
  select *, list_concat(list_transform(parts[1:{_DEPTH}], lambda x: case when regexp_matches(x, '[0-9]') or length(x) > 40 then '*' else x end), case when len(parts) > {_DEPTH} then ['**'] else [] end) as segs
  from s),
tree0 as (select host, segs, count(*) as n, count(*) filter (where rule in ('net/', 'example.com/de/')) as bad, count(*) filter (where rule in ('example.net/en/', 'org/fr/')) as good, '' as made from g group by host, segs),
{"".join(_url_level(k) for k in range(1, _DEPTH + 2))}
whole as (select sum(bad)::double as bad, sum(bad + good)::double as n from tree0),
hosts as (select host, sum(bad)::double as bad, sum(bad + good)::double as n from tree0 group by host),
sums as (select host, made, sum(bad)::bigint as n_bad, sum(good)::bigint as n_good from tree{_DEPTH + 1} group by host, made),
told as (
  select s.host, s.made, n_bad, n_good,
    (n_bad + 4.0::double * ((h.bad + 4.0::double * (case when w.n > 0 then w.bad / w.n else 0::double end)) / (h.n + 4.0::double))) / (n_bad + n_good + 4.0::double) >= 0.8::double as rejected
  from sums s join hosts h on h.host = s.host, whole w)
select page_id, g.host, path, rule, case when rule in ('net/', 'example.com/de/') or (rule is null and rejected) then 'block' else 'allow' end as verdict,
  case when t.made = '' then '/' else t.made end as template, n_bad, n_good
from g join tree{_DEPTH + 1} t on t.host = g.host and t.segs = g.segs join told on told.host = t.host and told.made = t.made
"""
