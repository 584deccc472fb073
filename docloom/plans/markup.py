"""Markup, question and model-output queries: documents become markdown, customers' facts questions and answers, by templates that both engines fill."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import questions as Q
from ..functions import text as T
from ..operators import chunking
from ..operators.lineage import kept, spread
from ..sources import markdown
from .base import stem_sql, table
from .wiki import _DOCS, wiki_docs

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _values(rows: list[tuple], names: str) -> str:
    """A SELECT of literal rows."""
    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]"
        if isinstance(v, str):
            return "concat(" + ", chr(10), ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n")) + ")"
        return f"{v}::bigint"

    return "select * from (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


@query
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(M.html_strip(F.col("html")).cast("binary")).alias("text_md5"))


_TAGS = "|".join(M.HTML_TAGS)
SQL["html_strip"] = rf"select page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<script(?:\s[^>]*)?>.*?</script>', '', 'gsi'), '<style(?:\s[^>]*)?>.*?</style>', '', 'gsi'), '</?(?:{_TAGS})(?:\s[^<>\n]*)?/?>', '', 'gi')) as text_md5 from pages"


def _anchors(spark, sf_dir) -> DataFrame:
    """Pages with their anchors written as markdown links."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)").alias("text"))


@query
def link_extract(spark, sf_dir):
    each = _anchors(spark, sf_dir).select("page_id", F.posexplode(M.extract_links("text")).alias("n", "x"))
    return each.select("page_id", F.col("n").cast("long").alias("n"), "x.words", "x.href")


_HREFS = """hr as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as words, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) as n from pages where html is not null)"""
SQL["link_extract"] = f"with {_HREFS} select page_id, n, words, href from hr"

HREFS = {"https://x.org/a": True, "mailto:me@x.org": True, "#top": True, "/a/b.md": False, "../c.md": False, "d": False}


@query
def link_classify(spark, sf_dir):
    own = link_extract(spark, sf_dir).select("href").distinct()
    return own.unionByName(spark.createDataFrame([(h,) for h in HREFS], "href string")).select("href", T.is_external(F.col("href")).alias("external"))


SQL["link_classify"] = f"with {_HREFS} select distinct href, regexp_matches(href, '^(https?://|mailto:|#)') as external from hr union all {_values(list(HREFS.items()), 'href, external')}"

RESOLVED = [("/a/b.md", "x/y.md", "a/b.md"), ("../c.md#part", "x/y/z.md", "x/c.md"), ("d?q=1", "x/y.md", "x/d"), ("./e/../f", "y.md", "f"), ("#top", "y.md", None), ("https://x.org", "y.md", None), ("../../../g.md", "x/y.md", "g.md")]


@query
def link_resolve(spark, sf_dir):
    own = link_extract(spark, sf_dir).select("href", F.lit("pages/index.md").alias("source")).distinct()
    given = spark.createDataFrame([(h, s) for h, s, _ in RESOLVED], "href string, source string")
    return own.unionByName(given).select("href", "source", T.resolve_href(F.col("href"), F.col("source")).alias("target"))


SQL["link_resolve"] = f"with {_HREFS} select distinct href, 'pages/index.md' as source, ltrim(split_part(split_part(href, '#', 1), '?', 1), '/') as target from hr union all {_values(RESOLVED, 'href, source, target')}"


@query
def link_stats(spark, sf_dir):
    """Links of pages by whether a page has their path; how many pages hold each kind."""
    pages = table(spark, sf_dir, "pages")
    paths = pages.select(F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/$", "").alias("target"), F.lit(True).alias("_known")).distinct()
    each = link_extract(spark, sf_dir).withColumn("target", T.resolve_href(F.col("href"), F.lit("index.md")))
    return each.join(paths, "target", "left").groupBy(F.coalesce("_known", F.lit(False)).alias("resolved")).agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_hrefs"), F.count_distinct("page_id").alias("n_pages"))


SQL["link_stats"] = rf"with {_HREFS}, p as (select distinct regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', '') as target from pages) select ltrim(split_part(split_part(href, '#', 1), '?', 1), '/') in (select target from p) as resolved, count(*) as n_links, count(distinct href) as n_hrefs, count(distinct page_id) as n_pages from hr group by 1"

#: Lines that documents get instead of some of their own, by number, so that each holds code, headings, links and tags; {} is the line.
_LINES = {
    0: "```", 1: "~~~~ text", 2: "# {}", 3: "### {}", 4: "## Part", 5: "See [the page](/p/x.md) and ![pic](p.png).", 6: "Run `x <b>` or ``y ` z`` now ` end", 7: "<b>{}</b><br/> 3 < 4 and <job_id>",
    8: "[ref][a] and [a] and [b]", 9: "[a]: http://x.org", 10: "~~~", 11: "`````", 12: "",
}


def _markdown(spark, sf_dir) -> DataFrame:
    """doc_id and text of documents as markdown."""
    docs = table(spark, sf_dir, "documents").where("text is not null")

    def line(own, i):
        kind, out = F.pmod(F.col("doc_id") * 7 + i, F.lit(23)), own
        for n, made in _LINES.items():
            parts = [x for part in made.split("{}") for x in (F.lit(part), own)][:-1]
            out = F.when(kind == n, F.concat(*parts)).otherwise(out)
        return out

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MADE = " ".join(f"when {n} then " + " || ".join(x for part in made.split("{}") for x in (_quoted(part), "own")).removesuffix(" || own") for n, made in _LINES.items())
def _fences(source: str, tag: str = "") -> str:
    """CTEs over lines (doc_id, lines): fe, with fenced regions by lines from 1, and fl, with a flag for each line; their names end in the tag."""
    return f"""mk{tag} as (select *, list_filter(list_transform(lines, lambda l, i: {{'i': i, 'm': regexp_extract(l, '^(`{{3,}}|~{{3,}})')}}), lambda x: x.m <> '') as marks from {source}),
fo{tag} as (select doc_id, lines, list_reduce(marks, lambda s, x: case
    when s.m = '' then {{'m': x.m, 'f': x.i, 'found': s.found}}
    when starts_with(x.m, s.m) then {{'m': '', 'f': 0::bigint, 'found': list_append(s.found, {{'f': s.f, 'l': x.i}})}}
    else s end, {{'m': '', 'f': 0::bigint, 'found': []::struct(f bigint, l bigint)[]}}) as s from mk{tag}),
fe{tag} as (select doc_id, lines, case when s.m = '' then s.found else list_append(s.found, {{'f': s.f, 'l': len(lines)}}) end as regions from fo{tag}),
fl{tag} as (select *, list_transform(lines, lambda l, i: len(list_filter(regions, lambda r: i between r.f and r.l)) > 0) as fenced from fe{tag})"""


#: Documents as markdown, with their fences.
_MD = f"""md as (select doc_id, list_transform(string_split(text, chr(10)), lambda own, i: case (doc_id * 7 + i - 1) % 23 {_MADE} else own end) as lines from documents where text is not null),
{_fences('md')}"""
#: The parts of a line, and whether each is inline code.
_PARTS = """(list_reduce(list_transform(regexp_extract_all({0}, '`+|[^`]+'), lambda p, i: {{'p': p, 'rest': regexp_extract_all({0}, '`+|[^`]+')[i + 1:]}}),
  lambda s, x: case when s.o = '' and starts_with(x.p, '`') and list_contains(x.rest, x.p) then {{'o': x.p, 'h': x.p, 'd': s.d}}
    when s.o = '' then {{'o': '', 'h': '', 'd': list_append(s.d, {{'c': false, 't': x.p}})}}
    when x.p = s.o then {{'o': '', 'h': '', 'd': list_append(s.d, {{'c': true, 't': s.h || x.p}})}}
    else {{'o': s.o, 'h': s.h || x.p, 'd': s.d}} end, {{'o': '', 'h': '', 'd': []::struct(c boolean, t varchar)[]}})).d"""


@query
def fence_regions(spark, sf_dir):
    found = _markdown(spark, sf_dir).select("doc_id", M.fence_regions(F.col("text")).alias("x"))
    return found.where(F.size("x") > 0).select("doc_id", F.array_join(F.transform("x", lambda s: F.concat_ws("-", s[0], s[1])), ",").alias("regions"))


_THROUGH = "length(array_to_string(lines[1:{}], chr(10)))"
SQL["fence_regions"] = f"with {_MD} select doc_id, array_to_string(list_transform(regions, lambda r: (case when r.f = 1 then 0 else {_THROUGH.format('r.f - 1')} + 1 end) || '-' || {_THROUGH.format('r.l')}), ',') as regions from fe where len(regions) > 0"


@query
def inline_code(spark, sf_dir):
    found = _markdown(spark, sf_dir).select("doc_id", M.inline_code_texts(F.col("text")).alias("x"))
    return found.where(F.size("x") > 0).select("doc_id", F.array_join("x", "|").alias("code"))


SQL["inline_code"] = f"""with {_MD}, li as (select doc_id, unnest(lines) as line, unnest(fenced) as out, unnest(range(len(lines))) as n from fl),
pa as (select doc_id, n, list_transform(list_filter({_PARTS.format('line')}, lambda p: p.c), lambda p: p.t) as codes from li where not out and contains(line, '`'))
select doc_id, string_agg(array_to_string(codes, '|'), '|' order by n) as code from pa where len(codes) > 0 group by doc_id"""


@query
def reduce_links(spark, sf_dir):
    return _markdown(spark, sf_dir).select("doc_id", F.md5(M.reduce_links(F.col("text")).cast("binary")).alias("text_md5"))


#: rl: the markdown without links, tags (outside code) and reference definitions.
_REDUCED = rf"""{_MD}, li as (select doc_id, unnest(lines) as line, unnest(fenced) as out, unnest(range(len(lines))) as n from fl),
hid as (select doc_id, n, case when out then replace(line, '<', chr(57344)) when contains(line, '`') then array_to_string(list_transform({_PARTS.format('line')}, lambda p: case when p.c then replace(p.t, '<', chr(57344)) else p.t end), '') else line end as line from li),
st as (select doc_id, n, replace(regexp_replace(line, '</?(?:{_TAGS})(?:\s[^<>
]*)?/?>', '', 'gi'), chr(57344), '<') as line, regexp_extract(line, '^\s*\[([^\]]+)\]:\s*\S', 1) as label from hid),
jo as (select doc_id, regexp_replace(string_agg(case when label <> '' then chr(57345) else line end, chr(10) order by n), '(^|
)\s*' || chr(57345), '\1', 'g') as t, list_distinct(list(label) filter (label <> '')) as labels from st group by doc_id),
rf as (select doc_id, regexp_replace(t, '\[([^\]]*)\]\[[^\]]*\]', '\1', 'g') as t, labels from jo),
sh as (select doc_id, list_reduce(coalesce(labels, []), lambda a, l: replace(replace(replace(a, '[' || l || '](', chr(57345) || l || ']('), '[' || l || ']', l), chr(57345), '['), t) as t from rf),
rl as (select doc_id, regexp_replace(t, '!?\[([^\]]*)\]\([^)]+\)', '\1', 'g') as text from sh)"""
SQL["reduce_links"] = f"with {_REDUCED} select doc_id, md5(text) as text_md5 from rl"


@query
def chunk_struct(spark, sf_dir):
    docs = _markdown(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), M.reduce_links(F.col("text")).alias("text"))
    return chunking.chunk_struct(docs, 64, 8).select("path", "ord", F.array_join("heading_path", "/").alias("heading_path"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["chunk_struct"] = rf"""with {_REDUCED}, rs as (select doc_id, string_split(text, chr(10)) as lines from rl), {_fences('rs', '2')},
ln as (select doc_id, unnest(range(len(lines))) as n, unnest(lines) as line, unnest(fenced) as out from fl2),
lv as (select *, case when not out and regexp_matches(line, '^#{{1,6}}\s+\S') then length(regexp_extract(line, '^#{{1,6}}')) end as level from ln),
se as (select *, count(level) over (partition by doc_id order by n) as section from lv),
sc as (select doc_id, section, max(level) as level, max(trim(regexp_replace(line, '^#{{1,6}}\s+', ''))) filter (level is not null) as title, string_agg(line, chr(10) order by n) as text,
  count(*) filter (level is null and trim(line) <> '') = 0 as bare from se group by doc_id, section having max(level) is not null or count(*) filter (level is null and trim(line) <> '') > 0),
pt as (select s.doc_id, s.section, array_to_string(list(a.title order by a.section), '/') as heading_path from sc s join sc a on a.doc_id = s.doc_id and a.level is not null and (a.section = s.section or a.section < s.section and a.level < s.level
  and not exists (select 1 from sc b where b.doc_id = s.doc_id and b.section > a.section and b.section <= s.section and b.level <= a.level)) where s.level is not null group by 1, 2),
il as (select sc.*, coalesce(heading_path, '') as heading_path, coalesce(sum(case when bare and level is not null then 0 else 1 end) over (partition by sc.doc_id order by sc.section rows between unbounded preceding and 1 preceding), 0) as island from sc left join pt on pt.doc_id = sc.doc_id and pt.section = sc.section),
fd as (select doc_id, island, max_by(heading_path, section) as heading_path, regexp_extract_all(string_agg(text, chr(10) order by section), '[^\t\n\v\f\r ]+') as ws from il group by 1, 2),
wi as (select doc_id, island, heading_path, ws, unnest(range(greatest(ceil((len(ws) - 64) / 56.0), 0)::bigint + 1)) as part from fd where len(ws) > 0)
select doc_id::varchar as path, row_number() over (partition by doc_id order by island, part) - 1 as ord, heading_path, md5(array_to_string(ws[part * 56 + 1:part * 56 + 64], ' ')) as text_md5 from wi"""

#: Questions about customers' segments, nations and regions, by number; names after $ are columns.
_TEMPLATES = (
    "Which $region region stores opened after $year?", "List all suppliers outside $nation", "What promotions start in $month, at least $num% off?",
    "Which stores have a pharmacy but no gas pumps and more than $area square feet?", "Name every vendor in $nation or $region, not $region",
    "How many $seg locations opened between $year and $later without a pharmacy?", "Where can I buy fuel near $nation?",
    "promotions that end in $month only for $seg shops, $num percent or more", "stores in the $seg format of $area sq ft or less, not in $region, opened in $year",
    "Is $region far?", "Which regions have the largest $seg stores?", "Which stores in Africa, America, Asia, Europe or the Middle East sell gas?",
)
_KINDS = (
    ("store", "region", "str"), ("store", "store_format", "str"), ("store", "opened_year", "int"), ("store", "sq_ft", "int"), ("store", "has_pharmacy", "bool"), ("store", "has_fuel", "bool"),
    ("supplier", "region", "str"), ("supplier", "country", "str"), ("promotion", "formats", "list"), ("promotion", "start", "date"), ("promotion", "end", "date"), ("promotion", "discount_pct", "int"),
)
_BLANKS = {"region": "r_name", "nation": "n_name", "seg": "c_mktsegment", "month": "mon", "year": "(1980 + c_custkey % 40)", "later": "(1985 + c_custkey % 40)", "num": "(c_custkey % 50 + 1)", "area": "(c_custkey % 90 + 10)"}


def _template_parts(template: str) -> list[tuple[bool, str]]:
    """Whether each part is a column, and the part."""
    parts = []
    for i, piece in enumerate(re.split(r"\$(\w+)", template)):
        if i % 2:
            parts += [(True, _BLANKS[piece])] + [(False, ",000")] * (piece == "area")
        elif piece:
            parts.append((False, piece))
    return parts


def _filled(templates: tuple[str, ...]) -> str:
    """A SQL expression, in either dialect, of the template that a customer's number chooses."""
    text = lambda t: "concat(" + ", ".join(f"cast({p} as string)" if column else _quoted(p) for column, p in _template_parts(t)) + ")"
    return f"case c_custkey % {len(templates)} " + " ".join(f"when {i} then {text(t)}" for i, t in enumerate(templates)) + " end"


_MONTH_CASE = "case c_custkey % 12 " + " ".join(f"when {i} then '{m.title()}'" for i, m in enumerate(Q.MONTHS)) + " end"
_PLACED = f"(select c_custkey, c_mktsegment, n_name, r_name, {_MONTH_CASE} as mon from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def _asked(spark, sf_dir, templates: tuple[str, ...], name: str) -> DataFrame:
    placed = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.withColumn("mon", F.expr(_MONTH_CASE)).select(F.col("c_custkey").cast("string").alias("query_id"), F.expr(_filled(templates)).alias(name))


def _kinds(spark) -> DataFrame:
    return spark.createDataFrame(list(_KINDS), "doc_type string, field string, kind string")


def _field_values(spark, sf_dir) -> DataFrame:
    """The categorical values that _KINDS' fields have."""
    regions = table(spark, sf_dir, "region").agg(F.collect_set("r_name").alias("vals"))
    nations = table(spark, sf_dir, "nation").agg(F.collect_set("n_name").alias("vals"))
    segments = table(spark, sf_dir, "customer").agg(F.collect_set("c_mktsegment").alias("vals"))
    of = lambda df, kind, name: df.select(F.lit(kind).alias("doc_type"), F.lit(name).alias("field"), "vals")
    return of(regions, "store", "region").unionByName(of(segments, "store", "store_format")).unionByName(of(regions, "supplier", "region")).unionByName(of(nations, "supplier", "country")).unionByName(of(segments, "promotion", "formats"))


@query
def target_type(spark, sf_dir):
    return _asked(spark, sf_dir, _TEMPLATES, "text").select("query_id", Q.target_type(F.col("text")).alias("target"))


_words = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TYPE_MAP = "map {" + ", ".join(f"'{w}': '{kind}'" for kind, words in Q.TYPE_WORDS for w in words) + "}"
#: qs: questions; tg: with their words and target type.
_TARGETS = f"""qs as (select c_custkey::varchar as query_id, {_filled(_TEMPLATES)} as text from {_PLACED}),
wo as (select *, regexp_extract_all(lower(text), '[a-z&''-]+') as ws from qs),
cu as (select *, list_transform(list_filter(range(1, len(ws) + 1), lambda i: list_contains({_words(Q.CUES)}, ws[i])), lambda i: ws[i + 1:i + 6]) as phrases from wo),
ph as (select *, list_transform(phrases, lambda p: list_filter(list_transform(p[1:coalesce(list_position(list_transform(p, lambda w: list_contains({_words(Q.PHRASE_ENDS)}, w)), true), 7) - 1], lambda w: {_TYPE_MAP}[w]), lambda k: k is not null)[-1]) as heads from cu),
tg as (select query_id, text, coalesce(list_filter(heads, lambda h: h is not null)[1], list_filter(list_transform(ws, lambda w: {_TYPE_MAP}[w]), lambda k: list_contains({_words(Q.ANYWHERE_TYPES)}, k))[1], case when ws[1] = 'where' then 'store' end) as target from ph)"""
SQL["target_type"] = f"with {_TARGETS} select query_id, target from tg"


def _told_filters(filters: DataFrame) -> DataFrame:
    return filters.select("query_id", "doc_type", "field", "op", F.array_join("s", "|").alias("words"), F.array_join(F.transform("x", lambda x: x.cast("long").cast("string")), "|").alias("numbers"))


@query
def parse_filters(spark, sf_dir):
    return _told_filters(Q.parse_filters(_asked(spark, sf_dir, _TEMPLATES, "text"), _kinds(spark), _field_values(spark, sf_dir)))


def _compared() -> str:
    """The operation that the texts b and a, before and after a number, say."""
    after = " ".join(f"when contains(a[1:16], '{phrase}') then '{op}'" for phrase, op in Q.PHRASES_AFTER)
    before = " ".join(f"when rtrim(b) like '%{phrase}' then '{op}'" for phrase, op in Q.PHRASES_BEFORE)
    return rf"case {after} {before} when regexp_matches(b, '\bin\s*$') then '==' end"


_RE2_NUMBERS = {"opened_year": r"\b(?:19|20)\d{2}\b", "sq_ft": r"\b(?:\d{1,3}(?:,\d{3})+|\d{5,})\b", "discount_pct": r"\b\d{1,2}\s*(?:%|percent)"}
_NUMBERS = " union all ".join(
    rf"""select query_id, target, '{field}' as field, low, regexp_extract(low, '(?:between|from)\s+({number})\s+(?:and|to|through)\s+({number})', ['a', 'b']) as r1, regexp_extract(low, '({number})\s+(?:through|to)\s+({number})', ['a', 'b']) as r2,
  string_split(regexp_replace(low, '({number})', chr(1) || '\1' || chr(2), 'g'), chr(1)) as ps from lo join kd on kd.doc_type = target and kd.field = '{field}' where regexp_matches(low, '{needs or '.'}')"""
    for (field, _, needs), number in zip(Q.NUMBER_FIELDS, _RE2_NUMBERS.values())
)
SQL["parse_filters"] = rf"""with {_TARGETS}, kd as (select * from (values {', '.join(map(str, _KINDS))}) k(doc_type, field, kind)),
vals as (select 'store' as doc_type, 'region' as field, r_name as v from region union all select 'supplier', 'region', r_name from region union all select 'supplier', 'country', n_name from nation
  union all select 'store', 'store_format', c_mktsegment from (select distinct c_mktsegment from customer) union all select 'promotion', 'formats', c_mktsegment from (select distinct c_mktsegment from customer)),
lo as (select query_id, target, lower(text) as low, {stem_sql('text')} as ts from tg where target in ('store', 'supplier', 'promotion')),
ps as (select query_id, target, low, ts, field, kind, v, {stem_sql('v')} as vs from lo join vals on vals.doc_type = target join kd using (doc_type, field)),
pl as (select *, list_position(list_transform(range(1, len(ts) - len(vs) + 2), lambda i: ts[i:i + len(vs) - 1]), vs) as p from ps),
ne as (select *, list_has_any(ts[greatest(p - 3, 1):p - 1], {_words(Q.NEGATIONS)}) as out from pl where p > 0),
ca as (select query_id, target, field, out, list_sort(list(distinct v)) as s, any_value(kind) as kind, any_value(low) as low, (select count(*) from vals where vals.doc_type = target and vals.field = ne.field) as n from ne group by query_id, target, field, out),
nu as ({_NUMBERS}),
si as (select query_id, target, field, unnest(range(2, len(ps) + 1)) as i, ps from nu where r1.a = '' and r2.a = ''),
ba as (select query_id, target, field, regexp_extract(ps[i], '^[0-9,]+') as x, replace(ps[i - 1], chr(2), '') as b, string_split(ps[i], chr(2))[2] || replace(array_to_string(ps[i + 1:], ''), chr(2), '') as a from si),
bo as (select query_id, target, c.field, list_position(list_transform(ts, lambda t: list_contains(c.cues, t)), true) as p, ts from lo join kd on kd.doc_type = target join (values {', '.join(f"('{f}', {_words(c)})" for f, c in Q.BOOLEAN_CUES)}) c(field, cues) on c.field = kd.field),
mo as (select query_id, target, low, m.i from lo, (values {', '.join(f"({i}, '{m}')" for i, m in enumerate(Q.MONTHS, 1))}) m(i, name) where target = 'promotion' and regexp_matches(low, '\b' || m.name || '\b'))
select query_id, target as doc_type, field, case when out then 'not_in' when kind = 'list' and regexp_matches(low, '\b(?:{'|'.join(Q.ONLY_WORDS)})\b') then 'only' else 'in' end as op, array_to_string(s, '|') as words, '' as numbers from ca where out or len(s) < n or n = 1
union all select query_id, target, field, 'between', '', regexp_extract(replace(case when r1.a <> '' then r1.a else r2.a end, ',', ''), '^[0-9]+') || '|' || regexp_extract(replace(case when r1.a <> '' then r1.b else r2.b end, ',', ''), '^[0-9]+') from nu where r1.a <> '' or r2.a <> ''
union all select query_id, target, field, {_compared()} as op, '', replace(x, ',', '') from ba where {_compared()} is not null
union all select query_id, target, field, '==', '', case when list_has_any(ts[greatest(p - 4, 1):p - 1], {_words(Q.NEGATIONS)}) then '0' else '1' end from bo where p > 0
union all select query_id, target, case when not regexp_matches(low, '\b(?:{'|'.join(Q.START_WORDS)})\b') and regexp_matches(low, '\b(?:{'|'.join(Q.END_WORDS)})\b') then 'end' else 'start' end,
  case when regexp_matches(low, '\b(?:{'|'.join(Q.START_WORDS)})\b') then 'start_month' when regexp_matches(low, '\b(?:{'|'.join(Q.END_WORDS)})\b') then 'end_month' else 'month_overlap' end, '', i::varchar from mo"""

#: What a model may answer, by customer number.
_ANSWERS = (
    'Sure: {"type": "store", "filters": [{"field": "opened_year", "op": ">", "value": "$area"}, {"field": "has_fuel", "op": "==", "value": "Yes"}, {"field": "nope", "op": "==", "value": 1}, {"field": "region", "op": "like", "value": "x"}]} done',
    '{broken {"type": "promotion", "filters": [{"field": "x", "op": "end_month", "value": "$num"}, {"field": "formats", "op": "in", "value": "$seg"}, {"field": "discount_pct", "op": "between", "value": [$num]}]}',
    "no JSON about $region",
    '{"type": "planet", "filters": []} $num',
    '{"type": "supplier", "filters": [{"field": "country", "op": "not_in", "value": ["$nation", "$region"]}, 7, {"field": "country", "op": "=="}]}',
    '{"type": "store", "filters": [{"field": "sq_ft", "op": "between", "value": [$num, "$area"]}, {"field": "has_pharmacy", "op": "!=", "value": false}, {"field": "sq_ft", "op": "<", "value": "$seg"}]}',
)


@query
def llm_filter_parse(spark, sf_dir):
    return _told_filters(Q.model_filters(_asked(spark, sf_dir, _ANSWERS, "raw"), _kinds(spark)))


SQL["llm_filter_parse"] = rf"""with an as (select c_custkey::varchar as query_id, {_filled(_ANSWERS)} as raw from {_PLACED}),
ca as (select query_id, list_transform(list_filter(range(1, length(raw) + 1), lambda i: raw[i] = '{{'), lambda i: regexp_extract(raw[i:], '(?s)^.*\}}')) as cs from an),
ob as (select query_id, list_filter(cs, lambda c: json_valid(c))[1]::json as o from ca),
fi as (select query_id, o ->> '$.type' as doc_type, unnest(json_extract(o, '$.filters[*]')) as f from ob where (o ->> '$.type') in ('store', 'supplier', 'promotion')),
va as (select query_id, doc_type, f ->> '$.op' as op, f ->> '$.field' as field, json_extract(f, '$.value') as value, case when json_type(f, '$.value') = 'ARRAY' then json_extract_string(f, '$.value[*]') else [f ->> '$.value'] end as each from fi where json_type(f) = 'OBJECT'),
ki as (select va.*, kind from va left join (values {', '.join(map(str, _KINDS))}) k(doc_type, field, kind) using (doc_type, field) where value is not null),
nu as (select *, list_transform(each, lambda v: try_cast(replace(v, ',', '') as bigint)) as n from ki)
select query_id, doc_type, case when op = 'end_month' then 'end' when op in ('start_month', 'month_overlap') then 'start' else field end as field, op,
  case when op in ('in', 'not_in', 'only') then array_to_string(each, '|') else '' end as words,
  case when op in ('in', 'not_in', 'only') then '' when kind = 'bool' then (lower(each[1]) in ('true', 'yes', '1'))::int::varchar else array_to_string(n, '|') end as numbers
from nu where op in ('end_month', 'start_month', 'month_overlap') and len(n) = 1 and n[1] is not null or kind is not null and (op in ('in', 'not_in', 'only') or op = 'between' and kind = 'int' and len(n) = 2 and not list_contains(list_transform(n, lambda x: x is null), true)
  or op in ('==', '!=', '>', '>=', '<', '<=') and (kind = 'bool' or kind = 'int' and not list_contains(list_transform(n, lambda x: x is null), true)))"""

#: What a model may answer about a nation's page, by number; some answers are cut off.
_LINK_ANSWERS = """case when n_nationkey % 5 = 4 then 'nothing' else concat('{"parent": "', r_name, '", "mentions": ["', lower(r_name), '", "Atlantis", "', n_name, '", "NATION_', cast((n_nationkey + 1) % 25 as string), '", "', upper(n_name),
  case n_nationkey % 3 when 0 then '", "EUR' when 1 then '"]}' else '", "", " EUROPE "' end) end"""


@query
def extract_edges_parse(spark, sf_dir):
    """Links of model answers that may be cut off: titles, whatever their case, become paths; unknown ones are told apart."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    raw = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("region/"), "r_name", F.lit("/"), "n_name", F.lit(".md")).alias("path"), F.expr(_LINK_ANSWERS).alias("raw"))
    each = raw.select("path", F.explode(Q.model_links(F.col("raw"))).alias("x")).select("path", "x.kind", "x.title", F.lower("x.title").alias("key"))
    titles = wiki_docs(spark, sf_dir).where("doc_type in ('region', 'nation')").select(F.lower("title").alias("key"), F.col("path").alias("target"))
    found = each.join(titles, "key", "left").where("target is null or target <> path")
    child = (F.col("kind") == "child") & F.col("target").isNotNull()
    src, dst = F.when(child, F.col("target")).otherwise(F.col("path")), F.when(child, F.col("path")).otherwise(F.col("target"))
    return found.select(src.alias("src"), dst.alias("dst"), F.when(F.col("target").isNotNull(), F.col("kind")).otherwise("unknown").alias("kind"), F.when(F.col("target").isNull(), F.col("title")).alias("unknown_title")).distinct()


SQL["extract_edges_parse"] = rf"""with {_DOCS}, a as (select 'region/' || r_name || '/' || n_name || '.md' as path, {_LINK_ANSWERS} as raw from nation join region on n_regionkey = r_regionkey),
t as (select path, 'child' as kind, trim(regexp_extract(raw, '"parent"\s*:\s*"([^"]+)"', 1)) as title from a union all
  select path, 'prose', trim(unnest(regexp_extract_all(regexp_extract(raw, '(?s)"mentions"\s*:\s*\[(.*)', 1), '"([^"]*)"', 1))) from a),
j as (select t.path, t.kind, t.title, d.path as target from t left join docs d on lower(d.title) = lower(t.title) and doc_type in ('region', 'nation') where t.title <> '')
select distinct case when kind = 'child' and target is not null then target else path end as src, case when kind = 'child' and target is not null then path else target end as dst,
  case when target is null then 'unknown' else kind end as kind, case when target is null then title end as unknown_title from j where target is null or target <> path"""


def _files(spark, sf_dir) -> DataFrame:
    """The wiki as markdown files; a target with a space is no markdown link."""
    docs = wiki_docs(spark, sf_dir)
    front = F.concat(F.lit("---\ntype: "), "doc_type", F.lit("\ntitle: '"), "title", F.lit("'\ndescription: "), "description", F.lit("\ntags: ["), F.concat(F.lit("'"), F.array_join("tags", "', '"), F.lit("'")), F.lit("]\nstatus: current\n"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("parent: "), "parent", F.lit("\n"))).otherwise(""), F.lit("---\n"))
    body = F.concat(F.lit("# "), "title", F.lit("\n"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("See [up](/"), "parent", F.lit(").\n"))).otherwise(""))
    return docs.select("path", F.concat(front, body).cast("binary").alias("content"))


@query
def ingest_docs(spark, sf_dir):
    docs = kept(markdown.documents(spread(_files(spark, sf_dir), "path")), "docs")  # parsed once, by as many tasks as the session's width
    edges, _ = markdown.links(docs)
    out = edges.groupBy(F.col("dst").alias("path"), "kind").count().groupBy("path").pivot("kind", ["child", "prose"]).agg(F.sum("count"))
    return docs.join(out, "path", "left").select("path", "doc_type", "title", F.array_join("tags", ",").alias("tags"), F.col("depth").cast("long").alias("depth"), F.col("char_len").cast("long").alias("char_len"), F.coalesce("child", F.lit(0)).cast("long").alias("n_child"), F.coalesce("prose", F.lit(0)).cast("long").alias("n_prose"))


SQL["ingest_docs"] = f"""with {_DOCS}, k as (select parent as path, count(*) as n from docs where parent is not null and not contains(parent, ' ') group by 1)
select d.path, doc_type, title, array_to_string(tags, ',') as tags, (len(string_split(d.path, '/')) - 1)::bigint as depth, (length('# ' || title || chr(10)) + case when parent is not null then length('See [up](/' || parent || ').' || chr(10)) else 0 end)::bigint as char_len,
  (parent is not null)::int::bigint as n_child, coalesce(k.n, 0)::bigint as n_prose from docs d left join k on k.path = d.path"""
