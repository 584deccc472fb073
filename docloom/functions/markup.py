"""Markdown and HTML in text as Columns: code regions, tags, links.

Texts are scanned by lines and by pieces. Fences are lines of their own, so a text's code regions
come from a fold over its lines; inline code from a fold over a line's runs of backticks; tags
from the pieces between "<". In code, "<" is masked while tags are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTML element names, current and obsolete (fixed values).
HTML_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas caption "
    "center cite code col colgroup content data datalist dd del details dfn dialog dir div dl dt em embed fencedframe fieldset figcaption figure "
    "font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe image img input ins isindex kbd keygen label legend "
    "li link listing main map mark marquee math menu menuitem meta meter multicol nav nextid nobr noembed noframes noscript object ol optgroup "
    "option output p param picture plaintext pre progress q rb rp rt rtc ruby s samp script search section select selectedcontent shadow slot "
    "small source spacer span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track "
    "tt u ul var video wbr xmp"
).split()
#: Elements whose contents are no text.
SILENT_TAGS = ("script", "style")

_MASK, _MARK = "\ue000", "\ue001"  # private-use characters: a "<" in code, and a bracket or a line to be looked at later
_NO_REGIONS = "array<struct<first: int, last: int, begin: int, end: int>>"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once a row: in a lambda, a name for it costs nothing, while an expression is evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def fenced_regions(lines: Column) -> Column:
    """Each fenced code region: its first and last line, and the characters where it begins and ends.

    A fence is three or more backticks or tildes at the start of a line. It is closed by the next
    line that begins with as many of the same, whatever follows them; if there is none, the last line closes it.
    One fold over the lines carries the place in the text.
    """

    def step(state: Column, line: Column) -> Column:
        def told(mark: Column) -> Column:
            opens = (state["mark"] == "") & (mark != "")
            closes = (state["mark"] != "") & mark.startswith(state["mark"])
            end = state["at"] + F.length(line)
            region = F.struct(state["first"].alias("first"), state["line"].alias("last"), state["begin"].alias("begin"), end.alias("end"))
            return F.struct(
                F.when(closes, F.concat(state["found"], F.array(region))).otherwise(state["found"]).alias("found"),
                F.when(opens, mark).when(closes, "").otherwise(state["mark"]).alias("mark"),
                F.when(opens, state["line"]).otherwise(state["first"]).alias("first"), F.when(opens, state["at"]).otherwise(state["begin"]).alias("begin"),
                (state["line"] + 1).alias("line"), (end + 1).alias("at"),
            )

        return let(F.regexp_extract(line, "^(?:`{3,}|~{3,})", 0), told)

    start = F.struct(F.array().cast(_NO_REGIONS).alias("found"), F.lit("").alias("mark"), *[F.lit(0).alias(c) for c in ("first", "begin", "line", "at")])
    rest = lambda s: F.array(F.struct(s["first"].alias("first"), (s["line"] - 1).alias("last"), s["begin"].alias("begin"), (s["at"] - 1).alias("end")))
    return F.aggregate(lines, start, step, lambda s: F.when(s["mark"] == "", s["found"]).otherwise(F.concat(s["found"], rest(s))))


def fenced_flags(lines: Column) -> Column:
    """For each line, whether it belongs to a fenced code region: stretches of no and yes, region after region."""

    def flags(regions: Column) -> Column:
        def stretch(r: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(regions, i - 1)["last"] + 1)
            return F.concat(F.array_repeat(F.lit(False), r["first"] - before), F.array_repeat(F.lit(True), r["last"] - r["first"] + 1))

        after = F.size(lines) - F.when(F.size(regions) == 0, F.lit(0)).otherwise(F.get(regions, F.size(regions) - 1)["last"] + 1)
        return F.concat(F.flatten(F.transform(regions, stretch)), F.array_repeat(F.lit(False), after))

    return let(fenced_regions(lines), flags)


def unfenced_lines(text: Column, fenced: Callable[[Column], Column] = lambda line: F.lit("")) -> Column:
    """The lines of a text; those of fenced code as `fenced` makes them, by default empty."""
    return let(lines_of(text), lambda lines: F.zip_with(lines, fenced_flags(lines), lambda line, code: F.when(code, fenced(line)).otherwise(line)))


def fence_regions(text: Column) -> Column:
    """Character offsets of fenced code, from the opening fence's start to the closing one's end."""
    return F.transform(fenced_regions(lines_of(F.coalesce(text, F.lit("")))), lambda r: F.array(r["begin"], r["end"]))


def in_region(regions: Column, at: Column) -> Column:
    """Whether one of the regions (first offset, offset after the last) holds the place."""
    return F.exists(regions, lambda r: (r[0] <= at) & (at < r[1]))


def code_parts(line: Column) -> Column:
    """A line's parts in order, and whether each is inline code: a run of backticks, up to the next run of the same length."""
    part = lambda code, text: F.array(F.struct(F.lit(code).alias("code"), text.alias("text")))

    def of_runs(runs: Column) -> Column:
        kinds = F.array_distinct(F.filter(runs, lambda r: r.startswith("`")))
        # the last place of each length of run
        ends = let(F.reverse(runs), lambda back: F.transform(kinds, lambda k: F.struct(k.alias("run"), (F.size(back) - F.array_position(back, k)).alias("at"))))
        numbered = F.transform(runs, lambda piece, i: F.struct(i.alias("i"), piece.alias("piece")))
        return let(ends, lambda last: F.aggregate(numbered, start, lambda state, x: step(last, state, x), lambda s: s["parts"]))

    def step(last: Column, state: Column, x: Column) -> Column:
        outside, piece = state["open"] == "", x["piece"]
        opens = outside & piece.startswith("`") & F.exists(last, lambda e: (e["run"] == piece) & (e["at"] > x["i"]))
        closes = ~outside & (piece == state["open"])
        return F.struct(
            F.when(closes, F.concat(state["parts"], part(True, F.concat(state["held"], piece)))).when(outside & ~opens, F.concat(state["parts"], part(False, piece))).otherwise(state["parts"]).alias("parts"),
            F.when(opens, piece).when(closes, "").otherwise(state["open"]).alias("open"),
            F.when(opens, piece).when(outside | closes, "").otherwise(F.concat(state["held"], piece)).alias("held"),
        )

    start = F.struct(F.array().cast("array<struct<code: boolean, text: string>>").alias("parts"), F.lit("").alias("open"), F.lit("").alias("held"))
    return let(F.regexp_extract_all(line, F.lit("`+|[^`]+"), F.lit(0)), of_runs)


def inline_code_texts(text: Column) -> Column:
    """The inline code of a text, outside fences, with its backticks."""
    free = F.filter(unfenced_lines(F.coalesce(text, F.lit(""))), lambda line: F.contains(line, F.lit("`")))
    return F.flatten(F.transform(free, lambda line: F.transform(F.filter(code_parts(line), lambda p: p["code"]), lambda p: p["text"])))


def _masked(text: Column) -> Column:
    """The text with every "<" in code masked."""
    hidden = lambda c: F.translate(c, "<", _MASK)
    inline = lambda line: F.array_join(F.transform(code_parts(line), lambda p: F.when(p["code"], hidden(p["text"])).otherwise(p["text"])), "")
    masked = let(lines_of(text), lambda lines: F.zip_with(lines, fenced_flags(lines), lambda line, code: F.when(code, hidden(line)).when(F.contains(line, F.lit("`")) & F.contains(line, F.lit("<")), inline(line)).otherwise(line)))
    return F.when(F.contains(text, F.lit("<")) & (F.contains(text, F.lit("~~~")) | F.contains(text, F.lit("`"))), F.array_join(masked, "\n")).otherwise(text)


def _silenced(text: Column, name: str) -> Column:
    """The text without the elements of that name. Each stretch up to a closing tag is looked at by itself, so openings that nothing closes are not followed to the end."""
    close = f"</{name}>"
    drop = lambda p: F.when(F.lower(F.right(p, F.lit(len(close)))) == close, F.regexp_replace(p, rf"(?is)<{name}(?=[\s>])[^>]*+>.*{close}$", "")).otherwise(p)
    return let(text, lambda t: F.when(F.lower(t).contains(close), F.array_join(F.transform(F.split(t, f"(?i)(?<={close})"), drop), "")).otherwise(t))


def html_strip(text: Column) -> Column:
    """Text without scripts, styles and tags, for markup without code samples.

    A tag is "<" or "</", the name of an element, attributes without "<", and ">". Attributes may run over
    lines only if a later piece closes the element. What no element is called stays.
    """
    for name in SILENT_TAGS:
        text = _silenced(text, name)
    name_of = lambda p: F.lower(F.regexp_extract(p, r"^/?([A-Za-z][A-Za-z0-9]*)(?:\s[^>]*)?/?>", 1))
    end_of = lambda p: F.lower(F.regexp_extract(p, "^/([A-Za-z0-9]+)>", 1))

    def of_pieces(pieces: Column) -> Column:
        # the elements that some piece closes: no more than there are names
        return let(F.array_distinct(F.filter(F.transform(F.filter(pieces, lambda p: p.startswith("/")), end_of), lambda e: e.isin(HTML_TAGS))), lambda ends: F.array_join(F.transform(pieces, lambda p, i: told(ends, p, i)), ""))

    def told(ends: Column, piece: Column, i: Column) -> Column:
        def of_name(name: Column) -> Column:
            inside = F.substring_index(piece, ">", 1)
            known = name.isin(HTML_TAGS) & (~F.contains(inside, F.lit("\n")) | F.array_contains(ends, name))
            return F.when(known, piece.substr(F.length(inside) + 2, F.length(piece))).otherwise(F.concat(F.lit("<"), piece))

        return F.when(i == 0, piece).otherwise(let(name_of(piece), of_name))

    return let(text, lambda t: F.when(F.contains(t, F.lit("<")), let(F.split(t, "<"), of_pieces)).otherwise(t))


def _definition_label(line: Column) -> Column:
    """The label of a line that defines a reference, as in "[label]: target"; else the empty string."""
    body = F.ltrim(line)
    label = F.substring_index(body.substr(F.lit(2), F.length(body)), "]", 1)
    after = body.substr(F.length(label) + 3, F.length(body))
    return F.when(body.startswith("[") & after.startswith(":") & (F.trim(after.substr(F.lit(2), F.length(after))) != ""), label).otherwise("")


def reduce_links(text: Column) -> Column:
    """Links become their words: tags outside code, reference definitions (with blank lines before them) and targets go.

    A single bracket is a reference only if its label is defined.
    """
    return let(F.translate(html_strip(_masked(text)), _MASK, "<"), lambda plain: let(lines_of(plain), lambda lines: _unlinked(plain, lines)))


def _unlinked(plain: Column, lines: Column) -> Column:
    """reduce_links of a text without tags, and its lines."""
    labels = F.array_distinct(F.filter(F.transform(lines, _definition_label), lambda x: x != ""))
    marked = lambda: F.array_join(F.transform(lines, lambda line: F.when(_definition_label(line) != "", _MARK).otherwise(line)), "\n")
    bracket = r"\[([^\]]*+)]"

    def unbracketed(done: Column, label: Column) -> Column:
        linked = F.concat(F.lit("["), label, F.lit("]("))
        kept = F.replace(done, linked, F.concat(F.lit(_MARK), label, F.lit("](")))
        return F.translate(F.replace(kept, F.concat(F.lit("["), label, F.lit("]")), label), _MARK, "[")

    def of_labels(found: Column) -> Column:
        body = F.when(F.size(found) > 0, F.regexp_replace(marked(), rf"(?m)^\s*{_MARK}", "")).otherwise(plain)
        body = F.regexp_replace(body, bracket + r"\[[^\]]*+]", "$1")
        return F.regexp_replace(F.aggregate(found, body, unbracketed), "!?" + bracket + r"\([^)]++\)", "$1")

    return let(labels, of_labels)


def extract_links(text: Column) -> Column:
    """words and href of the links outside fences, images left out; null has none."""
    # a link is cut at "](": its words are before, its target behind, up to ")" or to a title in quotes
    behind_cut = r'^([^)\s]++)(?:\s++"[^"]*+")?\)'
    target = lambda p: F.regexp_extract(p, behind_cut, 1)

    def of_last(last: Column, following: Column) -> Column:
        words = last.substr(F.instr(last, "[") + 1, F.length(last))
        href = F.when(F.instr(last, "[") > 0, target(following))
        image = last.substr(F.instr(last, "[") - 1, F.lit(1)) == "!"
        return F.struct(words.alias("words"), F.when((F.instr(last, "[") == 1) | ~image, href).alias("href"))

    def of_pieces(pieces: Column) -> Column:
        def link(piece: Column, i: Column) -> Column:
            behind = F.when(i == 0, piece).otherwise(F.regexp_replace(piece, behind_cut, ""))
            return let(F.substring_index(behind, "]", -1), lambda last: of_last(last, F.get(pieces, i + 1)))

        return F.filter(F.transform(pieces, link), lambda x: x["href"] != "")

    return let(F.split(F.array_join(unfenced_lines(F.coalesce(text, F.lit(""))), "\n"), r"\]\("), of_pieces)
