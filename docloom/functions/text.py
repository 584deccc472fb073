"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keep identifiers such as v1.2 and store_id whole (fixed value).
IDENTIFIER = r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*"


def tokenize_ident(text: Column) -> Column:
    """Identifier-preserving tokens in lower case; none for null."""
    found = F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))
    return F.coalesce(F.transform(found, F.lower), F.array().cast("array<string>"))


def stem(word: Column) -> Column:
    """Three letters or fewer stay; -ies becomes -y; another single final s goes."""
    cut = lambda n: word.substr(F.lit(1), F.length(word) - n)
    return (
        F.when(F.length(word) <= 3, word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def normalize_stem(text: Column) -> Column:
    """Stemmed words of letters and digits, underscores being spaces."""
    words = F.regexp_extract_all(F.lower(F.translate(text, "_", " ")), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.coalesce(F.transform(words, stem), F.array().cast("array<string>"))


def answer_norm(text: Column) -> Column:
    """Lower case, plain dashes, no thousands commas, % for percent, single spaces."""
    out = F.translate(F.lower(text), "–", "-")
    out = F.regexp_replace(out, r"(?<=\d),(?=\d{3}\b)", "")
    out = F.regexp_replace(out, r"\s*percent\b", "%")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_citations(text: Column) -> Column:
    """Citation marks removed, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\[\d+\]", ""), r"\s+", " "))


def claim_sentences(text: Column) -> Column:
    """Sentences without their citation marks, blank ones left out."""
    parts = F.split(strip_citations(text), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


def abstained(answer: Column) -> Column:
    return answer.isNull() | F.contains(F.upper(answer), F.lit("NOT FOUND"))


def context_text(title: Column, heading_path: Column, text: Column) -> Column:
    """title > heading > heading, and the text on the next line."""
    return F.concat(F.concat_ws(" > ", F.array(title), heading_path), F.lit("\n"), text)


def heading_path_text(title: Column, heading_path: Column, text: Column) -> Column:
    """The heading path without a leading page title, and the text on the next line."""
    rest = F.when(F.get(heading_path, F.lit(0)) == title, F.slice(heading_path, 2, F.greatest(F.size(heading_path), F.lit(1)))).otherwise(heading_path)
    return F.concat(F.concat_ws(" > ", rest), F.lit("\n"), text)


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_external(href: Column) -> Column:
    return href.rlike("^(https?://|mailto:|#)")


def resolve_href(href: Column, source: Column) -> Column:
    """Bundle path of a link: cut at # and ?, a leading slash is the root, dot segments folded; null if external or empty."""
    bare = F.substring_index(F.substring_index(href, "#", 1), "?", 1)
    parent = F.when(F.contains(source, F.lit("/")), F.regexp_replace(source, "/[^/]*$", "")).otherwise("")
    joined = F.when(bare.startswith("/"), bare).otherwise(F.concat(parent, F.lit("/"), bare))
    folded = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda path, part: F.when((part == "") | (part == "."), path).when(part == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(part))),
    )
    return F.when(~is_external(href) & (bare != ""), F.concat_ws("/", folded))


def path_candidates(path: Column) -> Column:
    """The path itself if it names a markdown file, else the file and the directory index it may mean."""
    return F.when(path.endswith(".md"), F.array(path)).otherwise(F.array(F.concat(path, F.lit(".md")), F.concat(path, F.lit("/index.md"))))


def english_list(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(head, F.lit(", and "), F.element_at(items, -1)))


def slug(name: Column) -> Column:
    """Lower case, spaces as dashes, no full stops."""
    return F.translate(F.lower(name), " .", "-")


def possessive(name: Column) -> Column:
    return F.concat(name, F.when(name.endswith("s"), "'").otherwise("'s"))


def prefixed(question: Column, prefix: str) -> Column:
    """The question as an encoder takes it."""
    return F.concat(F.lit(prefix), question)


def pairs(items: Column) -> Column:
    """Each two of a short list, smaller one first (first, second)."""
    rows = F.array_sort(F.array_distinct(items))
    after = lambda i: F.slice(rows, i + 2, F.size(rows))
    return F.flatten(F.transform(rows, lambda a, i: F.transform(after(i), lambda b: F.struct(a.alias("first"), b.alias("second")))))


def value_text(value: Column) -> Column:
    """Booleans as yes and no."""
    return F.when(value.cast("string") == "true", "yes").when(value.cast("string") == "false", "no").otherwise(value.cast("string"))


def is_commit(revision: Column) -> Column:
    return F.coalesce(revision.rlike("^[0-9a-f]{40}$"), F.lit(False))


def has_token(text: Column, needle: Column) -> Column:
    """Whether the needle stands in the text, not inside a longer word or number."""
    quoted = F.concat(F.lit(r"(?<![\w.])\Q"), needle, F.lit(r"\E(?!\w)"))
    return F.regexp_like(text, quoted)


#: Units that a reference may end in (fixed values).
UNITS = r"\s*(square feet|days|day|cents|cent|hours|hour)$"


def reference_cores(reference: Column) -> Column:
    """What an answer must hold: both dates of a range, else the reference without its unit, $ and %."""
    plain = answer_norm(reference)
    dates = r"^(\d{4}-\d{2}-\d{2}) to (\d{4}-\d{2}-\d{2})$"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, UNITS, ""), r"^\$+", ""), "%+$", "")
    return F.when(plain.rlike(dates), F.array(F.regexp_extract(plain, dates, 1), F.regexp_extract(plain, dates, 2))).otherwise(F.array(bare))


def fact_correct(answer: Column, reference: Column) -> Column:
    """1 if every core of the reference stands in the answer, 0 if not or if the answer abstains."""
    text = answer_norm(answer)
    return F.when(abstained(answer), 0.0).otherwise(F.forall(reference_cores(reference), lambda core: has_token(text, core)).cast("double"))


def faithful(score: Column, answer: Column, threshold: float) -> Column:
    """An abstention is faithful; else the support must reach the threshold."""
    return F.when(abstained(answer) | (score >= threshold), 1.0).otherwise(0.0)
