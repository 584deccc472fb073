"""Filter audit, URL filters and token alignment against plain versions, and what they must bear."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from docloom.llm import alignment, audit, urls

from . import corpus

LABELS = "doc_id long, quality int, toxic int, text string, n string"


def _failures(rows):
    firsts = {}
    for d, text, *_ in rows:
        if d is not None:
            firsts[text or ""] = min(d, firsts.get(text or "", d))
    for d, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(
            c for c, failed in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                re.search(r"[#$%&*|]", text) is not None, d is not None and d > firsts[text]))
            if failed
        )
        yield d, lang or "", fails


def _plain_audit(rows, labels):
    told = defaultdict(set)
    for d, quality, toxic in labels:
        told[d] |= {"good"} if quality == 1 else set()
        told[d] |= {"toxic"} if toxic == 1 else set()
    docs = [(part, fails, told.get(d, set()) if d is not None else set()) for d, part, fails in _failures(rows)]
    found = {}
    removed_at = Counter()
    for part in {p for p, _, _ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                fails = [x for x in own if letter in x[0]]
                removed_at[part, letter] += len(here)
                found[part, order, step] = [len(left), len(here), len(fails) - len(here), sum(x[0] == letter for x in own), sum("good" in x[1] for x in here), sum("toxic" in x[1] for x in here)]
    return {k: (*v, removed_at[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_audit_is_what_every_order_removes(spark):
    rows = corpus.rows()
    rows += [(100 + i, corpus.words(random.Random(i), 250, 4000) + ("" if i % 3 else " #"), "de", "s", 1, "", "", "", "", "", "") for i in range(9)]
    rows += [(200 + i, rows[0][1], "de" if i % 2 else "en", "s", 1, "", "", "", "", "", "") for i in range(40)]
    labels = [(d, d % 2, d % 3 == 0 and 1 or 0) for d in range(0, 230, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (7, None, 1)]
    labels = [(d, q, t, "x", "y") for d, q, t in labels]
    found = audit.audit(corpus.frame(spark, own=rows), spark.createDataFrame(labels, LABELS)).collect()
    want = _plain_audit(rows, [x[:3] for x in labels])
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found} == want
    assert len(found) == len(want)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit(corpus.empty(spark), none).isEmpty()
    found = audit.audit(corpus.frame(spark), none)
    assert found.where("good_lost + toxic_lost > 0").isEmpty() and found.count() == 600 * len({r[2] for r in corpus.rows()})


PAGES = "page_id long, url string, host string, _label boolean, segs string, verdict string, spam boolean"


def _pages(spark, found):
    return spark.createDataFrame([(i, u, "x", None, "y", "z", s) for i, (u, s) in enumerate(found)], PAGES)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://Shop.Example.NET/de/1?x=/en/#y", "shop.example.net", "/de/1", "net/", "block"),
        ("http://shop.example.net/en/1", "shop.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/en", "example.net", "/en", "net/", "block"),
        ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://a.net?q=/", "a.net", "", None, "allow"),
        ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("http://a.example.com/DE/", "a.example.com", "/DE/", None, "allow"),
        ("a.example.com/de/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://a.net/x\ny://b.org/fr/", "a.net", "/x\ny://b.org/fr/", "net/", "block"),
        ("\nq://É.ORG/fr/é", "É.org", "/fr/é", "org/fr/", "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule, verdict):
    own = _pages(spark, [(url, None)])
    h, p = urls.host_and_path(own["url"])
    r = urls.rule_of(h, p, urls.RULES)
    row = own.select(h.alias("host"), p.alias("path"), r["rule"].alias("rule"), r["block"].alias("block")).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)
    assert rule is None or row.block == (verdict == "block")


def test_templates_of_spam_are_rejected(spark):
    pages = [(f"https://shop.test/{lang}/item/{i}.html", False if i % 2 else None) for lang in ("en", "fr") for i in range(30)]
    pages += [(f"https://shop.test/win/{i}/casino", True if i % 3 else None) for i in range(30)]
    pages += [(f"https://shop.test/blog/{a}{b}", None) for a in "abcdefgh" for b in "klmnop"]
    pages += [("https://shop.test/blog/a/b/c/d/e/f/g", None), ("https://shop.test/blog/a/b/c/d/x/y", None), (None, True), ("nothing", None)]
    pages += [pages[0], pages[0]]
    found = urls.judge(_pages(spark, pages), "page_id", "spam", rules=[], bad="spam").collect()
    assert len(found) == len(pages)
    by = {r.page_id: r for r in found}
    for i, (url, _) in enumerate(pages):
        assert by[i].verdict == ("block" if url and "/win/" in url else "allow"), url
        if url and "/blog/" in url:
            assert by[i].template in ("/blog/*", "/blog/*/b/c/**")
        if url and "/win/" in url:
            assert by[i].template in ("/win/*/casino",)
        if url and "/item/" in url:
            assert by[i].template == f"/{url.split('/')[3]}/item/*" or by[i].template == "/*/item/*"
    assert {r.rule for r in found} == {None}


def test_url_filters_of_empty_tables_and_limits(spark):
    assert urls.judge(_pages(spark, []), "page_id").isEmpty()
    with pytest.raises(ValueError):
        urls.rule_of(None, None, [urls.UrlRule("a/", True)] * (urls.MOST_RULES + 1))
    long = [("http://h.test/" + "a" * 300_000, None), ("http://h.test" + "/b" * 20_000, None)]
    assert {r.verdict for r in urls.judge(_pages(spark, long), "page_id").collect()} == {"allow"}


def _plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    names = alignment.Tokenizers()
    a_side = Tokenizer.from_file(names.byte_level)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=names.pieces)
    to_byte = alignment.byte_characters()
    docs = []
    for text in texts:
        if not text:
            docs.append([])
            continue
        a = a_side.encode(" " + text, add_special_tokens=False).ids
        b = b_side.encode(text)
        spelled_a = [bytes(to_byte[c] for c in a_side.id_to_token(i)) for i in a]
        spelled_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
            docs.append([])
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, spelled_a))), list(itertools.accumulate(map(len, spelled_b)))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        docs.append(groups)
    links = [Counter((x, y) for own_a, own_b in groups for x in own_a for y in own_b) for groups in docs]
    counts = Counter(pair for own in links for pair in own)
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(n, highest.get(x, 0))
    for groups, own in zip(docs, links):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()), sum(n for p, n in own.items() if counts[p] == highest[p[0]]),
            sum(n * counts[p] for p, n in own.items()), hashlib.sha256(told.encode()).hexdigest() if groups else "",
        )


ODD = ["<|endoftext|> <s> </s> <0x41> <unk>", "a▁b", "▁", "don't stop, we'll  see   x", "1234567890" * 30, "日本語のテキスト 🙂🙂", " lead and trail ", "\n\n\t tabs\r\n", " " * 700, "a" * 3000, "﻿mark    wide", "é combining", "\x00\x01\x7f", "x" + "​" * 50 + "y"]


def test_alignment_is_that_of_byte_offsets(spark):
    rows = [r for r in corpus.rows() if r[1] is None or len(r[1]) < 30_000]
    rows += [(300 + i, t, "en", "s", 1, "x", "y", "z", "n", "0", "q") for i, t in enumerate(ODD + ODD[:3])]
    own = corpus.frame(spark, own=rows).repartition(5)
    found = alignment.align(own, "doc_id", "n_words", tokenizers=alignment.Tokenizers(block_pairs=2_000, memo=5_000)).collect()
    want = sorted(((r[0], *w) for r, w in zip(rows, _plain_alignment([r[1] for r in rows]))), key=repr)
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found), key=repr) == want


def test_alignment_of_nothing(spark):
    assert alignment.align(corpus.empty(spark), "doc_id").isEmpty()
    rows = [(1, None, None, None, None, "x", "y", "z", "n", "0", "q"), (2, "", None, None, None, "x", "y", "z", "n", "0", "q")]
    assert [(r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in alignment.align(corpus.frame(spark, own=rows), "doc_id").collect()] == [(0, 0, 0, "")] * 2


def test_transducer_closes_wide_groups():
    a, b = [b"ab", b"abab", b"b"], [b"a", b"ba", b"bab"]
    reader = alignment.Transducer(a, b, 10)
    assert reader.groups([0, 0, 0], [0, 1, 2]) == ([3], [3])
    assert reader.groups([0, 1], [0, 1, 2]) == ([2], [3])
    with pytest.raises(ValueError):
        reader.groups([2], [0])


def test_wide_groups_are_linked_by_distinct_ids():
    files = alignment.Tokenizers().load()
    aligner = alignment.Aligner(files, 1000)
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 90), rng.integers(0, 30, 70)
    ends = np.array([50, 90]), np.array([40, 70])
    pairs, times = aligner._links(a, b, *ends)
    want = Counter()
    for (i, j), (k, m) in (((0, 50), (0, 40)), ((50, 90), (40, 70))):
        want.update(int(x) * aligner.n_b + int(y) for x in a[i:j] for y in b[k:m])
    assert {(int(p) * alignment.UNMIX) & 0xFFFFFFFF: int(n) for p, n in zip(pairs, times)} == want
