"""Quality rules, packing, decontamination, licences and token counts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from docloom.llm import decontaminate, licenses, packing, quality, registry, tokens
from docloom.llm.near import NearRule

from . import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_base_measures(spark):
    docs = corpus.frame(spark)
    got = quality.judge(docs, "doc_id", "text").collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(r.text)
        assert not (r.kept and r.base_failed)


def test_quality_divergence_rejects_foreign_characters(spark):
    import random

    rng = random.Random(3)
    own = [(i, corpus.words(rng, 200, 300), "en", "s", 0, *"xyzn0q") for i in range(40)]
    own.append((99, " ".join("#$%&" for _ in range(100)) + " " + " ".join(f"{i}!!!" for i in range(100)), "en", "s", 0, *"xyzn0q"))
    kept = {r.doc_id for r in quality.keep(corpus.frame(spark, own=own)).collect()}
    assert kept == set(range(40))


@pytest.mark.parametrize("n_large", [400, 20])
def test_quality_verdict_does_not_depend_on_the_languages_share(spark, tmp_path, n_large):
    import random

    rng = random.Random(4)
    greek = [chr(c) for c in range(0x3B1, 0x3C9)]
    word = lambda: "".join(rng.choice(greek) for _ in range(rng.randrange(3, 9)))
    own = [(i, corpus.words(rng, 200, 300), "en", "s", 0, *"xyzn0q") for i in range(n_large)]
    own += [(1000 + i, " ".join(word() for _ in range(60)), "el", "s", 0, *"xyzn0q") for i in range(8)]
    own.append((2000, " ".join("#$%&" for _ in range(20)) + " " + " ".join(f"{i}!!!" for i in range(60)), "el", "s", 0, *"xyzn0q"))
    docs = corpus.frame(spark, own=own)
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert kept == set(range(n_large)) | set(range(1000, 1008))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.read_parquet(str(tmp_path / "documents.parquet/*.parquet")).create_view("documents")
    answer = duck.execute(registry.oracle_sql()["op1_quality_rules"])
    names = [c[0] for c in answer.description]
    assert sorted(map(tuple, registry.queries()["op1_quality_rules"](spark, str(tmp_path)).select(*names).collect())) == sorted(answer.fetchall())


def test_quality_keep_returns_the_columns(spark):
    docs = corpus.frame(spark)
    assert quality.keep(docs).columns == docs.columns
    assert quality.keep(corpus.empty(spark)).count() == 0


def test_js_distance():
    import numpy as np

    assert quality.js_distance(np.array([1, 0.0]), np.array([0, 1.0])) == 1
    assert quality.js_distance(np.array([2, 2.0]), np.array([1, 1.0])) == 0
    assert quality.js_distance(np.zeros(2), np.ones(2)) == 0


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return ITEM.findall((text or "").translate(LOWER))


def hits(text, items):
    words, hit, found = item_words(text), set(), set()
    for item_id, item in items:
        own = item_words(item)
        m = min(13, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    own = corpus.rows()
    items = [(1, " ".join(own[0][1].split()[3:30])), (2, "w1 W2"), (10, own[32][1][:400]), (3, None), (4, "??"), (5, "one"), (5, "one"), (None, " ".join(own[7][1].split()[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.verdict(decontaminate.find(corpus.frame(spark), bench, "doc_id", "text", rule=decontaminate.Winnowing(block_bytes=block_bytes)))
    got = found.collect()
    assert len(got) == len(own)
    for r in got:
        n, n_hit, ids = hits(r.text, items)
        ids = [i for i in ids if i != "None"]
        assert (r.n_words, r.n_hit, r.n_items) == (n, n_hit, len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n)


def test_decontamination_with_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.keep(corpus.frame(spark), none).count() == len(corpus.rows())
    assert decontaminate.keep(corpus.empty(spark), none).columns == corpus.empty(spark).columns


def test_packing_is_tightest_fit():
    import random

    rng = random.Random(5)
    for _ in range(30):
        rests = [(rng.randrange(1, 40), rng.choice(["a", "b", "c", None]), rng.randrange(6)) for _ in range(60)]
        got = packing.pack(rests, packing.Packing(capacity=40, frequent=rng.choice([1, 4, 100])))
        bins = []  # residual, labels, offset
        for i in sorted(range(len(rests)), key=lambda i: -rests[i][0]):
            size, source, cluster = rests[i]
            labels = {("c", cluster)} | ({("s", source)} if source else set())
            fit = {n: b[0] for n, b in enumerate(bins) if b[0] >= size and not b[1] & labels}
            number, offset = got[i]
            if fit:
                assert fit[number] == min(fit.values())
            else:
                assert number == len(bins)
                bins.append([40, set()])
            assert offset == 40 - bins[number][0]
            bins[number][0] -= size
            bins[number][1] |= labels


def test_packing_places_every_word(spark):
    rule = packing.Packing(capacity=100, shard_rows=20)
    got = packing.assign(corpus.frame(spark), rule).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    sizes = [len(WORD.findall(r[1] or "")) for r in corpus.rows()]
    assert sum(r.n_tokens for r in got) == sum(sizes) and len(got) == sum(math.ceil(s / 100) for s in sizes)
    for own in bins.values():
        taken = sorted((r.offset, r.offset + r.n_tokens) for r in own)
        assert taken[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
        named = [r.source for r in own if r.source is not None]
        assert len(named) == len(set(named))
    assert packing.assign(corpus.empty(spark)).count() == 0


def test_packing_parts_copies(spark):
    import random

    rng = random.Random(6)
    texts = [corpus.words(rng, 40, 5000) for _ in range(6)]
    copies = [t.upper() for t in texts] + [t.replace(" ", " \n\t ", 5) + "  " for t in texts]  # case and white space
    near = [t + " end" for t in texts]
    other = [t.replace("w", "W").replace("2", "x") for t in texts]  # not copies
    rows = [(i, t, "en", None, 0, *"xyzn0q") for i, t in enumerate([*texts, *copies, *near, *other])]
    rows += [(99, corpus.words(rng, 40, 5000), "en", None, 0, *"xyzn0q") for _ in range(2)]  # an id that repeats
    docs, rule = corpus.frame(spark, own=rows), packing.Packing(capacity=10_000)

    def together(found):
        bins = defaultdict(set)
        for r in found:
            bins[r.bin].add(r.doc_id)
        assert sum(r.n_tokens for r in found) == sum(len(WORD.findall(r[1])) for r in rows)
        return {(a, b) for own in bins.values() for a in own for b in own}

    plain, classed = together(packing.assign(docs, rule).collect()), together(packing.assign(docs, rule, near=NearRule()).collect())
    for i in range(6):
        assert not {(i, i + 6), (i, i + 12), (i + 6, i + 12)} & plain
        assert not {(i, i + 6), (i, i + 12), (i + 6, i + 12), (i, i + 18), (i + 6, i + 18)} & classed
    assert {(18, 19), (18, 24)} <= classed and {(18, 19), (18, 24)} <= plain and {(0, 18), (6, 18), (12, 18)} & plain


def test_op2_parts_near_copies(spark, tmp_path):
    import random

    rng = random.Random(8)
    texts = [corpus.words(rng, 60, 5000) for _ in range(5)]
    rows = [(2 * i + k, t, "en", f"s{2 * i + k}", 0, *"xyzn0q") for i, text in enumerate(texts) for k, t in enumerate((text, text + " end"))]
    corpus.frame(spark, own=rows).write.parquet(str(tmp_path / "documents.parquet"))
    bins = {r.doc_id: r.bin for r in registry.op2_best_fit_packing(spark, str(tmp_path)).collect()}
    assert all(bins[2 * i] != bins[2 * i + 1] for i in range(5)) and len(set(bins.values())) == 2


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    own = [(1, f"some words before {apache} and after", None), (2, "no licence here " * 50, None), (3, None, None), (4, "Released  under the MIT license", None), (5, licenses.TEMPLATES[1][1], None), (6, f"{apache}\n" * 3, None)]
    own.append((7, "filler " * 20_000 + licenses.TEMPLATES[5][1] + " filler" * 20_000, None))
    rows = [(d, t, "en", None, 0, *"xyzn0q") for d, t, _ in own]
    got = {(r.doc_id, r.license): r for r in licenses.scan(corpus.frame(spark, own=rows), "doc_id").collect()}
    assert set(got) == {(1, "Apache-2.0"), (4, "MIT"), (5, "Apache-2.0"), (6, "Apache-2.0"), (7, "MIT")}
    assert got[1, "Apache-2.0"].first_word == 3 and got[1, "Apache-2.0"].containment == 1 and got[7, "MIT"].first_word == 20_000
    assert licenses.scan(corpus.empty(spark), "doc_id").count() == 0


def test_licence_templates_from_a_table(spark):
    import random

    rng = random.Random(12)
    full = " ".join(f"term{rng.randrange(400)}" for _ in range(1500))
    table = spark.createDataFrame([("Long", full), ("Long", full), ("Short", "one two three four five six"), ("Null", None)], "name string, text string")
    cut = full.split()
    own = [(1, f"before {full} after", "en", None, 0, *"xyzn0q"), (2, " ".join(cut[:1300]), "en", None, 0, *"xyzn0q"), (3, " ".join(cut[:900]), "en", None, 0, *"xyzn0q"), (4, "one two three four five six", "en", None, 0, *"xyzn0q")]
    got = {(r.doc_id, r.license): r.first_word for r in licenses.scan(corpus.frame(spark, own=own), "doc_id", templates=table).collect()}
    assert got == {(1, "Long"): 1, (2, "Long"): 0, (4, "Short"): 0}
    with pytest.raises(ValueError, match="may be broadcast"):
        licenses.scan(corpus.frame(spark, own=own), "doc_id", templates=table, rule=licenses.LicenseScan(template_bytes=1000))


def test_licence_containment_by_brute_force(spark):
    import random

    rng = random.Random(9)
    own = []
    for i in range(60):
        name, text = rng.choice(licenses.TEMPLATES)
        part = text.split()
        for _ in range(rng.randrange(0, 3)):
            part[rng.randrange(len(part))] = "changed"
        own.append((i, f"{corpus.words(rng, 40)} {' '.join(part)} {corpus.words(rng, 30)}", "en", None, 0, *"xyzn0q"))
    got = {(r.doc_id, r.license) for r in licenses.scan(corpus.frame(spark, own=own), "doc_id").collect()}
    for d, text, *_ in own:
        words = decontaminate.fold_words(text.encode())
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for name in {n for n, _ in licenses.TEMPLATES}:
            best = 0.0
            for n, t in licenses.TEMPLATES:
                w = decontaminate.fold_words(t.encode())
                s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
                best = max(best, len(s & grams) / len(s)) if n == name else best
            assert ((d, name) in got) == (best >= 0.8)


def test_token_counts_are_the_librarys(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokens.load_vocabulary(public.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    got = tokens.count(corpus.frame(spark), "text", vocabulary=vocabulary).collect()
    for r in got:
        assert r.n_tokens == len(exact.encode(r.text or "", add_special_tokens=False).ids)
    model = tokens.Viterbi([("▁a", -1.0), ("a", -1.0), ("aa", -2.0), ("▁", -1.0)])
    assert model.count("aaaa") == model.count("aaaa") > 0 and model.count("") == 0
    assert tokens.count(corpus.empty(spark), "doc_id", vocabulary=vocabulary).count() == 0


def test_quality_verdicts_do_not_depend_on_the_size_of_the_corpus(spark):
    """Languages are large by their share of the words: a corpus repeated is judged as before, also at and below one in a hundred."""
    words = " ".join(f"word{i % 30}" for i in range(120))
    odd = " ".join(f"other{i}" for i in range(120))
    rows = [(i, "en", f"{words} number{i}") for i in range(150)] + [(200, "fi", words), (201, "sv", odd), (202, "sv", words), (203, None, odd)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    told = lambda df: {tuple(r) for r in quality.judge(df, "doc_id", "text").select("doc_id", "kept", "class_distance", "word_distance").collect()}
    assert told(docs) == told(docs.union(docs).union(docs).union(docs))
