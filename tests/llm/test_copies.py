"""Suffix arrays, byte and word deduplication, near duplicates."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import exact, near, substring
from docloom.llm.anchors import anchors
from docloom.llm.core import PrefixHash, pack_sorted, unpack_sorted
from docloom.llm.suffixes import permuted_prefixes, suffix_array

from . import corpus


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(300):
        k = rng.choice([1, 2, 3, 30, 300])
        text = [rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0]
        array = suffix_array(np.array(text), k + 1).tolist()
        assert array == sorted(range(len(text)), key=lambda i: text[i:])
        shared = permuted_prefixes(np.array(text), np.array(array))
        for a, b in zip(array, array[1:]):
            n = 0
            while text[a + n : a + n + 1] == text[b + n : b + n + 1] != []:
                n += 1
            assert shared[b] == n


def test_anchors_follow_the_bytes():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 4, 100).astype(np.uint64)
    found = []
    for _ in range(5):
        before = rng.integers(0, 4, rng.integers(40, 200)).astype(np.uint64)
        text = np.concatenate((before, shared, rng.integers(0, 4, 90).astype(np.uint64))) + np.uint64(1)
        hasher = PrefixHash()
        at, first, last = anchors(hasher.sums(text), hasher, 32)
        assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and ((first <= at) & (at < last + 32)).all()
        led = {int(s): int(a) - len(before) for a, f, l in zip(at, first, last) for s in range(f, l + 1)}
        found.append([led[s + len(before)] for s in range(100 - 32 - 15 + 1)])
    assert all(f == found[0] for f in found)


def test_packed_values():
    for values in ([], [5], [0, 1, 2**40, 2**64 - 1], list(range(0, 10**6, 999))):
        own = np.array(values, np.uint64)
        assert (unpack_sorted(pack_sorted(own)) == own).all()


def brute_bytes(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        runs = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(t), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return out


def check_bytes(spark, own, length, **more):
    """The operator's result against the brute-force one."""
    got = exact.dedup(corpus.frame(spark, own=own), "text", length=length, **more)
    got = Counter((r.text, r.n_bytes, r.n, r.k, r.h, r.n_passage) for r in got.select("text", "n_bytes", F.expr("aggregate(removed, 0L, (s, x) -> s + x.end - x.start)").alias("n"), F.size("removed").alias("k"), F.sha2("kept", 256).alias("h"), "n_passage").collect())
    texts = [(r[1] or "").encode() for r in own]
    want = Counter((r[1], *b, p[1]) for r, b, p in zip(own, brute_bytes(texts, length), brute_bytes(texts, more.get("passage", length))))
    assert got == want
    return sum(n * x[2] for x, n in want.items())


def test_repeated_bytes(spark):
    assert check_bytes(spark, corpus.rows(), 100)


def passages(seed: int = 5) -> list[tuple]:
    """Passages of 50 to 90 words in documents of their own words, some more than once, one cut at every place."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 10)))
    text = lambda n: " ".join(word() for _ in range(n))
    planted = [text(n) for n in (50, 55, 60, 65, 70, 80, 90)]
    texts = [f"{text(rng.randrange(80))} {p} {text(rng.randrange(80))}" for p in planted for _ in range(3)]
    line = text(45)
    texts += [f"{text(9)} {line} {text(60)}" for _ in range(12)] + [text(300), planted[-1], planted[-1] * 3]
    texts += [f"{text(5)} {planted[-1][k:]} {text(30)}" for k in range(0, 250, 9)]
    return [(i, t, "en", "s", 0, *"xyzn0q") for i, t in enumerate(texts)]


def test_repeated_bytes_at_the_contract_length(spark):
    assert check_bytes(spark, passages(), 400, passage=240)
    assert check_bytes(spark, corpus.rows(), 400, passage=240)


def test_passages_over_fifty_words_are_told(spark):
    """Passages of 50 to 70 words are shorter than 400 bytes here, so nothing of them is removed: n_passage tells them."""
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    planted = {n: text(n) for n in (51, 55, 60, 65, 70, 80)}
    own = [(i * 1000 + n, f"{text(40)} {p} {text(60)}", "en", "s", 0, *"xyzn0q") for i in range(3) for n, p in planted.items()]
    own += [(9000 + i, text(120), "en", "s", 0, *"xyzn0q") for i in range(20)]
    got = {r.doc_id: r for r in exact.dedup(corpus.frame(spark, own=own), "doc_id", length=400, passage=240).collect()}
    removed = {n: sum(x.end - x.start for x in got[n].removed) for n in planted}
    assert [removed[n] > 0 for n in planted] == [len(p) >= 400 for p in planted.values()] and removed[51] == 0
    assert all(got[i * 1000 + n].n_passage >= len(p) for i in range(3) for n, p in planted.items())
    assert not any(got[9000 + i].n_passage for i in range(20))


def test_crowded_contexts_give_the_same(spark):
    assert check_bytes(spark, passages(), 400, crowd=2, passage=240)
    assert check_bytes(spark, passages(9), 400, crowd=0, passage=100)
    assert check_bytes(spark, passages(9), 200, crowd=0)


def test_repeated_bytes_of_low_entropy(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(50, 400))) for _ in range(25)] + ["a" * 500, "ab" * 200, "ab" * 201]
    core = texts[0][:120]
    texts += [f"{i}{core}{i * 7}" for i in range(6)] + [core[k : k + 70] for k in (0, 5, 31, 50)]
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))  # polynomial hashes modulo powers of two tell its halves apart badly
    texts += [thue[:2048], thue[2048:], thue[1000:1300]]
    own = [(i, t, "en", "s", 0, *"xyzn0q") for i, t in enumerate(texts)]
    for crowd in (4096, 0):
        assert check_bytes(spark, own, 64, crowd=crowd)


def test_shared_prefixes():
    pieces = [(0, b"xxabab", b"babababa"), (0, b"yyabab", b"bababaxx"), (1, b"abab", b"babababa"), (0, b"abab", b"bababab"), (2, b"xyx", b"yyyyyyyyy"), (3, b"", b"")]
    best, middle = exact.shared_prefixes(pieces)
    text = [x for g, left, right in pieces for x in [*(b + 2 for b in left), 258 + g, *(b + 2 for b in right), 1]] + [0]
    assert [text[i] for i in middle] == [258 + p[0] for p in pieces]
    for i in range(len(text)):
        same = 0
        for j in range(len(text)):
            n = 0
            while i != j and text[i + n : i + n + 1] == text[j + n : j + n + 1] != []:
                n += 1
            same = max(same, n)
        assert best[i] == same


def test_repeated_starts():
    rng = random.Random(12)
    for _ in range(40):
        width, some = rng.choice([3, 9]), lambda n: bytes(rng.choice(b"ab") for _ in range(n))
        pieces = []
        for _ in range(rng.randrange(1, 30)):
            n = rng.randrange(width)
            pieces.append((rng.randrange(3), some(n), some(rng.randrange(width - 1 - n, width))))
        pieces = [p for p in dict.fromkeys(pieces) if p[1] or p[2]] + [(7, b"", b"")]
        count = np.array([rng.choice([1, 1, 1, 2]) for _ in pieces])
        hit, bounds = exact.repeated_starts(pieces, count, width)
        strings = [[(g, left[s:], right[: width - 1 - len(left) + s]) for s in range(len(left) + len(right) + 2 - width)] if left or right else [g] for g, left, right in pieces]
        every = Counter()
        for own, n in zip(strings, count.tolist()):
            for x in own:
                every[x] += n
        assert hit.tolist() == [every[x] > 1 for own in strings for x in own]
        assert bounds.tolist() == np.cumsum([0] + [len(own) for own in strings]).tolist()


def test_cleaned_documents_are_documents(spark):
    docs = corpus.frame(spark)
    got = exact.clean(docs, 100)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert all(r.text is None or "�" not in r.text for r in got.collect())
    assert exact.clean(corpus.empty(spark)).count() == 0
    assert exact.whole_characters("aéb".encode(), 2, 4) == (3, 4) and exact.whole_characters("aéb".encode(), 0, 2) == (0, 1)


def test_repeated_words(spark):
    own = [r for r in corpus.rows() if r[0] is not None and r[1] != "another text of a repeated id"]
    rng = random.Random(8)
    own += [(500 + i, " ".join(rng.choice("ab") for _ in range(60)), "en", "s", 0, *"xyzn0q") for i in range(10)]
    got = substring.dedup(corpus.frame(spark, own=own), "doc_id", window=5)
    got = Counter((r.doc_id, r.n_words, sum(x.end - x.start for x in r.removed), r.kept) for r in got.collect())
    seen, want = set(), Counter()
    for d, t, *_ in sorted(own, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - 4):
            key = tuple(w[i : i + 5])
            if key in seen:
                gone.update(range(i, i + 5))
            seen.add(key)
        want[d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    assert got == want


def test_repeated_words_bear_nulls(spark):
    got = substring.dedup(corpus.frame(spark), "doc_id")
    assert got.count() == len(corpus.rows())
    assert substring.dedup(corpus.empty(spark), "doc_id").count() == 0


def classes(own, k, percent=80):
    sets = []
    for d, t, *_ in own:
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(own):
        ids[find(i)].append(r[0])
    smallest = {root: min((x for x in v if x is not None), default=None) for root, v in ids.items()}
    return Counter((r[0], len(sets[i]), smallest[find(i)] if sets[i] else r[0]) for i, r in enumerate(own))


def test_near_duplicates(spark):
    rng = random.Random(6)
    own = corpus.rows()
    base = corpus.words(rng, 80, 400).split()
    for i in range(60):
        changed = list(base)
        for _ in range(rng.randrange(0, 9)):
            changed[rng.randrange(len(changed))] = f"z{rng.randrange(50)}"
        own.append((1000 + i, " ".join(changed), "en", "s", 0, *"xyzn0q"))
    for k in (2, 5):
        got = near.components(corpus.frame(spark, own=own), near.NearRule(words=k, chunk=7))
        assert Counter((r.id, r.n_shingles, r.component_id) for r in got.collect()) == classes(own, k)


def test_near_duplicates_keep_one(spark):
    own = corpus.rows()
    docs = corpus.frame(spark, own=own)
    kept = near.keep(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    label = classes(own, 5)  # (id, size, class) of each row
    silent = Counter((r[0], r[1]) for r in own if not (r[1] or "").split())
    for (d, t), n in silent.items():
        assert got.pop((d, t)) == n
    assert set(got.values()) == {1} and len({d for d, _ in got}) < len(got)  # two texts of one id stay
    assert len(got) == len({c for (_, size, c), _ in label.items() if size}) + 1  # another text of the smallest id of a class
    assert near.keep(corpus.empty(spark)).count() == 0


def test_registers_estimate_similarity():
    rule, rng = near.NearRule(), np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for j, passes in ((0.95, True), (0.8, True), (0.3, False)):
        n = int(2000 / (2 - 2 * j / (1 + j)))
        shared = int(2 * n * j / (1 + j))
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared : 2 * n - shared])
        regs = near.sketch(np.concatenate((a, b)), np.array([0, len(a)]), rule)
        assert (near.likely(regs[:1], np.array([len(a)]), regs[1:], np.array([len(b)]), rule)[0] >= 0) == passes
    union = near.sketch(np.unique(np.concatenate((a, b))), np.array([0]), rule)
    assert (union[0] == np.maximum(*regs)).all()


def test_empty_texts_between_copies_have_no_span(spark):
    copy = corpus.words(random.Random(7), 150, 5000)
    own = [(i, (copy, "", None)[i % 3], "en", "s", 0, *"xyzn0q") for i in range(60)]
    for r in exact.dedup(corpus.frame(spark, own=own), "doc_id").collect():
        want = [(0, len(copy))] if r.doc_id % 3 == 0 else []
        assert [(x.start, x.end) for x in r.removed] == want and bytes(r.kept) == b""
