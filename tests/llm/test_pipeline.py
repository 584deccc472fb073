"""Each stage of the pipeline against a brute-force version or SQL, on the rows that the stage before it has kept."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from docloom.llm import packing, sql
from docloom.llm.core import saved

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def by_sql(query, docs, column):
    connection = duckdb.connect()
    connection.register("documents", docs)
    connection.read_parquet(f"{SF}/benchmark.parquet").create_view("benchmark")
    found = connection.sql(query).df()
    return set(found[found[column]]["doc_id"])


def words_of(text):
    return (text or "").encode().translate(LOWER).split()


def first_of_classes(texts):
    """The ids that stay: the smallest of each class of linked texts, and texts without words."""
    sets = {}
    for i, text in texts.items():
        words = words_of(text)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                one, two = sorted((root(a), root(b)))
                label[two] = one
    return {i for i in ids if root(i) == i}


def without_repeats(texts, length):
    data = {i: (text or "").encode() for i, text in texts.items()}
    counts = Counter(t[k : k + length] for t in data.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in data.items():
        covered = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                covered[k : k + length] = b"\x01" * length
        kept, at = b"", 0
        for run in re.finditer(rb"\x01+", bytes(covered)):
            start, end = run.span()
            while start < end and t[start] & 0xC0 == 0x80:  # code points held in part stay
                start += 1
            while end > start and end < len(t) and t[end] & 0xC0 == 0x80:
                end -= 1
            kept, at = kept + t[at:start], max(at, end)
        out[i] = (kept + t[at:]).decode()
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        before = docs.toPandas()
        docs = saved(stages[name](spark, docs, SF), "stage-test")
        return before, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

    before, kept = step("quality rules")
    assert set(kept) == by_sql(sql.QUALITY, before, "kept")
    before, kept = step("near-duplicates")
    assert set(kept) == first_of_classes(dict(zip(before.doc_id, before.text)))
    before, kept = step("suffix-array dedup")
    assert kept == without_repeats(dict(zip(before.doc_id, before.text)), corpus_pipeline.PASSAGE_BYTES)
    before, kept = step("benchmark decontamination")
    assert set(kept) == set(before.doc_id) - by_sql(sql.DECONTAMINATION, before, "contaminated")

    placed = stages["best-fit packing"](spark, docs, SF).collect()
    sizes, bins = Counter(), defaultdict(list)
    for r in placed:
        sizes[r.doc_id] += r.n_tokens
        bins[r.bin].append(r)
    assert sizes == Counter({i: len(words_of(text)) for i, text in kept.items() if words_of(text)})
    for own in bins.values():
        spans = sorted((r.offset, r.offset + r.n_tokens) for r in own)
        assert spans[-1][1] <= packing.Packing().capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for labels in ([r.source for r in own if r.source is not None], [b" ".join(words_of(kept[r.doc_id])) for r in own]):
            assert len(labels) == len(set(labels))
