"""Language-model scores, WARC archives and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import lm, warc

from . import corpus


def tokens(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split() + [None]


def test_base_scores(spark):
    docs = corpus.frame(spark)
    training = docs.where("doc_id % 3 <> 0")
    counts = Counter(w for r in corpus.rows() if r[0] is not None and r[0] % 3 for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    got = lm.score(docs, training, "text").collect()
    assert len(got) == len(corpus.rows())
    for r in got:
        own = tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0


def test_scores_by_brute_force(spark):
    model = lm.FilterModel()
    edges = lm.levels(model.spacing)
    read = lambda c: float(edges[np.searchsorted(edges, c, side="right") - 1]) if c else 0.0
    docs = corpus.frame(spark)
    words, pairs, texts = Counter(), Counter(), 0
    for r in corpus.rows():
        if r[0] is not None and r[0] % 3:
            own = tokens(r[1])
            texts += 1
            words.update(own)
            pairs.update(zip([0, *own], own))
    size = sum(words.values()) + len(words) + 1

    def by_hand(text):
        own, total = tokens(text), 0.0
        for before, word in zip([0, *own], own):
            context = read(words[before]) if before != 0 else read(texts)
            together = min(read(pairs[before, word]), read(words[word]), context)
            single = (read(words[word]) + 1) / size
            total += math.log10(model.pair_weight * together / context + (1 - model.pair_weight) * single if context else single)
        return total

    # with a filter so wide that no false positive is to be expected, the scores are the formula's
    training = docs.where("doc_id % 3 <> 0")
    got = lm.score(docs, training, "text", model=lm.FilterModel(bits_each=1024)).collect()
    assert len(got) == len(corpus.rows()) and all(math.isclose(r.score, by_hand(r.text), rel_tol=1e-9) for r in got)
    # false positives of the production filter move them by little
    got = lm.score(docs, training, "text", model=model).collect()
    off = sum(abs(r.score - by_hand(r.text)) for r in got) / sum(r.n_tokens for r in got)
    assert off < 0.01


def test_scores_without_training(spark):
    docs = corpus.frame(spark)
    got = lm.score(docs, corpus.empty(spark), "doc_id").collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert lm.score(corpus.empty(spark), docs, "doc_id").count() == 0


def test_held_out_text_is_likelier_under_the_model(spark):
    rng = random.Random(1)
    lines = [corpus.words(rng, 12, 400) for _ in range(40)]
    own = [(i, " ".join(rng.choice(lines) for _ in range(10)), "en", "s", 0, *"xyzn0q") for i in range(120)]
    docs = corpus.frame(spark, own=own)
    got = lm.score(docs, docs.where("doc_id % 4 <> 0"), "doc_id").where("doc_id % 4 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_filter_reads_what_was_put_in():
    model = lm.FilterModel()
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64))  # of the first of two buckets
    counts = np.random.default_rng(2).integers(1, 5000, len(values)).astype(np.uint64)
    import pyarrow as pa

    from docloom.llm.blocks import pack_fixed
    from docloom.llm.core import pack_sorted

    table = pa.table({"bucket": pa.array([0], pa.int32()), "kind": pa.array([0], pa.int32()), "blob": pa.array([pack_sorted(values)], pa.binary()), "counts": pa.array([pack_fixed(counts)], pa.binary())})
    filled = lm._fill(model, 1 << 22)(table)
    got = lm.Filter(np.frombuffer(filled["bits"][0].as_py(), np.uint8), 1 << 22, 40, 1, model).counts(values, 0)
    edges = lm.levels(model.spacing)
    want = edges[np.searchsorted(edges, counts.astype(float), side="right") - 1]
    assert (got >= want).all() and (got == want).mean() > 0.99


def test_filter_grows_with_the_events():
    import pyarrow as pa

    from docloom.llm.blocks import pack_fixed
    from docloom.llm.core import pack_sorted

    model = lm.FilterModel()
    fills, unseen = [], np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    for n in (500, 5000, 50_000):
        values = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        table = pa.table({"bucket": pa.array([0], pa.int32()), "kind": pa.array([0], pa.int32()), "blob": pa.array([pack_sorted(values)], pa.binary()), "counts": pa.array([pack_fixed(np.full(len(values), 7, np.uint64))], pa.binary())})
        data = np.frombuffer(lm._fill(model)(table)["bits"][0].as_py(), np.uint8)
        fills.append(np.unpackbits(data).mean())
        assert (lm.Filter(data, 8 * len(data), 40, 0, model).counts(unseen, 0) > 0).mean() < 0.01
    assert max(fills) < 0.2 and max(fills) - min(fills) < 0.02


def test_climb_ends_at_the_last_level():
    model = lm.FilterModel()
    full = np.full(128, 255, np.uint8)
    assert (lm.Filter(full, 1024, 40, 0, model).counts(np.arange(5, dtype=np.uint64), 0) == lm.levels(model.spacing)[-1]).all()


BAD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_round_trip_with_magic_in_payloads(spark):
    rows = [(i, None if i % 7 == 0 else f"http://x/{i}\r\nX: 1", None if i % 11 == 0 else "x" * (i * 37 % 900) + BAD * (i % 40) + "é" * (i * 91 % 3000) + ("WARC/1.1\r\n" if i % 3 == 0 else "")) for i in range(200)]
    rows += [(1000 + i, "u", "z" * 2000) for i in range(30)] + [(None, "u", "z" * 2000), (None, None, "q"), (7, "again", "z" * 999), (8, "again", "z" * 999)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # many byte ranges, some inside payloads
        got = Counter(tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        main = max((x for x in groups[h] if x is not None), default=None)
        revisit = len(h.encode()) >= 1000 and len(groups[h]) > 1 and i != main
        want[i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", main if revisit else None] += 1
    assert got == want


def test_warc_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = corpus.frame(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, corpus.rows()[0][1][:200])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        own = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert own.columns == docs.columns and own.count() <= docs.count(), name
        assert stage(spark, corpus.empty(spark), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
