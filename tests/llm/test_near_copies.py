"""The near-copy stage: five-word shingles from 0.8 on."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.llm import common, mixing, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULE = {"words": 5, "num": 80, "den": 100}


def sets_of(text, n):
    w = WORD.findall((text or "").translate(ASCII_LOW))
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, words=5, num=80, den=100):
    """key -> (set size, smallest key linked), over all pairs."""
    s, root = {d: sets_of(t, words) for d, t in texts.items()}, {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(s[a] & s[b])
            if s[a] and s[b] and den * both >= num * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(s[d]), top(d)) for d in s}


@pytest.mark.parametrize("chunk", [256, 4])
def test_the_rule_can_be_set(spark, chunk):
    r, texts = random.Random(chunk), {}
    for family in range(12):
        base = [f"f{family}w{r.randrange(500)}" for _ in range(r.choice([6, 11, 25, 60, 200]))]
        for _ in range(r.choice([1, 3, 15])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 6])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    texts |= {900: None, 901: "", 902: "a b", 903: "A  B", 904: "a"}
    old, ngram_join.CHUNK = ngram_join.CHUNK, chunk
    try:
        rows = ngram_join.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **RULE).collect()
    finally:
        ngram_join.CHUNK = old
    assert {r["doc_id"]: (r["n"], r["component_id"]) for r in rows} == brute(texts) != brute(texts, 3, 90)


def test_pipeline_drops_copies_with_one_word_in_fifty_changed(spark):
    import corpus_pipeline as P

    base = [f"w{i}" for i in range(100)]
    near = base[:30] + ["other"] + base[31:70] + ["another"] + base[71:]
    far = [w if i % 20 else f"far{i}" for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r["doc_id"] for r in P.drop_near_copies(spark, docs, "").collect()} == {1, 3}


def test_pipeline_stages_from_the_near_copies_on(spark, sf_dir):
    import corpus_pipeline as P

    docs = common.read(spark, sf_dir, "documents")
    stage2 = common.stored(P.drop_boilerplate(spark, P.drop_toxic(spark, docs, sf_dir), sf_dir), "t")
    stage3 = common.stored(P.drop_near_copies(spark, stage2, sf_dir), "t")
    found = brute({r["doc_id"]: r["text"] for r in stage2.collect()})
    assert {r["doc_id"] for r in stage3.collect()} == {d for d, (n, c) in found.items() if d == c or n == 0}
    stage4 = common.stored(P.mix_sources(spark, stage3, sf_dir), "t")
    n = stage4.agg(F.sum(mixing.n_words())).first()[0]
    assert abs(n - stage3.agg(F.sum(mixing.n_words())).first()[0]) <= 20 * mixing.BLOCK
    last = P.pack_sequences(spark, stage4, sf_dir)
    assert last.where("piece = 0").count() == stage4.count() and last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()
    assert sorted(map(tuple, last.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, P.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_ids_may_be_null_or_repeated(spark):
    """A null id on a text's first copy loses no link; each class keeps one row, whatever its id."""
    r = random.Random(5)

    def pair(k):
        w = [f"p{k}w{r.randrange(10**6)}" for _ in range(80)]
        return " ".join(w), " ".join([*w[:-1], "end"])

    (a, a2), (b, b2), (c, c2), (d, _), (e, _), (f, f2) = (pair(k) for k in range(6))
    rows = [(None, a), (5, a), (6, a2), (None, b), (None, b2), (7, c), (7, d), (8, c2), (9, None), (7, e), (4, c), (None, f), (3, f2), (7, d)]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, place int").coalesce(1)
    found = [(x["doc_id"], x["n"] > 0, x["component_id"]) for x in ngram_join.classes(docs).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    want = [(None, True, 5), (5, True, 5), (6, True, 5), (None, True, None), (None, True, None), (7, True, 4), (7, True, 7), (8, True, 4), (9, False, 9), (7, True, 7), (4, True, 4), (None, True, 3), (3, True, 3), (7, True, 7)]
    assert sorted(found, key=key) == sorted(want, key=key)
    kept = [(x["doc_id"], x["text"]) for x in ngram_join.keep_one(docs, **RULE).collect()]
    either = (None, b) if (None, b) in kept else (None, b2)
    assert sorted(kept, key=key) == sorted([(5, a), either, (7, d), (9, None), (7, e), (4, c), (3, f2)], key=key)
