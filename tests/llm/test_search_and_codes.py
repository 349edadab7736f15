"""Vector codes, decontamination and ranked search against brute force, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import code_gemm, common, lexical, queries, toxicity, winnowing

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


# ---- op11 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [3, 2**13, 2**26, 2**28, -(2**28)])
@pytest.mark.parametrize("bits", [None, 5, 16])
def test_products_of_limbs_are_exact(top, bits):
    r = np.random.default_rng(abs(top))
    x, c = (r.integers(-abs(top), abs(top) + 1, size=s) for s in ((2, 50, 8), (2, 16, 8)))
    x[0, 0], c[0, 0] = top, -top
    want = [[[sum(int(a) * int(b) for a, b in zip(v, w, strict=True)) for w in c[p]] for v in x[p]] for p in range(2)]
    assert code_gemm.dots(x, c, bits).tolist() == want
    for k in (1, 2, 8, 100, 4096):
        b = code_gemm.limb_bits(k)
        assert k * (2**b - 1) ** 2 < 2**53


def test_limbs_put_together_are_the_number():
    x = np.array([0, 1, -1, 2**40, -(2**40), 2**61, -(2**61) + 7], dtype=np.int64)
    for bits in (7, 24):
        assert [sum(int(v[i]) << bits * k for k, v in enumerate(code_gemm.limbs(x, bits))) for i in range(len(x))] == x.tolist()
        assert all(np.abs(v).max() < 2**bits for v in code_gemm.limbs(x, bits))


def brute_codes(rows, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    k = len(kept[0][1]) // 8
    cut = [[v[p * k : p * k + k] for p in range(8)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(x[p], books[p][e]), e)) for p in range(8)] for x in cut]
    for _ in range(6):
        at = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [x[p] for x, a in zip(cut, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    errors = [sum(far(x[p], books[p][a[p]]) for p in range(8)) for x, a in zip(cut, at, strict=True)]
    by_label = collections.Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{x:02x}" for x in a), e, by_label[label], digest) for (i, _, label), a, e in zip(kept, at, errors, strict=True))


def codes(spark, tmp, rows, schema="vec_id long, embedding array<double>, label int, code string, n long"):
    spark.createDataFrame([(*r, "x", 1) for r in rows], schema).write.mode("overwrite").parquet(f"{tmp}/embeddings.parquet")
    return [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in queries.QUERIES["op11_code_gemm"](spark, str(tmp)).collect()]


def test_codes_are_the_brute_force_ones(spark, tmp_path):
    r = random.Random(4)
    spread = [(i, [r.gauss(0, 0.4) for _ in range(16)], r.choice([None, 1, 2])) for i in r.sample(range(1000), 70)]
    ties = [(i, [r.choice([-0.5, 0.0, 0.5]) for _ in range(8)], 3) for i in range(60)]  # many equal parts and distances
    few = [(i, [r.gauss(0, 1) for _ in range(8)], None) for i in range(5)]
    big = [(i, [r.gauss(0, 20_000) for _ in range(8)], 1) for i in range(40)]  # components of 27 bits: two limbs
    bad = [(2000, None, 1), (2001, [float("nan")] * 16, 1), (2002, [None] * 16, 1), (2003, [float("inf")] + [0.0] * 15, None)]
    for k, rows in enumerate((spread + bad, ties, few, big)):
        assert sorted(codes(spark, tmp_path / str(k), rows)) == brute_codes(rows)


def test_codes_of_awkward_tables(spark, tmp_path):
    assert codes(spark, tmp_path / "empty", []) == []
    assert codes(spark, tmp_path / "none", [(1, None, 1)]) == []
    rows = [(1, [0.5] * 8, None), (1, [0.5] * 8, None), (None, [0.25] * 8, 2), (3, [1.0] * 9, 2), (4, [], 2)]
    got = codes(spark, tmp_path / "odd", rows)
    assert sorted(((r[0] is None, r[0]), r[1] is None, r[2], r[3]) for r in got if r[0] is not None) == [((False, 1), False, 0, 0), ((False, 1), False, 0, 0), ((False, 3), True, None, 0), ((False, 4), True, None, 0)]
    assert len(got) == 5  # of another length: no code, but the row
    with pytest.raises(Exception, match="8 equal parts"):
        codes(spark, tmp_path / "nine", [(1, [1.0] * 9, 2)])
    with pytest.raises(Exception, match="too large"):
        codes(spark, tmp_path / "huge", [(1, [1e12] * 8, 2), (2, [-1e12] * 8, 2)])


def test_label_totals_with_more_labels_than_are_sent(spark, monkeypatch):
    df = common.stored(spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, i) for i in range(200)], "vec_id long, label int, error long"), "t")
    want = {r["vec_id"]: r["total"] for r in code_gemm.with_totals(df, "label", "error", "total").collect()}
    monkeypatch.setattr(code_gemm, "BROADCAST", 0)
    assert {r["vec_id"]: r["total"] for r in code_gemm.with_totals(df, "label", "error", "total").collect()} == want and want[5] == sum(range(0, 200, 5))


# ---- op12 ------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    spans = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            spans[tuple(w[i : i + 10])].add("" if item is None else str(item))
    sizes, out = {len(s) for s in spans}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := spans.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def hit_rows(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "p") for x in docs], "doc_id long, text string, fp int, t string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"]), r["contaminated"]) for r in winnowing.contamination(d, i).collect()), key=repr)


def test_hits_are_the_brute_force_ones(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = ["alpha", "beta", "Gamma", "δelta", "É", "x1", "a"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 4, 9, 10, 11, 30]))) for k in range(25)] + [(3, text(12)), (None, text(20)), (99, None), (100, "a a a a a a a a a a a a a a")]
    docs = [(k, text(r.choice([0, 3, 12, 60]))) for k in range(40)]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        docs.append((100 + k, f"{text(20)} {' '.join(w[: r.randrange(1, len(w) + 1)] if w else [])} {text(20)}".upper()))
    docs += [(7, docs[5][1]), (None, docs[50][1]), (None, docs[50][1]), (200, None), (201, ""), (202, "a " * 3000), (203, "...")]
    want = brute_hits(docs, items)
    assert hit_rows(spark, docs, items) == want and 0 < sum(x[4] for x in want) < len(want)
    monkeypatch.setattr(winnowing, "BROADCAST", 0)  # nothing is sent to every task
    assert hit_rows(spark, docs, items) == want


def test_no_shared_span_is_missed(spark):
    """Spans of exactly ten words out of long items, each in a text of its own, and of nine, which are none."""
    r = random.Random(1)
    items = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(200))) for k in range(3)]
    docs = []
    for k in range(300):
        w = items[k % 3][1].split()
        at, n = r.randrange(0, 190), 10 if k % 2 else 9
        docs.append((k, " ".join(["pad", *w[at : at + n], "pad"])))
    got = {x[0]: (x[2], x[3]) for x in hit_rows(spark, docs, items)}
    assert got == {k: (10, [str(k % 3)]) if k % 2 else (0, []) for k in range(300)}


def test_decontamination_of_awkward_tables(spark):
    assert hit_rows(spark, [], [(1, "a b")]) == []
    assert hit_rows(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, [], False), (2, 0, 0, [], False)]
    assert hit_rows(spark, [(1, "a B a"), (2, "c")], [(1, "a"), (2, ""), (3, None), (4, "b a")]) == [(1, 3, 3, ["1", "4"], True), (2, 1, 0, [], False)]
    docs = spark.createDataFrame([(1, "a b", 5), (2, "c d", 6), (None, "a", 7), (None, None, 8)], "doc_id long, text string, key int")
    assert sorted(r["key"] for r in winnowing.decontaminated(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect()) == [6, 8]


def test_winnowing_runs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op12_winnowing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- op13 ------------------------------------------------------------------------------------------


def brute_ranks(docs, items, k=50):
    tf = [(d, collections.Counter(words(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(w for _, c in tf for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for d, c in tf:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(item, n + 1, None if x[1] else x[2], -x[0]) for n, x in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=50):
    d = spark.createDataFrame([(*x, 3) for x in docs], "doc_id long, text string, n int")
    got = lexical.top_documents(d, spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("chunk, pairs", [(16_384, 500_000), (40, 500_000), (16_384, 60)])
def test_ranks_are_the_brute_force_ones(spark, monkeypatch, chunk, pairs):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ñandú", "A", "b7"]
    text = lambda n: " ".join(r.choice(vocabulary[: r.choice([5, 20, 64])]) for _ in range(n))
    docs = [(k, text(r.choice([0, 1, 5, 40, 300]))) for k in range(400)] + [(k, "w1 w2 w3") for k in range(1000, 1100)]
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w9"), (None, "w1 w9"), (7000, None), (7001, ""), (7002, "W1-w2.W3\nw4 " * 2000)]
    r.shuffle(docs)
    items = [(k, text(r.choice([1, 3, 12, 30]))) for k in range(12)] + [(3, "w59 zzz"), (None, "w1 w2"), (50, None), (51, ""), (52, "unheard of"), (53, "w1"), (54, "w1 W1 w1")]
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    assert ranked(spark, docs, items) == brute_ranks(docs, items)


def test_ranked_search_of_awkward_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert ranked(spark, [(2, "a"), (1, "a"), (3, "b")], [(9, "a")], 1) == brute_ranks([(2, "a"), (1, "a"), (3, "b")], [(9, "a")], 1)


def test_best_first_search_looks_at_few_documents():
    """The table's answers are the largest impacts, and a score to beat spares most of the work."""
    r = np.random.default_rng(2)
    n, t = 3000, 40
    docs = [np.sort(r.choice(t, size=r.integers(1, 12), replace=False)) for _ in range(n)]
    counts = np.array([len(d) for d in docs])
    terms, tfs = np.concatenate(docs), r.integers(1, 6, size=counts.sum())
    c = lexical.Chunk(np.arange(n), counts * 10, counts, terms, tfs, t, n, int(counts.sum() * 10))
    for _ in range(300):
        first, last = c.start[x := int(r.integers(0, t))], c.start[x + 1]
        a = int(r.integers(first, last))
        b = int(r.integers(a, last)) + 1
        assert c.impact[c.best(np.array([a]), np.array([b]))[0]] == c.impact[a:b].max()
    weights = r.integers(1, 9000, size=8)
    asked = np.sort(r.choice(t, size=8, replace=False))
    every = np.zeros(n, dtype=np.int64)
    for x, w in zip(asked, weights, strict=True):
        a, b = c.start[x], c.start[x + 1]
        every[c.docs[a:b]] += w * c.impact[a:b]
    best = np.sort(every)[::-1]
    for least in (1, int(best[5])):
        got, scores = c.search(asked, weights, 50, least)
        assert all(every[got] == scores) and sorted(scores.tolist(), reverse=True)[:50] == [int(x) for x in best[:50] if x >= least]


# ---- op9 -------------------------------------------------------------------------------------------


def test_lexicon_matches_like_a_naive_one(spark, sf_dir):
    """The automaton's features are those of a search for each term at every place."""
    folder = f"{sf_dir.rpartition('/')[0]}/sf0.01"  # with enough labelled rows to learn from
    docs, labels = common.read(spark, folder, "documents"), common.read(spark, folder, "labels")
    lexicon = toxicity.learn(docs, labels)
    assert lexicon.terms

    def naive(text):
        plain = f"{toxicity._BREAK.sub(' ', toxicity.fold(text))} "
        spared = [(m.start(), m.end()) for e in lexicon.exceptions if e not in lexicon.terms for m in re.finditer(f"(?={re.escape(e)})", plain) for m in [re.compile(re.escape(e)).match(plain, m.start())] if not (m.start() and plain[m.start() - 1].isalpha())]
        total = 0.0
        for at in range(len(plain)):
            if not (at and plain[at - 1].isalpha()):
                best = max((w for t, w in lexicon.terms.items() if plain.startswith(t, at)), default=0.0)
                total += 0.0 if any(a <= at < b for a, b in spared) else best
        return math.log1p(total), math.log1p(100 * total / max(1, plain.count(" ")))

    texts = [r["text"] for r in docs.where(F.length("text") < 3000).select("text").limit(60).collect()]
    term = max(lexicon.terms, key=lexicon.terms.get).strip()
    for text in [*texts, f"{term} x {term}, un{term} {term.upper()}", "Scunthorpe idi0t", ""]:
        assert lexicon.features(text) == pytest.approx(naive(text))
