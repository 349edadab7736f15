"""Cases at the edges of the training-data operators: large families, linked corpora, repeated ids, many matches, odd names."""

from __future__ import annotations

import collections
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import common, line_dedup, mixing, ngram_join, norm_topk, packing, quality, secrets, sharding, sstable, tokens, toxicity


def family(r, n, base, changed, fresh):
    """n sets around one base, each with `changed` of its elements exchanged."""
    core = np.array(sorted(r.getrandbits(63) for _ in range(base)), dtype=np.uint64)
    out = []
    for _ in range(n):
        s = set(core.tolist())
        s -= set(r.sample(sorted(s), changed))
        s |= {r.getrandbits(63) if fresh else int(core[0]) ^ r.randrange(1, 4000) for _ in range(changed)}
        out.append(np.array(sorted(s), dtype=np.uint64))
    return out


def components(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return [top(i) for i in range(n)]


def all_pairs(sets, num, den, apart=None):
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((len(sets), len(names)), dtype=np.float32)
    held[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
    both = held @ held.T
    size = held.sum(1)
    a, b = np.nonzero(den * both >= num * (size[:, None] + size[None, :] - both))
    return [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j and (apart is None or apart[i] != apart[j])]


@pytest.mark.parametrize("num", [80, 90])
@pytest.mark.parametrize("fresh", [True, False])
def test_one_tree_is_all_pairs(num, fresh):
    r = random.Random(num)
    for _ in range(20):
        sets = [s for _ in range(3) for s in family(r, r.randrange(1, 12), r.choice([5, 30, 80]), r.randrange(0, 5), fresh)]
        side = {i: r.randrange(2) for i in range(len(sets))}
        known = {i: r.randrange(len(sets)) for i in range(len(sets))}
        as_dict = dict(enumerate(sets))
        assert components(len(sets), ngram_join.tree_links(as_dict, None, num, 100)) == components(len(sets), all_pairs(sets, num, 100))
        across = all_pairs(sets, num, 100, side)
        assert components(len(sets), ngram_join.tree_links(as_dict, None, num, 100, side)) == components(len(sets), across)
        same = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if known[i] == known[j]]
        assert components(len(sets), same + ngram_join.tree_links(as_dict, known, num, 100)) == components(len(sets), same + all_pairs(sets, num, 100))


def test_blocks_of_a_wide_tree(monkeypatch):
    r = random.Random(1)
    sets = family(r, 60, 40, 2, True) + family(r, 60, 40, 3, False)
    monkeypatch.setattr(ngram_join, "CELLS", 1)
    assert components(120, ngram_join.tree_links(dict(enumerate(sets)))) == components(120, all_pairs(sets, 90, 100))


@pytest.mark.parametrize("changed, linked", [(0.01, True), (0.05, False)])
def test_a_family_of_two_thousand_texts(spark, changed, linked):
    """More sets than a tree holds, all near each other or all just too far, and no longer than a few trees take."""
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for d in range(2000):
        w = list(base)
        for i in r.sample(range(300), int(300 * changed)):
            w[i] = f"x{d}y{i}"
        rows.append((d, " ".join(w)))
    t = time.time()
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r["component_id"] for r in got} == ({0} if linked else set(range(2000)))
    assert time.time() - t < 120


def sizes_of(spark, groups):
    """Sizes by shard of rows of 100 bytes in groups of the given sizes, and in how many shards each group lies."""
    rows = [(g, k) for g, n in enumerate(groups) for k in range(n)]
    nodes = common.with_uid(spark.createDataFrame(rows, "link_id long, k long").withColumn("size", F.lit(100).cast("long")), "t")
    out = sharding.shard(nodes.select("uid", "size"), nodes.select("uid", F.col("link_id").cast("string").alias("link_id")))
    got = out.join(nodes.select("uid", "link_id"), "uid").collect()
    assert len(got) == len(rows) == len({r["uid"] for r in got})
    load, where = collections.Counter({s: 0 for s in range(16)}), collections.defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        where[r["link_id"]].add(r["shard"])
    return load, where


@pytest.mark.parametrize("groups", [[3000], [3] * 1000, [2] * 1500, [1] * 500 + [2] * 300 + [900, 400]], ids=["one", "triples", "pairs", "mixed"])
def test_linked_rows_are_even_too(spark, groups):
    load, where = sizes_of(spark, groups)
    mean = sum(load.values()) / 16
    assert max(load.values()) - min(load.values()) <= max(200, 0.02 * mean)
    small = [g for g, n in enumerate(groups) if n == max(k for k in groups if k < 10) > 1] if min(groups) < 10 else []
    assert sum(len(where[g]) > 1 for g in small) <= 0.1 * len(small)


def test_null_and_repeated_vector_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (None, [2.0, 0.0]), (None, [3.0, 0.0]), (2, [0.5, 1.0])]
    vecs = norm_topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"] if r["vec_id"] is not None else "none", r["score"]) for r in norm_topk.top_k(vecs, F.col("vec_id") % 50 == 0, 5).collect())
    one = [(50, 1, "none", 3 * 65536), (50, 2, 1, 2 * 65536), (50, 3, 1, 2 * 65536), (50, 4, "none", 2 * 65536), (50, 5, 50, 65536)]
    assert got == sorted(one + one, key=str) or collections.Counter(got) == collections.Counter(one + one)


@pytest.mark.parametrize("sigma", [0.0, 2.0])
def test_many_blocks_and_chunks(spark, monkeypatch, sigma):
    monkeypatch.setattr(norm_topk, "BLOCK", 32)
    monkeypatch.setattr(norm_topk, "FOLD", 1)
    r = np.random.default_rng(3)
    v = (r.normal(size=(600, 6)) * r.lognormal(sigma=sigma, size=(600, 1))).round(2)
    v[100:200] = v[100]  # a third of a bucket alike
    ints = np.floor(256 * v).astype(int)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in norm_topk.top_k(norm_topk.vectors(df), F.col("vec_id") % 3 == 0, 4).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((-x["score"], x["vec_id"]))
    score = ints @ ints.T
    assert got == {q: sorted((-int(score[q, i]), i) for i in range(600) if i != q)[:4] for q in range(0, 600, 3)}


def fewest(sizes, cap):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bin_completion_beats_best_fit():
    beaten = 0
    for seed in range(300):
        r = random.Random(seed)
        sizes = sorted((r.randrange(12, 50) for _ in range(11)), reverse=True)
        s = packing.search(collections.Counter(sizes), 100)
        assert s.bins == fewest(sizes, 100) == sum(n for _, n in s.plan) and s.bound <= s.bins <= s.best_fit and s.descents >= 1
        beaten += s.bins < s.best_fit
    assert beaten >= 10


def test_plans_come_from_completions(spark, sf_dir):
    """On the given lengths too the plan is a descent's, and reaches the lower bound."""
    lengths = packing.packed_documents(common.read(spark, sf_dir, "documents")).groupBy("length").count().collect()
    s = packing.search({r["length"]: r["count"] for r in lengths})
    assert s.descents >= 1 and s.fillings >= len(s.plan) and s.bins == s.bound


def test_fillings_are_the_undominated_ones():
    r = random.Random(2)
    for _ in range(50):
        counts = collections.Counter(r.randrange(3, 15) for _ in range(8))
        first, size = 16, 40
        got = list(packing.completions(first, counts, sorted(counts, reverse=True), size, 5))
        every = set()
        items = sorted(counts.elements(), reverse=True)
        for k in range(len(items) + 1):
            every |= {c for c in itertools.combinations(items, k) if size - first - 5 <= sum(c) <= size - first}
        some = lambda c: [s for k in range(len(c) + 1) for s in itertools.combinations(c, k)]
        better = lambda c: any(counts[y] > c.count(y) and sum(s) <= y <= sum(s) + size - first - sum(c) and (y > sum(s) or len(s) > 1) for s in some(c) for y in counts)
        assert sorted(got) == sorted(c for c in every if not better(c)) and [sum(c) for c in got] == sorted((sum(c) for c in got), reverse=True)


def test_a_pair_gives_way_to_one_length():
    assert list(packing.completions(10, {5: 1, 3: 1, 2: 1}, [5, 3, 2], 15, 5)) == [(5,)]


def test_many_matches_in_one_text(spark):
    took = {}
    for n in (2000, 16_000, 32_000):
        text = " ".join(f"{i:032x}" for i in range(n)) + " https://h.example/x " + "Qq" * 20
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        row = secrets.scan(df).first()
        took[n] = time.time() - t
        assert [(s["start"], s["end"]) for s in row["base"]] == [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{32}", text)]
        assert [secrets.KINDS[s["ord"]] for s in row["added"]] == ["endpoint", "opaque"]
    assert took[32_000] < 2 * took[16_000] + 1


def test_opaque_strings_that_overlap(spark):
    r = random.Random(5)
    long = "Zz" * 22
    texts = [" ".join(r.choice([long, f"https://h.example/{long}", f"token={long}", long + "0123456789abcdef" * 2, "pad", "0a" * 20]) for _ in range(8)) for _ in range(60)]
    for row in secrets.parts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        t = texts[row["doc_id"]]
        other = [(s["start"], s["end"]) for s in row["base"]] + [(m.start(), m.end()) for m in re.finditer(secrets.ENDPOINT, t)]
        want = [(m.start(), m.end()) for m in re.finditer(secrets.OPAQUE, t) if not any(a < m.end() and m.start() < b for a, b in other)]
        assert [(s["start"], s["end"]) for s in row["weak"] if secrets.KINDS[s["ord"]] == "opaque"] == want


ODD = ["__uid", "__id", "__score", "score", "a.b", "row", "uid", "key", "keys", "text_", "w", "l", "t", "gone", "size", "place", "hash", "empty", "copy", "first", "n_words", "class", "x`y"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns that carry the operators' own names."""
    r = random.Random(9)
    rows = []
    for d in range(60):
        text = "one line that many sites have in common\n" + " ".join(f"w{r.randrange(50)}" for _ in range(30))
        rows.append((d, None if d == 3 else text, "en", f"s{d % 7}", 10, *[f"{c}{d}" for c in ODD]))
    rows += [rows[5], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD)
    return common.stored(spark.createDataFrame(rows, schema), "odd")


def test_columns_pass_through_whatever_their_names(odd):
    stages = {
        "toxicity": lambda d: toxicity.reject_toxic(d, toxicity.Lexicon({"idiot": 5.0})),
        "lines": line_dedup.deduped_documents,
        "cleaned": line_dedup.cleaned,
        "near copies": lambda d: ngram_join.keep_one(d, 5, 80, 100),
        "mixing": mixing.mixed_documents,
        "quality": lambda d: quality.measures(d).select("row.*"),
    }
    for name, stage in stages.items():
        out = stage(odd)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in ODD), name


def test_repeated_rows_in_the_stages(odd):
    lines = line_dedup.deduped_documents(odd).collect()
    assert collections.Counter(r["doc_id"] for r in lines)[5] == 2 and sum(r["doc_id"] == 3 for r in lines) == 2
    assert [r["doc_id"] for r in lines if (r["text"] or "").startswith("one line")] == [0] and len({r["text"] for r in lines if r["doc_id"] == 5}) == 1
    kept = ngram_join.keep_one(odd, 5, 80, 100).collect()
    assert collections.Counter(r["doc_id"] for r in kept)[5] == 1 and sum(r["text"] is None for r in kept) == 2
    assert len(toxicity.reject_toxic(odd, toxicity.Lexicon({"idiot": 5.0})).collect()) == 62


def test_lines_repeated_in_one_text(spark):
    rows = [(d, "a line that is on many sites\nother\na line that is on many sites\n", f"s{d}") for d in range(6)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup._cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.doc_id", "text", "n_lines", "n_removed").collect()}
    assert got[0] == ("a line that is on many sites\nother\n", 4, 1) and all(got[d] == ("other\n", 4, 2) for d in range(1, 6))


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1000]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_vocabulary_gives_the_texts_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path(name)), tokens.Encoder(public_tokenizers.path(name))
    for text in ("", "Two  words,\nand\tmore ", "naïve ﬁ 日本 don't", "x" * 300):
        assert list(np.frombuffer(e.ids(text, None), dtype="<u4")) == t.encode(text, add_special_tokens=False).ids
    assert e.by_word == name.startswith("word")


def test_many_sources_share_by_weight(spark):
    r = random.Random(3)
    sizes = {f"s{i:04d}": r.choice([0, 1, 5, 50, 1000, 20_000]) for i in range(400)} | {None: 77}
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        rest, weights = total - sum(capped.values()), sum(w for s, w in weight.items() if s not in capped)
        over = {s: 3 * sizes[s] for s in sizes if s not in capped and rest * weight[s] / weights > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = capped | {s: rest * weight[s] / weights for s in sizes if s not in capped}
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_many_texts_under_one_id(spark, tmp_path):
    rows = [(7, f"text number {i} of one id") for i in range(400)] + [(i, f"another {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/sst"
    files = sstable.write(docs, folder, parts=4)
    assert files.where("low <= 7 and high >= 7").count() > 1
    assert sstable.lookup(spark, folder, files, spark.createDataFrame([(7,)], "doc_id long")).count() == 401
    back = sstable.read_back(folder, files).select("doc_id").collect()
    assert collections.Counter(r["doc_id"] for r in back) == collections.Counter(d for d, _ in rows)
