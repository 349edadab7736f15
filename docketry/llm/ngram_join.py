"""N-gram Jaccard self-join over prefix trees, and its connected components."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, components, read, released, stored, with_uid

N, NUM, DEN = 3, 90, 100  # words of a shingle; linked when DEN * both >= NUM * union
CHUNK = 1024  # sets of one tree
ELEMENTS = 1 << 20  # and elements, about
CELLS = 1 << 25  # bytes of the table of which set holds which element
BROADCAST = 1_000_000  # rows of a few numbers at most that are sent to every task
COPIES = 4_000_000  # and single ids at most (about 160 MB as a hash table)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Words()


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The text's distinct n-word shingles as ascending 64-bit hashes; with fewer words the whole sequence
    is one shingle; without words, none. Only A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    last = len(words) - k + 1
    acc = np.full(last, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        acc = acc * _A + h[i : i + last]  # the words' hashes are random, so are these sums
    acc = _mix(acc)
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = int(np.sum(_mix(s + _A), dtype=np.uint64)), int(np.bitwise_xor.reduce(_mix(s * _B + _C))) if len(s) else 0
    return a - (1 << 63), b - (1 << 63)


class Parts:
    """Signatures by which similar sets are sure to meet.

    Sizes fall into classes such that linked sets are in one class or in neighbouring ones. For each class
    pair, linked sets differ by at most `most` elements; the hash range is cut into k = most + 1 + SPARE * most
    parts, so at least k - most parts agree, element for element. A set names each part by the hash of what
    it holds there and signs the first most + 1 of them, larger parts first: two sets that agree on k - most of k
    parts agree on one of those, whatever the order, as long as both use the same. What is left out are
    the empty and the smallest parts, in which unlike sets may agree by chance or by one shared passage.
    """

    SPARE = 0.2

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den, self.low, self.bounds = num, den, [1], {}

    def klass(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return bisect_right(self.low, n) - 1

    def most(self, level: int) -> int:
        self.klass(self.low[min(level + 1, len(self.low) - 1)])
        high = self.low[level + 1] - 1  # |x| <= high and |y| <= |x| * den / num differ in at most |x| * (den - num) / num
        return high * (self.den - self.num) // self.num

    def cuts(self, level: int) -> tuple[int, np.ndarray, np.ndarray]:
        """most, the first hash of each part, the parts' own names."""
        if level not in self.bounds:
            most = self.most(level)
            k = most + 1 + math.ceil(most * self.SPARE)
            names = np.arange(k, dtype=np.uint64) * _B + np.full(k, level, dtype=np.uint64) * _C + _A
            self.bounds[level] = most, np.array([(i << 64) // k for i in range(k)], dtype=np.uint64), names
        return self.bounds[level]

    def sign(self, s: np.ndarray) -> np.ndarray:
        c, out = self.klass(len(s)), []
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(s + _C), dtype=np.uint64)])
        for level in range(max(0, c - 1), c + 1):
            most, cuts, names = self.cuts(level)
            at = np.append(np.searchsorted(s, cuts), len(s))
            held, size = sums[at[1:]] - sums[at[:-1]], (at[1:] - at[:-1]).astype(np.uint64)
            sig = _mix(_mix(held * _A + size) ^ names)
            if len(sig) > most + 1:  # by size, then by name
                rank = (np.minimum(size, np.uint64(255)) << np.uint64(56)) | (sig >> np.uint64(8))
                sig = sig[np.argpartition(rank, len(sig) - most - 1)[len(sig) - most - 1 :]]
            out.append(sig)
        return np.concatenate(out).view(np.int64)


def same(a: int, b: int, both: int, num: int = NUM, den: int = DEN) -> bool:
    return den * both >= num * (a + b - both)


def tree_links(sets: dict[int, np.ndarray], known: dict[int, int] | None = None, num: int = NUM, den: int = DEN, side: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links among a few sets of ascending elements that connect every two linked ones: from the smallest of
    each group to its others. Sets of one class in `known` count as connected and are not compared, nor are sets of
    one `side`.

    The sets' elements, ordered from the rarest of the tree to the most frequent, form a trie whose edges
    hold runs of elements. One walk serves all sets: at each node it holds the sets that may still match
    something below and how much of the path each of them has, so an overlap is counted once for a whole
    subtree. A set leaves the walk when its size cannot match, or when its overlap so far plus all that can
    still come, the fewer of what remains of either set, stays under what the subtree's smallest set
    needs; a subtree without sets is not entered. Runs are read in pieces, the first just long enough to use up the
    misses allowed, and rare elements stand first, so sets that are not linked leave early. An element that only
    one set has is a miss from the start. Each pair is looked at once, from the later row.
    """
    trie = _Trie(sets, num, den)
    if trie.n < 2:
        return []
    cluster, new = np.arange(trie.n), False
    if known:
        cluster = np.unique([known[i] for i in trie.ids], return_inverse=True)[1]
    sides = None if side is None else np.array([side[i] for i in trie.ids])
    for x, y in trie.matches(cluster, sides):
        old = np.unique(cluster[x])
        if (old != cluster[y]).any():
            cluster[np.isin(cluster, old)] = cluster[y]
            new = True
    if not new:
        return []
    least_of: dict[int, int] = {}
    for k, i in zip(cluster.tolist(), trie.ids, strict=True):
        least_of[k] = min(i, least_of.get(k, i))
    return [(least_of[k], i) for k, i in zip(cluster.tolist(), trie.ids, strict=True) if least_of[k] != i]


class _Trie:
    """Rows of element ranks, sorted; sets that lack too much to match any other are left out."""

    def __init__(self, sets: dict[int, np.ndarray], num: int, den: int):
        self.num, self.den, self.n = num, den, 0
        ids = [i for i in sets if len(sets[i])]
        while len(ids) > 1:  # without the hopeless sets more elements stand alone
            size = np.array([len(sets[i]) for i in ids])
            names, place, df = np.unique(np.concatenate([sets[i] for i in ids]), return_inverse=True, return_counts=True)
            left = np.bincount(np.repeat(np.arange(len(ids)), size)[df[place] > 1], minlength=len(ids))
            may = den * left >= num * size
            if may.all():
                break
            ids = [i for i, ok in zip(ids, may.tolist(), strict=True) if ok]
        else:
            return
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.lexsort((names, df))] = np.arange(len(names)) - (df == 1).sum()  # negative: held by one set alone
        held = rank[place]
        owner = np.repeat(np.arange(len(ids)), size)[held >= 0]
        held = held[held >= 0]
        at = np.lexsort((held, owner))
        rows = np.split(held[at], np.cumsum(left)[:-1])
        order = sorted(range(len(ids)), key=lambda k: (rows[k].astype(">u4").tobytes(), ids[k]))
        self.ids, self.n, self.width = [ids[k] for k in order], len(ids), len(names) - int((df == 1).sum())
        self.rows, self.size, self.left = [rows[k] for k in order], size[order], left[order]
        self.off = np.concatenate([[0], np.cumsum(self.left)])
        self.keys = np.concatenate(self.rows) + np.repeat(np.arange(self.n) * self.width, self.left)
        self.common = np.array([_prefix(a, b) for a, b in zip(self.rows, self.rows[1:], strict=False)])

    def need(self, n: np.ndarray, least: int) -> np.ndarray:
        return -(-self.num * (n + least) // (self.num + self.den))

    def matches(self, cluster: np.ndarray, sides: np.ndarray | None) -> Iterator[tuple[np.ndarray, int]]:
        """(x, y): rows x linked to row y, in blocks of rows small enough for a table of CELLS bytes. Reads
        `cluster` anew at each leaf."""
        block = max(16, CELLS // max(1, self.width))
        for lo in range(0, self.n, block):
            hi = min(self.n, lo + block)
            holds = np.zeros((self.width, hi - lo), dtype=np.uint8)
            k = self.keys[self.off[lo] : self.off[hi]]
            holds[k % self.width, k // self.width - lo] = 1
            yield from self._walk(lo, hi, holds, cluster, sides)

    def _walk(self, first: int, last: int, holds: np.ndarray, cluster: np.ndarray, sides: np.ndarray | None) -> Iterator[tuple[np.ndarray, int]]:
        size, num, den = self.size, self.num, self.den
        x = np.arange(first, last)
        stack = [(0, last, 0, x, np.zeros(len(x), dtype=np.int64))]
        while stack:
            # rows lo..hi-1 agree on their first `depth` elements, of which each x holds `both`
            lo, hi, depth, x, both = stack.pop()
            leaf = hi - lo == 1
            least, most, rest = int(size[lo:hi].min()), int(size[lo:hi].max()), int(self.left[lo:hi].max())
            ok = (x > lo) & (den * np.minimum(size[x], most) >= num * np.maximum(size[x], least))
            if leaf:
                ok &= cluster[x] != cluster[lo]
                if sides is not None:
                    ok &= sides[x] != sides[lo]
            x, both = x[ok], both[ok]
            run = self.rows[lo]
            end = len(run) if leaf else int(self.common[lo : hi - 1].min())
            step = 8 + max(0, most - num * most // den)
            while len(x) and depth < end:
                upto = min(end, depth + step)
                both = both + holds[run[depth:upto]][:, x - first].sum(axis=0, dtype=np.int64)
                depth, step = upto, 2 * step
                seen = np.searchsorted(self.keys, x * self.width + run[depth - 1], side="right") - self.off[x]
                ok = both + np.minimum(self.left[x] - seen, rest - depth) >= self.need(size[x], least)
                x, both = x[ok], both[ok]
            if not len(x):
                continue
            if leaf:
                hit = den * both >= num * (size[x] + size[lo] - both)
                if hit.any():
                    yield x[hit], lo
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.common[lo : hi - 1] == end)).tolist(), hi]
            stack += [(a, b, end, x, both) for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True)]


def _prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


# ---- Spark ------------------------------------------------------------------------------------------


def _signed(batches: Iterator[pd.DataFrame], words: int = N, num: int = NUM, den: int = DEN) -> Iterator[pd.DataFrame]:
    parts = Parts(num, den)
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part, rows = batch.iloc[lo : lo + 500], []
            for doc, digest, text in zip(part["doc_id"], part["digest"], part["text"], strict=True):
                s = shingles(text, words)
                rows.append((doc, digest, len(s), *identity(s), parts.sign(s) if len(s) else np.empty(0, dtype=np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "n", "k1", "k2", "sigs"]).astype({"doc_id": "Int64"})
    _WORDS.clear()  # a worker goes on to other stages


def _sets(batches: Iterator[pd.DataFrame], words: int = N) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part, rows = batch.iloc[lo : lo + 500], []
            for doc, text in zip(part["doc_id"], part["text"], strict=True):
                s = shingles(text, words)
                rows.append((doc, len(s), *identity(s), s.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "k1", "k2", "elements"]).astype({"doc_id": "Int64"})
    _WORDS.clear()


def _trees(batches: Iterator[pd.DataFrame], num: int = NUM, den: int = DEN) -> Iterator[pd.DataFrame]:
    """Rows sorted by tree: the links of one tree at a time, also across batches."""
    tree, held, known, side = None, {}, {}, {}

    def links() -> list[tuple[int, int]]:
        return tree_links(held, known, num, den, side if any(s is not None for s in side.values()) else None)

    for batch in batches:
        out = []
        for key, rep, c, s, elements in zip(batch["tree"], batch["rep"], batch["c"], batch["side"], batch["elements"], strict=True):
            if key != tree:
                out += links()
                tree, held, known, side = key, {}, {}, {}
            held[rep], known[rep], side[rep] = np.frombuffer(elements, dtype=np.uint64), c, None if pd.isna(s) else int(s)
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    yield pd.DataFrame(links(), columns=["a", "b"], dtype="int64")


def _small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A stored table of a few numbers a row, sent to every task while it has at most `most` rows; beyond, it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def _join_trees(members: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """members (tree, rep, c: what rep is connected to already, side): links found in each tree."""
    rows = sets.join(_small(stored(members, "ngram-members")), "rep").select("tree", "rep", "c", "side", "elements")
    return rows.repartition("tree").sortWithinPartitions("tree").mapInPandas(partial(_trees, num=num, den=den), "a long, b long")


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def classes(docs: DataFrame, words: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n (set size), component_id for each row of docs (doc_id, text)."""
    return _classed(docs, words, num, den).select("doc_id", "n", "component_id")


def _classed(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """uid, doc_id, digest (of the text), n (set size), class, component_id for each row of docs (doc_id, text),
    by shingles of `words` words that are linked when den * both >= num * union.

    1. Every text is shingled once; equal sets (all exact copies among them) become one representative.
    2. Representatives that share a signature of `Parts` meet: the first of each signature leads, and every
       other goes to one of its leader's trees of about CHUNK sets and ELEMENTS elements, so no signature is listed
       pair by pair and no tree outgrows a task. Every tree holds its leader. Elements are rebuilt from the texts only for these.
    3. `tree_links` joins each tree. Where a leader has several trees that are not all connected yet, each two of
       them are joined once, the sets of one with those of the other, so every pair that shares a signature has met.
    4. Components of all links; the smallest doc_id of a component names it (null
       where all are null), and `class` tells components apart also then.

    Null, empty or wordless texts have n = 0 and are linked with nothing; repeated rows are rows of one
    class; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = with_uid(rows.withColumn("digest", _digest()).mapInPandas(partial(_signed, words=words, num=num, den=den), "doc_id long, digest binary, n long, k1 long, k2 long, sigs array<long>"), "ngram-signed")
    reps = stored(signed.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min("uid").alias("rep")), "ngram-reps")
    # copies of a set do not sign: they are few, so the signatures stay where they are instead of moving to meet the representatives
    copies = stored(signed.where("n > 0").select("uid").join(reps.select(F.col("rep").alias("uid")), "uid", "left_anti"), "ngram-copies")
    entries = signed.where("n > 0").select("uid", "sigs").join(_small(copies, COPIES), "uid", "left_anti").select(F.col("uid").alias("rep"), F.explode("sigs").alias("sig"))
    ends = entries.groupBy("sig").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("last > leader").drop("last")  # summed where the entries are, so a hot signature is one row a task
    meets = stored(entries.join(_small(stored(ends, "ngram-shared")), "sig"), "ngram-meets")
    near = meets.select("rep").distinct()
    wanted = stored(reps.join(near, "rep").select("doc_id", "n", "k1", "k2", "rep"), "ngram-wanted")
    ids = wanted.select("doc_id").distinct()
    ids, known = (F.broadcast(ids), F.broadcast(wanted)) if wanted.count() <= BROADCAST else (ids, wanted)
    built = rows.join(ids, rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").mapInPandas(partial(_sets, words=words), "doc_id long, n long, k1 long, k2 long, elements binary")
    sets = built.join(known, [built["doc_id"].eqNullSafe(wanted["doc_id"]), built["n"] == wanted["n"], built["k1"] == wanted["k1"], built["k2"] == wanted["k2"]]).select("rep", "elements")
    sets = stored(sets, "ngram-sets")  # a row repeated in the input repeats its set, which a tree holds once

    star = stored(meets.where("rep <> leader").select("leader", "rep").distinct().join(wanted.select("rep", "n"), "rep"), "ngram-stars")
    count = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / ELEMENTS)).cast("int")
    leads = stored(star.groupBy("leader").agg(count.alias("trees")), "ngram-leads")
    led = star.join(_small(leads), "leader").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("trees")).cast("int"))
    own = leads.select("leader", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("chunk"))
    tree, none = F.xxhash64("leader", "chunk").alias("tree"), F.lit(None).cast("int").alias("side")
    members = led.select(tree, "rep", F.col("rep").alias("c"), none).union(own.select(tree, F.col("leader").alias("rep"), F.col("leader").alias("c"), none))
    links = stored(_join_trees(members, sets, num, den), "ngram-links")
    label = components(spark, links, "ngram-part")
    if not leads.where("trees > 1").isEmpty():
        spread = led.where("trees > 1").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
        apart = spread.groupBy("leader").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("leader")
        facing = spread.join(_small(stored(apart, "ngram-apart")), "leader").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).where("other <> chunk")
        cell = F.xxhash64("leader", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tree")
        more = stored(_join_trees(facing.select(cell, "rep", "c", F.col("chunk").alias("side")), sets, num, den), "ngram-links")
        if not more.isEmpty():
            label = components(spark, links.union(more), "ngram-all")

    classed = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    least = classed.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = classed.join(least, "c").select(F.col("n").alias("__n"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("c").alias("class"), "component_id")
    out = signed.select("uid", "doc_id", "digest", "n", "k1", "k2").join(named, (F.col("n") == F.col("__n")) & (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left")
    return out.select("uid", "doc_id", "digest", "n", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One document of each class of linked texts, all columns: the one with the smallest doc_id, one without
    doc_id only where all are. Where an id stands over several texts, each text is of its own class; of rows repeated
    under one id and text one stays. Texts without words, null ones too, stay as they are, however often. Columns may have any names."""
    rows = carried(docs, F.col("doc_id").cast("long").alias("id"), _digest().alias("hash"))
    classed = stored(_classed(docs, words, num, den).where("n > 0").select("uid", "doc_id", "digest", "class"), "ngram-classed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    firsts = classed.groupBy("class").agg(F.min_by(F.struct("doc_id", "digest"), order).alias("first"))
    other = ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest")))
    texts = classed.groupBy("class", "doc_id", "digest").agg(F.count("*").alias("times")).join(firsts, "class")  # texts under their ids
    told = stored(texts.select("doc_id", "digest", other.alias("goes"), "times").where("goes or times > 1"), "ngram-told")

    def named(df: DataFrame, names: DataFrame, how: str) -> DataFrame:
        return df.join(_small(names), df["id"].eqNullSafe(names["doc_id"]) & (df["hash"] == names["digest"]), how)

    # what goes is less than what stays, so the texts stay where they are
    kept = named(rows, told.select("doc_id", "digest"), "left_anti")
    repeated = told.where("not goes").select("doc_id", "digest")
    if not repeated.isEmpty():
        kept = kept.union(named(rows, repeated, "left_semi").dropDuplicates(["id", "hash"]))
    return released(kept, docs)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of all documents."""
    return classes(read(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
