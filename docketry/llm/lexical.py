"""Ranked lexical search over posting lists with range-maximum sparse tables.

Documents are searched in chunks. A chunk has a posting list for each term of a question, and over each list a sparse table
that tells the largest impact between any two of its places. An interval of documents can hold no better score than the sum, over the
terms, of the largest impact inside it. Intervals are taken best first and split at the document of their largest impact, which is
scored; one whose bound is below the k-th best score so far is never looked into.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_bucket, read, stored

TOP = 50
PAIRS = 500_000  # (item, term) pairs of the questions that are searched in one pass
CHUNK = 16_384  # documents of a chunk
POSTINGS = 2_000_000  # postings from which on a chunk ends before that
FIRST = 32  # every so many documents are searched first, for a score to beat
BATCH = 64  # intervals split at once, doubling up to 16 times as many

#: A byte of a term stands for itself, A-Z for a-z, all else for a blank.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII digits and letters, lower-cased, and characters from U+0080 on, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split() if text else []


def questions(items: DataFrame) -> DataFrame:
    """item_id, term (binary): the distinct terms of each item; rows under one id are one item, rows without id one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs: for each document the numbers of the vocabulary's terms in it and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):  # one text at a time is decoded
                words = terms_of(text.as_py())
                n.append(len(words))
                for word, tf in Counter(words).items():
                    if (t := vocabulary.get(word)) is not None:
                        terms.append(t)
                        tfs.append(tf)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Chunk:
    """Posting lists of some documents and the sparse tables over them. Documents are placed by length, which
    keeps impacts inside an interval alike."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int, n_docs: int, n_words: int):
        order = np.argsort(lengths, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.size = ids[order], len(ids)
        m = np.array([50 + 50 * int(n) * n_docs // max(1, n_words) for n in lengths], dtype=np.int64)  # as Python's integers, so nothing wraps
        doc = np.repeat(np.arange(len(ids)), counts)
        impact, doc = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]), place[doc]
        by = np.lexsort((doc, terms))
        self.docs, self.impact = doc[by].astype(np.int32), impact[by].astype(np.int64)
        self.start = np.searchsorted(terms[by], np.arange(n_terms + 1))
        longest = int(np.diff(self.start).max(initial=1))
        table = [np.arange(len(by), dtype=np.int32)]  # level l, place i: where the largest impact of [i, i + 2**l) is
        for level in range(1, max(1, longest).bit_length()):
            half, below = 1 << (level - 1), table[-1]
            a, b = below[: len(below) - half], below[half:]
            table.append(np.concatenate([np.where(self.impact[a] >= self.impact[b], a, b), below[len(below) - half :]]))
        self.table = np.stack(table) if len(by) else np.zeros((1, 1), dtype=np.int32)

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the largest impact of [a, b) is; any place where the range is empty."""
        level = np.frexp(np.maximum(b - a, 1).astype(np.float64))[1] - 1
        last = self.table.shape[1] - 1
        x, y = self.table[level, np.minimum(a, last)], self.table[level, np.clip(b - (1 << level), 0, last)]
        return np.where(self.impact[x] >= self.impact[y], x, y)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) that are among the k best of the chunk and reach `least` (at least 1), with their scores; ties at the edge stay."""
        has = (self.start[terms + 1] > self.start[terms]) & (weights > 0)
        terms, weights = terms[has], weights[has]
        none = np.empty(0, dtype=np.int64)
        if not len(terms):
            return none, none
        begin, end = self.start[terms], self.start[terms + 1]
        rank = np.zeros((len(terms), self.size + 1), dtype=np.int32)  # of a document in each list
        for row, a, b in zip(rank, begin, end, strict=True):
            row[self.docs[a:b] + 1] = 1
        np.cumsum(rank, axis=1, out=rank)
        rank += begin[:, None].astype(np.int32)

        def bounded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
            """Intervals [lo, hi) that may hold a score that counts: lo, hi, bound, the document to split at."""
            live = hi > lo
            lo, hi = lo[live], hi[live]
            a, b = rank[:, lo], rank[:, hi]
            at = self.best(a, b)
            most = np.where(b > a, self.impact[at] * weights[:, None], 0)
            bound, lead = most.sum(axis=0), most.argmax(axis=0)
            live = bound >= least
            return lo[live], hi[live], bound[live], self.docs[at[lead, np.arange(len(lo))]][live].astype(np.int64)

        if not len(self.impact):
            return none, none
        lo, hi, bound, split = bounded(np.array([0]), np.array([self.size]))
        docs, scores, batch = none, none, BATCH
        while len(lo):
            if len(lo) > batch:
                part = np.argpartition(-bound, batch)
                now, rest = part[:batch], part[batch:]
            else:
                now, rest = np.arange(len(lo)), none
            d = split[now]
            a = rank[:, d]
            held = rank[:, d + 1] > a
            score = np.where(held, self.impact[np.minimum(a, len(self.impact) - 1)] * weights[:, None], 0).sum(axis=0)
            docs, scores = np.concatenate([docs, d]), np.concatenate([scores, score])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                docs, scores = docs[keep], scores[keep]
            made = bounded(np.concatenate([lo[now], d + 1]), np.concatenate([d, hi[now]]))
            rest = rest[bound[rest] >= least]
            lo, hi, bound, split = (np.concatenate([x[rest], y]) for x, y in zip((lo, hi, bound, split), made, strict=True))
            batch = min(2 * batch, 16 * BATCH)
        keep = scores >= least
        return docs[keep], scores[keep]


def _searched(rows: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray, n_terms: int, n_docs: int, n_words: int) -> DataFrame:
    """ask (number of the question), doc_id, score: the k best of every chunk for each question that reach its `least`."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, lists = t["doc_id"].to_pylist(), t["terms"].chunk(0)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [t[c].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs")]
        known = np.array([i is not None for i in ids])
        number = np.array([i or 0 for i in ids], dtype=np.int64)
        chunk = Chunk(np.arange(len(ids)), t["n"].to_numpy(), counts, *flat, n_terms, n_docs, n_words)
        out = [np.empty((3, 0), dtype=np.int64)]
        for i, (terms, weights) in enumerate(asked):
            docs, scores = chunk.search(terms, weights, k, max(1, int(least[i])))
            docs = chunk.ids[docs]
            top = np.lexsort((number[docs], ~known[docs], -scores))[:k]
            out.append(np.stack([np.full(len(top), i), docs[top], scores[top]]))
        ask, docs, scores = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ask, pa.int32()), pa.array(number[docs], pa.int64(), mask=~known[docs]), pa.array(scores, pa.int64())], names=["ask", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                docs, size = docs + part.num_rows, size + len(part.column("terms").flatten())
                if docs >= CHUNK or size >= POSTINGS:
                    yield found(held)
                    held, docs, size = [], 0, 0
        if held:
            yield found(held)

    return rows.mapInArrow(run, "ask int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank (from 1), doc_id, score.

    One pass tokenises the whole texts and stores the postings of the questions' terms; document frequencies and lengths are
    sums over them. A FIRST-th part of the documents is searched first: its k-th best score is one that k documents reach, so the search over
    all of them passes over what is below. Each chunk gives its k best, and these are merged. Questions of more than PAIRS terms in all go in several passes.
    Only the questions and their terms' frequencies reach the driver. Null and empty texts have no terms; ties go to the smaller doc_id, null ids last; repeated
    rows rank each; an item without terms, and every item where no document has a term, gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    pairs = stored(questions(items), "lexical-questions")
    blocks = max(1, -(-pairs.count() // PAIRS))
    out = []
    for block in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(hash_bucket(blocks, "item_id") == block)
        by: dict[int | None, list[bytes]] = {}
        for r in mine.collect():  # about PAIRS rows
            by.setdefault(r["item_id"], []).append(bytes(r["term"]))
        ids = sorted(by, key=lambda i: (i is None, i or 0))
        vocabulary = {t: i for i, t in enumerate(sorted({t for ts in by.values() for t in ts}))}
        rows = stored(postings(docs, vocabulary), "lexical-postings")
        n_docs, n_words = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["t"]: r["count"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row a term of the vocabulary
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], dtype=np.int64)
        numbers = [np.array(sorted(vocabulary[t] for t in by[i]), dtype=np.int64) for i in ids]
        asked, least = [(x, weight[x]) for x in numbers], np.ones(len(ids), dtype=np.int64)
        facts = (len(vocabulary), n_docs, n_words)
        first = rows.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(FIRST)) == 0)
        for r in _best(_searched(first, asked, k, least, *facts), k).where(F.col("rank") == k).collect():  # a row an item
            least[r["ask"]] = max(1, r["score"])
        found = _best(_searched(rows, asked, k, least, *facts), k)
        names = spark.createDataFrame(list(enumerate(ids)), "ask int, item_id long")
        out.append(found.join(F.broadcast(names), "ask").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
g AS (SELECT count(DISTINCT doc_id) AS nd, count(*) AS l FROM d),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
f AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, g GROUP BY 1),
s AS (SELECT item_id, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN f ON q.t = f.t JOIN w ON w.t = f.t JOIN n ON n.doc_id = f.doc_id, g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
