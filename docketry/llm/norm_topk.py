"""Exact top-k inner-product search over norm buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_bucket, read, stored, with_uid

FOCUS = 4  # coordinates looked at by coordinate pruning
STEEP = 0.6  # local cosine threshold from which coordinates prune better than lengths
BLOCK = 2048  # rows of a candidate chunk; a block has FOLD as many queries
FOLD = 4
GROUP = 32  # queries multiplied at once


def vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v array<long> = floor(scale * x), norm double. Rows whose vector is null, empty or holds a
    null or non-finite component take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e).cast("long"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(fine).select("vec_id", v.alias("v")).withColumn("norm", length).withColumn("dim", F.size("v"))


def _numbers(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """q and p as doubles while every partial sum of their products stays below 2**53, else as they are: products are exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float), p.astype(float)) if top < 2**53 else (q, p)


def prune(q: np.ndarray, length: float, theta: float, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the rows of p (by falling length) that may score theta or more with q.

    t = theta / (|q| * longest) is the bucket's local cosine threshold: over 1 none can, from STEEP up the
    rows are cut by the feasible interval of q's largest coordinates, below that by length alone. The
    slack of 1e-9 only ever lets more through; products are verified later.
    """
    if theta <= 0 or not len(lengths):
        return np.arange(len(lengths))
    if length == 0 or lengths[0] == 0:
        return np.arange(0)
    t = theta / (length * lengths[0]) - 1e-9
    if t > 1:
        return np.arange(0)
    keep = np.arange(np.searchsorted(-lengths, -(theta / length) * (1 - 1e-9), side="right"))
    if t < STEEP or not len(keep):
        return keep
    unit = q / length
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        a, spread = unit[f], np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - unit[f] ** 2))
        low = -1.0 if a < 0 and a <= -t else a * t - spread
        high = 1.0 if a > 0 and a >= t else a * t + spread
        x = p[keep, f] / lengths[keep]
        keep = keep[(x >= low - 1e-9) & (x <= high + 1e-9)]
    return keep


def _search(k: int):
    """For each query the k best rows, by score and then by id, of those that may reach its theta. Queries that length alone
    prunes share products over the longest rows they need; each of the others multiplies what its coordinates leave."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 3), dtype=np.int64)]
        if len(queries) and len(rows):
            rows = rows.sort_values("norm", ascending=False)
            p, lengths, ids, own = np.array(rows["v"].tolist(), dtype=np.int64), rows["norm"].to_numpy(), rows["id"].to_numpy(), rows["uid"].to_numpy()
            q, asks = np.array(queries["v"].tolist(), dtype=np.int64), queries["uid"].to_numpy()
            norm, theta = queries["norm"].to_numpy(), queries["theta"].to_numpy()
            (qf, pf), place = _numbers(q, p), np.arange(len(p))

            def take(i: np.ndarray, at: np.ndarray, score: np.ndarray, ok: np.ndarray) -> None:
                """Queries i, rows at, a score for each two, and which of them count."""
                ok = ok & (score >= theta[i, None]) & (asks[i, None] != own[at])
                if len(at) > 4 * k:  # only the best can matter; equal scores at the edge stay
                    held = np.where(ok, score, np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf)
                    ok &= held >= np.partition(held, len(at) - k, axis=1)[:, [len(at) - k]]
                a, b = np.nonzero(ok)
                s, r = score[a, b].astype(np.int64), at[b]
                order = np.lexsort((ids[r], -s, a))
                a, s, r = a[order], s[order], r[order]
                first = np.searchsorted(a, a)
                best = np.arange(len(a)) - first < k
                out.append(np.column_stack([asks[i][a[best]], own[r[best]], s[best]]))

            with np.errstate(divide="ignore", invalid="ignore"):
                t = theta / (norm * lengths[0])
            steep = (theta > 0) & ~(t < STEEP)  # also where a length is 0: prune() settles those
            for i in np.flatnonzero(steep):
                at = prune(q[i], norm[i], theta[i], p, lengths)
                if len(at):
                    take(np.array([i]), at, (pf[at] @ qf[i])[None, :], np.ones((1, len(at)), dtype=bool))
            flat = np.flatnonzero(~steep)
            upto = np.where(theta[flat] > 0, np.searchsorted(-lengths, -(theta[flat] / np.maximum(norm[flat], 1e-300)) * (1 - 1e-9), side="right"), len(p))
            order = np.argsort(-upto, kind="stable")
            for lo in range(0, len(flat), GROUP):
                i, n = flat[order[lo : lo + GROUP]], upto[order[lo : lo + GROUP]]
                if n[0]:
                    take(i, place[: n[0]], qf[i] @ pf[: n[0]].T, place[: n[0]] < n[:, None])
        return pd.DataFrame(np.concatenate(out), columns=["ask", "uid", "score"])

    return run


def _pairs(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Queries and candidates meet once for each (dim, chunk, block) that both name: ask, uid (row ids), score."""
    by = ["dim", "chunk", "block"]
    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(_search(k), "ask long, uid long, score long")


def _dealt(df: DataFrame, by: str, size: int, n: int, name: str) -> DataFrame:
    """df (n rows) with `name`_bucket, cut at quantiles of `by` (0: the largest), and `name`_part, by hash, of about `size` rows each, so that
    many equal values never meet in one task; `name`_parts says how many parts the bucket has."""
    cuts = min(64, max(1, n // size))
    bounds = sorted(set(df.approxQuantile(by, [i / cuts for i in range(1, cuts)], 0.002))) if cuts > 1 else []
    cut = df.withColumn(f"{name}_bucket", sum(((F.col(by) < F.lit(b)).cast("int") for b in bounds), F.lit(0)))
    keys = ["dim", f"{name}_bucket"]
    parts = cut.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}_parts"))
    parts = parts.toDF("dim", "b", f"{name}_parts").withColumnRenamed("dim", "d")
    return cut.join(F.broadcast(parts), (F.col("dim") == F.col("d")) & (F.col(f"{name}_bucket") == F.col("b"))).drop("d", "b").withColumn(f"{name}_part", F.pmod(F.xxhash64("uid"), F.col(f"{name}_parts")).cast("int"))  # 64 rows a dimension


def top_k(vecs: DataFrame, queries: Column | DataFrame, k: int = 5) -> DataFrame:
    """The k best integer inner products of each query row with every other row of its dimension:
    query_id, rank (from 1), vec_id, score; ties to the smaller vec_id, null ids last. vecs: as `vectors` gives them.
    queries: which of the rows ask, as a condition or as a table of their vec_ids. A row is known by a number of its own: rows
    repeated under one id are candidates each, also for each other, and each asks for itself.

    Candidates are cut at quantiles of their length into buckets, and these by hash into chunks of about
    BLOCK rows. One chunk of the longest bucket gives each query a sound threshold theta (its k-th best there); the bucket test theta <= |q| * longest
    then drops whole buckets before anything moves, and inside a chunk `prune` chooses length or coordinates.
    Queries are cut into blocks by theta / |q|, the length they ask for, so that a block asks for much the same buckets, and a vector
    moves once for each block that asks for its chunk, not once for each query.
    """
    if isinstance(queries, DataFrame):
        asking = queries.select("vec_id").distinct().withColumn("asks", F.lit(True))
        vecs = vecs.join(asking, "vec_id", "left").select("vec_id", "v", "norm", "dim", F.coalesce("asks", F.lit(False)).alias("asks"))
    else:
        vecs = vecs.select("vec_id", "v", "norm", "dim", F.coalesce(queries, F.lit(False)).alias("asks"))
    vecs = with_uid(vecs, "topk-vectors")
    n, n_queries = vecs.agg(F.count("*"), F.count_if("asks")).first()
    rows = _dealt(vecs, "norm", BLOCK, n, "c").withColumn("chunk", F.col("c_bucket").cast("long") * (1 << 32) + F.col("c_part"))
    rows = stored(rows.withColumn("id", F.coalesce("vec_id", F.lit((1 << 63) - 1))), "topk-rows")  # for ties; the id itself comes back by uid
    chunks = stored(rows.groupBy("dim", "c_bucket", "chunk").agg(F.max("norm").alias("longest")), "topk-chunks")  # a row a chunk
    wide = BLOCK * FOLD
    asked = stored(rows.where("asks").select("dim", "uid", "v", "norm"), "topk-queries")

    first = chunks.groupBy("dim").agg(F.min("chunk").alias("chunk"))
    blocks = max(1, -(-n_queries // wide))
    start = asked.join(F.broadcast(first), "dim").withColumn("block", hash_bucket(blocks, "uid")).withColumn("theta", F.lit(float("-inf")))
    head = rows.join(F.broadcast(first), ["dim", "chunk"]).select("dim", "chunk", "uid", "id", "v", "norm", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"))
    seen = _pairs(start, head, k).withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
    theta = stored(seen.select(F.col("ask").alias("uid"), F.col("score").cast("double").alias("theta")), "topk-theta")
    asked = asked.join(theta, "uid", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    asked = asked.withColumn("length", F.when(F.col("theta") > 0, F.col("theta") / F.greatest("norm", F.lit(1e-300))).otherwise(F.lit(-1.0)))
    asked = stored(_dealt(asked, "length", wide, n_queries, "q").withColumn("block", F.col("q_bucket").cast("long") * (1 << 32) + F.col("q_part")), "topk-asked")

    asks = asked.groupBy("dim", "block").agg(F.min("length").alias("least"))  # a row a block
    met = chunks.join(F.broadcast(asks), "dim").where(F.col("least") <= F.col("longest") * (1 + 1e-9)).select("dim", "chunk", "block", "longest")
    met = stored(met, "topk-met")  # which chunks meet which blocks
    calls = asked.join(met, ["dim", "block"]).where(F.col("length") <= F.col("longest") * (1 + 1e-9)).select("dim", "chunk", "block", "uid", "v", "norm", "theta")
    called = rows.join(met.drop("longest"), ["dim", "chunk"]).select("dim", "chunk", "block", "uid", "id", "v", "norm")
    found = _pairs(calls, called, k).join(rows.select("uid", "vec_id"), "uid")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = rows.where("asks").select(F.col("uid").alias("ask"), F.col("vec_id").alias("query_id"))
    return found.join(named, "ask").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of every embedding whose vec_id is divisible by 50, over all embeddings. Vectors without components take no part,
    and only vectors of one dimension have a product; other columns are not read; an empty table gives no rows."""
    return top_k(vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
