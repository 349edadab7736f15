"""Vector codes by exact integer products: each part of a vector is named by its nearest codebook entry.

Integers are broken into limbs so narrow that no partial sum of a float64 product of two limbs reaches 2**53; the limbs'
products come from BLAS, are exact, and are put together in int64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, unused

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BROADCAST = 1_000_000  # labels at most that are sent to every task
SALTS = 16  # parts of a label beyond that
ROWS = 4096  # vectors multiplied at once


def limb_bits(length: int) -> int:
    """Bits of a limb: `length` products of two limbs sum to less than 2**53."""
    return (53 - max(1, length - 1).bit_length() - 1) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """int64 x as float64 arrays, lowest first: x = sum of limb i times 2**(bits * i). All but the highest are at least 0, so
    each is below 2**bits in size."""
    out = []
    while True:
        if x.size == 0 or (-(1 << bits) < int(x.min()) and int(x.max()) < 1 << bits):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits  # rounds down, so the rest keeps the sign


def dots(x: np.ndarray, c: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact products x @ c.T along the last axis, int64: x (..., n, k), c (..., m, k). The caller sees to it that they fit."""
    bits = bits or limb_bits(x.shape[-1])
    out = np.zeros((*x.shape[:-1], c.shape[-2]), dtype=np.int64)
    xs, cs = limbs(x, bits), [np.swapaxes(b, -1, -2) for b in limbs(c, bits)]
    for i, a in enumerate(xs):
        for j, b in enumerate(cs):
            out += np.matmul(a, b).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (parts, n, k) and codebooks (parts, m, k): index of each part's nearest entry, the first of equals, and its squared
    distance, both (parts, n) int64."""
    top = max((int(np.abs(a).max()) for a in (x, books) if a.size), default=0)
    if 4 * top * top * max(1, x.shape[2]) * len(x) >= 1 << 63:
        raise ValueError(f"components up to {top} are too large for distances in 64 bits")
    half = (books * books).sum(axis=2)[:, None, :] - 2 * dots(x, books)
    at = half.argmin(axis=2)
    return at, np.take_along_axis(half, at[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """df with `v`, array<long>: floor(scale * x) of every component; rows whose `embedding` is null or holds null or
    non-finite components go."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(fine).withColumn("v", F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("long")))


def _parts(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    """Vectors of an Arrow list column as (parts, n, dim / parts)."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), parts, dim // parts)
    return np.ascontiguousarray(v.transpose(1, 0, 2))


def train(vecs: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, dim / parts) of vecs (a stored table with vec_id and v of length dim). They begin with the
    rows of smallest vec_id (then smallest v, null ids last; fewer rows give fewer entries). A round sums each entry's parts
    inside every task, and the tasks' sums in one aggregation of parts * entries rows; an entry becomes their floor(sum / count), an unused one stays."""
    first = vecs.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()

    def sums(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, m, k = books.shape
            total, count = np.zeros((p * m, k), dtype=np.int64), np.zeros(p * m, dtype=np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    x = _parts(batch.column("v").slice(lo, ROWS), dim, p)
                    slot = (nearest(x, books)[0] + np.arange(p)[:, None] * m).ravel()
                    order, flat = np.argsort(slot, kind="stable"), x.reshape(-1, k)
                    used, at, n = np.unique(slot[order], return_index=True, return_counts=True)
                    count[used] += n
                    if k:
                        total[used] += np.add.reduceat(flat[order], at, axis=0)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int32()), "n": pa.array(count[used], pa.int64()), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

        return run

    for _ in range(rounds if len(first) else 0):
        made = vecs.select("v").mapInArrow(sums(books), "slot int, n long, total array<long>")
        each = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim // parts)]
        for r in made.groupBy("slot").agg(F.sum("n").alias("n"), *each).collect():  # parts * entries rows at most
            p, m = divmod(r["slot"], books.shape[1])
            books[p, m] = [r[f"t{i}"] // r["n"] for i in range(dim // parts)]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vecs: DataFrame, books: np.ndarray, dim: int, code: str = "code", error: str = "error") -> DataFrame:
    """vecs (with v) with `code`, two hex digits a part, and `error`, the squared distances summed. A vector of another length
    than dim has neither (null)."""
    parts = len(books)
    keep = [c for c in vecs.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                v = rows.column("v")
                fits = v.value_lengths().to_numpy(zero_copy_only=False) == dim
                codes, errors = np.full(len(v), None, dtype=object), np.zeros(len(v), dtype=np.int64)
                if fits.any() and books.shape[1]:
                    at, far = nearest(_parts(v.filter(pa.array(fits)), dim, parts), books)
                    codes[fits], errors[fits] = ["".join(x) for x in hexes[at].T], far.sum(axis=0)
                made = [pa.array(codes, pa.string()), pa.array(errors, pa.int64(), mask=~fits)]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *made], names=[*keep, code, error])

    schema = vecs.select(*keep).schema.add(code, "string").add(error, "long")
    return vecs.mapInArrow(run, schema)


def with_totals(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df (a stored table) with `out`: the sum of `value` over rows of equal `key`, nulls together. Sums form on the map side; up to BROADCAST
    of them are sent to every task, more meet their rows in SALTS parts of each key."""
    k, salt = unused(df, "__key"), unused(df, "__salt")
    totals = df.groupBy(F.col(key).alias(k)).agg(F.sum(value).alias(out))
    if totals.count() <= BROADCAST:
        return df.join(F.broadcast(totals), df[key].eqNullSafe(totals[k]), "left").drop(k)
    totals = totals.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = df.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(totals, (rows["__part"] == totals[salt]) & rows[key].eqNullSafe(totals[k]), "left").drop(k, salt, "__part")


def quantised(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of df (vec_id, embedding, label): vec_id, label, code, error as a stored table, and the codebooks.

    Vectors have the length of the one with the smallest vec_id (of equals the smaller length); it must be a multiple of `parts`. Others keep their
    row with code and error null. An empty table gives no rows and no entries; repeated rows count each; other columns are not read."""
    ints = stored(integers(df.select("vec_id", "embedding", "label"), scale).select("vec_id", "label", "v"), "gemm-integers")
    first = ints.orderBy(F.asc_nulls_last("vec_id"), F.size("v")).select(F.size("v")).first()
    dim = first[0] if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    books = train(ints.where(F.size("v") == dim), dim, parts, entries, rounds)
    return stored(encode(ints, books, dim), "gemm-codes"), books


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, the errors summed by label, and the digest of the codebooks."""
    rows, books = quantised(read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    return with_totals(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    far = "CAST(list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    assign = f"SELECT p.vec_id, p.part, any_value(p.x) AS x, arg_min(c.entry, {far} * 16 + c.entry) AS entry, min({far}) AS far FROM p JOIN c{{0}} c ON p.part = c.part GROUP BY 1, 2"
    rounds = "".join(
        f"""a{i} AS MATERIALIZED ({assign.format(i)}),
m{i} AS (SELECT part, entry, list(CAST(floor_div AS BIGINT) ORDER BY pos) AS c FROM (SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS floor_div FROM
  (SELECT part, entry, pos, sum(y) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY 1, 2, 3)) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON o.part = m.part AND o.entry = m.entry),
"""
        for i in range(ROUNDS)
    )
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, CAST(k AS INTEGER) AS part, list_slice(v, k * (len(v) // 8) + 1, (k + 1) * (len(v) // 8)) AS x FROM e, range(8) t(k)),
c0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x AS c FROM p QUALIFY entry < 16),
{rounds}z AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM ({assign.format(ROUNDS)}) GROUP BY 1),
d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})
SELECT z.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM z JOIN e ON z.vec_id = e.vec_id, d
"""


OP11_SQL = _sql()
