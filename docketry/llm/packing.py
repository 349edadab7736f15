"""Best-fit packing by bin completion, a branch and bound over lengths."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import hash_bucket, read, running_total, stored

SIZE, END = 4096, 1
KEPT = 900_000  # words that a task's encoder keeps where nothing runs beside it: about 180 MB


def token_pieces(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None, kept: int = tokens.KEPT) -> DataFrame:
    """Tokenise (doc_id, text) and cut each document's ids and its end id into pieces of at most `size`:
    uid, doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit). uid tells repeated rows apart once
    the result is stored. A null text is empty: its only id is the end id. kept: words that a task's encoder keeps."""
    path = path or tokens.vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(path, kept)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                got = [
                    (uid, doc, k, at, len(ids) // 4, tokens.crc(ids), ids)
                    for uid, doc, text in zip(part["uid"], part["doc_id"], part["text"], strict=True)
                    for k, at, ids in tokens.pieces(encode.ids(text, end), size)
                ]
                yield pd.DataFrame(got, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


# ---- the plan: which lengths share a bin ------------------------------------------------------------


def completions(first: int, counts: dict[int, int], lengths: list[int], size: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of a bin around `first` that waste `most_waste` at most, least waste first, longest lengths first.

    Which sums the lengths from each one down can reach is worked out beforehand, a bit a sum, so a branch that cannot
    end in the waste looked for is never entered. A filling is dominated when some of its lengths, or none, could give way to one length that is
    left, is not shorter than they are together, and still fits. lengths: falling, each with a count left beside `first`.
    """
    room, rising, have = size - first, [-x for x in lengths], sum(1 << x for x in lengths)
    mask, reach = (1 << room + 1) - 1, [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        x, r, step = lengths[i], reach[i + 1], 1
        left = min(counts[x], room // x)
        while left:
            step = min(step, left)
            r |= r << x * step
            left, step = left - step, step * 2
        reach[i] = r & mask

    def exact(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for j in range(max(i, bisect_left(rising, -total)), len(lengths)):
            x = lengths[j]
            for m in range(min(counts[x], total // x), 0, -1):
                if reach[j + 1] >> total - m * x & 1:
                    for rest in exact(j + 1, total - m * x):
                        yield (x,) * m + rest
            if not reach[j + 1] >> total & 1:
                return

    for waste in range(min(most_waste, room) + 1):
        if reach[0] >> room - waste & 1:
            for taken in exact(0, room - waste):
                if not _dominated(list(taken), waste, counts, have):
                    yield taken


def _fullest(left: dict[int, int], lengths: list[int], size: int) -> tuple[int, ...]:
    """The longest length left, then again and again the longest that fits."""
    taken, room = [lengths[0]], size - lengths[0]
    i = 0
    while room:
        i = max(i, bisect_left(lengths, -room, key=lambda x: -x))
        if i == len(lengths):
            break
        x = lengths[i]
        n = min(room // x, left[x] - (x == lengths[0]))
        taken += [x] * n
        room -= n * x
        i += 1
    return tuple(taken)


def _dominated(taken: list[int], room: int, counts: dict[int, int], have: int) -> bool:
    """Some of the taken lengths, or none of them, could give way to one length that is left, is as long as all of them or longer, and fits into their place and
    the room. have: a bit for each length that there is. One that is only as long as the single length it replaces is no gain."""
    some, more = 1, 0  # bits: sums of some of taken; sums of two or more
    for x in taken:
        more |= more << x | (some & ~1) << x
        some |= some << x
    for x in set(taken):
        if counts[x] == taken.count(x):
            have &= ~(1 << x)
    longer, width = some << 1 if room else 0, 1
    while width < room:
        step = min(width, room - width)
        longer, width = longer | longer << step, width + step
    return bool(have & (longer | more))


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """The incumbent: best-fit decreasing over the multiset, as (bin, how many). Bins are built from the
    longest length left; the rest of a bin takes the longest length that fits, again and again, which is
    what best fit does to the fullest open bin. One step uses up a length or more, so there are at most
    as many steps as lengths, whatever the counts."""
    left, plan = dict(counts), []
    lengths = sorted(left, reverse=True)
    while left:
        filling, n = _use(left, _fullest(left, lengths, size))
        plan.append((filling, n))
        lengths = [x for x in lengths if x in left]
    return plan


def _use(left: dict[int, int], filling: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    need = Counter(filling)
    n = min(left[x] // k for x, k in need.items())
    for x, k in need.items():
        left[x] -= n * k
        if not left[x]:
            del left[x]
    return filling, n


def bound(counts: dict[int, int], size: int) -> int:
    """Bins that no packing can do without: all ids over the size, or the lengths over half a bin and
    what must go beside them, whichever is more."""
    many, ids = [0] * (size + 2), [0] * (size + 2)  # of the lengths from x on
    for x in range(size, -1, -1):
        n = counts.get(x, 0)
        many[x], ids[x] = many[x + 1] + n, ids[x + 1] + n * x
    half, best = size // 2 + 1, -(-ids[0] // size)
    for low in range(half):
        big = many[size - low + 1]
        mid, held = many[half] - big, ids[half] - ids[size - low + 1]
        small = ids[low] - ids[half]
        best = max(best, big + mid + max(0, -(-(small - (mid * size - held)) // size)))
    return best


@dataclass
class Search:
    """A plan (bin, how many such bins), with what it took: the bins of best fit and of the lower bound, the descents begun and
    the fillings chosen in them."""

    plan: list[tuple[tuple[int, ...], int]]
    bins: int
    best_fit: int
    bound: int
    descents: int = 0
    fillings: int = 0


def search(counts: dict[int, int], size: int = SIZE, descents: int = 400, steps: int = 8_000, width: int = 24) -> Search:
    """Bin completion for a multiset of lengths.

    Best-fit decreasing gives the incumbent. A descent works around the longest length left: it takes the first undominated
    filling in order of waste, applies it as often as the counts allow, and goes on; it is cut when the waste so far pushes its
    bound to the incumbent's bins or over. Other fillings are gone back to, those with the fewest departures from first
    choices first, then those nearest the start. The first descent's plan is taken where it needs no more bins than
    best fit, a later one where it needs fewer than the best so far.

    It ends when the plan meets the lower bound (it is then optimal), when nothing is left to try, or after `descents` descents
    or `steps` fillings past the first; each node tries `width` fillings at most. Then the plan may be above the optimum,
    by `bins - bound` at most. No length is lost in any case, and time and memory depend on the number of different
    lengths (at most `size`), not on the number of documents.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    incumbent = best_fit(counts, size)
    best, full = sum(n for _, n in incumbent), sum(x * n for x, n in counts.items())
    out = Search(incumbent, best, best, bound(counts, size))
    queue: list[tuple[int, int, int, list, int]] = [(0, 0, 0, [], 0)]  # departures, depth, number, bins before, which filling
    pushed = 0
    while queue and counts and (not out.descents or out.bins > out.bound) and out.descents < descents and out.fillings < steps + len(counts) * (out.descents < 1):
        off, depth, _, before, skip = heapq.heappop(queue)
        out.descents += 1
        made, left = before[:depth], dict(counts)
        for filling, n in made:
            for x in filling:
                left[x] -= n
        left = {x: n for x, n in left.items() if n}
        lengths = sorted(left, reverse=True)
        waste = sum(n * (size - sum(f)) for f, n in made)
        while left:
            spare = (out.bins if out.descents > 1 else out.bins + 1) * size - full - waste - 1  # waste that still gains, or at first draws level
            if spare < 0:
                break
            filling = None if skip else _fullest(left, lengths, size)
            if filling is None or sum(filling) < size:  # a full bin comes first in the order of completions() anyway
                rest = dict(left)
                rest[lengths[0]] -= 1
                short = [x for x in lengths if x <= size - lengths[0] and rest[x] > 0]
                filling = next(islice(completions(lengths[0], rest, short, size, spare), skip, None), None)
                if filling is None:
                    break
                filling = (lengths[0], *filling)
            if skip + 1 < width and pushed < 10 * descents:
                pushed += 1
                heapq.heappush(queue, (off + 1, len(made), pushed, made, skip + 1))
            step = _use(left, filling)
            out.fillings += 1
            made.append(step)
            waste += step[1] * (size - sum(filling))
            skip = 0
            if any(x not in left for x in filling):
                lengths = [x for x in lengths if x in left]
        else:
            n = sum(k for _, k in made)
            if n < out.bins or out.descents == 1 and n == out.bins:
                out.plan, out.bins = made, n
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Bins for a multiset of lengths, by `search`: (lengths in the bin, how many such bins)."""
    return search(counts, size).plan


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to stored pieces (uid, piece, length from 1 to size).

    The histogram of lengths (at most `size` rows) goes to the driver and `plan` decides which lengths
    share a bin and how often. Each piece's rank among the pieces of its length (a running total, so one
    length may hold any share of the rows) then names its bin and its place there. No pieces: no rows.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots, base, used = [], 0, Counter()
    for filling, n in plan(counts, size):
        at = 0
        for x, k in sorted(Counter(filling).items(), reverse=True):
            slots.append((x, used[x], used[x] + k * n, k, base, at))
            used[x] += k * n
            at += k * x
        base += n
    table = spark.createDataFrame(slots, "slot_length long, low long, high long, times long, base long, at long")  # under 2 * size * log rows
    n = max(counts.values(), default=0)
    ranked = running_total(
        pieces.withColumn("bucket", hash_bucket(max(16, n // 20_000), "uid", "piece")).withColumn("one", F.lit(1)), ["length"], "bucket", ["uid", "piece"], "one", "rank"
    )
    place: Column = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        *pieces.columns,
        (F.col("base") + F.floor(place / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + place % F.col("times") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: sequence_id, n_tokens, ids (all pieces' ids in order of offset)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))  # at most `size` ids
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), joined.alias("ids"))


def packed_documents(docs: DataFrame, kept: int = tokens.KEPT) -> DataFrame:
    """Documents (doc_id, text) to placed pieces: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Null text: empty; repeated rows are packed each; an empty table gives no rows."""
    pieces = stored(token_pieces(docs, kept=kept).drop("ids"), "pack-pieces")
    return pack(pieces).drop("uid")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packed_documents(read(spark, sf_dir, "documents"), KEPT)
