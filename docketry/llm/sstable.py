"""Token ids in sorted-string-table shards.

A file holds entries in ascending key order. Its layout, all integers little-endian:

    blocks   each zstd-compressed: entries (shared u8, key suffix length u8, value length u32, key suffix,
             value) and then the offsets of the restart entries (u32 each) and their number (u32)
    index    one entry per block: first key (8 bytes), offset u64, size u32, entries u32
    bloom    bits of the Bloom filter
    footer   index offset u64, index entries u32, bloom offset u64, bloom bytes u32, probes u32,
             entries u64, tokens u64, smallest key (8), largest key (8), magic (8)

A key is the document's id as a big-endian integer with its sign bit flipped, so byte order is id order;
within a restart run of 16 entries a key leaves out what it shares with the one before. A value is the
ids, two bytes each when the file's ids allow it and else four (first byte of the value: the width).
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import read, shared_dir, stored

BLOCK, RESTART, PROBES, BITS = 64 << 10, 16, 7, 10
MAGIC = b"DKTSST01"
FOOTER = struct.Struct("<QIQIIQQ8s8s8s")
INDEX = struct.Struct("<8sQII")
ENTRY = struct.Struct("<BBI")
NONE = -(2**63)  # key of a null doc_id
KEPT = 900_000  # words that a task's encoder keeps while it writes: about 180 MB


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + 2**63) & (2**64 - 1))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - 2**63


def _bits(key: bytes, n_bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % n_bits for i in range(PROBES)]


class Writer:
    """Builds one file in memory from entries in key order; `size` is what it holds so far."""

    def __init__(self) -> None:
        self.out, self.index, self.keys, self.tokens, self.n, self.size = [], [], [], 0, 0, 0
        self.press = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.filled, self.restarts, self.count, self.last, self.first = [], 0, [], 0, b"", b""

    def add(self, key: bytes, ids: bytes) -> None:
        wide = np.frombuffer(ids, dtype="<u4")
        value = b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\x04" + ids
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.filled)
        else:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        entry = ENTRY.pack(shared, 8 - shared, len(value)) + key[shared:] + value
        self.block.append(entry)
        self.filled += len(entry)
        self.first = self.first or key
        self.last, self.count, self.n, self.tokens = key, self.count + 1, self.n + 1, self.tokens + len(wide)
        self.keys.append(key)
        if self.filled >= BLOCK:
            self._close()

    def _close(self) -> None:
        if self.count:
            raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            block = self.press.compress(raw)
            self.index.append((self.first, self.size, len(block), self.count))
            self.out.append(block)
            self.size += len(block)
            self._open()

    def finish(self) -> bytes:
        self._close()
        index = b"".join(INDEX.pack(*x) for x in self.index)
        bits = np.zeros(max(8, -(-len(self.keys) * BITS // 8)), dtype=np.uint8)
        for key in set(self.keys):
            for b in _bits(key, len(bits) * 8):
                bits[b >> 3] |= 1 << (b & 7)
        low, high = (self.keys[0], self.keys[-1]) if self.keys else (b"\0" * 8, b"\0" * 8)
        footer = FOOTER.pack(self.size, len(self.index), self.size + len(index), len(bits), PROBES, self.n, self.tokens, low, high, MAGIC)
        return b"".join([*self.out, index, bits.tobytes(), footer])


class Reader:
    """One file: `entries` in key order, `get` by Bloom filter, index and binary search. read(at, n) gives n bytes of its `size` from at on: only the
    footer and the index are read at once, the filter and a block when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        at, n, self.bloom_at, self.bloom_size, _, self.n, self.tokens, self.low, self.high, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        index = read(at, n * INDEX.size)
        self.index = [INDEX.unpack_from(index, i * INDEX.size) for i in range(n)]
        self.open, self.bloom = zstandard.ZstdDecompressor(), b""

    @classmethod
    def of(cls, data: bytes) -> Reader:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        raw = self.open.decompress(self.read(self.index[k][1], self.index[k][2]))
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 * (n + 1)
        return raw[:end], list(struct.unpack_from(f"<{n}I", raw, end))

    @staticmethod
    def _walk(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, rest, size = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            value = raw[at : at + size]
            at += size
            yield key, np.frombuffer(value, dtype=f"<u{value[0]}", offset=1).astype("<u4").tobytes()

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._walk(self._block(k)[0], 0)

    def may_hold(self, key: bytes) -> bool:
        self.bloom = self.bloom or self.read(self.bloom_at, self.bloom_size)
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.bloom_size * 8))

    def get(self, key: bytes) -> list[bytes]:
        """Values of all entries with this key."""
        if not self.index or not self.low <= key <= self.high or not self.may_hold(key):
            return []
        k, found = max(0, bisect_right([x[0] for x in self.index], key) - 1), []
        while k and self.index[k][0] == key:  # equal keys may begin in the block before
            k -= 1
        for k in range(k, len(self.index)):
            if self.index[k][0] > key:
                break
            raw, restarts = self._block(k)
            firsts = [raw[r + ENTRY.size : r + ENTRY.size + 8] for r in restarts]  # a restart's key is whole
            i = max(0, bisect_right(firsts, key) - 1)
            while i and firsts[i] == key:
                i -= 1
            for other, value in self._walk(raw, restarts[i]):
                if other > key:
                    break
                if other == key:
                    found.append(value)
        return found


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 1, parts: int | None = None, most: int = 64 << 20, kept: int = KEPT) -> DataFrame:
    """Tokenise (doc_id, text) and write files of at most about `most` bytes to `folder`, any place that
    pyarrow.fs opens: file, low, high, entries, tokens of each file.

    Rows are range-partitioned by doc_id, and by the text's hash where one id has many; each task writes its range. A file's name has its task's number and
    one of the attempt's own; the returned table, which is stored, lists the files of the attempts that counted, and readers open only those, so what a lost task
    left behind, whole or in part, is never read. Null text: only the end id; a null doc_id sorts first. Words kept by a task's encoder: `kept`.
    """
    path = path or tokens.vocabulary()

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        place, root = fs.FileSystem.from_uri(folder)
        task, made, encode, out = TaskContext.get().partitionId(), [], tokens.encoder(path, kept), Writer()

        def close() -> None:
            if out.n:
                name = f"part-{task:06d}-{len(made):04d}-{uuid.uuid4().hex}.sst"
                with place.open_output_stream(f"{root}/{name}") as f:
                    f.write(out.finish())
                made.append((name, id_of(out.keys[0]), id_of(out.keys[-1]), out.n, out.tokens))

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                out.add(key_of(int(doc)), encode.ids(text, end))
                if out.size >= most:
                    close()
                    out = Writer()
        close()
        if made:
            yield pd.DataFrame(made, columns=["file", "low", "high", "entries", "tokens"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.xxhash64("text"))  # many texts under one id go to many tasks
    spread = rows.repartitionByRange(parts, "doc_id", "salt") if parts else rows.repartitionByRange("doc_id", "salt")
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(folder)
    place.create_dir(root, recursive=True)
    return stored(spread.sortWithinPartitions("doc_id", "salt", "text").mapInPandas(save, "file string, low long, high long, entries long, tokens long"), "sst-files")


def _opened(folder: str) -> Callable[[str], Reader]:
    """Opens a file of the folder for reads at any place."""
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(folder)

    def opened(name: str) -> Reader:
        f = place.open_input_file(f"{root}/{name}")
        return Reader(lambda at, n: f.read_at(n, at), f.size())

    return opened


def read_back(folder: str, files: DataFrame) -> DataFrame:
    """All entries of the files that `write` lists: file, doc_id, at (ids before it in its file), n_tokens, ids_crc32, ids. A task reads a block at a time."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _opened(folder)
        for batch in batches:
            for name in batch["file"]:
                at, got, held = 0, [], 0
                for key, ids in opened(name).entries():
                    got.append((name, id_of(key), at, len(ids) // 4, tokens.crc(ids), ids))
                    at += len(ids) // 4
                    held += len(ids)
                    if held > 8 << 20:
                        yield pd.DataFrame(got, columns=COLUMNS)
                        got, held = [], 0
                if got:
                    yield pd.DataFrame(got, columns=COLUMNS)

    COLUMNS = ["file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"]
    n = max(1, min(files.count(), 20_000))  # a file a task
    return files.select("file").repartition(n).mapInPandas(parse, "file string, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")


def lookup(spark: SparkSession, folder: str, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the wanted documents (doc_id): doc_id, ids. Each id goes to the files whose key range holds
    it; a file is opened once and asked by Bloom filter, block index and binary search, and only the blocks that may hold an id are read."""

    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = _opened(folder)(key[0])
        got = [(d, v) for d in rows["doc_id"].unique() for v in table.get(key_of(int(d)))]
        return pd.DataFrame({"doc_id": pd.Series([d for d, _ in got], dtype="int64"), "ids": pd.Series([v for _, v in got], dtype=object)})

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    near = asked.join(files, (F.col("doc_id") >= F.col("low")) & (F.col("doc_id") <= F.col("high"))).select("file", "doc_id")
    return near.groupBy("file").applyInPandas(find, "doc_id long, ids binary")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token tables in the shared folder and read back.

    start adds the file's place (a prefix over the files' token counts: a row a file) to the document's
    place in its file. Repeated ids keep all their rows; an empty table gives no rows.
    """
    folder = f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    files = write(read(spark, sf_dir, "documents"), folder, kept=KEPT)
    before = Window.orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    rows = read_back(folder, files).drop("ids")
    return rows.join(places, "file").select(
        F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
