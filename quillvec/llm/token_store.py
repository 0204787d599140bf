"""Token ids in binary shards, with a minimal perfect hash index from document keys.

A shard file has, after an 8-byte mark, the ids of its documents end to end as unsigned 16- or 32-bit little-endian
integers, then an index, then the place of the index.  The index holds
  - the token offset of every document, and the number of documents without a key, which come first;
  - a minimal perfect hash of the keys: bit arrays in levels, with the number of set bits before each 64-bit word,
    so that a key's slot costs a few memory reads however many keys there are;
  - for each slot a 32-bit fingerprint and the key's first document; a key that is absent meets a wrong fingerprint;
  - the keys in order, to list them and to tell how many documents repeat a key.
Documents are in ascending key order within and over shards.  A manifest lists the shards with their key range and
sizes; only names in the manifest count, so files of tasks that were lost or run twice do no harm.

Defined results: a null or empty text is its end id alone; null keys come first and are not in the index;
repeated keys keep all their documents, in order of the first 64 characters of their texts; an empty table makes no shard;
columns besides doc_id and text are not read, whatever their names; ids that are no integers are refused.  Any tokenizer file will do: units
are cut for those whose pattern is known, and any other encodes whole texts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import _encoding as E
from . import _text as T
from ._work import scratch

MARK = b"QVTOK001"
#: A shard is closed at so many ids or documents; both bound the memory of a task.
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20
_FOOT = struct.Struct("<QQQQQQ")  # place of the index, documents, null keys, distinct keys, levels, id bytes


def filesystem(path: str):
    """(file system, path in it) of a folder named by a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a key is placed at the first level where no other shares its bit."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.ranks = levels, ranks

    @staticmethod
    def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (T.mix(keys ^ T.mix(np.uint64(level + 1) * np.ones(1, np.uint64))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, ranks, before = [], [], 0
        while len(keys):
            words = -(-2 * len(keys) // 64)
            bit = cls._bit(keys, len(levels), words * 64)
            alone = np.bincount(bit, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            counts = alone.reshape(-1, 64).sum(1)
            ranks.append((before + np.cumsum(counts) - counts).astype("<u4"))
            before += int(counts.sum())
            keys = keys[~alone[bit]]
        return cls(levels, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that was built in; others get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            bit = self._bit(keys[todo], level, len(words) * 64)
            word, shift = words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << shift) - np.uint64(1))
            out[todo[hit]] = (ranks[bit >> 6] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (T.mix(keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Writes one shard: ids as they come, the index at the end."""

    def __init__(self, out, id_bytes: int):
        self.out, self.kind, self.id_bytes = out, f"<u{id_bytes}", id_bytes
        self.keys: list[np.ndarray] = []
        self.nulls, self.sizes, self.ids, self.docs = 0, [], 0, 0
        out.write(MARK)

    def add(self, keys: np.ndarray, nulls: int, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents in key order, the first `nulls` of them without a key."""
        self.out.write(ids.astype(self.kind).tobytes())
        self.keys.append(keys[nulls:])
        self.sizes.append(sizes)
        self.nulls += nulls
        self.ids += len(ids)
        self.docs += len(sizes)

    def close(self) -> tuple[int | None, int | None]:
        """The least and greatest key."""
        keys = np.concatenate(self.keys)
        distinct, first = np.unique(keys, return_index=True)
        table = PerfectHash.build(distinct.view(np.uint64))
        slot = table.slots(distinct.view(np.uint64))
        prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        prints[slot] = fingerprints(distinct.view(np.uint64))
        rows[slot] = first + self.nulls
        at = len(MARK) + self.ids * self.id_bytes
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype("<u8")
        for part in (offsets, keys.astype("<i8"), prints, rows, np.array([len(x) for x in table.levels], "<u8"), *table.levels, *table.ranks):
            self.out.write(part.tobytes())
        self.out.write(_FOOT.pack(at, self.docs, self.nulls, len(distinct), len(table.levels), self.id_bytes))
        self.out.close()
        return (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)


class Shard:
    """An opened shard: its index in memory, its ids read on demand."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        foot = source.read_at(_FOOT.size, size - _FOOT.size)
        at, self.docs, self.nulls, distinct, levels, self.id_bytes = _FOOT.unpack(foot)
        if source.read_at(len(MARK), 0) != MARK:
            raise ValueError("not a token shard")
        block = memoryview(source.read_at(size - _FOOT.size - at, at))
        place = 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(block, kind, n, place)
            place += out.nbytes
            return out

        self.offsets, self.keys = take(self.docs + 1, "<u8"), take(self.docs - self.nulls, "<i8")
        self.prints, self.rows = take(distinct, "<u4"), take(distinct, "<u4")
        sizes = take(levels, "<u8").tolist()
        words = [take(n, "<u8") for n in sizes]
        self.table = PerfectHash(words, [take(n, "<u4") for n in sizes])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, or -1, by hash and fingerprint alone."""
        if not len(self.rows):
            return np.full(len(keys), -1, np.int64)
        slot = self.table.slots(keys.view(np.uint64))
        ok = (slot >= 0) & (self.prints[slot] == fingerprints(keys.view(np.uint64)))
        return np.where(ok, self.rows[slot], -1).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first to last - 1, end to end."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self.source.read_at((b - a) * self.id_bytes, len(MARK) + a * self.id_bytes), f"<u{self.id_bytes}")


def write(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, folder: str | None = None, special: bool = True) -> str:
    """Encodes docs (doc_id, text) into shards in a new folder, and returns the folder; its `manifest` is a Parquet table.

    special: whether names of special tokens in a text are those tokens, as the library has it; else they are ordinary text.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("document keys are integers; number or hash other ids first")
    folder = folder or f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        def make():
            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.encode_special_tokens = not special
            return tokenizer

        encoder = E.encoder((tokenizer_path, special), make, keep=True)
        id_bytes = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        part, number, writer, name = TaskContext.get().partitionId(), 0, None, ""

        def closed():
            low, high = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, number, name, writer.docs, writer.ids, low, high), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "file", "docs", "ids", "low", "high"])

        for batch in batches:
            keys = batch.column("doc_id")
            for first, texts in E.text_slices(batch.column("text")):
                ids, ends = encoder.encode(texts)
                sizes = np.diff(ends) + 1
                ids = np.insert(ids, ends[1:], end_id)
                own = keys.slice(first, len(texts))
                if writer is None:
                    name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
                    writer = ShardWriter(store.open_output_stream(f"{root}/{name}"), id_bytes)
                writer.add(own.fill_null(0).to_numpy().astype(np.int64), own.null_count, sizes, ids)
                if writer.ids >= SHARD_IDS or writer.docs >= SHARD_DOCS:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    # a key with very many rows is split by the beginnings of its texts, and equal ones by row
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 64).alias("begin"), F.monotonically_increasing_id().alias("row"))
    placed = placed.repartitionByRange("doc_id", "begin", "row").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    made = placed.mapInArrow(run, "part int, number int, file string, docs long, ids long, low long, high long")
    made.write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with `base`, the number of ids before each: one row for some 64 million ids."""
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    shards = spark.read.schema("part int, number int, file string, docs long, ids long, low long, high long").parquet(f"{folder}/manifest")
    return shards.withColumn("base", F.coalesce(before, F.lit(0)))


def _read(spark: SparkSession, folder: str, use: Callable[[Shard, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        store, root = filesystem(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    yield from use(Shard(source), base)

    shards = manifest(spark, folder).select("file", "base")
    return shards.repartition(max(2 * spark.sparkContext.defaultParallelism, 8)).mapInArrow(run, schema)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each key looked up through the index."""

    def use(shard: Shard, base: int):
        row, keys = np.arange(shard.docs), shard.keys
        repeat = np.arange(len(keys)) - np.searchsorted(keys, keys)  # place among the documents of one key
        row[shard.nulls :] = shard.find(keys) + repeat
        first = 0
        while first < shard.docs:
            last = int(np.searchsorted(shard.offsets, shard.offsets[first] + (1 << 21), side="right")) - 1
            last = min(max(last, first + 1), shard.docs)
            ids = memoryview(shard.ids(first, last).astype("<u4").tobytes())
            at = (shard.offsets[row[first:last]] - shard.offsets[first]).astype(np.int64)
            n = (shard.offsets[row[first:last] + 1] - shard.offsets[row[first:last]]).astype(np.int64)
            crc = [zlib.crc32(ids[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), n.tolist(), strict=True)]
            own = np.concatenate([np.zeros(max(0, min(shard.nulls, last) - first), np.int64), keys[max(first - shard.nulls, 0) : max(last - shard.nulls, 0)]])
            yield pa.RecordBatch.from_arrays([pa.array(own, mask=np.arange(first, last) < shard.nulls), pa.array(base + shard.offsets[row[first:last]].astype(np.int64)), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            first = last

    return _read(spark, folder, use, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) for the keys (column doc_id) that the store has; one row for each document of a key.

    Keys are dealt to shards by the manifest's key ranges, then found by hash, without a scan of ids.
    """
    spark = keys.sparkSession
    shards = manifest(spark, folder).where("low is not null").select("file", "low", "high")
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    met = wanted.join(shards, (F.col("doc_id") >= F.col("low")) & (F.col("doc_id") <= F.col("high"))).select("file", "doc_id").repartition("file").sortWithinPartitions("file")

    def run(batches):
        store, root = filesystem(folder)
        name, shard, source = None, None, None
        for batch in batches:
            for file, key in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    source = store.open_input_file(f"{root}/{file}")
                    name, shard = file, Shard(source)
                row = int(shard.find(np.array([key], np.int64))[0])
                out = []
                while row >= 0 and row < shard.docs and shard.keys[row - shard.nulls] == key:
                    out.append(shard.ids(row, row + 1).astype(np.int64).tolist())
                    row += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return met.mapInArrow(run, "doc_id long, ids array<long>")
