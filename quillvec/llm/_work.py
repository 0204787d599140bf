"""Where intermediate tables go, and small helpers all text operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def scratch(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; only where that is unset (tests) one of our own."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="quillvec-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant_doubles(values) -> Column:
    """A constant array; one literal that the optimizer folds, however many values there are."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def with_results(schema: StructType, *results: StructField) -> tuple[list[str], StructType]:
    """The columns that stay beside result columns, and the schema of both: a result takes the place of a column of its name."""
    names = {r.name.lower() for r in results}
    stay = [f for f in schema.fields if f.name.lower() not in names]
    return [f.name for f in stay], StructType([*stay, *results])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: inside a higher-order function an expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


#: Bits of a bitmap as powers of two: at least, and at most (16 MB); so many for a value between them.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 16


def bitmap(values: DataFrame) -> np.ndarray:
    """Packed bits, a power of two of them, of distinct 64-bit hashes, the one column of values: the bit of a hash is its lowest bits.

    Tasks make blocks of 2**16 bits, which are at most 2**(MOST_BITS - 16).
    """
    n = values.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))

    def block(table: pa.Table) -> pa.Table:
        held = np.zeros(1 << 16, bool)
        held[table["spot"].to_numpy() & 0xFFFF] = True
        return pa.table([table["block"].slice(0, 1), pa.array([np.packbits(held).tobytes()])], names=["block", "bits"])

    spot = F.col(values.columns[0]).bitwiseAND((1 << bits) - 1)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in values.select(spot.alias("spot"), F.shiftright(spot, 16).alias("block")).groupBy("block").applyInArrow(block, "block long, bits binary").collect():
        out[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which lives on for other tasks, gives back memory that it no longer uses."""

    def tidy(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidy


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


#: Elements that `placed` adds one by one to an array, which copies it.
_AT_ONCE = 512


def placed(items: Column, kind: str, size: Callable[[Column], Column], give: Callable[[Column, Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """give(item, place) of each item that is to be kept, where place is the sum of the sizes before it; items: an array with an element at least.

    kind: the type of what is given.  Items are taken in chunks, so the work does not grow with the square of their number.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        more = F.concat(acc["out"], F.array(give(item, acc["at"])))
        return F.struct((acc["at"] + size(item)).alias("at"), (more if keep is None else F.when(keep(item), more).otherwise(acc["out"])).alias("out"))

    def some(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return bound(own, lambda v: F.struct(v["at"].alias("at"), F.concat(acc["out"], v["out"]).alias("out")))

    def every(whole: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / _AT_ONCE).cast("int")), lambda c: F.slice(whole, c * _AT_ONCE + 1, F.lit(_AT_ONCE)))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), empty.alias("out")), some)["out"]

    return bound(items, every)
