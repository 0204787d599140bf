"""Benchmark decontamination by winnowing.

Of every `window` consecutive words the least hash of their `gram`-word grams is kept as a fingerprint, the last one of equal ones, with its
place.  Two texts that share `window` words in a row keep the same gram of them: no such span can be missed.
Documents' and benchmark's fingerprints are joined by hash, each with its words around as far as a window with the gram can reach.
A match extends to both sides while words are equal; where it reaches `window` words, they are hit.  Overlapping hits merge, so a longer span, which has
fingerprints all along, is hit as a whole.  Before the join a bitmap of fixed size spares fingerprints that no item has.

A benchmark item with fewer words than `window`, but not none, is one window; such windows are sought by the hash of
all their words, for each length that occurs (fewer than `window`), and joined by the words.

Equal words around equal grams are one row of the join, however many documents and places have them, and a document has one row for each,
with all its places.  The sides that a frequent passage makes hot are dealt over `SALTS` parts.

Defined results: null and wordless texts have no words and no hits; items with a null id
hit like others and count as one item, whose id is left out of the list; rows with one item id count as one item with the windows of all; rows with repeated document ids are
separate rows; an empty benchmark hits nothing, and an empty table gives no rows; texts of any length are taken whole; columns besides ids and texts are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._work import bitmap, materialize, tidied

#: Parts over which rows of one fingerprint or passage are dealt.
SALTS = 16


def winnowed(words: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the grams that some window of a document keeps; words are the hashes of all documents' words."""
    ok, _ = T.per_document(firsts, window)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = T.gram_hashes(words, gram)
    least, at = grams[: len(ok)].copy(), np.arange(len(ok))
    for j in range(1, window - gram + 1):
        own = grams[j : j + len(ok)]
        take = own <= least
        least[take] = own[take]
        at[take] = np.flatnonzero(take) + j
    at = np.unique(at[ok])
    return at, grams[at]


def short_windows(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of `size` words inside a document."""
    ok, _ = T.per_document(firsts, size)
    at = np.flatnonzero(ok)
    return at, (T.gram_hashes(words, size)[at] ^ np.uint64(size)) if len(at) else np.zeros(0, np.uint64)


class _Passage:
    """Words of a slice as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = T.lowered(data)
        self.starts, self.ends, self.firsts = T.word_bounds(self.data, offsets, T.ALNUM)
        self.hashes = T.span_hashes(self.data, self.starts, self.ends)

    def text(self, first: int, last: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)).decode()

    def places(self, sizes: list[int], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, first words, hashes, documents) of the fingerprints of each size that occurs."""
        for size in sizes:
            at, prints = winnowed(self.hashes, self.firsts, window, gram) if size == window else short_windows(self.hashes, self.firsts, size)
            yield size, at, prints, np.searchsorted(self.firsts, at, side="right") - 1

    def around(self, doc: int, at: int, size: int, window: int, gram: int) -> tuple[str, int]:
        """The words that a window with the gram at a place can have, and the gram's place among them; of a short window its own words."""
        if size < window:
            return self.text(at, at + size), 0
        first = max(at - (window - gram), int(self.firsts[doc]))
        return self.text(first, min(at + window, int(self.firsts[doc + 1]))), at - first


#: A passage, and 128 bits that stand for it where documents are joined with what is known of their passages.
_KEY, _DIGEST = ["size", "around", "place"], ["digest1", "digest2"]


def benchmark_fingerprints(benchmark: DataFrame, *, window: int = 10, gram: int = 5) -> DataFrame:
    """(item_id, print, size, around, place): the distinct fingerprints of each item with the words around."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("item_id").to_pylist(), []
            for low, _, data, offsets in T.slices(batch.column("text")):
                p = _Passage(data, offsets)
                n = np.diff(p.firsts)
                for size, at, prints, doc in p.places([x for x in range(1, window + 1) if (np.minimum(n, window) == x).any()], window, gram):
                    own = np.minimum(n[doc], window) == size  # an item is one short window, or has whole ones
                    for x, fp, d in zip(at[own].tolist(), prints[own].view(np.int64).tolist(), doc[own].tolist(), strict=True):
                        rows.append((ids[low + d], fp, size, *p.around(d, x, size, window, gram)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [batch.schema.field("item_id").type, pa.int64(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "print", *_KEY])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, print long, size int, around string, place int").distinct()


def _salted(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str) -> DataFrame:
    """left joined with right, rows of one key dealt by another column of left; right is small beside it."""
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [*on, "salt"], how).drop("salt")


def _common(a: Column, b: Column) -> Column:
    """How many words two arrays begin with alike."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def extended(prints: DataFrame, bench: DataFrame, *, window: int, gram: int) -> DataFrame:
    """Matches of documents' passages (print, size, around, place) with the benchmark's (the same, as b_around and b_place): size, around, place, b_around, b_place, back, length.

    back: words of the match before the place; length: its words, `window` at least, or those of a short window.
    """
    met = _salted(prints, bench, ["print", "size"], "around", "inner")
    a, b = F.split("around", " "), F.split("b_around", " ")
    tail = lambda words, place: F.slice(words, place + 1, F.size(words))
    head = lambda words, place: F.reverse(F.slice(words, 1, place))
    met = met.withColumn("ahead", _common(tail(a, F.col("place")), tail(b, F.col("b_place")))).withColumn("back", _common(head(a, F.col("place")), head(b, F.col("b_place"))))
    whole = (F.col("size") == window) & (F.col("ahead") >= gram) & (F.col("back") + F.col("ahead") >= window)
    short = (F.col("size") < window) & (F.col("around") == F.col("b_around"))
    return met.where(whole | short).select(*_KEY, "b_around", "b_place", "back", (F.col("back") + F.col("ahead")).alias("length"))


def _covered(batches):
    """(row_key, n_hit): words in any of the runs that begin `back` before each of `places`."""
    for batch in batches:
        out = []
        for runs in batch.column("runs"):
            starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for run in runs:
                at = run["places"].values.to_numpy()
                for match in run["matches"]:
                    starts.append(at - match["back"].as_py())
                    ends.append(starts[-1] + match["length"].as_py())
            starts, ends = np.concatenate(starts), np.concatenate(ends)
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            before = np.maximum.accumulate(np.concatenate([[0], ends]))[:-1]
            out.append(int(np.maximum(ends - np.maximum(starts, before), 0).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(out, pa.int64())], ["row_key", "n_hit"])


def overlaps(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and items (sorted item ids as strings, without the null one) of each row of docs."""
    spark = docs.sparkSession
    bench = materialize(benchmark_fingerprints(benchmark, window=window, gram=gram), "bench-prints")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # window of them at most
    shared = spark.sparkContext.broadcast(bitmap(bench.select("print").distinct()))
    names = ["doc_id", "row_key", "n_words", "print", *_KEY, "places"]

    def run(batches):
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            for low, high, data, offsets in T.slices(batch.column("text")):
                p, rows = _Passage(data, offsets), high - low
                none = lambda *kinds: [pa.nulls(rows, k) for k in kinds]
                yield pa.RecordBatch.from_arrays([ids.slice(low, rows), keys.slice(low, rows), pa.array(np.diff(p.firsts)), *none(pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()))], names)
                found: dict[tuple, list[int]] = {}  # (document, print, size, around, place): places
                for size, at, prints, doc in p.places(sizes, window, gram):
                    some = bits[prints & np.uint64(len(bits) - 1)]
                    for x, fp, d in zip(at[some].tolist(), prints[some].view(np.int64).tolist(), doc[some].tolist(), strict=True):
                        found.setdefault((d, fp, size, *p.around(d, x, size, window, gram)), []).append(x - int(p.firsts[d]))
                if found:
                    d, *own = zip(*found, strict=True)
                    m, places = len(d), list(found.values())
                    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, ids.type), keys.slice(low, rows).take(pa.array(d)), pa.nulls(m, pa.int64()), *(pa.array(c, k) for c, k in zip(own, kinds, strict=True)), pa.array(places, pa.list_(pa.int32()))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text")
    parts = materialize(parts.mapInArrow(tidied(run), f"doc_id {kind}, row_key long, n_words long, print long, size int, around string, place int, places array<int>"), "bench-met")
    digest = [F.xxhash64(F.lit(i), *_KEY).alias(name) for i, name in enumerate(_DIGEST)]
    met = parts.where("print is not null")
    passages = bench.select("print", "size", F.col("around").alias("b_around"), F.col("place").alias("b_place")).distinct()
    matches = materialize(extended(met.select("print", *_KEY).distinct(), passages, window=window, gram=gram), "bench-matches")
    runs = matches.groupBy(*_KEY).agg(F.collect_set(F.struct("back", "length")).alias("matches")).select(*digest, "matches")
    named = bench.select("size", F.col("around").alias("b_around"), F.col("place").alias("b_place"), F.col("item_id").cast("string").alias("item")).distinct()
    items = matches.join(named, ["size", "b_around", "b_place"]).select(*digest, "item").distinct()
    own = _salted(met.select("row_key", *digest, "places"), runs, _DIGEST, "row_key", "inner").groupBy("row_key").agg(F.collect_list(F.struct("places", "matches")).alias("runs"))
    covered = own.mapInArrow(_covered, "row_key long, n_hit long")
    listed = _salted(met.select("row_key", *digest), items, _DIGEST, "row_key", "inner").select("row_key", "item").distinct()
    listed = listed.groupBy("row_key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    out = parts.where("print is null").select("doc_id", "row_key", "n_words").join(covered, "row_key", "left").join(listed, "row_key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
