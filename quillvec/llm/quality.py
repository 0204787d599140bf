"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one pass over the bytes of a batch.  Trees are grown on the driver from a bounded
sample of labelled documents, on features cut into quantile bins, and kept as complete binary trees in
arrays, so that scoring a batch is `depth` array lookups for all documents and trees at once.

Defined results: null and empty texts have all statistics 0 and are scored like any other; labelled rows whose label or text row is
missing don't count; a document with several label rows, or a label of several documents, counts once for each pair; without training
rows, or with one label only, the score is the smoothed share of label 1; equal gains go to the first feature and cut; repeated rows are
scored each; other columns stay, and the score takes the place of a column of its name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from . import _text as T
from ._work import with_results

_LINES = T.separator_table((0x0A, 0x0A))
_SETS = {
    "lower": range(0x61, 0x7B),
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "space": (0x20, 0x09, 0x0B, 0x0C, 0x0D),
    "line": (0x0A,),
    "stop": b".,;:?",
    "mark": b"!",
    "symbol": b"#$%&*+/<=>@^_|~\\`",
    "bracket": b"()[]{}\"'-",
    "vowel": b"aeiouAEIOU",
    "wide": range(0x80, 0x100),
}
_MEMBER = np.zeros((256, len(_SETS)))
for _i, _set in enumerate(_SETS.values()):
    _MEMBER[list(_set), _i] = 1
FEATURES = [*(f"{x}_share" for x in _SETS), "log_bytes", "entropy", "commonest_byte_share", "log_words", "mean_word", "sd_word", "long_word_share", "one_byte_word_share", "capital_word_share", "symbol_end_share", "distinct_word_share", "commonest_word_share", "log_lines", "distinct_line_share", "mean_line", "distinct_triple_share"]


def _repetition(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: the share of distinct values, and of the commonest one."""
    distinct, most = np.zeros(len(firsts) - 1), np.zeros(len(firsts) - 1)
    for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(values[a:b])
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[i], most[i] = (len(cuts) - 1) / (b - a), np.diff(cuts).max() / (b - a)
    return distinct, most


def statistics(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, statistics) of runs of rows: one row for each text, one column for each of FEATURES."""
    for first, last, data, offsets in T.slices(texts):
        rows = last - first
        doc = np.repeat(np.arange(rows) * 256, np.diff(offsets))
        histogram = np.bincount(doc + data, minlength=rows * 256).reshape(rows, 256).astype(float)
        size = np.maximum(histogram.sum(1), 1)
        share = histogram / size[:, None]
        starts, ends, firsts = T.word_bounds(data, offsets, T.SPACED)
        n = np.diff(firsts)
        owner, length = np.repeat(np.arange(rows), n), (ends - starts).astype(float)
        per_word = lambda x: np.bincount(owner, x, rows) / np.maximum(n, 1)
        mean = per_word(length)
        last_byte, first_byte = (data[ends - 1], data[starts]) if len(starts) else (np.zeros(0, np.uint8),) * 2
        words = T.span_hashes(data, starts, ends)
        distinct, most = _repetition(words, firsts)
        line_starts, line_ends, line_firsts = T.word_bounds(data, offsets, _LINES)
        lines = np.diff(line_firsts)
        distinct_lines, _ = _repetition(T.span_hashes(data, line_starts, line_ends), line_firsts)
        ok, grams = T.per_document(firsts, 3)
        triples, _ = _repetition(T.gram_hashes(words, 3)[ok], np.concatenate([[0], np.cumsum(grams)]))
        columns = [
            *(share @ _MEMBER).T, np.log1p(histogram.sum(1)), -(share * np.log(np.maximum(share, 1e-300))).sum(1), share.max(1), np.log1p(n), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), per_word(length > 14), per_word(length == 1), per_word(_MEMBER[first_byte, 1]),
            per_word(_MEMBER[last_byte, 6] + _MEMBER[last_byte, 7]), distinct, most, np.log1p(lines), distinct_lines, histogram.sum(1) / np.maximum(lines, 1), triples,
        ]
        yield first, np.stack(columns, axis=1)


@dataclass
class Trees:
    """Complete binary trees: node i of a tree has the children 2 i + 1 and 2 i + 2; a value goes right if it exceeds the cut."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees)[None], np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return self.base + self.leaf[tree, at - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Boosts trees on binary labels with the logistic loss; least: hessian weight of a side of a split, at least."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if not len(y) or y.min() == y.max():
        return none
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin > b means x > cut b
    cell = binned + np.arange(width) * bins
    table = np.full((width, bins), np.inf)
    for j, c in enumerate(cuts):
        table[j, : len(c)] = c
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            begin, count = (1 << level) - 1, 1 << level
            at = ((node - begin)[:, None] * (width * bins) + cell).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (g, h))
            total_g, total_h = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
            gain[(hs < least) | (total_h - hs < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            real = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[begin : begin + count] = np.where(real, best // bins, 0)
            threshold[begin : begin + count] = np.where(real, table[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_train_rows: int = 16_000, **growing) -> Trees:
    """Learns from docs (doc_id, text) and labels (doc_id, label 0 or 1).

    max_train_rows: labelled rows to learn from, in expectation, chosen by a hash of id and text, so that neither the order of rows nor
    their files matter; 1.5 times that many at most, by the order of another such hash.
    """
    labels = labels.where(f"{label} is not null and doc_id is not null").select("doc_id", F.col(label).cast("double").alias("y"))
    n = labels.count()
    share = min(1.0, max_train_rows / max(n, 1))
    if share < 1:  # a label row of a text that is not drawn is not needed: ids first, as all texts of an id are about as likely
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.25 * share)))

    def run(batches):
        for batch in batches:
            y, place = batch.column("y").to_numpy(), batch.column("place")
            for first, x in statistics(batch.column("text")):
                yield pa.RecordBatch.from_arrays([place.slice(first, len(x)), pa.array(y[first : first + len(x)]), *map(pa.array, np.ascontiguousarray(x.T))], ["place", "y", *FEATURES])

    if labels.count() <= 2 * max_train_rows:
        labels = F.broadcast(labels)
    met = docs.select("doc_id", "text").join(labels, "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("place"))
    if share < 1:
        met = met.where(F.pmod("place", F.lit(1 << 30)) < int((1 << 30) * 0.8))
    known = met.mapInArrow(run, ", ".join(["place long", *(f"{x} double" for x in ["y", *FEATURES])]))
    rows = known.orderBy("place", "y", *FEATURES).limit(int(1.5 * max_train_rows)).drop("place").toPandas()  # a key with very many rows is cut off there
    rows = rows.sort_values(["y", *FEATURES])  # the same trees in whatever order rows come
    return grow(rows[FEATURES].to_numpy(), rows["y"].to_numpy(), **growing)


def score(docs: DataFrame, model: Trees, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stay, schema = with_results(docs.schema, StructField(score, DoubleType()))

    def run(batches):
        for batch in batches:
            for first, x in statistics(batch.column(batch.schema.get_field_index(text))):
                rows = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([*rows.select(stay).columns, pa.array(shared.value.score(x))], schema.names)

    return docs.mapInArrow(run, schema)
