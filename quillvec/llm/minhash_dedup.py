"""MinHash near-duplicate detection: many universal hash minima, banding, signature check, full check, components.

1. One scan gives each document its set of shingles, a digest of the set, `bands` band keys
   of `rows` minima each and a 128-bit sketch (one bit of each of 128 minima).  Documents with equal sets
   are one *node* from then on, so copies cost nothing further.
2. Nodes that share a band key meet in a bucket.  In each bucket every node is compared by sketch with two
   representatives, not with all others; nodes that may be linked with one make a *family*.
3. A small family is compared in full in one task.  A large one is cut into blocks of bounded size, and its most central nodes, those whose
   buckets are the fullest, are compared with every block.  What is linked with the most central one is one group; only the
   other nodes are then compared with all blocks.  So near copies of one text cost as much as they are many, and no link
   between groups is lost.  A task gives back a spanning forest of its links, never a row for each pair.
4. Pairs of a bucket in different families that the sketch allows are compared one by one.  So every pair of
   a bucket is judged.  Full buckets are cut into blocks too.
5. The links' components are the groups.

A pair at exactly the threshold shares no band with a probability of `miss` at most (1e-8); the
sketch check lets a true pair go with a probability below 1e-9.  Confirmation is on 64-bit shingle hashes.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and kept; a text with fewer
words than `width` has one shingle, the whole sequence; a null id is never a component's
id unless all ids of it are null; rows with repeated ids are kept or dropped together if their texts are linked; of equally central nodes the
one with the greatest digest stands first; a text of any length is taken whole; columns besides doc_id and text are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._work import BITS_EACH, MOST_BITS, bitmap, materialize, tidied
from .components import connected_components

_SKETCH = 128
#: Shingles in a block of a family, about, unless one set has more; nodes in a block of a bucket; central nodes of a large family.
BLOCK, CROSS, CENTRAL = 32_768, 512, 4
#: Parts in which rows of one family are joined with what is known of it.
_SALTS = 64


def document_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    starts, ends, firsts = T.word_bounds(data, offsets, T.SPACED)
    words = T.span_hashes(data, starts, ends)
    grams = T.gram_hashes(words, width)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield T.gram_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def set_node(s: np.ndarray) -> int:
    """A 64-bit digest of a set of hashes, which is the node of all documents with that set."""
    return int(np.int64(T.mix(np.array([T.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]))


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands so that a pair at the threshold shares none with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = T.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def _minima(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n minima of the upper half of a * x + b modulo 2**64 over each run of values: an array (n, runs)."""
    a, b = _hash_family(n)
    out = np.empty((n, len(starts)), np.uint32)
    held = np.empty_like(values)
    for i in range(n):
        np.multiply(values, a[i], out=held)
        np.add(held, b[i], out=held)
        out[i] = np.minimum.reduceat(held, starts) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, *, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, node, keys, s1, s2) of each row; node null and keys empty without shingles."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in T.slices(batch.column("text")):
                sets = list(document_sets(data, offsets, width))
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(full), bands), np.int64)
                sketch = np.zeros((len(full), 2), np.int64)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    low = _minima(np.concatenate([sets[i] for i in full]), starts, max(bands * rows, _SKETCH))
                    for j in range(bands):
                        acc = np.full(len(full), j + 1, np.uint64)
                        for i in range(j * rows, (j + 1) * rows):
                            acc = acc * np.uint64(0x9E3779B97F4A7C15) + low[i]
                        keys[:, j] = T.mix(acc).view(np.int64)
                    bits = (low[:_SKETCH] * np.uint32(0x9E3779B1) >> np.uint32(31)).T.astype(np.uint8)
                    sketch = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64).reshape(len(full), 2)
                node = np.zeros(len(sets), np.int64)
                node[full] = [set_node(sets[i]) for i in full]
                at = np.zeros(len(sets), np.int64)
                at[full] = np.arange(len(full))
                none = sizes == 0
                s1, s2 = (sketch[at, k] if len(full) else node for k in (0, 1))
                ends = np.concatenate([[0], np.cumsum(np.where(none, 0, bands))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(sizes), pa.array(node, mask=none), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())), pa.array(s1, mask=none), pa.array(s2, mask=none)],
                    ["doc_id", "n_shingles", "node", "keys", "s1", "s2"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_shingles long, node long, keys array<long>, s1 long, s2 long")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, items) of the wanted nodes (node, doc_id): their sets, as little-endian 64-bit hashes.

    A bitmap of the nodes lets each task leave out other documents' sets, so texts are not shuffled; where there are too many nodes for
    it, the documents are joined by id.
    """
    bits = None
    if wanted.count() * BITS_EACH <= 1 << MOST_BITS:
        bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("node")))
    else:
        docs = docs.join(wanted.select(F.col("doc_id").alias("wanted_id")), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches):
        held = None if bits is None else np.unpackbits(bits.value).view(bool)
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column("text")):
                sets = [(set_node(s), s) for s in document_sets(data, offsets, width) if len(s)]
                sets = [(node, s) for node, s in sets if held is None or held[node & (len(held) - 1)]]
                yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())], ["node", "items"])

    made = docs.select("text").mapInArrow(tidied(run), "node long, items binary")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, cut: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= cut * union of their full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= cut * (len(both) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def _alike(p: str, q: str, cut: int) -> F.Column:
    """Whether two nodes can be linked at all: by their sizes and 128 sketch bits."""
    share = (1 + cut / 100) / 2  # of equal bits, at the threshold
    most = math.ceil(_SKETCH * (1 - share) + 6.6 * math.sqrt(_SKETCH * share * (1 - share)))
    n1, n2 = F.col(f"{p}.n"), F.col(f"{q}.n")
    differ = F.bit_count(F.col(f"{p}.s1").bitwiseXOR(F.col(f"{q}.s1"))) + F.bit_count(F.col(f"{p}.s2").bitwiseXOR(F.col(f"{q}.s2")))
    return (100 * F.least(n1, n2) >= cut * F.greatest(n1, n2)) & (differ <= most)


def _star_pairs(members: DataFrame, turn: int, cut: int) -> DataFrame:
    """Every node of a bucket with the bucket's representative of this turn, where they can be linked."""
    rank = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    chosen = members.groupBy("key").agg(F.min_by(F.struct("node", "n", "s1", "s2"), rank).alias("r"))
    chosen = chosen.select("key", "r.*")
    met = members.alias("p").join(chosen.alias("q"), F.col("p.key") == F.col("q.key"))
    met = met.where((F.col("p.node") != F.col("q.node")) & _alike("p", "q", cut))
    return met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))


def _star_links(members: DataFrame, cut: int) -> DataFrame:
    """Links (a, b) that join each node with its buckets' representatives, which it can be linked with.

    A node of many buckets has as many representatives, of two turns each at most.  It is linked with the least of them and itself alone, and so are they:
    nodes near one another have the same ones, so a group of near copies has about as many links as nodes, not as many for each bucket.
    """
    stars = _star_pairs(members, 0, cut).unionByName(_star_pairs(members, 1, cut)).groupBy("a").agg(F.collect_set("b").alias("bs"))
    ends = stars.select(F.explode(F.array_append("bs", F.col("a"))).alias("a"), F.least("a", F.array_min("bs")).alias("b"))
    return ends.where("a != b").distinct()


def _cross_pairs(members: DataFrame, cut: int) -> DataFrame:
    """Every pair of a bucket in two families, where they can be linked; members: key, node, family, size (of the bucket), n and sketch."""
    several = members.groupBy("key").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low < high").select("key")
    blocks = F.ceil(F.col("size") / CROSS).cast("int")
    dealt = members.join(several, "key", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "node", "family", "n", "s1", "s2", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("key", "i", "j")]
    apart = (F.col("p.i") == F.col("p.j")) | (F.col("p.block") != F.col("q.block"))
    met = dealt.alias("p").join(dealt.alias("q"), same[0] & same[1] & same[2] & apart & (F.col("p.node") < F.col("q.node")) & (F.col("p.family") != F.col("q.family")) & _alike("p", "q", cut))
    return met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


class _Forest:
    """Links between some nodes that join no two that are joined already."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.root, self.a, self.b = nodes, np.arange(len(nodes)), [], []

    def link(self, k: int, others: np.ndarray) -> None:
        for m in others.tolist():
            if self.root[k] != self.root[m]:
                self.root[self.root == self.root[m]] = self.root[k]
                self.a.append(self.nodes[k])
                self.b.append(self.nodes[m])

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array(self.a, pa.int64()), "b": pa.array(self.b, pa.int64())})


def _compared(cut: int, asking: bool):
    """Links of one group of (node, items): of all pairs, or, if `asking`, of rows whose column `asks` is over 0 with all, those with small numbers first."""

    def run(group: pa.Table) -> pa.Table:
        askers = len(group)
        if asking:  # a row that asks stands first, and only once if it is among the others too
            asks = group["asks"].to_numpy()
            order = np.argsort(np.where(asks > 0, asks, np.iinfo(np.int32).max), kind="stable")
            _, first = np.unique(group["node"].to_numpy()[order], return_index=True)
            group = group.take(order[np.sort(first)])
            askers = int((group["asks"].to_numpy() > 0).sum())
        forest, parts = _Forest(group["node"].to_numpy()), [np.frombuffer(x.as_buffer(), np.uint64) for x in group["items"]]
        sizes = np.array([len(x) for x in parts], np.int64)
        shingles, flat = np.unique(np.concatenate(parts), return_inverse=True)
        starts, own = np.cumsum(sizes) - sizes, np.zeros(len(shingles), bool)
        for k in range(min(askers, len(parts) - 1)):
            low = k + 1  # the first of those it is compared with
            mine = flat[starts[k] : starts[k] + sizes[k]]
            own[mine] = True
            inter = np.add.reduceat(own[flat[starts[low] :]].astype(np.int32), starts[low:] - starts[low])
            own[mine] = False
            forest.link(k, np.flatnonzero(100 * inter >= cut * (sizes[k] + sizes[low:] - inter)) + low)
        return forest.table()

    return run


_LINK = "a long, b long"


def _salted(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """rows joined by family with known, one row of each large family, so that no task gets all rows of a family."""
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(_SALTS)).cast("int")).join(spread, ["family", "salt"], how).drop("salt")


def _family_links(families: DataFrame, sets: DataFrame, cut: int) -> DataFrame:
    """Links (a, b) that join what is linked inside families (node, family, n, weight)."""
    best = [F.max(F.when(F.pmod(F.xxhash64("node"), F.lit(CENTRAL)) == r, F.struct("weight", "node"))).alias(f"c{r}") for r in range(CENTRAL)]
    sizes = families.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), *best).where("blocks > 1")
    centres = F.array_compact(F.array(*[F.col(f"c{r}") for r in range(CENTRAL)]))
    centres = F.transform(F.reverse(F.array_sort(centres)), lambda c: c["node"])
    large = materialize(sizes.select("family", "blocks", centres.alias("centres")), "minhash-large")  # a row for BLOCK shingles, at most
    if not large.limit(1).count():
        return families.join(sets, "node").groupBy("family").applyInArrow(_compared(cut, False), _LINK)
    placed = materialize(_salted(families.select("node", "family", "n"), large.select("family", "blocks"), "left"), "minhash-placed")
    links = placed.where("blocks is null").join(sets, "node").groupBy("family").applyInArrow(_compared(cut, False), _LINK)

    # the central nodes of a large family with all of its blocks, the most central one first
    big = placed.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = large.select("family", "blocks", F.posexplode("centres").alias("asks", "node")).select("family", "node", every.alias("block"), F.col("asks") + 1)
    asked = asked.toDF("family", "node", "block", "asks").unionByName(big.select("family", "node", "block", F.lit(0).alias("asks")))
    central = materialize(asked.join(sets, "node").groupBy("family", "block").applyInArrow(_compared(cut, True), _LINK), "minhash-central")
    links = links.unionByName(central)

    # what is not linked with the most central node with all blocks
    first = large.select(F.col("centres")[0].alias("a"))
    settled = central.join(first, "a", "left_semi").select(F.col("b").alias("node")).unionByName(first.select(F.col("a").alias("node"))).distinct()
    marked = materialize(big.join(settled.withColumn("settled", F.lit(True)), "node", "left"), "minhash-marked")
    loose = marked.where("settled is null")
    left = materialize(loose.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("loose")), "minhash-loose")
    if not left.limit(1).count():
        return links
    rest = _salted(marked, left, "inner")
    asking = rest.where("settled is null").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("loose")).cast("int"))
    asking = asking.select("family", "node", "part", every.alias("block"), F.lit(1).alias("asks"))
    others = rest.select("family", "node", F.explode(F.sequence(F.lit(0), F.col("loose") - 1)).alias("part"), "block", F.lit(0).alias("asks"))
    return links.unionByName(asking.unionByName(others).join(sets, "node").groupBy("family", "part", "block").applyInArrow(_compared(cut, True), _LINK))


def near_duplicates(docs: DataFrame, *, percent: int = 80, width: int = 5, rows: int = 6, miss: float = 1e-8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    percent: least similarity of a link.  width: words of a shingle.  rows: minima in a band.
    miss: bounds the chance that a pair at the threshold shares no band.
    """
    docs = docs.select("doc_id", "text")
    sig = materialize(signatures(docs, width=width, bands=bands_for(percent / 100, rows, miss), rows=rows), "minhash")
    some = sig.where("node is not null")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("keys").alias("keys"))
    buckets = nodes.select("node", "doc_id", "n", "s1", "s2", F.explode("keys").alias("key"))
    shared = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(buckets.join(shared, "key"), "minhash-members")

    family = connected_components(_star_links(members, percent)).withColumnRenamed("comp", "family")
    placed = members.drop("doc_id").join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))
    pairs = materialize(_cross_pairs(placed, percent), "minhash-pairs")
    wanted = family.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    each = members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.sum("size").alias("weight"))
    wanted = materialize(each.join(wanted, "node", "left_semi"), "minhash-wanted")
    sets = materialize(_sets_of(docs, wanted, width), "minhash-sets")
    links = _family_links(family.join(wanted.select("node", "n", "weight"), "node"), sets, percent).unionByName(_confirm(pairs, sets, percent))
    labels = connected_components(links)

    by_node = some.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_comp = by_node.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    placed = by_node.select("node", "comp").join(by_comp, "comp").select("node", "component_id")
    out = some.select("doc_id", "n_shingles", "node").join(placed, "node").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(sig.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
