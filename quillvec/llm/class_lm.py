"""Brown class-based bigram language model with exchange clustering.

    P(text) = product over tokens of P(class | previous class) * P(token | class)

Emissions are smoothed by absolute discounting: P(word | c) = (n - D) / (N_c + 1), and the one unseen word
of each class has (D V_c + 1) / (N_c + 1), with D = n1 / (n1 + 2 n2); the sum over a class is 1.

Every word has a class of its own.  Classes are found in two steps.  First, words whose share of the training tokens is at least
`head_share` and, for all others, `SUFFIX_UNITS` buckets of first and last bytes are the units of an exact exchange on the
driver; there are at most 1 / head_share + SUFFIX_UNITS of them.  Then every other training word, however rare, starts in the
class of its bucket and is moved by itself, in `BATCHES` batches: the classes before and after all of its occurrences are
kept as a distributed table, and it goes to the class that raises the class bigram likelihood most, given the class
bigrams after the batches before.  Its neighbours count with the classes they started in.  Only words
that training never saw take the class of their bucket.  The end of a text is a class of its own.

The class bigrams of the model are counted anew from the final classes of all tokens.  Words with a share of `known_share` or more
of all tokens, of held-out texts too, are looked up in an array (at most 1 / known_share + 1 / head_share entries), rarer ones by a join; so
no key of the join has more than that share of the rows.  `tag` makes that join once for training and held-out texts alike: it gives the class of every
token, from which the bigrams are counted and the texts scored.

Defined results: a null or empty text is the end token alone; a null id is in the
training part of `bucket_of`'s empty text; repeated ids and repeated rows are scored each; equal gains go to the first class, and words
that gain nothing stay; without training rows every count is 0 and probabilities stay finite; an empty table gives no rows; columns besides doc_id,
text and held_out are not read, whatever their names; a text of any length is one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._work import materialize, tidied

#: Buckets in which words that are no unit of the first step start; a power of two, kept in the low bits of a word's key.
SUFFIX_UNITS = 512
#: Parts in which the words move one after the other; a power of two, by the key's bits above the bucket.
BATCHES = 4
_CHUNK = 2_000_000


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of words: the upper bits a hash, the lower bits the suffix unit."""
    if not len(starts):
        return np.zeros(0, np.int64)
    low = T.lowered(data)
    last2 = np.maximum(ends - 2, starts)
    shape = low[starts].astype(np.uint64) | low[ends - 1].astype(np.uint64) << np.uint64(8) | low[last2].astype(np.uint64) << np.uint64(16)
    unit = T.mix(shape + np.uint64(77)) & np.uint64(SUFFIX_UNITS - 1)
    return (T.span_hashes(data, starts, ends) & ~np.uint64(SUFFIX_UNITS - 1) | unit).view(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, last row + 1, word keys, first word of each row) of slices."""
    for batch in batches:
        for first, last, data, offsets in T.slices(batch.column("text")):
            starts, ends, firsts = T.word_bounds(data, offsets, T.SPACED)
            yield batch, first, last, word_keys(data, starts, ends), firsts


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n, n_all) over all words of column `text`, n without rows that are `held_out`; summed within a task before the shuffle."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, own = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, np.bincount(at, own, len(keys)).astype(np.int64), n.astype(np.int64))], ["key", "n", "n_all"])

        for batch, first, last, keys, firsts in _tokens(batches):
            own = ~batch.column("held_out").slice(first, last - first).to_numpy(zero_copy_only=False)
            held.append((keys, np.repeat(own, np.diff(firsts))))
            size += len(keys)
            if size >= _CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counted = _marked(docs).select("text", "held_out").mapInArrow(tidied(count), "key long, n long, n_all long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def _marked(docs: DataFrame) -> DataFrame:
    """docs with `held_out`, which is false where it is missing or null."""
    return docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)) if "held_out" in docs.columns else F.lit(False))


def _unit_rows(keys: np.ndarray, firsts: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Unit of every token, with the end (unit 0) after each document: one array for a slice."""
    at = np.searchsorted(head, keys)
    at[at == len(head)] = 0
    own = (head[at] == keys) if len(head) else np.zeros(len(keys), bool)
    unit = np.where(own, at + 1, 1 + len(head) + (keys & (SUFFIX_UNITS - 1)))
    return np.insert(unit, firsts[1:], 0)


def count_unit_bigrams(docs: DataFrame, head: np.ndarray) -> DataFrame:
    """(cell, n): cell = previous unit * units + unit, over all texts; the end also stands before a text."""
    units = 1 + len(head) + SUFFIX_UNITS

    def count(batches):
        total, held, size = np.zeros(units * units, np.int32), [], 0

        def add():
            nonlocal total
            total += np.bincount(np.concatenate(held), minlength=units * units).astype(np.int32)

        for _, _, _, keys, firsts in _tokens(batches):
            unit = _unit_rows(keys, firsts, head)
            before = np.empty_like(unit)
            before[1:] = unit[:-1]
            before[0] = 0
            held.append(before * units + unit)
            size += len(unit)
            if size >= _CHUNK:
                add()
                held, size = [], 0
        if held:
            add()
        cells = np.flatnonzero(total)
        for i in range(0, len(cells), 1 << 18):
            part = cells[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])

    return docs.select("text").mapInArrow(tidied(count), "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of every unit, by exchange clustering of a unit bigram matrix; unit 0 keeps class 0 to itself.

    Starts with the most frequent units dealt over the classes; then each unit moves
    to the class with the greatest likelihood, with exact counts after every move, until a sweep moves none.
    """
    units = len(bigrams)
    freq = bigrams.sum(1)
    order = np.argsort(-freq[1:], kind="stable") + 1
    of = np.zeros(units, np.int64)
    of[order] = np.arange(len(order)) % (classes - 1) + 1
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # counts of a unit before and after each class
    joint = member.T @ right
    single = joint.sum(1)
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if freq[u] == 0:
                continue
            a, own, n = of[u], bigrams[u, u], freq[u]
            r, le = right[u].copy(), left[u].copy()
            r[a] -= own
            le[a] -= own
            joint[a] -= r
            joint[:, a] -= le
            joint[a, a] -= own
            single[a] -= n
            diagonal = np.diag(joint)
            gain = (xlogx(joint + r) - xlogx(joint)).sum(1) + (xlogx(joint + le[:, None]) - xlogx(joint)).sum(0)
            gain -= xlogx(diagonal + r) + xlogx(diagonal + le) - xlogx(diagonal)
            gain += xlogx(diagonal + r + le + own)
            gain -= 2 * (xlogx(single + n) - xlogx(single))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += r
            joint[:, b] += le
            joint[b, b] += own
            single[b] += n
            if b != a:
                of[u] = b
                moved += 1
                right[:, a] -= bigrams[:, u]
                right[:, b] += bigrams[:, u]
                left[:, a] -= bigrams[u]
                left[:, b] += bigrams[u]
        if not moved:
            break
    return of


def count_contexts(docs: DataFrame, head: np.ndarray, of: np.ndarray) -> DataFrame:
    """(key, part, around): of words outside `head`, the classes before and after each occurrence, a byte each; some rows for a key."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            around = np.stack([left[order], right[order]], 1)
            offsets = (2 * np.append(at, len(keys))).astype(np.int32)
            own = keys[at]
            part = (own // SUFFIX_UNITS & (BATCHES - 1)).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(around)])
            for i in range(0, len(at), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (own, part)] + [data.slice(i, 1 << 18)], ["key", "part", "around"])

        for _, _, _, keys, firsts in _tokens(batches):
            unit = _unit_rows(keys, firsts, head)
            cls = of[unit].astype(np.uint8)
            where = np.arange(len(keys)) + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))  # of words among the units
            before = np.concatenate([[0], cls[:-1]]).astype(np.uint8)
            tail = unit[where] > len(head)
            where = where[tail]
            held.append((keys[tail], before[where], cls[where + 1]))
            size += len(where)
            if size >= _CHUNK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.select("text").mapInArrow(tidied(count), "key long, part int, around binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(word: np.ndarray, ctx: np.ndarray, n: np.ndarray, own: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class of each word with the greatest class bigram likelihood, each word taken by itself.

    word, ctx, n: sparse counts, ordered by word; ctx is the class before, or `classes` and the class after.  own: their classes in `joint`.
    """
    classes = len(joint)
    cells = np.concatenate([joint, joint.T])  # ctx, class: the bigrams of a context and a class
    single = (joint.sum(0) + joint.sum(1)) / 2
    small = 16
    table = np.stack([_xlogx(cells + k) - _xlogx(cells) for k in range(1, small + 1)]).reshape(-1, classes)
    total = np.bincount(word, n, len(own)) / 2
    best = own.copy()
    firsts = np.searchsorted(word, np.arange(len(own) + 1))
    low = 0
    while low < len(own):
        high = max(low + 1, int(np.searchsorted(firsts, firsts[low] + 100_000, side="right")) - 1)
        i = slice(firsts[low], firsts[high])
        c, k, a = ctx[i], n[i], own[low:high]
        part = table[(np.minimum(k, small) - 1) * 2 * classes + c]
        many = np.flatnonzero(k > small)
        part[many] = _xlogx(cells[c[many]] + k[many, None]) - _xlogx(cells[c[many]])
        mine = a[word[i] - low]
        part[np.arange(len(c)), mine] = _xlogx(cells[c, mine]) - _xlogx(np.maximum(cells[c, mine] - k, 0))
        gain = np.add.reduceat(part, firsts[low:high] - firsts[low], axis=0)
        rows, t = np.arange(high - low), total[low:high]
        alone = _xlogx(single + t[:, None]) - _xlogx(single)
        alone[rows, a] = _xlogx(single[a]) - _xlogx(np.maximum(single[a] - t, 0))
        gain -= 2 * alone
        gain[:, 0] = -np.inf
        to = gain.argmax(1)
        best[low:high] = np.where(gain[rows, to] > gain[rows, a] + 1e-9, to, a)
        low = high
    return best


def move_words(contexts: DataFrame, of: np.ndarray, joint: np.ndarray) -> DataFrame:
    """(key, n, cls, cell, d): the class of each word; and, with a null key, changes d of cells of the class bigrams.

    of: class of each bucket.  joint: class bigrams before.
    """
    classes = len(joint)

    def move(batches):
        held = [(b.column("key").to_numpy(), b.column("around")) for b in batches if b.num_rows]
        if not held:
            return
        sizes = np.concatenate([np.diff(np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]) for _, a in held]) // 2
        flat = np.concatenate([np.frombuffer(a.buffers()[2], np.uint8)[slice(*np.frombuffer(a.buffers()[1], np.int32)[[a.offset, a.offset + len(a)]])] for _, a in held]).reshape(-1, 2)
        keys, word = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        word = np.repeat(word, sizes)
        cell, n = np.unique(np.concatenate([word * 2 * classes + flat[:, 0], (word * 2 + 1) * classes + flat[:, 1]]), return_counts=True)
        word, ctx = np.divmod(cell, 2 * classes)
        own = of[keys & (SUFFIX_UNITS - 1)]
        best = best_classes(word, ctx, n, own, joint)
        count = np.bincount(word, n, len(keys)).astype(np.int64) // 2
        side, c = np.divmod(ctx, classes)
        change = np.zeros(classes * classes, np.int64)
        for sign, cls in ((-1, own[word]), (1, best[word])):
            change += sign * np.bincount(np.where(side == 0, c * classes + cls, cls * classes + c), n, classes * classes).astype(np.int64)
        names, void = ["key", "n", "cls", "cell", "d"], pa.nulls
        for i in range(0, len(keys), 1 << 18):
            part = [pa.array(x[i : i + (1 << 18)]) for x in (keys, count, best.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*part, void(len(part[0]), pa.int32()), void(len(part[0]), pa.int64())], names)
        at = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays([void(len(at), pa.int64()), void(len(at), pa.int64()), void(len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(change[at])], names)

    return contexts.select("key", "around").repartition("key").mapInArrow(tidied(move), "key long, n long, cls int, cell int, d long")


@dataclass
class ClassModel:
    """A trained model.  Arrays have fixed maximal sizes; `rare` holds the counts of all other words."""

    head: np.ndarray  # sorted keys of the words that are looked up without a join
    of: np.ndarray  # class of the end, of each of those words, and of unseen words by bucket
    head_n: np.ndarray  # their training counts, 0 for words that only held-out texts have
    rare: DataFrame  # (key, n, cls) of all training words that are not in `head`
    tokens: int  # N: training tokens, ends included
    types: int  # V: distinct training tokens, the end included
    ends: int
    discount: float
    share: np.ndarray  # log10 of the denominator of P(word | class)
    unseen: np.ndarray  # log10 of the numerator of an unseen word of each class
    prior: float
    transition: np.ndarray | None = None  # log10 P(class | previous class)


#: Class of a token whose word is not looked up in an array, until it is joined.
_OPEN = 255


def train_classes(docs: DataFrame, *, classes: int = 64, sweeps: int = 8, head_share: float = 1e-3, known_share: float = 1e-6, prior: float = 50.0) -> ClassModel:
    """Clusters the words of column `text` of docs; rows that are `held_out` only tell which words are frequent there.

    classes, sweeps: of the exchange clustering.  prior: weight of the class frequencies in the smoothed transitions, which are yet to be counted.
    """
    if classes > _OPEN:
        raise ValueError("a class takes one byte")
    docs = _marked(docs).select("text", "held_out")
    own_docs = docs.where("not held_out").select("text")
    counts = materialize(count_words(docs), "lm-counts")
    ends, all_ends = docs.agg(F.count(F.when(~F.col("held_out"), 1)), F.count("*")).first()
    of_n = lambda k: F.count(F.when(F.col("n") == k, 1))
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_all")]
    n_words, n_all, kinds, once, twice = counts.agg(*sums, F.count(F.when(F.col("n") > 0, 1)), of_n(1), of_n(2)).first()
    tokens, types = n_words + ends, kinds + (ends > 0)
    unit = max(1.0, tokens * head_share)
    frequent = (F.col("n_all") >= max(1.0, (n_all + all_ends) * known_share)) | (F.col("n") >= unit)
    known = counts.where(frequent).select("key", "n").toPandas().sort_values("key")
    known_key, known_n = known["key"].to_numpy(np.int64), known["n"].to_numpy(np.int64)
    head = known_key[known_n >= unit]
    units = 1 + len(head) + SUFFIX_UNITS
    cells = count_unit_bigrams(own_docs, head).toPandas()
    bigrams = np.zeros(units * units)
    bigrams[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    bigrams = bigrams.reshape(units, units)
    of = exchange(bigrams, classes, sweeps)
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    joint = member.T @ bigrams @ member
    contexts = materialize(count_contexts(own_docs, head, of), "lm-contexts")
    buckets, moved = of[1 + len(head) :], []
    for part in range(BATCHES):
        done = materialize(move_words(contexts.where(F.col("part") == part), buckets, joint), "lm-classes")
        change = done.where("key is null").groupBy("cell").agg(F.sum("d").alias("d")).toPandas()
        joint.ravel()[change["cell"].to_numpy(np.int64)] += change["d"].to_numpy(np.float64)
        joint = np.maximum(joint, 0)  # neighbours that both moved are counted by their first classes
        moved.append(done.where("key is not null").select("key", "n", "cls"))
    words = reduce(DataFrame.unionByName, moved)
    looked_up = F.broadcast(counts.where(frequent).select("key"))  # 1 / known_share + 1 / head_share rows at most
    met = words.join(looked_up, "key", "left_semi").toPandas()
    known_cls = buckets[known_key & (SUFFIX_UNITS - 1)].copy()
    known_cls[np.searchsorted(known_key, met["key"].to_numpy(np.int64))] = met["cls"]
    known_cls[np.searchsorted(known_key, head)] = of[1 : 1 + len(head)]
    rare = words.join(looked_up, "key", "left_anti")
    by_class = rare.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    class_n, class_v = np.bincount(known_cls, known_n, classes).astype(float), np.bincount(known_cls[known_n > 0], minlength=classes).astype(float)
    class_n[by_class["cls"].to_numpy(np.int64)] += by_class["n"].to_numpy(np.float64)
    class_v[by_class["cls"].to_numpy(np.int64)] += by_class["v"].to_numpy(np.float64)
    discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
    share, unseen = np.log10(class_n + 1), np.log10(discount * class_v + 1)
    return ClassModel(known_key, np.concatenate([[0], known_cls, buckets]), known_n, rare, tokens, types, ends, discount, share, unseen, prior)


def with_transitions(model: ClassModel, tagged: DataFrame) -> ClassModel:
    """The model with the class bigrams of tagged (classes) texts: previous class and class of every token; the end also stands before a text."""
    n = len(model.share)

    def count(batches):
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            cls, before, _ = _sequence(batch.column("classes"))
            total += np.bincount(before * n + cls, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    cells = tagged.select("classes").mapInArrow(tidied(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    joint = np.zeros(n * n)
    joint[cells["cell"].to_numpy(np.int64)] = cells["n"]
    joint = joint.reshape(n, n)
    prior_share = (joint.sum(0) + 1) / (joint.sum() + n)
    return replace(model, transition=np.log10((joint + model.prior * prior_share) / (joint.sum(1, keepdims=True) + model.prior)))


def train(docs: DataFrame, **options) -> ClassModel:
    """Learns from column `text` of all rows of docs that are not `held_out`; options: of train_classes."""
    model = train_classes(docs, **options)
    own = _marked(docs).where("not held_out").select(F.lit(0).alias("doc_id"), "text")
    return with_transitions(model, tag(own, model))


def _sequence(classes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every token of some rows, the class before it, and each row's offset."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(classes).to_numpy(zero_copy_only=False))]).astype(np.int64)
    cls = np.frombuffer(b"".join(classes.to_pylist()), np.uint8).astype(np.int64)
    return cls, np.concatenate([[0], cls[:-1]])[: len(cls)], offsets


def _spread(row_key: pa.Array) -> pa.Array:
    return pa.array(T.mix(row_key.to_numpy().view(np.uint64)).view(np.int64))


def _looked_up(keys: np.ndarray, firsts: np.ndarray, head: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row and place of each word of a slice; the words `head` lacks; the classes of the tokens of each row, _OPEN for those words."""
    unit = _unit_rows(keys, firsts, head)
    rows, n = len(firsts) - 1, np.diff(firsts)
    cls = np.where(unit > len(head), _OPEN, of[unit]).astype(np.uint8)
    doc = np.repeat(np.arange(rows), n)
    pos = np.arange(len(keys)) - firsts[:-1][doc]
    missed = np.flatnonzero(cls[np.arange(len(keys)) + doc] == _OPEN)
    return doc, pos.astype(np.int32), missed, _bytes_of(cls, firsts + np.arange(rows + 1))


def _bytes_of(cls: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(cls)])


def tag(docs: DataFrame, model: ClassModel, *, base_delta: float = 0.1) -> DataFrame:
    """docs' doc_id and held_out with n_tokens, n_known, base_score, points (log10 of the emissions' numerators) and classes, a byte for each token."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.head, model.of, model.head_n))
    base_all = float(np.log10(model.tokens + base_delta * (model.types + 1)))
    discount, ends, unseen = model.discount, model.ends, model.unseen
    docs = _marked(docs).select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "row_key", "key", "classes", "pos", "n_tokens", "n_known", "base_score", "points"]
    fields = f"doc_id {kind}, held_out boolean, row_key long, key long, classes binary, pos int, n_tokens long, n_known long, base_score double, points double"

    def run(batches):
        head, of, head_n = shared.value
        known_log = np.where(head_n > 0, np.log10(np.maximum(head_n - discount, 1e-300)), unseen[of[1 : 1 + len(head)]])
        known_base = np.log10(head_n + base_delta) - base_all
        end_base = np.log10(ends + base_delta) - base_all
        for batch, first, last, keys, firsts in _tokens(batches):
            rows, n = last - first, np.diff(firsts)
            doc, pos, missed, data = _looked_up(keys, firsts, head, of)
            hit = np.ones(len(keys), bool)
            hit[missed] = False
            at, by = np.searchsorted(head, keys[hit]), doc[hit]
            points, base = np.bincount(by, known_log[at], rows).astype(float), np.bincount(by, known_base[at], rows) + end_base
            known = np.bincount(by, head_n[at] > 0, rows).astype(np.int64) + (ends > 0)
            row_key = batch.column("row_key").slice(first, rows)
            own = [batch.column(c).slice(first, rows) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*own, row_key, _spread(row_key), data, pa.nulls(rows, pa.int32()), *map(pa.array, (n + 1, known, base, points))], names)
            if len(missed):
                blank = lambda kind, m=len(missed): pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays(
                    [blank(batch.schema.field("doc_id").type), blank(pa.bool_()), pa.array(row_key.to_numpy()[doc[missed]]), pa.array(keys[missed]), blank(pa.binary()), pa.array(pos[missed]), blank(pa.int64()), blank(pa.int64()), blank(pa.float64()), blank(pa.float64())],
                    names,
                )

    def close(batches):
        for batch in batches:
            cls, _, offsets = _sequence(batch.column("classes"))
            places = batch.column("places")
            place, row = (f(places).to_numpy(zero_copy_only=False).astype(np.int64) for f in (pc.list_flatten, pc.list_parent_indices))
            cls[offsets[row] + (place >> 8)] = place & 255
            kept = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "points")]
            yield pa.RecordBatch.from_arrays([*kept, _bytes_of(cls.astype(np.uint8), offsets)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "points", "classes"])

    met = docs.mapInArrow(tidied(run), fields).join(model.rare.withColumnRenamed("n", "c"), "key", "left")
    word = F.col("pos").isNotNull()
    c = F.coalesce(F.col("c"), F.lit(0))
    listed = lambda x: F.array(*[F.lit(float(v)) for v in x])
    bucket = F.element_at(listed(model.of[1 + len(model.head) :]), (F.col("key").bitwiseAND(SUFFIX_UNITS - 1) + 1).cast("int")).cast("int")
    cls = F.coalesce(F.col("cls"), bucket)
    rows = met.groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("classes").alias("classes"),
        F.collect_list(F.when(word, F.col("pos").cast("long") * 256 + cls)).alias("places"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(word, F.when(c > 0, 1).otherwise(0)).otherwise(F.col("n_known"))).cast("long").alias("n_known"),
        F.sum(F.when(word, F.log10(c + base_delta) - base_all).otherwise(F.col("base_score"))).alias("base_score"),
        F.sum(F.when(word, F.when(c > 0, F.log10(c - discount)).otherwise(F.element_at(listed(unseen), cls + 1))).otherwise(F.col("points"))).alias("points"),
    )
    return rows.drop("row_key").mapInArrow(tidied(close), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, points double, classes binary")


def scored(tagged: DataFrame, model: ClassModel) -> DataFrame:
    """Tagged rows' doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and perplexity."""
    small = tagged.sparkSession.sparkContext.broadcast((model.transition, model.share))
    kind = tagged.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        transition, share = small.value
        for batch in batches:
            cls, before, offsets = _sequence(batch.column("classes"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            worth = transition[before, cls] - share[cls]
            worth[offsets[1:] - 1] += share[0]  # the end is the only token of its class
            points = np.bincount(row, worth, batch.num_rows) + batch.column("points").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(points)], names)

    out = tagged.mapInArrow(tidied(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def score(docs: DataFrame, model: ClassModel, *, base_delta: float = 0.1) -> DataFrame:
    """One row for each row of docs (doc_id, text, perhaps held_out), as `scored` gives them."""
    return scored(tag(docs, model, base_delta=base_delta), model)


def train_and_score(docs: DataFrame, *, base_delta: float = 0.1, **options) -> DataFrame:
    """Learns from the rows of docs (doc_id, text, held_out) that are not held out and scores all, tagging each text once."""
    model = train_classes(docs, **options)
    tagged = materialize(tag(docs, model, base_delta=base_delta), "lm-tagged")
    return scored(tagged, with_transitions(model, tagged.where("not held_out")))
