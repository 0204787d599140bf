"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  The probability of a word is
the sum over all its segmentations into pieces, by a forward algorithm; that of a text is the product over its words.
Pieces never cross words, so words are scored once per task and remembered.  Training is
expectation maximisation: a forward-backward pass over the (language, word, count) table gives the expected
piece counts.

Words are maximal runs of letters of the lower-cased text, with a word-start mark before them, and whole however
long; the passes over long words are rescaled.  A letter outside the vocabulary is the piece `other`.

Defined results: null and letterless texts are `und` with score 0; equal likelihoods go to the first
language in sort order; without labelled training rows every text is `und`.  Words count wherever they stand; repeated rows are judged
each; other columns stay, and a result column takes the place of one of its name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from . import _text as T
from ._encoding import Memo
from ._work import materialize, tidied, with_results

#: Letters after which the passes over a word are rescaled.
RESCALE = 16
#: Places of pieces that are held at once, about: 8 MB.
CELLS = 1 << 20
#: Letters in a piece, at most; a vocabulary with longer pieces is refused.
LONGEST = 64
MARK = "▁"
UNDECIDED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBER = 100_000


def read_pieces(path: str) -> list[str]:
    """The pieces of a public vocabulary that consist of letters, lower-cased, and the word-start mark; sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    pieces = sorted(p for p in pieces if p == MARK or p.removeprefix(MARK).isalpha())
    if max(map(len, pieces), default=0) > LONGEST:
        raise ValueError(f"a piece of more than {LONGEST} letters")
    return pieces


def _code_points(s: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, s)])
    return np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def _prefix(codes: np.ndarray) -> np.ndarray:
    up, _ = T._power_tables(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(T.mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=out[1:])
    return out


class _KeyTable:
    """Places of distinct 64-bit keys, by hash tables of which each holds the keys that shared a slot in the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels, todo = keys, [], np.arange(len(keys))
        while len(todo):
            bits = max(4, (8 * len(todo)).bit_length())
            at = self._slot(keys[todo], bits, len(self.levels))
            slots, more = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            _, first = np.unique(at, return_index=True)
            slots[at[first]] = todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            more[at[rest]] = True
            self.levels.append((bits, slots, more))
            todo = todo[rest]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((keys if level == 0 else T.mix(keys + np.uint64(level))) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out, todo = np.full(len(keys), -1, np.int64), slice(None)
        for level, (bits, slots, more) in enumerate(self.levels):
            own = keys[todo]
            slot = self._slot(own, bits, level)
            at = slots[slot]
            hit = (at >= 0) & (self.keys[at] == own)
            out[todo] = np.where(hit, at, -1)
            left = np.flatnonzero(more[slot] & ~hit)
            if not len(left):
                break
            todo = left if isinstance(todo, slice) else todo[left]
        return out


class Lattice:
    """Finds the pieces of words.  Piece len(pieces) is `other`, the one after it is no piece."""

    def __init__(self, pieces: list[str]):
        self.other, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        codes, ends = _code_points(pieces)
        self.table = _KeyTable(self._keys(_prefix(codes), ends[:-1], np.diff(ends)))

    @staticmethod
    def _keys(prefix, starts, size):
        _, down = T._power_tables(len(prefix))
        return T.mix((prefix[starts + size] - prefix[starts]) * down[starts] + np.asarray(size, np.uint64))

    def groups(self, words: list[str]):
        """(indexes of words of one length, ids): ids[l - 1][:, i] is the piece of l letters from i on; some `CELLS` places at once."""
        codes, ends = _code_points(words)
        prefix, lengths = _prefix(codes), np.diff(ends)
        order = np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if not len(same):
                continue
            n = int(lengths[same[0]])
            step = max(1, CELLS // (n * min(self.longest, n)))
            for low in range(0, len(same), step):
                which = same[low : low + step]
                at = ends[which][:, None] + np.arange(n)
                ids = []
                for size in range(1, min(self.longest, n) + 1):
                    starts = at[:, : n - size + 1]
                    found = self.table.find(self._keys(prefix, starts.ravel(), size)).reshape(starts.shape)
                    ids.append(np.where(found >= 0, found, self.other if size == 1 else self.none))
                yield which, n, ids

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the summed probability of each word in each language; p: (pieces and other and none, languages)."""
        out = np.empty((len(words), p.shape[1]))
        for which, n, ids in self.groups(words):
            alpha, scale = np.zeros((n + 1, len(which), p.shape[1])), np.zeros((len(which), p.shape[1]))
            alpha[0] = 1
            for j in range(1, n + 1):
                for size in range(1, min(self.longest, j) + 1):
                    piece = ids[size - 1][:, j - size]
                    some = np.flatnonzero(piece != self.none)
                    if len(some) == len(which):
                        alpha[j] += alpha[j - size] * p[piece]
                    elif len(some):
                        alpha[j, some] += alpha[j - size, some] * p[piece[some]]
                if j % RESCALE == 0 and j < n:
                    by = alpha[j].copy()
                    alpha[max(0, j - self.longest) : j + 1] /= by
                    scale += np.log(by)
            out[which] = np.log(alpha[n]) + scale
        return out

    def expected(self, words: list[str], lang: np.ndarray, n_of: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of (piece, language), of words with a language and a count each."""
        total = np.zeros(p.size)
        for which, n, ids in self.groups(words):
            own = lang[which]
            prob = [p[i, own[:, None]] for i in ids]
            alpha, beta = np.zeros((n + 1, len(which))), np.zeros((n + 1, len(which)))
            a_scale, b_scale = np.zeros_like(alpha), np.zeros_like(beta)  # logs
            alpha[0] = beta[n] = 1
            for j in range(1, n + 1):
                a_scale[j] = a_scale[j - 1]
                for size in range(1, min(self.longest, j) + 1):
                    alpha[j] += alpha[j - size] * prob[size - 1][:, j - size]
                if j % RESCALE == 0 and j < n:
                    window, by = slice(max(0, j - self.longest), j + 1), alpha[j].copy()
                    alpha[window] /= by
                    a_scale[window] += np.log(by)
            for i in range(n - 1, -1, -1):
                b_scale[i] = b_scale[i + 1]
                for size in range(1, min(self.longest, n - i) + 1):
                    beta[i] += beta[i + size] * prob[size - 1][:, i]
                if (n - i) % RESCALE == 0 and i:
                    window, by = slice(i, min(n, i + self.longest) + 1), beta[i].copy()
                    beta[window] /= by
                    b_scale[window] += np.log(by)
            weight = n_of[which] / alpha[n]
            for size in range(1, min(self.longest, n) + 1):
                gamma = alpha[: n - size + 1].T * prob[size - 1] * beta[size : n + 1].T * weight[:, None]
                if n > RESCALE:
                    gamma *= np.exp(a_scale[: n - size + 1] + b_scale[size : n + 1] - a_scale[n]).T
                total += np.bincount((ids[size - 1] * p.shape[1] + own[:, None]).ravel(), gamma.ravel(), p.size)
        return total.reshape(p.shape)


def text_words(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def word_parts(word: str) -> list[str]:
    """A word's letters with the mark before them; none without letters."""
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    return [MARK + word] if word else []


@dataclass
class LanguageModel:
    pieces: list[str]
    languages: list[str]
    p: np.ndarray
    prior: np.ndarray  # log


def train(docs: DataFrame, vocabulary: str, *, max_train_docs: int = 20_000, rounds: int = 4, smoothing: float = 0.05) -> LanguageModel:
    """Learns from columns text and lang of docs; rows with a null lang don't count.

    max_train_docs: documents to learn from, in expectation, chosen by a hash of id and text, so that neither the order of rows nor
    their files matter; all where there are fewer.  Rows that repeat both are drawn together.
    """
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary)
    docs = docs.where("lang is not null").select("doc_id", "text", "lang")
    by_lang = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(by_lang)
    n = sum(by_lang.values())
    if n > max_train_docs:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * max_train_docs / n))
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        held: dict[int, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                held.setdefault(index[lang.as_py()], Counter()).update(text_words(text.as_py()))
            if sum(map(len, held.values())) > _REMEMBER:
                yield from flush(held)
                held = {}
        yield from flush(held)

    def flush(held):
        for lang, words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    counts = materialize(docs.select("text", "lang").mapInArrow(tidied(count), "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    p = np.zeros((len(pieces) + 2, max(len(languages), 1)))
    p[:-1] = 1 / (len(pieces) + 1)
    width = p.shape[1]
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches, shared=shared):
            lattice, now = Lattice(pieces), shared.value
            total = np.zeros_like(now)
            for batch in batches:
                words, lang, n_of = [], [], []
                for w, k, c in zip(batch.column("word").to_pylist(), batch.column("lang").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    for part in word_parts(w):
                        words.append(part)
                        lang.append(k)
                        n_of.append(c)
                if words:
                    total += lattice.expected(words, np.array(lang), np.array(n_of, float), now)
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "n"])

        found = counts.mapInArrow(tidied(expect), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(p.size)
        total[found["cell"].to_numpy(np.int64)] = found["n"]
        total = total.reshape(-1, width)[:-1] + smoothing
        p[:-1] = total / total.sum(0)
    prior = np.log(np.array([by_lang[x] for x in languages], float) / max(n, 1)) if languages else np.zeros(1)
    return LanguageModel(pieces, languages, p, prior)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the language of the text and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stay, schema = with_results(docs.schema, StructField(pred, StringType()), StructField(score, DoubleType()))

    def run(batches):
        m = shared.value
        lattice, memo = Lattice(m.pieces), Memo()
        values, letters = np.zeros((1 << 16, m.p.shape[1])), np.zeros(1 << 16, bool)

        def learn(new):
            """Values of the words at the last places, in order."""
            nonlocal values, letters
            while len(values) < memo.places:
                values, letters = np.concatenate([values, np.zeros_like(values)]), np.concatenate([letters, np.zeros_like(letters)])
            parts = [word_parts(w) for w in new]
            own = slice(memo.places - len(new), memo.places)
            letters[own] = some = np.fromiter(map(bool, parts), bool, len(parts))
            values[own] = 0
            values[np.arange(own.start, own.stop)[some]] = lattice.forward([p[0] for p in parts if p], m.p) if some.any() else 0

        for batch in batches:
            preds, scores = [], []
            texts = batch.column(batch.schema.get_field_index(text))
            for first in range(0, len(texts), 256):
                if len(memo) > _REMEMBER:
                    memo = Memo()
                split = [_WORD.findall(x.lower()) if x else () for x in texts.slice(first, 256).to_pylist()]
                n = np.fromiter(map(len, split), np.int64, len(split))
                at = np.fromiter(map(memo.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
                new, memo.new = memo.new, []
                learn(new)
                doc = np.repeat(np.arange(len(n)), n)
                total = np.stack([np.bincount(doc, values[at, k], len(n)) for k in range(values.shape[1])], 1) + m.prior
                none = (np.bincount(doc, letters[at], len(n)) == 0) | (not m.languages)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                preds += [UNDECIDED if x else m.languages[i] for x, i in zip(none.tolist(), best.tolist(), strict=True)]
                scores.append(np.where(none, 0.0, share))
            yield pa.RecordBatch.from_arrays([*batch.select(stay).columns, pa.array(preds, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], schema.names)

    return docs.mapInArrow(tidied(run), schema)
