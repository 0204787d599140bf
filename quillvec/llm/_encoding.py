"""Encoding many texts with the tokenizers library, each distinct unit of a text once per task.

A *unit* is a piece of text at whose ends the tokenizer always cuts, so the ids of a text are those
of its units one after another.  Texts repeat their units, so the library sees each unit once until
the memory of a task is renewed; units of more than `LONG` characters are encoded each time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Hashable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa

LONG = 200
_REMEMBER = 150_000
#: Words encoded in one call, as one text.
_TOGETHER = 300
_SLICE_CHARS = 1_000_000


_tokenizers: dict[Hashable, object] = {}
_encoders: dict[Hashable, UnitEncoder] = {}


def encoder(key: Hashable, make: Callable, units: Callable[[str], list[str]] | None = None, *, keep: bool = False) -> UnitEncoder:
    """A new encoder; the worker keeps the tokenizer of the last key, with the library's own threads off: a task has one core.

    units: None for those that suit the tokenizer.  keep: whether the worker also keeps the encoder with what it has learned, four
    times as much, for its next task.
    """
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers.clear()
        _encoders.clear()
        _tokenizers[key] = make()
    if not keep:
        return UnitEncoder(_tokenizers[key], units)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(_tokenizers[key], units, 4 * _REMEMBER)
    return _encoders[key]


class Memo(dict):
    """The place of each unit; a unit that is met first gets the next place and is noted in `new`."""

    def __init__(self, items=()):
        super().__init__(items)
        self.places, self.new = len(self), []

    def __missing__(self, unit: str) -> int:
        place = self[unit] = self.places
        self.places += 1
        self.new.append(unit)
        return place


class UnitEncoder:
    def __init__(self, tokenizer, units: Callable[[str], list[str]] | None = None, remember: int = _REMEMBER):
        self.tokenizer, self.remember = tokenizer, remember
        self.units = units or units_of(tokenizer)
        self.word_ends = word_ends(tokenizer) if cutter_of(tokenizer) is word_units else None
        self.memo = Memo()
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units end to end, and how many each has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes

    def _encoded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of units that are one word each, many in a call: the last id of a word tells its end."""
        ids, _ = self._encoded([" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)])
        ends = np.flatnonzero(self.word_ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._encoded(words)

    def _store(self, first: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps the ids of the units at places from `first` on."""
        last, total = first + len(sizes), len(ids)
        while last > len(self.starts):
            self.starts, self.sizes, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.met))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = ids
        self.starts[first:last], self.sizes[first:last], self.met[first:last] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += total

    def _learn(self, new: list[str]) -> None:
        """Encodes the units at the last places, in order."""
        first = self.memo.places - len(new)
        if self.word_ends is None or len(new) < 2:
            return self._store(first, *self._encoded(new))
        plain = np.fromiter((u.isalpha() and u.lower().isalpha() for u in new), bool, len(new))
        words, others = list(compress(new, plain)), list(compress(new, ~plain))
        (a, n_a), (b, n_b) = self._encoded_words(words) if words else self._encoded([]), self._encoded(others)
        sizes = np.empty(len(new), np.int64)
        sizes[plain], sizes[~plain] = n_a, n_b
        ids, own = np.empty(len(a) + len(b), np.int32), np.repeat(plain, sizes)
        ids[own], ids[~own] = a, b
        self._store(first, ids, sizes)

    def _forget(self) -> None:
        """Keeps the half of the units that were met most often, at most, and of those only the ones met again."""
        places = np.fromiter(self.memo.values(), np.int64, len(self.memo))
        met = self.met[places]
        keep = met >= max(2, int(np.partition(met, len(met) // 2)[len(met) // 2])) if len(met) else np.zeros(0, bool)
        places, units = places[keep], compress(self.memo, keep.tolist())
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        self.used = int(ends[-1]) if len(ends) else 0
        self.ids[: self.used] = self.ids[np.arange(self.used) - np.repeat(ends - sizes - self.starts[places], sizes)]
        self.memo, n = Memo(zip(units, range(len(places)), strict=True)), len(places)
        self.starts[:n], self.sizes[:n], self.met[:n] = ends - sizes, sizes, met[keep] // 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of each text in it."""
        if len(self.memo) > self.remember or self.used > 16 * self.remember:
            self._forget()
        split = [self.units(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        new, self.memo.new = self.memo.new, []
        self._learn(new)
        self.met[: self.memo.places] += np.bincount(at, minlength=self.memo.places)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) - np.repeat(ends - sizes - self.starts[at], sizes)]
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        for u in new:
            if len(u) > LONG:
                del self.memo[u]
        return ids, ends


def text_slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about a million characters; null is empty."""
    first = 0
    while first < len(texts):
        held, size = [], 0
        while first + len(held) < len(texts) and (not held or size < _SLICE_CHARS):
            held.append(texts[first + len(held)].as_py() or "")
            size += len(held[-1])
        yield first, held
        first += len(held)


# Both patterns below always cut at white space, and between a letter and an ASCII mark after it.  Letters: Latin and Cyrillic ones; a text in other
# letters is cut at white space alone.
_LETTERS, _NEXT = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ʯЀ-ҁҊ-ԯ]++", r"(?![^ \t\n\r!-/:-@\[-`{-~])"
#: For a tokenizer that drops white space and cuts by `DROPPING`.
_WORD = re.compile(rf"{_LETTERS}{_NEXT}|[^ \t\n\r]++")
#: For one that cuts by `SPACING`: a run of white space belongs to the word after it; only the last run of a text stands alone.
_SPACED_WORD = re.compile(rf"[ \t\n\r]*+{_LETTERS}{_NEXT}|[ \t\n\r]*+[^ \t\n\r]++|[ \t\n\r]+")
#: White space besides: a text with any of it is not cut at all, for a run of white space may hold both.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The patterns of public tokenizers that the two kinds of units are made for.
DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACING = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

word_units = _WORD.findall


def spaced_units(text: str) -> list[str]:
    if _OTHER_SPACE.search(text):
        return [text]
    return _SPACED_WORD.findall(text)


def whole_text(text: str) -> list[str]:
    return [text] if text else []


def cutter_of(tokenizer) -> Callable[[str], list[str]]:
    """The units that suit a tokenizer, by the pattern it first cuts by; whole texts for an unknown one."""
    cutter = json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}
    first = cutter.get("pretokenizers", [cutter])[0]
    pattern = first.get("pattern", {}).get("Regex")
    if (pattern, first.get("behavior"), first.get("invert")) == (DROPPING, "Removed", True):
        return word_units
    return spaced_units if (pattern, first.get("behavior")) == (SPACING, "Isolated") else whole_text


def units_of(tokenizer) -> Callable[[str], list[str]]:
    """The same; a text with the name of an added token that the tokenizer looks for is one unit."""
    cut = cutter_of(tokenizer)
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not (t.special and tokenizer.encode_special_tokens)]
    if not names or cut is whole_text:
        return cut
    named = re.compile("|".join(map(re.escape, names))).search
    return lambda text: [text] if named(text) else cut(text)


def word_ends(tokenizer) -> np.ndarray | None:
    """Whether each id ends a word, of a tokenizer that marks its words' ends."""
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return out
