"""Byte-level BPE over Arrow batches with the tokenizers library, and back.

The vocabulary is a file of ranks.  The library works on characters, so each byte
is mapped to a printable character by the byte table below.  Every way to form a token from two others becomes a
merge, in the order of the ranks, so that merges happen as by rank alone.

`encode` also gives the character at which each token starts; a token that starts inside a character
has that character's place.  `decode` turns the characters of each id's token back to bytes by the reversed table and joins them; bytes of a
character may be split over tokens and meet again in the result.

Defined results: a null or empty text has no ids and decodes to no bytes; ids that the vocabulary lacks, or a null among ids, give
null bytes; null ids are null bytes; repeated rows are coded each; other columns stay, and a result column replaces one of its name; a
very long text is coded whole.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from . import _encoding as E
from ._work import tidied, with_results


def byte_table() -> list[str]:
    """The character of each byte: itself where it is printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary(ranks: dict[bytes, int]) -> dict[str, int]:
    """The id of each token, written in the characters of the byte table."""
    table = byte_table()
    return {"".join(map(table.__getitem__, token)): rank for token, rank in ranks.items()}


def make_tokenizer(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    known = vocabulary(ranks)
    merges = [(t[:i], t[i:]) for t in sorted(known, key=known.__getitem__) for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
    tokenizer = Tokenizer(models.BPE(vocab=known, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class _Tokens:
    """The bytes of each id, by the reversed byte table, end to end, for decoding with array operations."""

    def __init__(self, known: dict[str, int]):
        byte_of = {c: b for b, c in enumerate(byte_table())}
        size = max(known.values()) + 1
        sizes, is_known = np.zeros(size, np.int64), np.zeros(size, bool)
        for t, r in known.items():
            sizes[r], is_known[r] = len(t), True
        self.sizes, self.known, self.starts = sizes, is_known, np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(bytes(map(byte_of.__getitem__, t)) for t in sorted(known, key=known.__getitem__)), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of known ids, and the end of each id among them."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) - np.repeat(ends - sizes - self.starts[ids], sizes)], ends


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: str = "ids", starts: str | None = None, decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text.

    starts: names a column for the character at which each token starts.  decoded: one for the bytes that the ids stand for, as
    `decode` gives them, made in the same task.
    """
    more = [*([StructField(starts, ArrayType(IntegerType()))] if starts else []), *([StructField(decoded, BinaryType())] if decoded else [])]
    stay, schema = with_results(docs.schema, StructField(ids, ArrayType(IntegerType())), *more)

    def run(batches):
        ranks = read_ranks(ranks_path)
        encoder = E.encoder((ranks_path, pattern), lambda: make_tokenizer(ranks, pattern))
        tokens = _Tokens(vocabulary(ranks)) if starts or decoded else None
        for batch in batches:
            for first, texts in E.text_slices(batch.column(batch.schema.get_field_index(text))):
                found, ends = encoder.encode(texts)
                offsets = pa.array(ends.astype(np.int32))
                more = [pa.ListArray.from_arrays(offsets, pa.array(found))]
                if tokens is not None:
                    data, byte_ends = tokens.decode(found)
                if starts:
                    begins = np.concatenate([[0], byte_ends])[: len(found)]
                    chars = np.cumsum((data & 0xC0) != 0x80)  # of characters begun up to each byte
                    before = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                    more.append(pa.ListArray.from_arrays(offsets, pa.array((chars[begins] - 1 - np.repeat(before[:-1], np.diff(ends))).astype(np.int32))))
                if decoded:
                    at = np.concatenate([[0], byte_ends])[ends].tolist()
                    held = memoryview(np.ascontiguousarray(data))
                    more.append(pa.array([bytes(held[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary()))
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.select(stay).columns, *more], schema.names)

    return docs.mapInArrow(tidied(run), schema)


def decode(docs: DataFrame, ranks_path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for."""
    stay, schema = with_results(docs.schema, StructField(decoded, BinaryType()))

    def run(batches):
        tokens = _Tokens(vocabulary(read_ranks(ranks_path)))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for first in range(0, len(lists), 512):
                part = lists.slice(first, 512)
                offsets = part.offsets.to_numpy().astype(np.int64)
                flat = part.values.slice(offsets[0], offsets[-1] - offsets[0])
                gone = flat.is_null().to_numpy(zero_copy_only=False)
                values = flat.fill_null(0).to_numpy().astype(np.int64)
                bad = gone | (values < 0) | (values >= len(tokens.known))
                values = np.where(bad, 0, values)
                bad |= ~tokens.known[values]
                data, ends = tokens.decode(values)
                at = np.concatenate([[0], ends])[offsets - offsets[0]]
                wrong = np.concatenate([[0], np.cumsum(bad)])[offsets - offsets[0]]
                mask = (np.diff(wrong) > 0) | part.is_null().to_numpy(zero_copy_only=False)
                held = memoryview(np.ascontiguousarray(data))
                out = [None if m else bytes(held[a:b]) for m, a, b in zip(mask.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*rows.select(stay).columns, pa.array(out, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)
