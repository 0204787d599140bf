from __future__ import annotations

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import AWKWARD, documents, spaced
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillvec.llm import _encoding, bm25, byte_bpe, token_store

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABETS = ["ab", "aA '.", "äöü é", "日本 ,.", "\U0001f600\U0001f601a", "  \n\t\r", "   a.", "0123 .,", "'s't're ", "áb̸ <=", "$&#!? a", "\x0b\x0c\x1c\x85 x", "ΣσΑ İıſK", "aé$#'s.", "a1²½٣.'-", "é\u0301=\u0338<a ", "ᄀ\u1161\u11a8가.a", "_a'_(t)", "’“a.b'S"]


def odd_texts(n):
    r = random.Random(7)
    return ["".join(r.choice(a) for _ in range(r.randrange(1, 60))) for a in ALPHABETS for _ in range(n)] + [t or "" for _, t in AWKWARD]


def plain_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_against_tiktoken(spark):
    texts = odd_texts(60)
    docs = documents(spark, list(enumerate(texts)))
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, starts="starts"), RANKS)
    plain = plain_encoding()
    for r in coded.collect():
        assert r["ids"] == plain.encode_ordinary(r["text"]), r["text"]
        assert bytes(r["decoded"]) == r["text"].encode()
        pieces, at, want = [plain.decode_single_token_bytes(i) for i in r["ids"]], 0, []
        for p in pieces:
            want.append(len(r["text"].encode()[: at + 1].decode(errors="ignore")) if (r["text"].encode()[at] & 0xC0) == 0x80 else len(r["text"].encode()[:at].decode()))
            at += len(p)
        starts = [w - ((r["text"].encode()[a] & 0xC0) == 0x80) * 0 for w, a in zip(want, np.cumsum([0, *map(len, pieces)]))]
        assert [s for s, p in zip(r["starts"], pieces) if (p[0] & 0xC0) != 0x80] == [s for s, p in zip(starts, pieces) if (p[0] & 0xC0) != 0x80]


def test_byte_bpe_cases(spark):
    docs = documents(spark)
    rows = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert all(r["ids"] == [] for r in rows if not r["text"]) and len(rows) == len(AWKWARD)
    odd = spark.createDataFrame([(0, [5, None]), (1, None), (2, [999999]), (3, []), (4, [5, 6])], "i int, ids array<int>")
    out = {r["i"]: r["decoded"] for r in byte_bpe.decode(odd, RANKS).collect()}
    assert out[0] is None and out[1] is None and out[2] is None and bytes(out[3]) == b"" and len(out[4]) > 0
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_word_units_change_nothing(special):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = not special
    texts = odd_texts(120) + ["<|endoftext|>", "a<|endoftext|>b.<|startoftext|> c", "plain <|endoftext|> words", "x" * 1000, "y" * 1000 + " " + "x" * 1000]
    encoder = _encoding.UnitEncoder(tokenizer)
    assert _encoding.cutter_of(tokenizer) is _encoding.word_units and encoder.units("a é's b.") == ["a", "é", "'s", "b", "."]
    for first in range(0, len(texts), 50):
        if first == 200:
            encoder._forget()
        for _ in range(2):
            ids, ends = encoder.encode(texts[first : first + 50])
            for t, a, b in zip(texts[first : first + 50], ends, ends[1:]):
                assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert max(map(len, encoder.memo)) <= _encoding.LONG


def test_units_of_other_tokenizers():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = _encoding.UnitEncoder(other)
    assert encoder.units is _encoding.whole_text
    for t in odd_texts(5):
        assert encoder.encode([t])[0].tolist() == other.encode(t, add_special_tokens=False).ids


def test_token_store_keeps_the_library_s_special_tokens(spark):
    plain = Tokenizer.from_file(WORDS)
    folder = token_store.write(documents(spark, [(1, "some <|endoftext|> text<|startoftext|>.")]), WORDS)
    ids = token_store.lookup(spark.createDataFrame([(1,)], "doc_id long"), folder).first()["ids"]
    assert ids == [*plain.encode("some <|endoftext|> text<|startoftext|>.", add_special_tokens=False).ids, 2] and 49407 in ids
    with pytest.raises(TypeError):
        token_store.write(documents(spark).withColumn("doc_id", F.lit("a")), WORDS)


def test_token_store(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_DOCS", 5)
    folder = token_store.write(documents(spark), WORDS)
    tokenizer = Tokenizer.from_file(WORDS)
    rows = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in token_store.digests(spark, folder).collect()], key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(6,), (4,), (4,), (12345,), (None,), (-3,)], "doc_id long")
    found = Counter(r["doc_id"] for r in token_store.lookup(asked, folder).collect())
    assert found == {6: 3, 4: 1}
    empty = token_store.write(documents(spark, []), WORDS)
    assert token_store.digests(spark, empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000).astype(np.uint64))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert token_store.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    others = keys + np.uint64(1 << 62)
    slots = table.slots(others)
    prints = np.zeros(len(keys), np.uint32)
    prints[table.slots(keys)] = token_store.fingerprints(keys)
    assert ((slots >= 0) & (prints[slots] == token_store.fingerprints(others))).mean() < 0.001


def small_shards(monkeypatch):
    for name, value in {"POSTINGS": 400, "DOCS": 50, "BLOCK": 4, "QUERIES": 20, "TOGETHER": 7, "AT_ONCE": 300, "MOST_FREQUENT": 20, "COMMON": 5}.items():
        monkeypatch.setattr(bm25, name, value)


def all_scores(rows, k):
    """The best k of every row's text: exact sums in the order of word hashes, as the operator adds."""
    bags = [Counter(spaced(t)) for _, t in rows]
    lengths, n = [sum(b.values()) for b in bags], len(rows)
    mean = sum(lengths) / n
    df = Counter(w for b in bags for w in b)
    for i, t in rows:
        scores = []
        for (j, _), b, size in zip(rows, bags, lengths):
            s = math.fsum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(spaced(t)) if w in b)
            if s:
                scores.append((-round(s, 8), j is None, j))
        yield i, [(r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]


def test_bm25_against_all_scores(spark, monkeypatch):
    small_shards(monkeypatch)
    r = random.Random(9)
    weights = [1 / (k + 1) for k in range(300)]
    rows = AWKWARD + [(100 + i, " ".join(f"t{x}" for x in r.choices(range(300), weights, k=r.randrange(1, 60)))) for i in range(200)]
    rows += [(1000 + i, rows[-1][1]) for i in range(12)]  # ties
    r.shuffle(rows)
    docs = documents(spark, rows).withColumn("rank", F.lit("clash")).repartition(3)
    asked = docs.where("doc_id % 5 = 0 or doc_id is null").select(F.col("doc_id").alias("query_id"), "text")
    got = {}
    for x in bm25.top_k(docs, asked, k=10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["doc_id"], x["score"]))
    for i, want in all_scores(rows, 10):
        if i is None or i % 5:
            continue
        found = sorted(got.get(i, []))
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want] and np.allclose([x[2] for x in found], [x[2] for x in want])
    assert bm25.top_k(docs, asked.limit(0)).count() == 0
    assert bm25.top_k(docs.limit(0), asked).count() == 0
    with pytest.raises(TypeError):
        bm25.top_k(docs.withColumn("doc_id", F.lit("a")), asked)


def test_bm25_equal_texts_tie_exactly_in_any_shard(spark, monkeypatch):
    """Copies stand among frequent words in one shard and rare ones in another; their scores must not differ in any bit."""
    small_shards(monkeypatch)
    r = random.Random(4)
    copy = " ".join(f"w{i}" for i in range(80))
    rows = []
    for part in range(6):
        pool = [f"w{i}" for i in r.sample(range(80), 40)] + [f"p{part}_{i}" for i in range(40)]
        rows += [(1000 * part + i, copy if i % 17 == 3 else " ".join(r.choices(pool, k=30))) for i in range(60)]
    docs = documents(spark, rows).repartition(6)
    asked = docs.where(F.col("text") == copy).select(F.col("doc_id").alias("query_id"), "text")
    copies = sorted(i for i, t in rows if t == copy)
    found = bm25.top_k(docs, asked, k=20).collect()
    assert {x["query_id"] for x in found} == set(copies)
    for q in copies:
        own = sorted((x["rank"], x["doc_id"], x["score"]) for x in found if x["query_id"] == q)
        assert [d for _, d, _ in own] == copies[:20] and len({s for *_, s in own}) == 1


def test_bm25_skips_blocks(monkeypatch):
    """With a threshold from an earlier shard, blocks whose bounds do not reach it are not scored."""
    monkeypatch.setattr(bm25, "BLOCK", 8)
    r = random.Random(5)
    texts = [" ".join(r.choices([f"{lang}{i}" for i in range(40)], k=50)) for lang in "ab" for _ in range(100)]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    term, tf, sizes, length = bm25._terms(np.frombuffer(data, np.uint8), offsets)
    arrays, df = bm25._shard(term, tf, sizes, length, np.arange(200))
    index = bm25.ShardIndex(arrays, float(length.mean()))
    first = np.cumsum(sizes) - sizes
    own = term[first[0] : first[0] + sizes[0]]
    q = bm25.Queries([own], [np.ones(len(own))], 5)
    index.search(q)
    best, scored = q.best, []
    monkeypatch.setattr(bm25.ShardIndex, "_narrowed", lambda self, found, *a: scored.append(sum(len(x[0]) for x in found)) or tuple(np.concatenate(x) for x in zip(*found)))
    index.search(q)
    assert len(best[0]) == 5 and scored[-1] < 50  # half the entries share no word, and few reach the threshold


def test_pipeline(spark, sf_dir):
    rows = AWKWARD + [(100, "Some words here and token = \"0123456789abcdef0123456789abcdef\" and more words follow after it.")]
    docs = documents(spark, rows).drop("score").withColumn("lang", F.when(F.col("doc_id") == 9, "xx").otherwise("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}-{random.random()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    left = docs.collect()
    assert all(any(c.isalpha() for c in r["text"]) for r in left)
    assert not any("0123456789abcdef" in r["text"] for r in left) and any("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]) for r in left)
    assert len({spaced(r["text"])[0] + str(len(r["text"])) for r in left}) == len(left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == len(left) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)


def test_pipeline_repeated_rows_and_clashing_names(spark, sf_dir):
    """Rows that repeat id and text in any order give the same row; names that stages use inside are left alone; an empty table passes."""
    text = "Some words that stand here twice, and enough of them to make a sentence of it"
    rows = [(1, text, "en", f"src{k}", k) for k in range(5)] + [(2, text, "en", "src9", 9), (None, "Other words of a text that has no id, but a language", "en", "s", 1), (None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    seen = set()
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame(turn, kinds).repartition(3)
        for name in ("__pred", "__score", "__spans", "__base", "__key", "__id", "__null", "row"):
            docs = docs.withColumn(name, F.lit("own"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.where("__pred <> 'own' or __key <> 'own' or row <> 'own'").count() == 0
            docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.add(tuple(sorted(map(str, docs.collect()))))
        assert docs.count() == 2
    assert len(seen) == 1
    docs = spark.createDataFrame([], kinds)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.75 * n < out.count() < n


def test_a_shard_holds_the_lists_of_its_words_in_order():
    r = np.random.default_rng(3)
    docs = [np.unique(r.integers(0, 400, 30)) for _ in range(500)]
    term, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    arrays, df = bm25._shard(term, r.integers(1, 5, len(term)), sizes, sizes, np.arange(500))
    assert arrays["list_sizes"].tolist() == df.tolist()  # no two documents are equal
    starts = arrays["begins"]
    for t, (first, n) in enumerate(zip(np.cumsum(df) - df, df, strict=True)):
        at = np.flatnonzero(arrays["term"] == t)
        assert arrays["listed"][first : first + n].tolist() == (np.searchsorted(starts, at, side="right") - 1).tolist()
        assert arrays["listed_tf"][first : first + n].tolist() == arrays["tf"][at].tolist()
