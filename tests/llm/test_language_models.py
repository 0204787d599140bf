from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
from helpers import AWKWARD, documents, spaced
from pyspark.sql import functions as F

from quillvec.llm import class_lm, language_id, queries
from quillvec.llm._work import bucket_of


def test_class_lm_counts_and_base(spark):
    docs = documents(spark).select("doc_id", "text").withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    rows = [(i, t, i is not None and i % 3 == 0) for i, t in AWKWARD]
    count, n = {}, 0
    for _, t, held in rows:
        for w in [] if held else [*spaced(t), None]:
            count[w] = count.get(w, 0) + 1
            n += 1
    want = []
    for i, t, held in rows:
        tokens = [*spaced(t), None]
        base = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (len(count) + 1))) for w in tokens)
        want.append((i, held, len(tokens), sum(w in count for w in tokens), n, round(base, 6)))
    model = class_lm.train(docs.where("not held_out"), classes=8, head_share=0.02)
    scored = class_lm.score(docs, model)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in scored.collect())
    few = class_lm.train(docs.where("not held_out"), classes=8, head_share=0.02, known_share=0.02)  # the join of rare words
    again = [(r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in class_lm.score(docs, few).collect()]
    assert sorted(again, key=str) == sorted([(r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in scored.collect()], key=str)


def test_probabilities_sum_to_one(spark):
    docs = documents(spark).select("text")
    m = class_lm.train(docs, classes=8)
    assert np.allclose((10**m.transition).sum(1), 1)
    keys = {r["key"]: r["n"] for r in class_lm.count_words(docs).collect()}
    total = 10**m.unseen
    for k, n in keys.items():
        at = np.searchsorted(m.head, k)
        unit = at + 1 if at < len(m.head) and m.head[at] == k else 1 + len(m.head) + (k & (class_lm.SUFFIX_UNITS - 1))
        total[m.of[unit]] += n - m.discount
    assert np.allclose((total / 10**m.share)[1:], 1)


def classes_of(m, words):
    """Class of each word by its key: looked up, joined, or by bucket."""
    known, joined = dict(zip(m.head.tolist(), m.of[1 : 1 + len(m.head)].tolist())), {r["key"]: r["cls"] for r in m.rare.collect()}
    data = " ".join(words).encode()
    ends = np.flatnonzero(np.frombuffer(data + b" ", np.uint8) == 32)
    keys = class_lm.word_keys(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1] + 1]), ends).tolist()
    return {w: known.get(k, joined.get(k, int(m.of[1 + len(m.head) + (k & (class_lm.SUFFIX_UNITS - 1))]))) for w, k in zip(words, keys)}


def test_class_lm_score_by_the_formula(spark):
    """The whole score from the learned classes alone, in plain Python: with words that are looked up, joined, and unseen."""
    rows = [(i, t, i is not None and i % 3 == 0) for i, t in AWKWARD] + [(99, "unseen unseen Unseen words here " * 30, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    for known_share in (1e-6, 0.03):
        options = {"classes": 8, "head_share": 0.05, "known_share": known_share, "prior": 5.0}
        m = class_lm.train(docs, **options)
        of = classes_of(m, sorted({w for _, t, _ in rows for w in spaced(t)})) | {None: 0}
        texts = [[*spaced(t), None] for _, t, held in rows if not held]
        count, pairs, of_class, kinds = Counter(w for t in texts for w in t), Counter(), Counter(), Counter()
        for t in texts:
            pairs.update(zip([0, *(of[w] for w in t)], (of[w] for w in t)))
        for w, n in count.items():
            of_class[of[w]] += n
            kinds[of[w]] += 1
        once, twice = (sum(n == k for w, n in count.items() if w is not None) for k in (1, 2))
        d = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
        total = sum(pairs.values())
        into, out = [[sum(n for pair, n in pairs.items() if pair[side] == c) for c in range(8)] for side in (1, 0)]

        def step(a, b):
            return (pairs[a, b] + 5.0 * (into[b] + 1) / (total + 8)) / (out[a] + 5.0)

        def emitted(w):
            c = of[w]
            return 1.0 if w is None else ((count[w] - d) if count[w] else d * kinds[c] + 1) / (of_class[c] + 1)

        want = []
        for i, t, _ in rows:
            tokens = [*spaced(t), None]
            p = sum(math.log10(step(a, of[w]) * emitted(w)) for a, w in zip([0, *(of[w] for w in tokens)], tokens))
            want.append((str(i), len(tokens), round(p, 6)))
        for scored in (class_lm.score(docs, m), class_lm.train_and_score(docs, **options)):
            got = scored.collect()
            assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in got) == sorted(want)
            assert all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in got)


def test_frequent_unseen_words_are_not_joined(spark):
    docs = spark.createDataFrame([(0, "a b c", False), (1, "x " * 500, True)], "doc_id long, text string, held_out boolean")
    m = class_lm.train(docs, classes=4, known_share=0.1)
    x = class_lm.word_keys(np.frombuffer(b"x", np.uint8), np.array([0]), np.array([1]))[0]
    assert x in m.head.tolist() and m.head_n[m.head.tolist().index(x)] == 0


def test_class_lm_without_training_rows(spark):
    docs = documents(spark).select("doc_id", "text").withColumn("held_out", F.lit(True))
    m = class_lm.train(docs.limit(0), classes=4)
    rows = class_lm.score(docs, m).collect()
    assert len(rows) == len(AWKWARD) and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert class_lm.score(docs.limit(0), m).count() == 0


def test_exchange_finds_classes():
    r = np.random.default_rng(1)
    of = np.array([0] + [1, 2] * 10)  # words of two kinds that alternate
    n = np.zeros((21, 21))
    for a in range(1, 21):
        for b in range(1, 21):
            n[a, b] = r.integers(5, 9) if of[a] != of[b] else 0
    found = class_lm.exchange(n, 3, 20)
    assert len({(x, y) for x, y in zip(of[1:], found[1:])}) == 2


def test_class_lm_beats_the_base_on_held_out_text(spark, sf_dir):
    r = queries.op1_class_lm(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# ---- language


def all_segmentations(word, p, other):
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, min(language_id.LONGEST, len(word)) + 1):
        q = p.get(word[:size], other if size == 1 else None)
        if q:
            total += q * all_segmentations(word[size:], p, other)
    return total


def test_forward_is_the_sum_over_segmentations():
    pieces = sorted(["a", "b", "ab", "ba", "aba", "▁", "▁a", "bb"])
    lattice, r = language_id.Lattice(pieces), np.random.default_rng(2)
    p = np.zeros((len(pieces) + 2, 2))
    p[:-1] = r.dirichlet(np.ones(len(pieces) + 1), 2).T
    words = ["▁", "▁a", "▁abab", "▁bzba", "abbaabba"]
    got = np.exp(lattice.forward(words, p))
    for k in range(2):
        prob = dict(zip(pieces, p[:, k]))
        assert np.allclose(got[:, k], [all_segmentations(w, prob, p[len(pieces), k]) for w in words])
    expected = lattice.expected(words, np.zeros(5, int), np.ones(5), p)
    lengths = np.array([len(x) for x in pieces] + [1, 0])
    assert np.isclose((expected[:, 0] * lengths).sum(), sum(map(len, words)))  # every letter is in one piece


def test_long_pieces_and_long_words():
    """Pieces of any length, and words past every chunk and underflow; by exact sums in fractions."""
    from fractions import Fraction

    pieces = sorted(["a", "b", "ab", "abababababab", "▁", "▁ab", "bbbbbbbbbbbbbbbbbbbb"])
    lattice, r = language_id.Lattice(pieces), np.random.default_rng(4)
    p = np.zeros((len(pieces) + 2, 2))
    p[:-1] = r.dirichlet(np.ones(len(pieces) + 1), 2).T * 1e-4
    words = ["▁" + "ab" * 15, "▁" + "b" * 50, "▁" + "abz" * 200]
    got, prob = lattice.forward(words, p), dict(zip(pieces, p))
    for w, row in zip(words, got):
        for k in range(2):
            alpha = [Fraction(1)]
            for j in range(1, len(w) + 1):
                q = lambda x: Fraction(prob[x][k] if x in prob else p[len(pieces), k] if len(x) == 1 else 0)
                alpha.append(sum((alpha[j - n] * q(w[j - n : j]) for n in range(1, min(20, j) + 1)), Fraction(0)))
            want = math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)
            assert math.isclose(row[k], want, rel_tol=1e-9)
    expected = lattice.expected(words, np.zeros(3, int), np.ones(3), p)
    lengths = np.array([len(x) for x in pieces] + [1, 0])
    assert np.isclose((expected[:, 0] * lengths).sum(), sum(map(len, words)))
    assert language_id.word_parts("x" * 100) == ["▁" + "x" * 100]
    assert max(map(len, language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))) > 8


def test_piece_table():
    r = np.random.default_rng(3)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 63, 5000).astype(np.uint64), np.arange(300, dtype=np.uint64)]))  # many share a slot
    table = language_id._KeyTable(keys)
    assert table.find(keys).tolist() == list(range(len(keys))) and len(table.levels) > 1
    assert (table.find(keys + np.uint64(1 << 63)) == -1).all() and len(table.find(keys[:0])) == 0


def test_posterior_by_hand(spark):
    """Each text's language and probability from the sums over segmentations of its words, in plain Python."""
    pieces = sorted(["a", "b", "ab", "ba", "▁", "▁a", "bb"])
    r = np.random.default_rng(5)
    p = np.zeros((len(pieces) + 2, 2))
    p[:-1] = r.dirichlet(np.ones(len(pieces) + 1), 2).T
    model = language_id.LanguageModel(pieces, ["x", "y"], p, np.log([0.3, 0.7]))
    texts = ["ab ab ba", "Bb, a-b! a", "zab", "", None, "12 _", "a" * 40 + " b"]
    rows = language_id.identify(documents(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        words = ["▁" + w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        log = [math.log(q) + sum(math.log(all_sums(w, dict(zip(pieces, p[:, k])), p[len(pieces), k])) for w in words) for k, q in enumerate((0.3, 0.7))]
        best = int(np.argmax(log))
        assert r["lang_pred"] == "xy"[best] and math.isclose(r["score"], 1 / sum(math.exp(x - log[best]) for x in log))


def all_sums(word, p, other):
    """The sum over all segmentations, a letter at a time."""
    alpha = [1.0]
    for j in range(1, len(word) + 1):
        alpha.append(sum(alpha[i] * p.get(word[i:j], other if j - i == 1 else 0.0) for i in range(j)))
    return alpha[-1]


def test_awkward_languages(spark):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") == 9, F.lit(None)).when(F.col("doc_id") % 2 == 0, "en").otherwise("xx"))
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(docs, vocabulary)
    rows = language_id.identify(docs, model, score="p").collect()
    assert len(rows) == len(AWKWARD) and rows[0]["score"] == 7.0
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "xx") and 0 < r["p"] <= 1) if letters else (r["lang_pred"], r["p"]) == ("und", 0)
    none = language_id.train(docs.limit(0), vocabulary)
    assert {r["lang_pred"] for r in language_id.identify(docs, none, score="p").collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model, score="p").count() == 0


def test_held_out_languages(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    r = queries.op3_language_id(spark, sf_dir).where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] > 0.95
    assert bucket_of(F.lit(None), 4) is not None


def test_rare_words_are_clustered(spark):
    """Words of two kinds that alternate, none frequent enough for a unit: the buckets alone cannot tell the kinds apart."""
    r = np.random.default_rng(2)
    kinds = [[f"q{i}{'xyz'[i % 3]}e" for i in range(300)], [f"q{i}{'xyz'[i % 3]}e" for i in range(300, 600)]]
    text = [" ".join(f"{'the' if k % 2 else 'of'} {kinds[k % 2][r.integers(300)]}" for k in range(200)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in text], "text string")
    for known in (1e-6, 1e-2):  # looked up, and joined
        m = class_lm.train(docs, classes=6, head_share=0.01, known_share=known)
        of = {r["key"]: r["cls"] for r in m.rare.collect()} | dict(zip(m.head.tolist(), m.of[1 : 1 + len(m.head)].tolist()))
        found = []
        for words in kinds:
            data = " ".join(words).encode()
            ends = np.flatnonzero(np.frombuffer(data + b" ", np.uint8) == 32)
            keys = class_lm.word_keys(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1] + 1]), ends)
            found.append({of[k] for k in keys.tolist()})
        assert not found[0] & found[1]
        assert (10**m.transition).sum(1).round(9).tolist() == [1.0] * 6
