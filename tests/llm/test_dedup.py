from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import AWKWARD, documents, spaced

from quillvec.llm import minhash_dedup as M
from quillvec.llm.components import connected_components


def brute(rows, percent):
    sets = []
    for _, t in rows:
        w = spaced(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None]
        first = doc_id if not sets[i] else (min(ids) if ids else None)
        out.append((doc_id, len(sets[i]), first, doc_id == first))
    return sorted(out, key=str)


def family(n, edits, seed, first):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((first + i, " ".join(w)))
    return rows


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_against_all_pairs(spark, percent, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 600)  # families of several blocks
    monkeypatch.setattr(M, "CROSS", 3)
    rows = AWKWARD + family(60, 6, 1, 100) + family(30, 3, 2, 300) + [(500, AWKWARD[5][1])] * 3
    assert got(M.near_duplicates(documents(spark, rows), percent=percent)) == brute(rows, percent)


def test_near_copies_have_few_links_however_many_buckets_they_share(spark, monkeypatch):
    counts, whole = [], M.connected_components
    monkeypatch.setattr(M, "connected_components", lambda links: [counts.append(links.distinct().count()), whole(links)][1])
    rows = family(150, 5, 7, 100)
    assert got(M.near_duplicates(documents(spark, rows), percent=85)) == brute(rows, 85)
    assert max(counts) <= 2 * len(rows)


def test_sets_by_join_where_there_are_too_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_BITS", 3)
    rows = AWKWARD + family(20, 6, 1, 100)
    assert got(M.near_duplicates(documents(spark, rows), percent=80)) == brute(rows, 80)


def test_no_documents_and_no_duplicates(spark):
    assert got(M.near_duplicates(documents(spark, []))) == []
    rows = [(i, f"only text {i} with its own words a{i} b{i} c{i}") for i in range(4)]
    assert got(M.near_duplicates(documents(spark, rows))) == brute(rows, 80)


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200, 201 + i) for i in range(40)] + [(300 + i, 301 + i) for i in range(30)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links + [(5, None)], "a long, b long")
    want = {x: root(x) for a, b in links for x in (a, b) if a != b}
    assert {r["node"]: r["comp"] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_bands():
    assert 1 - (1 - 0.85**6) ** M.bands_for(0.85, 6, 1e-8) >= 1 - 1e-8


def star(n, edits, seed, first):
    """Copies of one text, each with so many words of its own: near to the text, but not to one another."""
    r = random.Random(seed)
    base = [f"s{seed}w{i}" for i in range(200)]
    rows = [(first, " ".join(base))]
    for i in range(1, n):
        w, at = list(base), r.sample(range(0, 200, 12), edits)
        for k in at:
            w[k] = f"own{i}x{k}"
        rows.append((first + i, " ".join(w)))
    return rows


def test_copies_that_are_near_to_the_original_alone(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 900)
    rows = star(50, 3, 5, 100) + star(40, 2, 6, 300) + family(40, 9, 7, 500)
    assert got(M.near_duplicates(documents(spark, rows), percent=85)) == brute(rows, 85)


def test_pairs_at_the_threshold_share_a_band():
    """20,000 pairs of sets at the threshold: of a hundred thousand and more sets none may miss its partner but by a chance of 1e-8 each."""
    r, bands, size = np.random.default_rng(11), M.bands_for(0.85, 6, 1e-8), 74
    a = r.integers(0, 1 << 63, (20_000, size)).astype(np.uint64)
    b = a.copy()
    b[:, :6] = r.integers(0, 1 << 63, (20_000, 6)).astype(np.uint64)  # 68 shared of 80
    low = [M._minima(x.ravel(), np.arange(0, x.size, size), bands * 6).reshape(bands, 6, -1) for x in (a, b)]
    same = low[0] == low[1]
    assert same.all(1).any(0).all()
    share = same.mean()
    assert abs(share - 0.85) < 0.002  # minima agree as often as they should
    each = same.reshape(bands * 6, -1).mean(1)
    assert each.min() > 0.84 and each.max() < 0.86
    assert abs(same.all(1).mean() - 0.85**6) < 0.003  # and independently within a band


def test_hubs(spark, monkeypatch):
    from quillvec.llm import components

    monkeypatch.setattr(components, "MANY", 70)
    monkeypatch.setattr(components, "HUBS", 40)
    links = [(7, 1000 + i) for i in range(3000)] + [(3, 1000)] + [(5000 + i, 5001 + i) for i in range(10)] + [(99_999, 10_000 + i) for i in range(3000)]
    out = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {7: 3, 3: 3} | {1000 + i: 3 for i in range(3000)} | {5000 + i: 5000 for i in range(11)} | {10_000 + i: 10_000 for i in range(3000)} | {99_999: 10_000}
