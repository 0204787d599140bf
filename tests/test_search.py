from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.functions import filters as fl
from quillvec.functions.distance import DELTA_ID_OFFSET, metric
from quillvec.operators import beam, graph, knn
from quillvec.operators import incremental as inc
from quillvec.operators.incremental import IncrementalConfig, IncrementalIndex
from quillvec.operators.validate import VectorError, check_vectors
from quillvec.plans import index as ix

SCHEMA = "id long, embedding array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def asked(spark, *q):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(q)], "qid long, q array<float>")


def ids(df):
    return [r["id"] for r in df.orderBy("qid", "rank").collect()]


CORNERS = [(0, 0), (0, 1), (1, 0), (1, 1)]
PARAMS = ix.IndexParams(8, 16)


def test_exact_small(spark):
    data = table(spark, [*CORNERS, (0.5, 0.5)])
    rows = knn.exact_knn(asked(spark, (0.1, 0.1)), data, 3).orderBy("rank").collect()
    assert rows[0]["id"] == 0 and len(rows) == 3 and rows[0]["dist"] < 1


def test_ties_go_to_the_smaller_id_and_k_is_bounded(spark):
    data = table(spark, [(1, 1)] * 6)
    assert ids(knn.exact_knn(asked(spark, (0, 0)), data, 3)) == [0, 1, 2]
    assert ids(knn.exact_knn(asked(spark, (0, 0)), data, 30)) == list(range(6))
    assert knn.exact_knn(asked(spark, (0, 0)), data, 0).count() == 0
    assert knn.exact_knn(asked(spark), data, 3).count() == 0
    assert knn.exact_knn(asked(spark, (0, 0)), data.limit(0), 3).count() == 0


def test_query_blocks_give_the_same(spark, monkeypatch):
    random = np.random.default_rng(2)
    data, q = table(spark, random.normal(size=(60, 4))), asked(spark, *random.normal(size=(9, 4)))
    whole = ids(knn.exact_knn(q, data, 5))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 64)
    assert ids(knn.exact_knn(q, data, 5)) == whole == ids(knn.pairwise_knn(q, data, 5))


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_column_path_takes_any_number_of_queries(spark, monkeypatch, most):
    monkeypatch.setattr(knn, "COLUMN_ROWS", 7)
    x = np.repeat(np.random.default_rng(9).random((20, 3)), 2, 0)
    data, q = table(spark, x), asked(spark, *np.random.default_rng(10).random((1100, 3)))
    right = ids(knn.exact_knn(q, data, 3))
    monkeypatch.setattr(knn, "BLOCK_BYTES", most)
    assert ids(knn.pairwise_knn(q, data, 3)) == right
    assert not knn.pairwise_knn(q, data.limit(0), 3).count() and not knn.pairwise_knn(q.limit(0), data, 3).count()


def test_bad_input(spark):
    with pytest.raises(VectorError):
        check_vectors(table(spark, []))
    with pytest.raises(VectorError):
        check_vectors(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], SCHEMA))
    with pytest.raises(VectorError):
        check_vectors(table(spark, [(float("nan"), 1)]))
    with pytest.raises(VectorError):
        check_vectors(spark.createDataFrame([(0, None)], SCHEMA))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    x = np.random.default_rng(3).normal(size=(300, 8))
    data = table(spark, x).withColumn("label", (F.col("id") % 5).cast("int"))
    return x, ix.build_index(data, str(tmp_path_factory.mktemp("index")), "l2", PARAMS)


def test_index_invariants(spark, built):
    _, index = built
    assert (index.rows, index.dim) == (300, 8)
    bad = index.nodes.where((F.size("neighbors") > 8) | F.array_contains("neighbors", F.col("id")) | (F.size(F.array_distinct("neighbors")) < F.size("neighbors")))
    assert bad.count() == 0
    assert ix.open_index(spark, index.path).table == index.table
    assert index.vector(5).count() == 1 and index.vector(5000).count() == 0
    with pytest.raises(VectorError):
        ix.open_index(spark, index.path, "cosine")
    assert ix.open_index(spark, index.path, "cosine", allow_metric_mismatch=True).metric == "cosine"
    with pytest.raises(VectorError):
        ix.open_index(spark, index.path + "-none")


def test_graph_recall_and_order(spark, built):
    x, index = built
    q = asked(spark, *x[:20])
    found, truth = ix.search(index, q, 10, 32, mode="graph"), knn.exact_knn(q, index.nodes, 10)
    hits = found.join(truth, ["qid", "id"], "left_semi").count()
    assert hits >= 180
    dist = [r["dist"] for r in found.where("qid = 0").orderBy("rank").collect()]
    assert dist == sorted(dist)


def test_graph_with_a_narrow_beam_and_filters(spark, built):
    x, index = built
    q = asked(spark, x[0])
    assert ix.search(index, q, 10, 4, mode="graph").count() == 4
    found = ix.search(index, q, 10, 32, fl.Equal("label", 3), mode="graph")
    assert 0 < found.count() <= 10
    assert all(i % 5 == 3 for i in ids(found))
    assert ids(ix.search(index, q, 10, where=fl.Equal("label", 3))) == ids(knn.exact_knn(q, index.nodes.where("label = 3"), 10))
    assert ix.search(index, q, 10, 32, fl.Equal("label", 77), mode="graph").count() == 0
    assert ix.count_matching(index, fl.Equal("label", 3)) == 60
    with pytest.raises(VectorError):
        ix.search(index, asked(spark, (1, 2)), 3)
    with pytest.raises(VectorError):
        ix.search(index, q, 3, 0, mode="graph")


def test_shards_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "SHARD_ROWS", 100)
    x = np.random.default_rng(4).normal(size=(300, 6))
    index = ix.build_index(table(spark, x), str(tmp_path), "l2", PARAMS)
    q = asked(spark, *x[:10])
    assert index.shards == 3
    assert ix.search(index, q, 5, 64, mode="graph").join(knn.exact_knn(q, index.nodes, 5), ["qid", "id"], "left_semi").count() >= 48


def test_pruning_rules():
    d = np.array([1.0, 1.1, 3.0])
    among = np.array([[0, 0.2, 2.5], [0.2, 0, 2.6], [2.5, 2.6, 0]])
    assert graph.prune_pool(d, among, 3, 1.2, fill=False).tolist() == [0, 2] or graph.prune_pool(d, among, 3, 1.2, fill=False).tolist() == [0]
    assert graph.prune_pool(d, among, 3, 1.0, fill=False)[0] == 0
    assert sorted(graph.prune_pool(d, among, 3, 1.2).tolist()) == [0, 1, 2]
    assert len(graph.prune_pool(d, among, 2, 1.2)) == 2
    assert graph.prune_pool(d, among, 3, 1.2, rule="strict", fill=False).tolist() == [0]


def test_delta_graph():
    x = np.random.default_rng(5).normal(size=(120, 5))
    g = beam.DeltaGraph(5, metric("l2"), degree=16)
    assert g.search(x[:2], 1, 8)[0].shape[0] == 2
    for i in range(0, 120, 30):
        g.add(x[i : i + 30])
    assert len(g.add(x[:0])) == 0
    found, _ = g.search(x, 1, 32)
    assert (found[:, 0] == np.arange(120)).sum() >= 110 and g.near.shape == (120, 16)
    assert beam.beam_search(x[:1], np.zeros((0, 5)), np.zeros((0, 4), np.int64), 0, 4, metric("l2"))[0].size == 0


def test_verified_delta_graph_is_exact(spark):
    x = np.random.default_rng(8).standard_normal((900, 32))
    data, q = table(spark, x), asked(spark, *x[::50])
    right = {tuple(r) for r in knn.exact_knn(q, data, 10).collect()}
    search = lambda verify: {tuple(r) for r in inc.delta_graph_search(q, data, 10, 10, params=ix.IndexParams(4, 8), verify=verify).collect()}
    assert search(True) == right != search(False)


@pytest.mark.parametrize("name", ["l2", "l2sq", "dot", "cosine", "l1", "hamming"])
def test_pairs_and_stacks_agree_with_the_kernel(name):
    r, m = np.random.default_rng(6), metric(name)
    a, b = r.integers(0, 3, (2, 7, 5)).astype(float)
    a[0] = 0
    whole = m.kernel(a, b)
    assert np.allclose(m.pairs(a, b), np.diag(whole))
    assert np.allclose(m.kernel(np.stack([a, b]), np.stack([b, a])), np.stack([whole, m.kernel(b, a)]))


@pytest.mark.parametrize("method", ["exact", "search"])
def test_both_builds_find_neighbours(method):
    r, m = np.random.default_rng(7), metric("l2")
    x = r.normal(size=(400, 8))
    near, start = graph.build_shard(x, 12, 32, 1.2, "l2", method=method)
    assert near.shape == (400, 12) and not (near == np.arange(400)[:, None]).any()
    assert all(len(set(c[c >= 0])) == (c >= 0).sum() for c in near)
    found, d = beam.beam_search(x, x, near, start, 40, m)
    truth = np.argsort(m.kernel(x, x), axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(found, truth)]) >= 9
    assert (np.diff(d, axis=1) >= 0).all()


@pytest.mark.parametrize("name", ["l2", "dot", "cosine", "l1"])
def test_what_a_walk_missed_is_completed(name, monkeypatch):
    monkeypatch.setattr(knn, "PACK_ROWS", 100)
    monkeypatch.setattr(knn, "CHECKED", 7)
    rng = np.random.default_rng(6)
    x, q, m = np.repeat(rng.random((300, 12)), 2, 0), rng.random((20, 12)), metric(name)
    d = np.stack([m.pairs(np.repeat(v[None], len(x), 0), x) for v in q])
    order = np.argsort(d, axis=1, kind="stable")
    best, right = order[:, :9], np.take_along_axis(d, order[:, :9], 1)
    half = np.where(rng.random(best.shape) < 0.5, best, order[:, -9:])
    for found in (best, half, order[:, -9:], np.full((20, 9), -1), np.full((20, 0), -1)):
        at, near = knn.completed(q, x, found, 9, m)
        assert np.array_equal(at, best) and np.array_equal(near, right)
    assert knn.completed(q, x[:4], np.full((20, 9), -1), 9, m)[0].shape == (20, 4)


@pytest.mark.parametrize("method", ["exact", "search"])
def test_verified_graph_search_is_exact(spark, tmp_path, monkeypatch, method):
    monkeypatch.setattr(ix, "SHARD_ROWS", 700)
    x = np.random.default_rng(4).standard_normal((1500, 32))
    data = table(spark, x).withColumn("label", (F.col("id") % 3).cast("int"))
    index, q = ix.build_index(data, f"{tmp_path}/i", "l2", ix.IndexParams(4, 8, method=method)), asked(spark, *x[::50])
    for where in (None, F.col("label") == 1):
        right = {tuple(r) for r in knn.exact_knn(q, data, 10, where=where).collect()}
        assert {tuple(r) for r in ix.search(index, q, 10, 4, where, mode="graph", verify=True).collect()} == right
        assert {tuple(r) for r in ix.search(index, q, 10, 4, where, mode="graph").collect()} != right or where is not None


def test_filtered_walk_returns_all_there_are(monkeypatch):
    r, m = np.random.default_rng(8), metric("l2")
    monkeypatch.setattr(beam, "SCAN", 5)
    x, q = r.normal(size=(300, 4)), r.normal(size=(9, 4))
    near, start = graph.build_shard(x, 8, 16, 1.2, "l2")
    for share in (0.9, 0.2, 0.02, 0.0):
        allowed = r.random(300) < share
        found, d = beam.filtered_search(q, x, near, start, 10, 16, m, allowed)
        want = min(10, int(allowed.sum()))
        assert ((found >= 0).sum(1) == want).all() and allowed[found[found >= 0]].all()
        truth = np.flatnonzero(allowed)[np.argsort(m.kernel(q, x[allowed]), axis=1)[:, :10]]
        assert sum(len(set(a) & set(b)) for a, b in zip(found, truth)) >= 0.8 * 9 * want


def test_delta_ids_are_never_lost(spark):
    """Many ranges, small partitions, and a column whose values lie in two far clusters."""
    from quillvec.operators import incremental as inc

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("64k", "16k", "23")):
            spark.conf.set(k, v)
        data = spark.range(600_000).select((F.col("id") * 7 % 600_000).alias("i")).select(F.when(F.col("i") < 400_000, F.col("i")).otherwise(F.col("i") + DELTA_ID_OFFSET).alias("old_id"), F.array(F.col("i").cast("float")).alias("embedding"))
        for rows in (1 << 18, 50_000):
            inc.RANGE_ROWS = rows
            named = inc.assign_delta_ids(data, 5, "old_id")
            n, low, high, kinds, wrong = named.agg(F.count("*"), F.min("id"), F.max("id"), F.countDistinct("id"), F.sum((F.col("id") - DELTA_ID_OFFSET - 5 != F.col("embedding")[0].cast("long")).cast("int"))).first()
            assert (n, low - DELTA_ID_OFFSET, high - low, kinds, wrong) == (600_000, 5, 599_999, 600_000, 0)
    finally:
        inc.RANGE_ROWS = 1 << 18
        for k, v in old.items():
            spark.conf.set(k, v)


def test_filters_are_pushed_down(spark, tmp_path):
    data = spark.range(100).select("id", (F.col("id") % 7).alias("label"), F.array(F.lit(1.0)).alias("embedding"), F.array(F.col("id") % 3).alias("labels"))
    data.write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda f: rows.where(f.column())._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan(fl.Equal("label", 3)) and "GreaterThanOrEqual(label,2)" in plan(fl.Between("label", 2, 4))
    assert "In(label" in plan(fl.OneOf("label", (1, 2))) and "Or(EqualTo(label,1),LessThan(label,0))" in plan(fl.Or((fl.Equal("label", 1), fl.Less("label", 0))))
    flags = rows.select(fl.Equal(9, 1).truth().alias("t"), fl.Or((fl.Equal(9, 1), fl.Less("id", 50))).truth().alias("u"))
    assert flags.where("t is null or u is null or t").count() == 0 and flags.where("u").count() == 50


def test_many_queries_meet_packed_blocks(spark, built, monkeypatch):
    x, index = built
    q = asked(spark, *x[:40])
    for f in (lambda: knn.exact_knn(q, index.nodes, 5), lambda: ix.search(index, q, 5, 32, mode="graph"), lambda: ix.search(index, q, 5, 32, fl.Equal("label", 3), mode="graph")):
        whole = ids(f())
        for module in (knn, ix):
            monkeypatch.setattr(module, "BLOCK_BYTES", 64)
        monkeypatch.setattr(knn, "PACK_BYTES", 1024)
        monkeypatch.setattr(knn, "PACK_ROWS", 50)
        assert ids(f()) == whole
        monkeypatch.undo()


def test_equal_rows_tie_by_id(spark):
    row = np.random.default_rng(9).normal(size=64)
    data = table(spark, [row * 1000 for _ in range(200)] + list(np.random.default_rng(10).normal(size=(200, 64)) * 1000))
    assert ids(knn.exact_knn(asked(spark, row * 1000 + 1), data.repartition(7), 5)) == [0, 1, 2, 3, 4]


def test_open_checks_counts(spark, tmp_path):
    data = table(spark, CORNERS).withColumn("labels", F.array(F.col("id"), F.lit(1).cast("long")))
    index = ix.build_index(data, str(tmp_path), "l2", PARAMS)
    assert [r["labels"] for r in index.labels_of(spark.range(2, 4)).orderBy("id").collect()] == [[2, 1], [3, 1]]
    with pytest.raises(VectorError):
        ix.build_index(data.withColumn("labels", F.when(F.col("id") > 1, F.col("labels")).otherwise(F.array(F.col("id")))), f"{tmp_path}/ragged")
    spark.createDataFrame([(9, index.table, "l2", 2, 5, 1, 8, 16, 1.2, "vamana", "exact", 2)], ix._VERSION).write.mode("append").parquet(f"{tmp_path}/versions")
    with pytest.raises(VectorError):
        ix.open_index(spark, str(tmp_path))
    assert ix.open_index(spark, str(tmp_path), check=False).rows == 5


def test_searches_do_not_shuffle_the_index(spark, built):
    _, index = built
    q = asked(spark, (0.0,) * 8)
    plan = ix.search_graph(index, q, 5, 16, without=spark.range(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(qid" in plan  # of the best rows alone
    assert "PartitionFilters: [isnotnull(shard" in index.vector(7)._jdf.queryExecution().executedPlan().toString()
    assert 7 not in ids(ix.search_graph(index, asked(spark, *built[0][7:8]), 5, 16, without=spark.range(7, 8)))


def test_incremental_life(spark, tmp_path):
    index = IncrementalIndex.build(table(spark, CORNERS), str(tmp_path), config=IncrementalConfig(params=PARAMS))
    added = {r["old_id"]: r["id"] for r in index.add(table(spark, [(0.5, 0.5), (2, 2)])).collect()}
    assert added == {0: DELTA_ID_OFFSET, 1: DELTA_ID_OFFSET + 1}
    assert {r["id"] for r in index.add(table(spark, [(5, 5)])).collect()} == {DELTA_ID_OFFSET + 2}
    assert index.add(table(spark, [])).count() == 0
    assert ids(index.search(asked(spark, (0.5, 0.5)), 1)) == [DELTA_ID_OFFSET]
    for _ in range(2):
        index.delete(spark.createDataFrame([(0,), (1,), (999,)], "id long"))
    s = index.stats().first()
    assert (s["base"], s["delta"], s["tombstones"], s["live"]) == (4, 3, 2, 5)
    assert 0 not in ids(index.search(asked(spark, (0, 0)), 10)) and len(ids(index.search(asked(spark, (0, 0)), 10))) == 5
    assert set(ids(index.search(asked(spark, (0, 0)), 5, 16))) == set(ids(index.search(asked(spark, (0, 0)), 5)))
    assert {r["id"]: r["deleted"] for r in index.is_deleted(spark.range(3)).collect()} == {0: True, 1: True, 2: False}
    assert index.vector(0).count() == 0 and index.vector(0, include_deleted=True).count() == 1
    assert index.should_compact()
    with pytest.raises(VectorError):
        index.add(table(spark, [(1, 2, 3)]))
    index.compact()
    again = IncrementalIndex.open(spark, index.path)
    s = again.stats().first()
    assert (s["base"], s["delta"], s["tombstones"], s["live"]) == (5, 0, 0, 5)
    assert sorted(ids(again.search(asked(spark, (0, 0)), 10))) == [0, 1, 2, 3, 4]


def test_delta_only_and_empty_compaction(spark, tmp_path):
    index = IncrementalIndex.empty(spark, str(tmp_path), 2)
    index.add(table(spark, [*CORNERS, (0.5, 0.5)]))
    assert ids(index.search(asked(spark, (0.5, 0.5)), 3))[0] == DELTA_ID_OFFSET + 4
    index.delete(index.delta.select("id"))
    with pytest.raises(VectorError):
        index.compact()


def test_queries_over_all_rows(spark, sf_dir):
    """Against brute force over every row."""
    from quillvec import queries as Q

    run = lambda name: [tuple(r) for r in Q.QUERIES[name](spark, sf_dir).collect()]
    rows = Q.vectors(spark, sf_dir).select("id", "embedding").orderBy("id").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    scaled = (v * (1 + ids[:, None] % 3)).astype(np.float32).astype(np.float64)
    got = dict(run("vec_l2_pairs"))
    assert sorted(got) == ids[:-1].tolist() and np.allclose([got[i] for i in ids[:-1].tolist()], np.linalg.norm(scaled[1:] - scaled[:-1], axis=1), atol=1e-3)
    assert {r[0] for r in run("vec_normalize")} == {r[0] for r in run("vec_cosine_zero_norm")} == {r[0] for r in run("pq_decode")} == set(ids.tolist())
    dist = np.linalg.norm(v[:, None] - v[None], axis=2)
    near = [[(round(dist[i, j], 9), j) for j in range(len(ids)) if j != i] for i in range(len(ids))]
    edges = {(i, j) for i in range(len(ids)) for _, j in sorted(near[i])[:5]}
    assert {(a, b) for a, b, _ in run("knn_graph")} == edges
    assert {tuple(x) for x in run("graph_symmetrize")} == edges | {(b, a) for a, b in edges}
    into = np.bincount([b for _, b in edges], minlength=len(ids))
    assert dict(run("graph_in_degree")) == dict(enumerate(into.tolist()))
    assert dict(run("graph_csr_offsets")) == dict(enumerate((np.cumsum(into) - into).tolist()))
    assert len(run("graph_pad")) == 8 * len(ids) and {r[0] for r in run("alpha_prune")} == set(ids.tolist())
    asked = ids[ids % 50 == 0].tolist()
    want = {(i, j) for i in asked for _, j in sorted((round(dist[i, j], 9), j) for j in range(len(ids)))[:10]}
    assert {(a, b) for a, b, *_ in run("knn_exact_l2")} == want
    assert {r[0] for r in run("beam_search")} == {r[0] for r in run("pq_adc_topk")} == set(asked)
