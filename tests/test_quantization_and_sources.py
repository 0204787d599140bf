from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.functions.distance import l2_squared
from quillvec.operators import knn, pq
from quillvec.operators.incremental import IncrementalIndex
from quillvec.operators.validate import VectorError
from quillvec.plans import benchmark
from quillvec.sources import files, vecs
from quillvec.streaming import ingest

SCHEMA = "id long, embedding array<float>"


@pytest.fixture(scope="module")
def data(spark):
    return vecs.generate(spark, 300, 16).cache()


@pytest.fixture(scope="module")
def quantizer(data):
    return pq.train(data, pq.PQConfig(4, 32, 5, 0))


def test_codes_and_table_distances(spark, data, quantizer):
    coded = pq.encode(data, quantizer)
    both = pq.decode(coded, quantizer).select("id", l2_squared("embedding", "decoded").alias("error"))
    assert both.agg(F.avg("error")).first()[0] < 1.0
    q = data.where("id < 3").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    tables = pq.distance_table(q, quantizer)
    met = pq.decode(coded, quantizer).join(F.broadcast(tables), F.lit(True))
    worst = met.select(F.abs(pq.table_distance("table", F.col("codes"), 32) - l2_squared("q", "decoded")).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-5
    found, truth = pq.adc_rerank(q, coded, data, quantizer, 5, 60), knn.exact_knn(q, data, 5, "l2sq")
    assert found.join(truth, ["qid", "id"], "left_semi").count() >= 10


def test_codebook_and_file_round_trip(spark, data, quantizer, tmp_path):
    again = pq.from_codebook(pq.codebook(spark, quantizer))
    assert np.array_equal(again.centroids, quantizer.centroids)
    files.write_quantizer(quantizer, f"{tmp_path}/q")
    assert np.allclose(files.read_quantizer(f"{tmp_path}/q").centroids, quantizer.centroids, atol=1e-6)
    assert pq.stats(spark, quantizer).first()["ratio"] == 16


def test_more_centroids_than_rows(data):
    q = pq.train(data.where("id < 5"), pq.PQConfig(4, 16, 2, 0))
    assert pq.encode(data, q).where(F.size("codes") != 4).count() == 0


@pytest.mark.parametrize("config", [pq.PQConfig(5), pq.PQConfig(0), pq.PQConfig(4, 0), pq.PQConfig(4, 257)])
def test_bad_configurations(data, config):
    with pytest.raises(VectorError):
        pq.train(data, config)


@pytest.mark.parametrize(("kind", "values"), [("fvecs", [[0.5, -1.25], [3.0, 4.0]]), ("bvecs", [[0.0, 255.0], [3.0, 4.0]]), ("ivecs", [[0, 4294967295], [3, 4]])])
def test_vector_files(spark, tmp_path, kind, values):
    df = spark.createDataFrame(list(enumerate(values)), f"id long, embedding array<{'long' if kind == 'ivecs' else 'float'}>")
    vecs.write_vecs(df, f"{tmp_path}/x", kind)
    assert [r["embedding"] for r in vecs.read_vecs(spark, f"file://{tmp_path}/x", kind).orderBy("id").collect()] == values
    assert vecs.read_vecs(spark, f"file://{tmp_path}/x", kind, limit=1).count() == 1


def test_bad_vector_files(spark, tmp_path):
    for name, data in (("short", b"\1"), ("ragged", b"\1\0\0\0aaaa\1"), ("mixed", b"\1\0\0\0aaaa\2\0\0\0aaaa")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="record"):
            vecs.read_vecs(spark, f"{tmp_path}/{name}", "fvecs").collect()


FAKE_H5PY = """
import numpy as np
class File(dict):
    def __init__(self, path, mode):
        super().__init__(np.load(path))
    def __enter__(self):
        return self
    def __exit__(self, *_):
        pass
"""


def test_hdf5_is_read_in_tasks(spark, tmp_path, monkeypatch):
    """With a stand-in for the optional library, which is not installed here."""
    (tmp_path / "h5py.py").write_text(FAKE_H5PY)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    monkeypatch.setattr(vecs, "RUN_BYTES", 100)
    r = np.random.default_rng(1)
    arrays = {"train": r.random((90, 4), np.float32), "test": r.random((7, 4), np.float32), "neighbors": r.integers(0, 90, (7, 3)).astype(np.int32), "distances": r.random((7, 3), np.float32)}
    np.savez(tmp_path / "x.npz", **arrays)
    parts = vecs.read_hdf5(spark, f"{tmp_path}/x.npz")
    for name, key, column in (("train", "id", "embedding"), ("test", "qid", "q"), ("neighbors", "qid", "ids"), ("distances", "qid", "d")):
        rows = parts[name].orderBy(key).collect()
        assert [r[key] for r in rows] == list(range(len(arrays[name]))) and np.array_equal(np.array([r[column] for r in rows]), arrays[name])
    near = knn.exact_knn(parts["test"], parts["train"], 3).orderBy("qid", "rank").collect()
    arrays["neighbors"], arrays["distances"] = (np.array([r[c] for r in near]).reshape(7, 3) for c in ("id", "dist"))
    arrays["neighbors"], arrays["distances"] = arrays["neighbors"].astype(np.int32), arrays["distances"].astype(np.float32)
    np.savez(tmp_path / "z.npz", **arrays)
    report = benchmark.hdf5_benchmark(spark, f"{tmp_path}/z.npz", f"{tmp_path}/hdf5", ks=(3,), beam=32).first()
    assert (report["k"], report["recall"], report["fraction"], report["complete"]) == (3, 1.0, 1.0, True)
    np.savez(tmp_path / "y.npz", train=arrays["train"])
    with pytest.raises(VectorError):
        vecs.read_hdf5(spark, f"{tmp_path}/y.npz")


def test_label_files(spark, tmp_path):
    (tmp_path / "short").write_bytes(b"abc")
    with pytest.raises(VectorError):
        files.read_labels(spark, f"{tmp_path}/short")
    (tmp_path / "cut").write_bytes(b"".join(int(x).to_bytes(8, "little") for x in (16, 3, 2, 5)))
    with pytest.raises(VectorError):
        files.read_labels(spark, f"{tmp_path}/cut")


def test_empty_clusters_start_anew(spark):
    rows = spark.createDataFrame([(i, [float(i % 4), 0.0]) for i in range(40)], SCHEMA)
    q = pq.Quantizer(np.array([[[0.0, 0.0], [0.0, 0.0], [99.0, 0.0], [98.0, 0.0]]]))
    moved = pq.lloyd_step(rows, q, np.array([[2.0, 0.0], [3.0, 0.0]]))
    assert {tuple(c) for c in moved.centroids[0].tolist()} >= {(1.5, 0.0), (2.0, 0.0), (3.0, 0.0)}


def test_ground_truth(spark, tmp_path):
    vecs.write_vecs(spark.createDataFrame([(0, [7, 8])], "id long, embedding array<long>"), f"{tmp_path}/i", "ivecs")
    vecs.write_vecs(spark.createDataFrame([(0, [1.0, 4.0])], SCHEMA), f"{tmp_path}/f", "fvecs")
    rows = vecs.truth_rows(vecs.read_ground_truth(spark, f"file://{tmp_path}/i", f"file://{tmp_path}/f")).orderBy("rank").collect()
    assert [(r["id"], r["dist"]) for r in rows] == [(7, 1.0), (8, 2.0)]


def test_index_and_label_files(spark, tmp_path):
    nodes = spark.createDataFrame([(0, [1.0, 2.0], [1]), (1, [3.0, 4.0], [0, 2]), (2, [5.0, 6.0], [])], "id long, embedding array<float>, neighbors array<long>")
    files.write_index(nodes, f"{tmp_path}/x", "l2", 1, 2)
    assert files.read_index_metadata(f"{tmp_path}/x")["medoid_id"] == 1
    assert files.read_index(spark, f"{tmp_path}/x").orderBy("id").collect() == nodes.orderBy("id").collect()
    labels = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "id long, labels array<long>")
    files.write_labels(labels, f"{tmp_path}/l")
    assert files.read_labels(spark, f"{tmp_path}/l").orderBy("id").collect() == labels.orderBy("id").collect()
    with pytest.raises(VectorError):
        files.write_labels(spark.createDataFrame([(0, [1]), (1, [3, 4])], "id long, labels array<long>"), f"{tmp_path}/m")


def test_stream_of_changes(spark, tmp_path):
    index = IncrementalIndex.empty(spark, f"{tmp_path}/index", 2)
    source = f"{tmp_path}/changes"
    spark.createDataFrame([("add", 0, [1.0, 1.0]), ("add", 1, [2.0, 2.0])], ingest.CHANGES).write.parquet(source)
    stream = spark.readStream.schema(ingest.CHANGES).parquet(source)
    ingest.ingest(stream, index, f"{tmp_path}/cp").awaitTermination(120)
    assert index.stats().first()["live"] == 2
    spark.createDataFrame([("delete", (1 << 48), None)], ingest.CHANGES).write.mode("append").parquet(source)
    ingest.ingest(stream, index, f"{tmp_path}/cp").awaitTermination(120)
    assert index.stats().first()["live"] == 1
    ingest.apply_changes(index, spark.createDataFrame([("add", 5, [9.0, 9.0])], ingest.CHANGES), 0)  # delivered again
    assert index.stats().first()["live"] == 1
    index.compact()
    again = IncrementalIndex.open(spark, index.path)
    ingest.apply_changes(again, spark.createDataFrame([("add", 5, [9.0, 9.0])], ingest.CHANGES), 0)
    assert again.stats().first()["live"] == 1


def test_first_batch_delivered_twice(spark, tmp_path):
    index = IncrementalIndex.empty(spark, f"{tmp_path}/index", 2)
    changes = spark.createDataFrame([("add", 0, [1.0, 1.0]), ("add", 1, [2.0, 2.0])], ingest.CHANGES)
    for _ in range(2):
        ingest.apply_changes(index, changes, 0)
    assert index.stats().first()["live"] == 2
    ingest.apply_changes(index, changes, 1)
    assert index.stats().first()["live"] == 4


def test_percentiles_of_repeated_and_many_values(spark, monkeypatch):
    from quillvec.functions import evaluate

    monkeypatch.setattr(evaluate, "IN_ORDER", 50)
    r = np.random.default_rng(2)
    for x in (np.full(1000, 3.0), np.concatenate([np.full(900, 1.0), r.random(100)]), r.normal(size=2000), np.array([5.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        for p in (0, 50, 95, 99, 100):
            want = np.sort(x)[int(p / 100 * (len(x) - 1) + 0.5)]
            assert evaluate.percentile(df, "v", p).first()["value"] == want
    assert evaluate.percentile(df.limit(0), "v", 50).first()["value"] == 0


def test_charts(spark, tmp_path):
    from xml.dom import minidom

    from quillvec.plans import charts

    rows = spark.createDataFrame([(1, 2.0, "a"), (2, None, "a"), (3, 5.0, "b<"), (4, 4.0, "b<")], "x int, y double, s string")
    assert charts.line_chart(rows, f"{tmp_path}/c.svg", "x", "y", series="s", title="A & B") == 3
    page = minidom.parse(f"{tmp_path}/c.svg")
    assert len(page.getElementsByTagName("circle")) == 3 and len(page.getElementsByTagName("polyline")) == 2
    assert charts.line_chart(rows.limit(0), f"{tmp_path}/d.svg", "x", "y") == 0


def test_benchmarks(spark, tmp_path):
    rows = benchmark.run_incremental_benchmark(spark, f"{tmp_path}/i", 200, 1, 20, 10, 8).collect()
    assert [r["phase"] for r in rows] == ["add", "search", "delete", "search_after_delete", "compact"] and rows[-1]["n"] == 200
    assert benchmark.compare_with_exact(spark, f"{tmp_path}/c", (300,), 8, 10).first()["recall"] > 0.8
    assert benchmark.engine_info(spark).first()["spark"] == spark.version
