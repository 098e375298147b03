import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veclume.functions import embedding as E
from veclume.operators import maintenance as T
from veclume.operators import shaping as R
from veclume.plans.config import BatchConfig, LogConfig, PaginationConfig
from veclume.sources import blobs, store, vecs
from veclume.streaming import ingest as I


def _docs(spark, ids, content="Content for {}"):
    return spark.createDataFrame([(i, content.format(i), [0.1, 0.2], None) for i in ids], T.DOCUMENT)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(sorted(blobs.CODECS)))
def test_blobs_round_trip(data, codec):
    assert blobs.decompress(blobs.compress(data, codec)) == data


def test_broken_blobs():
    good = blobs.compress(b"x" * 100, "gzip")
    for broken in (b"", good[:3], bytes([9]) + good[1:], good[:1] + bytes([7]) + good[2:]):
        with pytest.raises(ValueError):
            blobs.decompress(broken)
    with pytest.raises(Exception):
        blobs.decompress(good[:-9])


def test_log_then_checkpoint_then_tail(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s", LogConfig(checkpoint_ops=3, keep_checkpoints=1))
    assert s.state().count() == 0 and not s.needs_checkpoint()
    s.log_add(_docs(spark, ["doc1", "doc2", "doc3"]))
    assert s.needs_checkpoint()
    s.checkpoint()
    s.log_add(_docs(spark, ["doc4"]))
    assert s.pending().count() == 1 and s.snapshot().count() == 3
    s.log_remove(_docs(spark, ["doc1"]).select("id"))
    s.log_add(_docs(spark, ["doc2"], "changed {}"))
    again = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    state = {r.id: r.content for r in again.state().collect()}
    assert state == {"doc2": "changed doc2", "doc3": "Content for doc3", "doc4": "Content for doc4"}
    s.checkpoint()
    assert s.pending().count() == 0 and s.snapshot().count() == 3
    assert len(os.listdir(f"{tmp_path}/s/snapshots")) == 1
    s.log_clear()
    assert s.state().count() == 0
    seqs = [r.seq for r in s.log().collect()]
    assert len(seqs) == len(set(seqs))


def test_a_checkpoint_keeps_appends_that_come_meanwhile(spark, tmp_path, monkeypatch):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    s.log_add(_docs(spark, ["a"]))
    whole = s._state

    def late(manifest, parts):
        state = whole(manifest, parts)
        s.log_add(_docs(spark, ["late"]))  # after the state is taken, before its parts are dropped
        return state

    monkeypatch.setattr(s, "_state", late)
    s.checkpoint()
    again = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert sorted(r.id for r in again.state().collect()) == ["a", "late"]
    again.checkpoint()
    assert sorted(r.id for r in again.snapshot().collect()) == ["a", "late"] and again.pending().count() == 0


@pytest.mark.parametrize("step", ["rename", "delete"])
def test_a_crash_between_the_steps_of_a_checkpoint(spark, tmp_path, monkeypatch, step):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    s.log_add(_docs(spark, ["a", "b"]))
    s.checkpoint()
    s.log_add(_docs(spark, ["c"]))
    s.log_remove(_docs(spark, ["a"]).select("id"))

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(s.files, "write" if step == "rename" else "delete", crash)
    with pytest.raises(RuntimeError):
        s.checkpoint()
    again = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert sorted(r.id for r in again.state().collect()) == ["b", "c"]
    again.log_add(_docs(spark, ["d"]))
    again.checkpoint()
    assert sorted(r.id for r in again.snapshot().collect()) == ["b", "c", "d"] and again.log().count() == 0


def test_files_are_replaced_whole(spark, tmp_path):
    files = store.Files(spark, f"file://{tmp_path}")
    at = f"file://{tmp_path}/one.json"
    for text in ("first", "second"):
        files.write(at, text)
        assert files.read(at) == text
    assert len([f for f in os.listdir(tmp_path) if not f.startswith(".")]) == 1


def test_a_changed_log_is_noticed(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    s.log_add(_docs(spark, ["a"]))
    with pytest.raises(Exception, match="bad checksum"):
        store.verified(s.log().withColumn("id", F.lit("b"))).collect()


def test_items(spark, tmp_path):
    items = store.ItemStore(spark, f"file://{tmp_path}/items", "zstd")
    items.save("one", _docs(spark, ["a"]))
    created = items.metadata("one")["created_at"]
    items.save("one", _docs(spark, ["a", "b"]))
    meta = items.metadata("one")
    assert items.load("one").count() == 2 and meta["created_at"] == created and meta["codec"] == "zstd" and items.total_size() == meta["size"] > 0
    assert items.list() == ["one"] and items.exists("one") and not items.exists("two")
    for name in ("../x", "", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            items.save(name, _docs(spark, ["a"]))
    items.clear()
    assert items.list() == []
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        store.ItemStore(spark, f"file://{tmp_path}/file")


def test_vecs_files(spark, tmp_path):
    x = np.arange(60, dtype="<f4").reshape(12, 5)
    raw = b"".join(np.int32(5).tobytes() + r.tobytes() for r in x)
    (tmp_path / "a.fvecs").write_bytes(raw)
    vecs.register(spark)
    rows = spark.read.format("fvecs").option("splitBytes", 60).load(str(tmp_path / "a.fvecs"))
    assert rows.rdd.getNumPartitions() > 1
    assert [r.vector for r in rows.orderBy("id").collect()] == x.tolist()
    vecs.write_vecs(rows, str(tmp_path / "out"))
    files = sorted(f for f in os.listdir(tmp_path / "out") if f.endswith(".fvecs"))
    assert b"".join((tmp_path / "out" / f).read_bytes() for f in files) == raw
    (tmp_path / "bad.fvecs").write_bytes(raw[:-2])
    with pytest.raises(Exception, match="whole number"):
        vecs.read_vecs(spark, str(tmp_path / "bad.fvecs")).count()
    (tmp_path / "none.ivecs").write_bytes(b"")
    assert vecs.read_vecs(spark, str(tmp_path / "none.ivecs"), "ivecs").count() == 0


def test_npy(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(7, 3)).astype(np.float32)
    np.save(tmp_path / "base.npy", x)
    rows = vecs.read_npy(spark, f"file://{tmp_path}/base.npy").orderBy("id").collect()
    assert np.allclose([r.vector for r in rows], x)


def test_synthetic_is_the_same_however_partitioned(spark):
    a, b = vecs.synthetic(spark, 50, 8), vecs.synthetic(spark, 50, 8).repartition(7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert all(0 <= v <= 255 and v == int(v) for r in a.collect() for v in r.vector)


def test_results_file(spark, tmp_path):
    runs = [{"library": "l", "algorithm": "a", "recall_at_10": 0.9, "qps": 10.0, "parameters": {"ef": "5"}}]
    (tmp_path / "r.json").write_text(json.dumps(runs, indent=1))
    r = vecs.read_results(spark, f"file://{tmp_path}/r.json").first()
    assert r.qps == 10 and r.parameters == {"ef": "5"} and r.notes is None


def test_results_are_written_as_arrays_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vecs, "_RUNS", 40)
    runs = spark.range(0, 100, 1, 1).selectExpr("concat('l\\n\"]', id) as library", "cast(null as string) as notes", "cast(id as double) as qps", "map('ef', cast(id as string)) as parameters")
    vecs.write_results(runs, f"file://{tmp_path}/many")
    files = [json.loads(p.read_text()) for p in (tmp_path / "many").glob("part-*")]
    assert sorted(map(len, files)) == [20, 40, 40]
    back = vecs.read_results(spark, f"file://{tmp_path}/many")
    assert sorted(map(str, back.select(*runs.columns).collect())) == sorted(map(str, runs.collect()))
    vecs.write_results(runs.limit(0), f"file://{tmp_path}/none")
    assert vecs.read_results(spark, f"file://{tmp_path}/none").count() == 0


RESULTS = [("doc1", 0.9, '{"category":"A"}'), ("doc2", 0.5, '{"category":"B","n":1,"x":null}'), ("doc3", 0.3, None), ("doc4", float("nan"), "not json")]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(RESULTS, "id string, score double, metadata string")


def test_filters_by_hand(results):
    ids = lambda f: sorted(r.id for r in f.apply(results).collect())
    assert ids(R.ResultFilter().min_score(0.4)) == ["doc1", "doc2", "doc4"]
    assert ids(R.ResultFilter().has_metadata_field("category")) == ["doc1", "doc2"]
    assert ids(R.ResultFilter().has_metadata_field("x")) == ["doc2"]
    assert ids(R.ResultFilter().metadata_equals("category", "A")) == ["doc1"]
    assert ids(R.ResultFilter().metadata_equals("n", 1)) == ["doc2"] and ids(R.ResultFilter().metadata_equals("n", 1.0)) == []
    assert ids(R.ResultFilter().metadata_equals("x", None)) == ["doc2"]
    assert ids(R.ResultFilter()) == ["doc1", "doc2", "doc3", "doc4"]
    assert [r.id for r in R.ResultFilter().max_results(1).apply(results.filter("NOT isnan(score)"), [F.desc("score")]).collect()] == ["doc1"]


def test_pages(results):
    order = [F.asc("id")]
    assert [r.id for r in R.page(results, 1, 3, order).collect()] == ["doc4"]
    assert R.page(results, 5, 3, order).count() == 0
    info = R.page_info(results, 1, 3).first()
    assert (info.total_pages, info.has_next, info.has_prev) == (2, False, True)
    for bad in (lambda: R.page(results, 0, 0, order), lambda: PaginationConfig(0), lambda: BatchConfig(0)):
        with pytest.raises(ValueError):
            bad()
    assert PaginationConfig().candidates(1) == 40


def test_iterator(results):
    it = R.ResultIterator(results.orderBy("id"))
    assert it.peek().id == "doc1" and next(it).id == "doc1"
    assert [r.id for r in it.skip_n(1).collect_remaining()] == ["doc3", "doc4"] and it.peek() is None
    assert it.skip_n(3).collect_remaining() == []


def test_quarantine(spark):
    rows = [("a", "", [1.0, 2.0], None), ("b", "", [1.0], None), ("c", "", None, None), ("d", "", [float("nan"), 1.0], None)]
    docs = spark.createDataFrame(rows, T.DOCUMENT)
    good, bad = I.ingest(docs, 2, BatchConfig(continue_on_error=True))
    assert [r.id for r in good.collect()] == ["a"]
    assert {r.id: r.error for r in bad.collect()} == {"b": "dimension mismatch: expected 2, got 1", "c": "no embedding", "d": "embedding isn't finite"}
    with pytest.raises(Exception, match="dimension mismatch"):
        I.ingest(docs, 2)[0].collect()


def test_progress():
    p = I.BatchProgress(50, 1, 2, 200, 1000.0)
    assert p.percent() == 25 and p.docs_per_sec() == 50 and p.eta_ms() == 3000
    assert I.BatchProgress(0, 0, 0, None, 0.0).percent() is None


def test_streaming_ingest(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    _docs(spark, ["a", "b"]).write.parquet(source)
    s, seen = store.SnapshotStore(spark, f"file://{tmp_path}/s"), []
    for more in (None, ["c"]):
        if more:
            _docs(spark, more).write.mode("append").parquet(source)
        stream = spark.readStream.schema(T.DOCUMENT).parquet(source)
        I.stream_into(stream, s, 2, f"file://{tmp_path}/ck", on_progress=seen.append).awaitTermination(120)
    assert sorted(r.id for r in s.state().collect()) == ["a", "b", "c"] and len(seen) == 2
    assert all(p.elapsed_ms > 0 and p.docs_per_sec() > 0 for p in seen)
    # a micro-batch that is written again replaces itself
    s.log_add(_docs(spark, ["c"]), batch=1)
    assert s.log().count() == 3


def test_pooling(spark):
    frame = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "h array<array<float>>, m array<int>")
    assert frame.select(E.mean_pooling("h", "m").alias("x")).first().x == [2, 3]
    with pytest.raises(Exception, match="no token counts"):
        frame.select(E.mean_pooling(F.col("h"), F.array(F.lit(0), F.lit(0), F.lit(0)))).collect()


def test_model_embedder(tmp_path):
    hidden = np.array([[[1.0, 0.0], [3.0, 0.0]], [[0.0, 2.0], [5.0, 5.0]]])
    assert E.pool(hidden, np.array([[1, 1], [1, 0]])).tolist() == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        E.pool(hidden, np.zeros((2, 2), int))
    with pytest.raises(FileNotFoundError):
        E.OnnxEmbedder(str(tmp_path / "no.onnx"), str(tmp_path / "no.json"))
    for name in ("m.onnx", "t.json"):
        (tmp_path / name).write_text("x")
    with pytest.raises(ValueError):
        E.OnnxEmbedder(str(tmp_path / "m.onnx"), str(tmp_path / "t.json"))([])


def test_embedding(spark, tmp_path):
    one = E.hashing_embedder(16)
    assert np.allclose(np.linalg.norm(one(["some words"]), axis=1), 1) and not one([""]).any()
    docs = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, None), (4, "z")], "id bigint, content string")
    cached = E.CachedEmbedder(one, f"file://{tmp_path}/texts")
    for _ in range(2):
        rows = {r.id: r.embedding for r in cached.embed(docs).collect()}
        assert rows[1] == rows[2] == pytest.approx(one(["x y"])[0].tolist()) and rows[3] is None
    assert spark.read.parquet(f"file://{tmp_path}/texts").count() == cached.cache_size(spark) == 2
    assert cached.stats(docs).first()[:] == (3, 2, round(1 / 3, 6))
    cached.clear_cache(spark)
    assert cached.cache_size(spark) == 0
    with pytest.raises(RuntimeError):
        E.embed_column("content", None)
    assert E.sine_embed("", 2) == [0.0, 0.0]
