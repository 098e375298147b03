import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veclume.functions.codes import PQConfig
from veclume.operators import graph as G
from veclume.operators import indexes as X
from veclume.operators import maintenance as T
from veclume.operators import search as S
from veclume.operators.evaluation import recall
from veclume.plans.config import AnnConfig, QuantizedConfig


def _docs(spark, n, dim, seed=1):
    rng = random.Random(seed)
    rows = [(f"doc{i}", f"Test document doc{i}", [rng.uniform(-1, 1) for _ in range(dim)], None) for i in range(n)]
    return spark.createDataFrame(rows, T.DOCUMENT), [r[2] for r in rows]


@pytest.fixture(scope="module")
def basis(spark):
    rows = [("x", "ex", [1.0, 0.0, 0.0], '{"k":1}'), ("y", "ey", [0.0, 1.0, 0.0], None), ("z", "ez", [0.0, 0.0, 1.0], None)]
    return spark.createDataFrame(rows, T.DOCUMENT)


def test_exact_search(basis):
    index = X.ExactIndex(3, basis)
    rows = index.search([0.9, 0.1, 0.0], 2).collect()
    assert [r.id for r in rows] == ["x", "y"] and rows[0].metadata == '{"k":1}' and "embedding" not in rows[0]
    assert index.search([1, 0, 0], 10).count() == 3
    assert index.clear().search([1, 0, 0], 3).count() == 0
    with pytest.raises(ValueError, match="dimension mismatch"):
        index.search([1, 0], 1)
    for dim in (0, 100_001):
        with pytest.raises(ValueError):
            X.ExactIndex(dim, basis)


def test_an_id_that_comes_again(spark, basis):
    again = spark.createDataFrame([("x", "new", [0.0, 0.0, 1.0], None)], T.DOCUMENT)
    one = X.ExactIndex(3, basis).add(again)
    assert one.len() == 3 and one.documents.filter("id = 'x'").first().content == "new"
    assert X.ExactIndex(3, basis, "append").add(again).len() == 4


def test_wrong_sizes_fail_the_job(spark, basis):
    bad = spark.createDataFrame([("b", "", [1.0, 0.0], None)], T.DOCUMENT)
    with pytest.raises(Exception, match="dimension mismatch: expected 3, got 2"):
        X.ExactIndex(3, basis).add(bad).documents.collect()


def test_scores_are_ordered_and_bounded(spark):
    docs, vectors = _docs(spark, 300, 32)
    for index in (X.ExactIndex(32, docs), X.CellIndex.build(docs, 32, 6), X.SQ8Index(32, docs), X.BinaryIndex(32, docs, True)):
        rows = index.search(vectors[5], 20).collect()
        scores = [r.score for r in rows]
        assert scores == sorted(scores, reverse=True) and len(rows) == 20 and all(-1 <= s <= 1 for s in scores)
        assert rows[0].id == "doc5"


def test_cells_probe_more_for_more_width(spark):
    docs, vectors = _docs(spark, 400, 16)
    index = X.CellIndex.build(docs, 16, 10, AnnConfig(ef_search=1))
    exact = {r.id for r in X.ExactIndex(16, docs).search(vectors[0], 10).collect()}
    found = [len(exact & {r.id for r in index.search(vectors[0], 1 if ef == 1 else 10, ef=ef).collect()}) for ef in (1, 4, 10)]
    assert found == sorted(found) and found[-1] == 10


def test_probed_cells_are_pruned(spark, tmp_path):
    docs, vectors = _docs(spark, 200, 8)
    index = X.CellIndex.build(docs, 8, 5, AnnConfig(ef_search=2)).write(f"file://{tmp_path}/cells")
    plan = index.search(vectors[0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("make, least", [(lambda d: X.SQ8Index.fit(d, 128), 7), (lambda d: X.BinaryIndex(128, d, True), 5)])
def test_quantized_recall(spark, make, least):
    docs, vectors = _docs(spark, 100, 128, seed=42)
    index = make(docs)
    query = vectors[42]
    true = {r.id for r in X.ExactIndex(128, docs).search(query, 10).collect()}
    got = index.search_and_rerank(query, 60, 10) if isinstance(index, X.BinaryIndex) else index.search(query, 10)
    assert len(true & {r.id for r in got.collect()}) >= least


def test_written_indexes_read_codes(spark, tmp_path):
    docs, vectors = _docs(spark, 120, 16)
    pq = X.PQIndex.train(docs, PQConfig(16, 4, 4, iterations=3), QuantizedConfig().with_reranking(30))
    for n, index in enumerate((X.SQ8Index.fit(docs, 16), X.BinaryIndex(16, docs, True), pq)):
        want = [tuple(r) for r in index.search(vectors[3], 5).collect()]
        index.write(f"file://{tmp_path}/{n}")
        again = type(index).read(spark, f"file://{tmp_path}/{n}")
        found = again.search(vectors[3], 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == want and want[0][0] == "doc3"
        assert plan.count("ArrowEvalPython") <= 2 and (n == 2 or "embedding" not in plan.split("ReadSchema")[1])
        assert again.add(docs.limit(1)).len() == 121
    with pytest.raises(ValueError):
        X.SQ8Index.read(spark, f"file://{tmp_path}/1")


def test_codes_of_both_tiers_agree(spark):
    docs, _ = _docs(spark, 60, 16)
    sq, pq = X.SQ8Index.fit(docs, 16), X.PQIndex.train(docs, PQConfig(16, 4, 3, iterations=3), QuantizedConfig().with_reranking(30))
    assert sq.documents.filter(sq.quantizer.quantize("embedding") != F.col("sq8")).count() == 0
    assert pq.documents.filter(pq.quantizer.encode("embedding") != F.col("pq")).count() == 0


def test_reranking_widens_to_k(spark):
    assert QuantizedConfig(ef_search=5).with_reranking(8).beam(20) == 20
    assert QuantizedConfig().beam(10) == 50


def test_local_store(spark, tmp_path):
    local = X.LocalStore(spark, 2)
    local.add_document("a", "A", [1, 0])
    local.add_document("b", "B", [0, 1])
    local.add_document("a", "A2", [1, 1])
    assert local.document_count() == 2 and local.search([0, 1], 1).first().id == "b"
    assert local.remove_document("b") and not local.remove_document("b")
    local.save(f"file://{tmp_path}/one")
    other = X.LocalStore(spark, 2)
    other.load(f"file://{tmp_path}/one")
    assert other.document_count() == 1 and other.embedding_dim() == 2 and not other.is_ann()
    near = X.LocalStore(spark, 2, use_ann=True, cells=2)
    near.add_documents(other.index.documents)
    assert near.search([1, 1], 1).first().id == "a" and near._ann[0] is near.index
    local.clear()
    assert local.document_count() == 0
    with pytest.raises(ValueError):
        local.add_document("c", "C", [1])


def test_joins_of_many_queries(spark, monkeypatch):
    rng = random.Random(2)
    x = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)], "id bigint, embedding array<float>")
    q = x.select(F.col("id").alias("query_id"), "embedding")
    for metric in ("cosine", "l2", "dot"):
        want = sorted(map(tuple, S.batch_top_k(q, x, 7, metric).select("query_id", "id", "score", "rank").collect()))
        assert sorted(map(tuple, S.knn_join(q, x, 7, metric).select("query_id", "id", "score", "rank").collect())) == want
        monkeypatch.setattr(S, "BROADCAST_QUERIES", 10)
        monkeypatch.setattr(S, "_BLOCK", 64)
        assert sorted(map(tuple, S.knn_join(q, x, 7, metric).select("query_id", "id", "score", "rank").collect())) == want
        monkeypatch.undo()
    assert S.knn_join(q, x, 3, exclude_self=True).filter("query_id = id").count() == 0
    assert S.knn_join(q.limit(0), x, 3).count() == 0 and S.knn_join(q, x.limit(0), 3).count() == 0


def test_many_queries_meet_slices_of_bounded_size(spark, monkeypatch):
    rng = random.Random(5)
    x = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(400)], "id bigint, embedding array<float>")
    q = x.select(F.col("id").alias("query_id"), "embedding")
    want = sorted(map(tuple, S.batch_top_k(q, x, 7).select("query_id", "id", "score", "rank").collect()))
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 10)
    plan = S.knn_join(q, x, 7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    monkeypatch.setattr(S, "_GROUP", 64 * 4 * 8)
    monkeypatch.setattr(S, "_SLICE", 50 * 4 * 8)
    found = S.knn_join(q, x, 7)
    cells = re.search(r", (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert int(cells[1]) >= 7 * 8
    assert sorted(map(tuple, found.select("query_id", "id", "score", "rank").collect())) == want


def test_top_k_is_a_limited_sort(spark, basis):
    plan = S.top_k(basis, [1, 0, 0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_graph_search_recalls(spark):
    rng = random.Random(7)
    query = [rng.uniform(-1, 1) for _ in range(16)]
    rows = [(i, [0.9 * a + 0.1 * rng.uniform(-1, 1) if i < 10 else rng.uniform(-1, 1) for a in query]) for i in range(300)]
    x = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    config = AnnConfig(m=8, m0=16, ef_construction=24)
    edges = G.build(x, config).persist()
    degree = edges.groupBy("src", "layer").count().groupBy("layer").agg(F.max("count").alias("n")).collect()
    assert all(r.n <= (16 if r.layer == 0 else 8) for r in degree)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    q = spark.createDataFrame([(0, query)], "query_id bigint, embedding array<float>")
    got = G.beam(q, x, edges, x.filter("id in (50, 150, 250)").select("id"), 32, 10, 10)
    truth = S.knn_join(q, x, 10)
    assert recall(got, truth, 10).first().recall >= 0.7


def test_diverse_neighbours_by_hand():
    import numpy as np

    far = np.array([0.1, 0.15, 0.5])
    between = np.array([[0, 0.02, 0.9], [0.02, 0, 0.9], [0.9, 0.9, 0]])
    assert G.pick_diverse(far, between, 2, False) == [0, 2]
    assert G.pick_diverse(far, between, 3, True) == [0, 2, 1]


def test_levels_thin_out(spark):
    counts = {r.level: r["count"] for r in G.levels(spark.range(20000), AnnConfig(m=8)).groupBy("level").count().collect()}
    assert math.isclose(counts[0] / 20000, 7 / 8, abs_tol=0.02) and counts[0] > counts[1] > counts.get(2, 0)
