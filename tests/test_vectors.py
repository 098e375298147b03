import math
import random

import pytest
from pyspark.sql import functions as F

from veclume.functions import vectors as V
from veclume.functions.codes import BinaryQuantizer, PQConfig, ProductQuantizer, ScalarQuantizer
from veclume.operators import training as K


def _one(spark, value, a=None, b=None):
    a, b = ([float(x) for x in v] if v is not None else None for v in (a, b))
    frame = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return frame.select(value.alias("x")).first().x


@pytest.mark.parametrize(
    "a, b, cosine",
    [([1, 2, 3], [1, 2, 3], 1), ([1, 2, 3], [-1, -2, -3], -1), ([1, 0], [0, 1], 0), ([0, 0], [1, 1], 0), ([0, 0], [0, 0], 0), ([], [], 1), ([1e-3, 0], [1e3, 0], 1)],
)
def test_cosine_by_hand(spark, a, b, cosine):
    for tier in ("column", "arrow"):
        assert math.isclose(_one(spark, V.score("a", "b", "cosine", tier), a, b), cosine, abs_tol=1e-6)


def test_distances_by_hand(spark):
    for tier in ("column", "arrow"):
        assert math.isclose(_one(spark, V.score("a", "b", "l2", tier), [0, 0], [3, 4]), 5)
        assert _one(spark, V.score("a", "b", "dot", tier), [1, 2, 3], [4, 5, 6]) == 32
        assert _one(spark, V.score("a", "b", "dot", tier), [], []) == 0
        assert _one(spark, V.score("a", "b", "dot", tier), None, [1]) is None
    assert _one(spark, V.l2_squared("a", "b"), [0, 0], [3, 4]) == 25


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
@pytest.mark.parametrize("tier", ["column", "arrow"])
def test_unequal_lengths_are_an_error(spark, metric, tier):
    with pytest.raises(Exception, match="dimension mismatch"):
        _one(spark, V.score("a", "b", metric, tier), [1, 2], [1, 2, 3])


def test_tiers_agree_at_all_sizes(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(-1, 1) for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)]) for n in (1, 3, 4, 7, 8, 15, 16, 31, 64, 100, 384)]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    for m in V.METRICS:
        for r in frame.select(V.score("a", "b", m).alias("x"), V.score("a", "b", m, "arrow").alias("y")).collect():
            assert math.isclose(r.x, r.y, abs_tol=1e-6)


def test_normalising(spark):
    assert _one(spark, V.normalize("a"), [3, 4]) == pytest.approx([0.6, 0.8])
    assert _one(spark, V.normalize("a"), [0, 0]) == [0, 0] and _one(spark, V.normalize("a"), []) == []
    assert _one(spark, V.l2_normalize("a"), [1e-13, 0])[0] == pytest.approx(1e-13)
    assert _one(spark, V.normalize("a"), [1e-13, 0])[0] == pytest.approx(1)


def test_approx_equal(spark):
    assert _one(spark, V.approx_equal("a", "b", 0.1), [1, 2], [1.05, 2]) is True
    assert _one(spark, V.approx_equal("a", "b", 0.01), [1, 2], [1.05, 2]) is False
    assert _one(spark, V.approx_equal("a", "b", 9.0), [1, 2], [1]) is False


def test_scalar_fit_by_hand(spark):
    frame = spark.createDataFrame([([0.0, 0.5, 1.0],), ([0.2, 0.3, 0.8],), ([0.1, 0.6, 0.9],)], "embedding array<float>")
    q = K.fit_scalar(frame)
    assert q.low == pytest.approx((0, 0.3, 0.8)) and q.high == pytest.approx((0.2, 0.6, 1.0))
    with pytest.raises(ValueError):
        K.fit_scalar(frame.limit(0))


def test_scalar_codes_stop_at_the_ends(spark):
    q = ScalarQuantizer.for_normalized(4)
    assert _one(spark, q.quantize("a"), [-9, 9, float("nan"), 0]) == [0, 255, 0, 127]
    flat = ScalarQuantizer.with_bounds(1, 5.0, 5.0)
    assert _one(spark, flat.quantize("a"), [7]) == [2]
    back = _one(spark, q.dequantize(q.quantize("a")), [0.5, -0.25, 1, -1])
    assert back == pytest.approx([0.5, -0.25, 1, -1], abs=2 / 255)
    assert _one(spark, q.symmetric(q.quantize("a"), q.quantize("b")), [9, 0, 0, 0], [-1, 0, 0, 0]) == 255


def test_bits(spark):
    q = BinaryQuantizer(70)
    v = [1.0 if i % 3 == 0 else -1.0 for i in range(70)]
    assert q.byte_len == 9 and len(_one(spark, q.quantize("a"), v)) == 2
    assert _one(spark, q.signs(q.quantize("a")), v) == v
    assert _one(spark, q.hamming(q.quantize("a"), q.quantize("b")), v, [-x for x in v]) == 70
    assert _one(spark, BinaryQuantizer(4).signs(BinaryQuantizer(4).quantize("a")), [0.0, -0.0, float("nan"), -1e-9]) == [1, 1, -1, -1]
    assert _one(spark, BinaryQuantizer(2).inner("a", BinaryQuantizer(2).quantize("b")), [2, 3], [1, -1]) == -1


def test_product_codes(spark):
    c = PQConfig(4, subspaces=2, bits=1)
    q = ProductQuantizer.from_codebooks(c, [[[0, 0], [1, 1]], [[0, 0], [0, 0]]])
    assert _one(spark, q.encode("a"), [0.9, 1, 5, 5]) == [1, 0]  # of equals the first
    assert _one(spark, q.decode(q.encode("a")), [0.9, 1, 5, 5]) == [1, 1, 0, 0]
    assert _one(spark, q.error("a"), [1, 1, 3, 4]) == 5
    for broken in (PQConfig(10, 3), PQConfig(8, 2, bits=9)):
        with pytest.raises(ValueError):
            broken.validate()
    with pytest.raises(ValueError):
        ProductQuantizer.from_codebooks(c, [[[0, 0]]])


def test_training_recalls(spark):
    rng = random.Random(42)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)]) for i in range(500)]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    q = K.train_pq(frame, PQConfig(32, 8, 8, iterations=10))
    coded = frame.select("id", "embedding", q.encode("embedding").alias("pq"))
    hits = 0
    for n in range(10):
        query = rows[n][1]
        near = [r.id for r in coded.orderBy(q.with_table(q.table_literal(query), "pq"), "id").limit(10).collect()]
        true = [r.id for r in frame.orderBy(V.l2("embedding", V.literal(query)), "id").limit(10).collect()]
        hits += len(set(near) & set(true))
    assert hits / 100 >= 0.5


def test_seeds_of_equal_points():
    import numpy as np

    assert K.plus_plus(np.ones((2, 3)), 5, np.random.default_rng(1)).shape == (5, 3)


def test_element_types_do_not_matter(spark):
    frame = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0])], "a array<double>, b array<float>")
    assert frame.select(V.dot("a", "b").alias("x")).first().x == 5
    assert frame.select(F.size(V.literal([1, 2])).alias("n")).first().n == 2
