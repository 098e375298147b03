"""Every operator as a named query over the driver's tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.functions import codes as C
from veclume.functions import embedding as E
from veclume.functions import vectors as V
from veclume.operators import evaluation as M
from veclume.operators import graph as G
from veclume.operators import indexes as X
from veclume.operators import maintenance as T
from veclume.operators import search as S
from veclume.operators import shaping as R
from veclume.operators import training as K
from veclume.plans.config import AnnConfig, BatchConfig, PaginationConfig, QuantizedConfig
from veclume.sources import blobs, store, vecs
from veclume.sources.scratch import scratch, written
from veclume.streaming import ingest as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Vectors in double precision, and the first twenty as queries.
_V = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id < 20)"
_PAIRS = _V + ", p AS (SELECT query_id, vec_id AS id, qe, e FROM q, v WHERE vec_id < 200)"
_COS = "greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"
_ONE = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_DOCS = "SELECT e.vec_id AS id, d.text AS content, e.embedding, e.label, d.lang, d.source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).filter("id < 20").select(F.col("id").alias("query_id"), "embedding")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as indexes take them: texts joined to vectors, the rest as JSON metadata."""
    d = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")
    joined = _vectors(spark, sf).join(d, "id", "left")
    return joined.select("id", "content", "embedding", F.to_json(F.struct("label", "lang", "source")).alias("metadata"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    x = _vectors(spark, sf).filter("id < 200")
    return x.crossJoin(F.broadcast(_queries(spark, sf).select("query_id", F.col("embedding").alias("qe")))).select("query_id", "id", "qe", F.col("embedding").alias("e"))


def _first(spark: SparkSession, sf: str, n: int = 0) -> list[float]:
    return list(_vectors(spark, sf).filter(F.col("id") == n).first().embedding)


def _six(c: Column) -> Column:
    return F.round(c, 6)


# vectors


@query(f"{_PAIRS} SELECT query_id, id, round({_COS.format(a='qe', b='e')}, 6) AS score FROM p")
def v1_cosine(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", _six(V.cosine("qe", "e")).alias("score"))


@query(f"{_PAIRS} SELECT query_id, id, round(list_distance(qe, e), 6) AS score FROM p")
def v2_l2(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", _six(V.l2("qe", "e")).alias("score"))


@query(f"{_PAIRS} SELECT query_id, id, round(list_dot_product(qe, e), 6) AS score FROM p")
def v3_dot(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", _six(V.dot("qe", "e")).alias("score"))


@query(f"{_V}, u AS (SELECT vec_id AS id, list_transform(e, lambda x: x * 3) AS w FROM v), t AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos, sqrt(list_dot_product(w, w)) AS n FROM u) SELECT id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS x FROM t")
def v4_normalize(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return _vectors(spark, sf).select("id", F.posexplode(V.normalize(tripled)).alias("pos", "x")).select("id", "pos", _six(F.col("x")).alias("x"))


@query(f"{_PAIRS} SELECT query_id, id, list_bool_and(list_transform(range(1, 65), lambda i: abs(qe[i] - e[i]) <= 0.35)) AS near FROM p")
def v5_approx_equal(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", V.approx_equal("qe", "e", 0.35).alias("near"))


@query(f"{_V} SELECT vec_id AS id, round(sqrt(list_dot_product(e, e)), 6) AS size FROM v")
def v6_magnitude(spark, sf):
    return _vectors(spark, sf).select("id", _six(V.magnitude("embedding")).alias("size"))


@query(f"{_PAIRS} SELECT query_id, id, round({_COS.format(a='qe', b='e')}, 6) AS cosine, round(list_distance(qe, e), 6) AS l2, round(list_dot_product(qe, e), 6) AS dot FROM p")
def v7_arrow_scores(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", *(_six(V.arrow_score("qe", "e", m)).alias(m) for m in ("cosine", "l2", "dot")))


@query(ORACLE_SQL["v3_dot"])
def v9_auto(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", _six(V.score("qe", "e", "dot", tier="arrow")).alias("score"))


@query(f"{_PAIRS} SELECT query_id, id, round(list_sum(list_transform(range(1, 65), lambda i: (qe[i] - e[i]) * (qe[i] - e[i]))), 6) AS score FROM p")
def v10_l2_squared(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", _six(V.l2_squared("qe", "e")).alias("score"))


@query(f"{_PAIRS} SELECT query_id, id, round(1 - {_COS.format(a='qe', b='e')}, 6) AS score FROM p")
def v11_cosine_distance(spark, sf):
    return _pairs(spark, sf).select("query_id", "id", _six(V.cosine_distance("qe", "e")).alias("score"))


# scalar codes

_FIT = "f AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos), s AS (SELECT pos, lo, hi, CASE WHEN hi > lo THEN CAST(CAST(hi - lo AS DOUBLE) / 255 AS FLOAT) ELSE CAST(1 AS FLOAT) END AS scale FROM f)"
_SQ8 = f"{_FIT}, x AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), c AS (SELECT id, pos, x, lo, scale, greatest(0, least(255, floor(CAST(CAST(x - lo AS DOUBLE) / CAST(scale AS DOUBLE) AS FLOAT)))) AS c FROM x JOIN s USING (pos))"


def _fitted(spark: SparkSession, sf: str) -> C.ScalarQuantizer:
    return K.fit_scalar(_vectors(spark, sf))


@query(f"WITH {_FIT} SELECT CAST(pos AS INTEGER) AS pos, scale FROM s")
def q1_params(spark, sf):
    return K.bounds(_vectors(spark, sf)).select("pos", C.sq8_scale(F.col("low"), F.col("high")).alias("scale"))


@query(f"WITH {_FIT} SELECT CAST(pos AS INTEGER) AS pos, lo AS low, hi AS high FROM f")
def q2_sq8_fit(spark, sf):
    return K.bounds(_vectors(spark, sf))


@query("SELECT CAST(i AS INTEGER) AS pos, CAST(-1 AS FLOAT) AS low, CAST(1 AS FLOAT) AS high, CAST(2.0::DOUBLE / 255 AS FLOAT) AS scale FROM range(64) t(i)")
def q3_bounds(spark, sf):
    return spark.range(1).select(F.posexplode(C.ScalarQuantizer.for_normalized(64).params()).alias("pos", "p")).select("pos", F.col("p.min").alias("low"), F.col("p.max").alias("high"), "p.scale")


@query(f"WITH {_SQ8} SELECT id, CAST(pos AS INTEGER) AS pos, CAST(c AS SMALLINT) AS code FROM c")
def q4_sq8_codes(spark, sf):
    return _vectors(spark, sf).select("id", F.posexplode(_fitted(spark, sf).quantize("embedding")).alias("pos", "code"))


@query(f"WITH {_SQ8} SELECT id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(c AS FLOAT) * scale + lo AS DOUBLE), 5) AS x FROM c")
def q5_sq8_dequant(spark, sf):
    q = _fitted(spark, sf)
    return _vectors(spark, sf).select("id", F.posexplode(q.dequantize(q.quantize("embedding"))).alias("pos", "x")).select("id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


_SQ8_NORM = "c AS (SELECT vec_id AS id, embedding AS v, list_transform(embedding, lambda x: greatest(0, least(255, floor(CAST(CAST(x - CAST(-1 AS FLOAT) AS DOUBLE) / CAST(CAST(2.0::DOUBLE / 255 AS FLOAT) AS DOUBLE) AS FLOAT))))::DOUBLE) AS c FROM embeddings), d AS (SELECT id, v::DOUBLE[] AS v, c, list_transform(c, lambda x: CAST(CAST(x AS FLOAT) * CAST(2.0::DOUBLE / 255 AS FLOAT) + CAST(-1 AS FLOAT) AS DOUBLE)) AS d FROM c)"


def _coded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    q = C.ScalarQuantizer.for_normalized(64)
    return _pairs(spark, sf).withColumn("qc", q.quantize("qe")).withColumn("c", q.quantize("e"))


@query(f"WITH {_SQ8_NORM} SELECT a.id AS query_id, b.id, round(list_distance(a.c, b.c), 6) AS score FROM d a, d b WHERE a.id < 20 AND b.id < 200")
def q6_sq8_sym(spark, sf):
    q = C.ScalarQuantizer.for_normalized(64)
    return _coded_pairs(spark, sf).select("query_id", "id", _six(q.symmetric("qc", "c")).alias("score"))


@query(f"WITH {_SQ8_NORM} SELECT a.id AS query_id, b.id, round(list_distance(a.v, b.d), 6) AS score FROM d a, d b WHERE a.id < 20 AND b.id < 200")
def q7_sq8_asym(spark, sf):
    q = C.ScalarQuantizer.for_normalized(64)
    return _coded_pairs(spark, sf).select("query_id", "id", _six(q.asymmetric("qe", "c")).alias("score"))


# bits


@query("SELECT CAST(64 AS INTEGER) AS dim, CAST(8 AS INTEGER) AS byte_len")
def b1_binary_shape(spark, sf):
    q = C.BinaryQuantizer(64)
    return spark.range(1).select(F.lit(q.dim).alias("dim"), F.lit(q.byte_len).alias("byte_len"))


@query("SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END), '') AS bits FROM embeddings")
def b2_bits(spark, sf):
    q = C.BinaryQuantizer(64)
    word = F.bin(q.quantize("embedding")[0])
    return _vectors(spark, sf).select("id", F.reverse(F.lpad(word, 64, "0")).alias("bits"))


@query("SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(CASE WHEN unnest(embedding) >= 0 THEN 1 ELSE -1 END AS FLOAT) AS sign FROM embeddings")
def b3_signs(spark, sf):
    q = C.BinaryQuantizer(64)
    return _vectors(spark, sf).select("id", F.posexplode(q.signs(q.quantize("embedding"))).alias("pos", "sign"))


_HAM = "CAST(len(list_filter(range(1, 65), lambda i: (qe[i] >= 0) <> (e[i] >= 0))) AS INTEGER)"


@query(f"{_PAIRS} SELECT query_id, id, {_HAM} AS far FROM p")
def b4_hamming(spark, sf):
    q = C.BinaryQuantizer(64)
    return _pairs(spark, sf).select("query_id", "id", q.hamming(q.quantize("qe"), q.quantize("e")).alias("far"))


@query(f"{_PAIRS} SELECT query_id, id, {_HAM} AS far FROM p")
def b5_asymmetric(spark, sf):
    q = C.BinaryQuantizer(64)
    return _pairs(spark, sf).select("query_id", "id", q.asymmetric("qe", q.quantize("e")).alias("far"))


@query(f"{_PAIRS} SELECT query_id, id, round(list_sum(list_transform(range(1, 65), lambda i: qe[i] * CASE WHEN e[i] >= 0 THEN 1 ELSE -1 END)), 6) AS score FROM p")
def b6_binary_dot(spark, sf):
    q = C.BinaryQuantizer(64)
    return _pairs(spark, sf).select("query_id", "id", _six(q.inner("qe", q.quantize("e"))).alias("score"))


# product codes; a fixed codebook: the parts of the first sixteen vectors

_PQC = C.PQConfig(64, subspaces=8, bits=4)
_BOOK = "b AS (SELECT m, vec_id AS k, embedding[m * 8 + 1 : m * 8 + 8]::DOUBLE[] AS c FROM embeddings, range(8) t(m) WHERE vec_id < 16)"
_PQ = f"{_BOOK}, x AS (SELECT vec_id AS id, m, embedding[m * 8 + 1 : m * 8 + 8]::DOUBLE[] AS v FROM embeddings, range(8) t(m)), n AS (SELECT id, x.m, v, k, c, list_sum(list_transform(range(1, 9), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d2 FROM x JOIN b ON x.m = b.m), code AS (SELECT id, m, v, k, c, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY d2, k) AS r FROM n) WHERE r = 1)"


def _pq(spark: SparkSession, sf: str) -> C.ProductQuantizer:
    rows = [r.embedding for r in _vectors(spark, sf).filter("id < 16").orderBy("id").collect()]
    return C.ProductQuantizer.from_codebooks(_PQC, [[r[m * 8 : m * 8 + 8] for r in rows] for m in range(8)])


@query("SELECT CAST(8 AS INTEGER) AS sub_dim, CAST(16 AS INTEGER) AS centroids, CAST(4 AS INTEGER) AS code_size, CAST(64 AS DOUBLE) AS compression_ratio")
def p1_config(spark, sf):
    c = _PQC.validate()
    return spark.createDataFrame([(c.sub_dim, c.centroids, c.code_size, c.compression_ratio)], "sub_dim int, centroids int, code_size int, compression_ratio double")


@query()
def p3_train(spark, sf):
    q = K.train_pq(_vectors(spark, sf), C.PQConfig(64, 8, 4, iterations=10, samples=2000))
    rows = [(m, k, list(c)) for m, book in enumerate(q.books) for k, c in enumerate(book)]
    return spark.createDataFrame(rows, "m int, k int, centroid array<float>")


@query(
    f"{_V}, s AS (SELECT vec_id AS k, e AS c FROM v WHERE vec_id < 8), n AS (SELECT v.vec_id, v.e, s.k, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - s.c[i]) * (v.e[i] - s.c[i]))), s.k) AS r FROM v, s), a AS (SELECT k, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM n WHERE r = 1) SELECT CAST(k AS INTEGER) AS k, CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(x), 6) AS x FROM a GROUP BY k, pos"
)
def p4_lloyd_step(spark, sf):
    x = _vectors(spark, sf)
    seeds = x.filter("id < 8").select(F.col("id").cast("int").alias("k"), F.col("embedding").cast("array<double>").alias("centroid"))
    return K.lloyd_step(x, seeds).select("k", "n", F.posexplode("centroid").alias("pos", "x")).select("k", "pos", "n", _six(F.col("x")).alias("x"))


@query()
def p5_seeds(spark, sf):
    x = K.sample_of(_vectors(spark, sf), 500, 42)
    return spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(K.plus_plus(x, 16, np.random.default_rng(42)))], "k int, centroid array<double>")


@query(f"WITH {_BOOK} SELECT CAST(m AS INTEGER) AS m, CAST(k AS INTEGER) AS k, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, round(unnest(c), 6) AS x FROM b")
def p6_codebook(spark, sf):
    q, out = _pq(spark, sf), None
    for m in range(8):
        one = spark.range(1).select(F.lit(m).alias("m"), F.posexplode(q.book(m)).alias("k", "c")).select("m", "k", F.posexplode("c").alias("pos", "x"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("x", _six(F.col("x").cast("double")))


@query(f"WITH {_PQ} SELECT id, CAST(m AS INTEGER) AS m, CAST(k AS SMALLINT) AS code FROM code")
def p7_pq_encode(spark, sf):
    return _vectors(spark, sf).select("id", F.posexplode(_pq(spark, sf).encode("embedding")).alias("m", "code"))


@query(f"WITH {_PQ} SELECT id, CAST(m * 8 + generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, round(unnest(c), 6) AS x FROM code")
def p8_pq_decode(spark, sf):
    q = _pq(spark, sf)
    coded = _vectors(spark, sf).select("id", q.encode("embedding").alias("pq"))
    return coded.select("id", F.posexplode(q.decode("pq")).alias("pos", "x")).withColumn("x", _six(F.col("x").cast("double")))


def _pq_pairs(spark: SparkSession, sf: str, q: C.ProductQuantizer) -> DataFrame:
    x = _vectors(spark, sf).filter("id < 200").select("id", q.encode("embedding").alias("pq"))
    return x.crossJoin(F.broadcast(_queries(spark, sf).select("query_id", F.col("embedding").alias("qe"), q.encode("embedding").alias("qpq"))))


_ADC = f"WITH {_PQ}, t AS (SELECT id AS query_id, m, k, d2 AS d FROM n WHERE id < 20), a AS (SELECT query_id, code.id, sqrt(sum(t.d)) AS far FROM code JOIN t USING (m, k) WHERE code.id < 200 GROUP BY query_id, code.id)"
_SDC = f"WITH {_PQ}, a AS (SELECT x.id AS query_id, y.id, sqrt(sum(list_sum(list_transform(range(1, 9), lambda i: (x.c[i] - y.c[i]) * (x.c[i] - y.c[i]))))) AS far FROM code x JOIN code y USING (m) WHERE x.id < 20 AND y.id < 200 GROUP BY x.id, y.id)"


@query(f"{_ADC} SELECT query_id, id, round(far, 6) AS far FROM a")
def p9_pq_asym(spark, sf):
    q = _pq(spark, sf)
    return _pq_pairs(spark, sf, q).select("query_id", "id", _six(q.asymmetric("qe", "pq")).alias("far"))


@query(f"WITH {_PQ} SELECT id AS query_id, CAST(m AS INTEGER) AS m, CAST(k AS INTEGER) AS k, round(d2, 6) AS d FROM n WHERE id < 20")
def p10_pq_table(spark, sf):
    t = _queries(spark, sf).select("query_id", F.posexplode(_pq(spark, sf).table("embedding")).alias("m", "row"))
    return t.select("query_id", "m", F.posexplode("row").alias("k", "d")).withColumn("d", _six(F.col("d")))


@query(ORACLE_SQL["p9_pq_asym"])
def p11_pq_adc(spark, sf):
    q = _pq(spark, sf)
    with_tables = _pq_pairs(spark, sf, q).withColumn("table", q.table("qe"))
    return with_tables.select("query_id", "id", _six(q.with_table("table", "pq")).alias("far"))


@query(f"{_SDC} SELECT query_id, id, round(far, 6) AS far FROM a")
def p12_pq_sdc(spark, sf):
    q = _pq(spark, sf)
    return _pq_pairs(spark, sf, q).select("query_id", "id", _six(q.symmetric("qpq", "pq")).alias("far"))


@query(ORACLE_SQL["p12_pq_sdc"])
def p13_pq_cache(spark, sf):
    q = _pq(spark, sf)
    return _pq_pairs(spark, sf, q).select("query_id", "id", _six(q.with_pair_table(q.pair_table(), "qpq", "pq")).alias("far"))


@query(f"WITH {_PQ} SELECT id, round(sqrt(sum(d2)), 6) AS error FROM code GROUP BY id")
def p14_pq_error(spark, sf):
    return _vectors(spark, sf).select("id", _six(_pq(spark, sf).error("embedding")).alias("error"))


# exact search and maintenance

_TOP = f"{_V} SELECT vec_id AS id, label, round({_COS.format(a='e', b=_ONE)}, 6) AS score FROM v ORDER BY score DESC, vec_id LIMIT 10"


@query(_TOP)
def x1_exact_topk(spark, sf):
    return S.top_k(_vectors(spark, sf), _first(spark, sf), 10, keep=("label",))


_BATCH = f"{_V}, s AS (SELECT query_id, vec_id AS id, round({_COS.format(a='qe', b='e')}, 6) AS score FROM q, v), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10"


@query(_BATCH)
def x2_batch_topk(spark, sf):
    return S.batch_top_k(_queries(spark, sf), _vectors(spark, sf), 10)


@query(_BATCH)
def x2_batch_topk_arrow(spark, sf):
    return S.knn_join(_queries(spark, sf), _vectors(spark, sf), 10)


@query(_BATCH.replace("WHERE vec_id < 20)", ")"))
def x2_all_topk(spark, sf):
    """Every vector as a query."""
    x = _vectors(spark, sf)
    return S.knn_join(x.select(F.col("id").alias("query_id"), "embedding"), x, 10)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id < 10")
def x3_upsert(spark, sf):
    x = _vectors(spark, sf)
    added = x.filter("id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(x.filter("id < 10").withColumn("id", F.col("id") + 1_000_000))
    return T.upsert(x, added).select("id", "label")


@query("SELECT vec_id AS id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id < 50")
def x4_add_batch(spark, sf):
    x = _vectors(spark, sf)
    return T.append(x, T.strict(x.filter("id < 50"), 64)).select("id", "label")


@query("SELECT vec_id AS id, label, vec_id % 5 = 0 AS removed FROM embeddings")
def x5_remove(spark, sf):
    x = _vectors(spark, sf)
    kept, gone = T.remove(x, x.filter("id % 5 = 0").select("id"))
    return kept.select("id", "label", F.lit(False).alias("removed")).unionByName(gone.select("id", "label", F.lit(True).alias("removed")))


@query("SELECT count(*) AS len, count(*) = 0 AS is_empty, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim FROM embeddings UNION ALL SELECT 0, true, NULL")
def x6_describe(spark, sf):
    x = _vectors(spark, sf)
    return T.describe(x).unionByName(T.describe(T.clear(x)))


@query(f"WITH d AS ({_DOCS}) SELECT id, content, round({_COS.format(a='embedding::DOUBLE[]', b=_ONE)}, 6) AS score FROM d ORDER BY score DESC, id LIMIT 10")
def x7_late_materialisation(spark, sf):
    found = S.top_k(_vectors(spark, sf), _first(spark, sf), 10)
    return S.with_columns_of(found, _docs(spark, sf), ["content"])


# approximate search


def _cells(spark: SparkSession, sf: str, n: int = 8) -> X.CellIndex:
    return X.CellIndex.build(_docs(spark, sf), 64, n)


@query()
def h2_build(spark, sf):
    return _cells(spark, sf).documents.groupBy("cell").count()


@query()
def h3_levels(spark, sf):
    return G.levels(_vectors(spark, sf), AnnConfig(m=16)).groupBy("level").count()


@query(f"{_V}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(1 - round({_COS.format(a='a.e', b='b.e')}, 6), 6) AS dist, round({_COS.format(a='a.e', b='b.e')}, 6) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM s) SELECT src, dst, dist FROM r WHERE k <= 8")
def h4_knn_graph(spark, sf):
    return G.candidates(_vectors(spark, sf), 8)


@query("SELECT count(*) AS len FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id < 30)")
def h6_append(spark, sf):
    index = X.ExactIndex(64, _docs(spark, sf), on_duplicate="append")
    return index.add(_docs(spark, sf).filter("id < 30")).documents.agg(F.count("*").alias("len"))


@query("SELECT count(*) AS len, count(content) AS with_content FROM (SELECT vec_id, text AS content FROM embeddings LEFT JOIN documents ON doc_id = vec_id UNION ALL SELECT vec_id + 1000000, NULL FROM embeddings WHERE vec_id < 30)")
def h7_add_embedding(spark, sf):
    docs = _docs(spark, sf)
    bare = docs.filter("id < 30").select((F.col("id") + 1_000_000).alias("id"), "embedding")
    return T.append(docs, bare).agg(F.count("*").alias("len"), F.count("content").alias("with_content"))


@query()
def h8_edges(spark, sf):
    return G.build(_vectors(spark, sf).filter("id < 500"), AnnConfig(m=8, m0=16, ef_construction=24))


@query(f"WITH d AS ({_DOCS}) SELECT id, content, round({_COS.format(a='embedding::DOUBLE[]', b=_ONE)}, 6) AS score FROM d ORDER BY score DESC, id LIMIT 10")
def h9_ann_full_probe(spark, sf):
    return _cells(spark, sf).search(_first(spark, sf), 10, ef=8).drop("metadata")


def _shared(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    return lambda df: written(df, "graph")


@query()
def h10_beam(spark, sf):
    x, keep = _vectors(spark, sf).filter("id < 500"), _shared(spark)
    edges = keep(G.build(x, AnnConfig(m=8, m0=16, ef_construction=24)))
    return G.beam(_queries(spark, sf), x, edges, x.filter("id in (100, 200, 300)").select("id"), 32, 10, 8, materialise=keep)


@query()
def h11_select_diverse(spark, sf):
    x = _vectors(spark, sf)
    return G.select_diverse(G.candidates(x, 16).withColumn("layer", F.lit(0)), x, 6)


@query(f"WITH e AS ({ORACLE_SQL['h4_knn_graph']}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS rank FROM e) SELECT src, CAST(0 AS INTEGER) AS layer, dst, dist, rank FROM r WHERE rank <= 4")
def h12_simple_neighbours(spark, sf):
    return G.select_simple(G.candidates(_vectors(spark, sf), 8).withColumn("layer", F.lit(0)), 4).select("src", "layer", "dst", "dist", "rank")


@query(_BATCH)
def h14_batch_full_probe(spark, sf):
    return _cells(spark, sf).search_batch(_queries(spark, sf), 10, ef=8)


@query()
def h9_ann_search(spark, sf):
    """Half of the cells."""
    return _cells(spark, sf, 16).search_batch(_queries(spark, sf), 8, ef=8)


@query("SELECT count(*) AS len, CAST(64 AS INTEGER) AS embedding_dim FROM embeddings")
def h15_stats(spark, sf):
    return T.describe(_docs(spark, sf)).select("len", "embedding_dim")


@query("SELECT count(*) AS len FROM embeddings WHERE vec_id >= 40")
def h16_remove(spark, sf):
    index = X.ExactIndex(64, _docs(spark, sf))
    return index.remove(_docs(spark, sf).filter("id < 40").select("id")).documents.agg(F.count("*").alias("len"))


# quantized indexes



def _sq8(spark: SparkSession, sf: str) -> X.SQ8Index:
    return X.SQ8Index(64, _docs(spark, sf)).write(scratch(spark, "sq8"))


def _pq_index(spark: SparkSession, sf: str, config: QuantizedConfig = QuantizedConfig()) -> X.PQIndex:
    return X.PQIndex(_docs(spark, sf), _pq(spark, sf), config).write(scratch(spark, "pq"))


_C0 = "(SELECT c FROM d WHERE id = 0)"
_V0 = "(SELECT v FROM d WHERE id = 0)"


@query(f"WITH {_SQ8_NORM}, k AS (SELECT id, d FROM d ORDER BY round(list_distance(c, {_C0}), 6), id LIMIT 50) SELECT id, round(1 / (1 + list_distance(d, {_V0})), 6) AS score FROM k ORDER BY score DESC, id LIMIT 10")
def g4_sq8_search(spark, sf):
    return _sq8(spark, sf).search(_first(spark, sf), 10).select("id", "score")


@query(f"WITH {_SQ8_NORM} SELECT id, round(1 / (1 + list_distance(c, {_C0})), 6) AS score FROM d ORDER BY score DESC, id LIMIT 10")
def g5_sq8_sym_search(spark, sf):
    return _sq8(spark, sf).search_symmetric(_first(spark, sf), 10).select("id", "score")


@query(f"WITH {_SQ8} , w AS (SELECT id, list(c::DOUBLE ORDER BY pos) AS c FROM c GROUP BY id) SELECT id, round(1 / (1 + list_distance(c, (SELECT c FROM w WHERE id = 0))), 6) AS score FROM w ORDER BY score DESC, id LIMIT 10")
def g2_sq8_fitted_search(spark, sf):
    return X.SQ8Index.fit(_docs(spark, sf), 64).search_symmetric(_first(spark, sf), 10).select("id", "score")


@query("SELECT count(*) AS len FROM (SELECT 1 FROM embeddings UNION ALL SELECT 1 FROM embeddings WHERE vec_id < 25)")
def g3_sq8_add(spark, sf):
    docs = _docs(spark, sf)
    return X.SQ8Index(64, docs).add(docs.filter("id < 25")).documents.filter("size(sq8) = 64").agg(F.count("*").alias("len"))


@query("SELECT count(*) * 164 AS bytes FROM embeddings")
def g7_sq8_memory(spark, sf):
    return X.SQ8Index(64, _docs(spark, sf)).memory_usage()


_HQ = f"{_V}, z AS (SELECT e AS z FROM v WHERE vec_id = 0), h AS (SELECT vec_id AS id, label, e, len(list_filter(range(1, 65), lambda i: (z[i] >= 0) <> (e[i] >= 0))) AS h FROM v, z)"


@query(f"{_HQ} SELECT id, round(1 - h / 64.0, 6) AS score FROM h ORDER BY score DESC, id LIMIT 10".replace("h / 64.0", "h / 64.0::DOUBLE"))
def g10_binary_search(spark, sf):
    return X.BinaryIndex(64, _docs(spark, sf)).search(_first(spark, sf), 10).select("id", "score")


@query(f"{_HQ}, k AS (SELECT * FROM h ORDER BY h, id LIMIT 60) SELECT id, round({_COS.format(a='e', b=_ONE)}, 6) AS score FROM k ORDER BY score DESC, id LIMIT 10")
def g11_binary_rerank(spark, sf):
    return X.BinaryIndex(64, _docs(spark, sf), full_precision=True).search_and_rerank(_first(spark, sf), 60, 10).select("id", "score")


@query(f"{_HQ}, k AS (SELECT * FROM h WHERE id % 2 = 0 OR id < 100 ORDER BY h, id LIMIT 60) SELECT id, round(CASE WHEN id < 100 THEN {_COS.format(a='e', b=_ONE)} ELSE 1 - h / 64.0::DOUBLE END, 6) AS score FROM k ORDER BY score DESC, id LIMIT 10")
def g9_binary_mixed(spark, sf):
    """Some rows with full vectors, some without."""
    docs = _docs(spark, sf)
    index = X.BinaryIndex(64, docs.filter("id >= 100 AND id % 2 = 0")).add_with_full_precision(docs.filter("id < 100"))
    return index.search_and_rerank(_first(spark, sf), 60, 10).select("id", "score")


@query("SELECT count(*) * 108 AS codes, count(*) * 364 AS with_vectors FROM embeddings")
def g13_binary_memory(spark, sf):
    n = F.count("*")
    return _vectors(spark, sf).agg(C.binary_memory(n, 64, False).alias("codes"), C.binary_memory(n, 64, True).alias("with_vectors"))


_ADC0 = f"WITH {_PQ}, t AS (SELECT m, k, d2 AS d FROM n WHERE id = 0), a AS (SELECT code.id, sqrt(sum(t.d)) AS far FROM code JOIN t USING (m, k) GROUP BY code.id)"


@query(f"{_ADC0} SELECT id, round(1 / (1 + far), 6) AS score FROM (SELECT * FROM a ORDER BY round(far, 6), id LIMIT 50) ORDER BY score DESC, id LIMIT 10")
def g17_pq_search(spark, sf):
    return _pq_index(spark, sf).search(_first(spark, sf), 10).select("id", "score")


@query(f"{_ADC0}, k AS (SELECT id FROM a ORDER BY round(far, 6), id LIMIT 80) SELECT id, round({_COS.format(a='embedding::DOUBLE[]', b=_ONE)}, 6) AS score FROM k JOIN embeddings ON vec_id = id ORDER BY score DESC, id LIMIT 10")
def g17_pq_rerank(spark, sf):
    return _pq_index(spark, sf, QuantizedConfig().with_reranking(80)).search(_first(spark, sf), 10).select("id", "score")


@query(f"WITH {_PQ}, a AS (SELECT y.id, sqrt(sum(list_sum(list_transform(range(1, 9), lambda i: (x.c[i] - y.c[i]) * (x.c[i] - y.c[i]))))) AS far FROM code x JOIN code y USING (m) WHERE x.id = 0 GROUP BY y.id) SELECT id, round(1 / (1 + far), 6) AS score FROM a ORDER BY score DESC, id LIMIT 10")
def g18_pq_sym_search(spark, sf):
    return _pq_index(spark, sf).search_symmetric(_first(spark, sf), 10).select("id", "score")


@query("SELECT count(*) * 108 + 4096 + 8192 AS bytes FROM embeddings")
def g20_pq_memory(spark, sf):
    return X.PQIndex(_docs(spark, sf), _pq(spark, sf)).memory_usage()


def _beam_over(spark: SparkSession, sf: str, vectors: DataFrame) -> DataFrame:
    keep, x = _shared(spark), vectors.filter("id < 300")
    edges = keep(G.build(x, AnnConfig(m=8, m0=16, ef_construction=24)))
    return G.beam(x.filter("id < 20").select(F.col("id").alias("query_id"), "embedding"), x, edges, x.filter("id in (100, 200)").select("id"), 24, 10, 6, materialise=keep)


@query()
def g6_sq8_graph(spark, sf):
    q = C.ScalarQuantizer.for_normalized(64)
    return _beam_over(spark, sf, _vectors(spark, sf).select("id", q.dequantize(q.quantize("embedding")).alias("embedding")))


@query()
def g12_binary_graph(spark, sf):
    q = C.BinaryQuantizer(64)
    return _beam_over(spark, sf, _vectors(spark, sf).select("id", q.signs(q.quantize("embedding")).alias("embedding")))


@query()
def g19_pq_graph(spark, sf):
    q = _pq(spark, sf)
    return _beam_over(spark, sf, _vectors(spark, sf).select("id", q.decode(q.encode("embedding")).alias("embedding")))


# ingest


@query("SELECT vec_id AS id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 64) AS INTEGER) AS batch FROM embeddings")
def i3_batches(spark, sf):
    return I.batch_numbers(_vectors(spark, sf), "id", BatchConfig(batch_size=64)).select("id", "batch")


@query("SELECT count(*) AS completed, CAST(ceil(count(*) / 64.0) AS BIGINT) AS batches FROM embeddings")
def i5_batches(spark, sf):
    return I.batch_counts(_vectors(spark, sf), BatchConfig(batch_size=64))


@query("WITH b AS (SELECT CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 64) AS INTEGER) AS batch FROM embeddings), c AS (SELECT batch, count(*) AS n FROM b GROUP BY batch) SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS completed, round(100.0::DOUBLE * sum(n) OVER (ORDER BY batch) / (SELECT count(*) FROM b), 6) AS percent FROM c")
def i6_progress(spark, sf):
    c = BatchConfig(batch_size=64)
    return I.progress(I.batch_numbers(_vectors(spark, sf), "id", c), c)


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).withColumn("embedding", F.when(F.col("id") % 50 == 7, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 50 = 7 THEN 'dimension mismatch: expected 64, got 63' END AS error FROM embeddings")
def i7_quarantine(spark, sf):
    good, bad = I.ingest(_damaged(spark, sf), 64, BatchConfig(continue_on_error=True))
    return good.select("id", F.lit(None).cast("string").alias("error")).unionByName(bad)


@query("SELECT count(*) AS len FROM embeddings")
def i4_add_all(spark, sf):
    good, _ = I.ingest(_docs(spark, sf), 64)
    return T.append(T.clear(_docs(spark, sf)), good).agg(F.count("*").alias("len"))


# shaping

_RES = f"r AS (SELECT vec_id AS id, label, round({_COS.format(a='e', b=_ONE)}, 6) AS score FROM v)"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    x = _docs(spark, sf)
    return x.select("id", "content", F.round(V.cosine("embedding", V.literal(_first(spark, sf))), 6).alias("score"), "metadata")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), F.col("props").alias("metadata"))


@query(f"{_V}, {_RES} SELECT id, score FROM r WHERE id % 7 = 3 AND score > 0")
def f1_filter(spark, sf):
    return R.ResultFilter().filter(F.col("id") % 7 == 3).filter(F.col("score") > 0).apply(_results(spark, sf)).select("id", "score")


@query(f"{_V}, {_RES} SELECT id, score FROM r WHERE NOT score < 0.1")
def f2_min_score(spark, sf):
    return R.ResultFilter().min_score(0.1).apply(_results(spark, sf)).select("id", "score")


@query(f"{_V}, {_RES} SELECT id, score FROM r WHERE id % 2 = 0 ORDER BY score DESC, id LIMIT 15")
def f3_max_results(spark, sf):
    return R.ResultFilter().filter(F.col("id") % 2 == 0).max_results(15).apply(_results(spark, sf), S.best_first("cosine")).select("id", "score")


@query("SELECT event_id AS id, (CAST(props AS JSON)->'$.k') IS NOT NULL AS k, (CAST(props AS JSON)->'$.z') IS NOT NULL AS z FROM events")
def f4_has_field(spark, sf):
    return _events(spark, sf).select("id", R.has_field("k").alias("k"), R.has_field("z").alias("z"))


@query("SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS VARCHAR) = '42'")
def f5_metadata_equals(spark, sf):
    return R.ResultFilter().metadata_equals("k", 42).apply(_events(spark, sf)).select("id")


@query(f"{_V}, {_RES}, t AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 50) SELECT id, score FROM t WHERE label = 3 AND NOT score < 0.05")
def f6_apply(spark, sf):
    """After the search: fewer than k may be left."""
    top = _results(spark, sf).orderBy(*S.best_first("cosine")).limit(50)
    return R.ResultFilter().metadata_equals("label", 3).min_score(0.05).apply(top).select("id", "score")


@query(f"{_V}, {_RES} SELECT id, score FROM r WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def f6_prefilter(spark, sf):
    """Before the search: k are found if there are k."""
    docs = R.ResultFilter().metadata_equals("label", 3).prefilter(_docs(spark, sf))
    return S.top_k(docs, _first(spark, sf), 10)


@query(f"{_V}, {_RES} SELECT id, score FROM r ORDER BY score DESC, id LIMIT 10 OFFSET 20")
def f7_page(spark, sf):
    return R.page(_results(spark, sf), 2, PaginationConfig().page_size, S.best_first("cosine")).select("id", "score")


@query("SELECT CAST(2 AS INTEGER) AS page, CAST(10 AS INTEGER) AS page_size, count(*) AS total_results, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 10.0) AS has_next, true AS has_prev FROM embeddings")
def f7_page_info(spark, sf):
    return R.page_info(_results(spark, sf), 2, 10)


@query(f"{_V}, {_RES}, t AS (SELECT id, score FROM r ORDER BY score DESC, id LIMIT 40) SELECT id, score FROM t ORDER BY score DESC, id OFFSET 5")
def f9_skip(spark, sf):
    it = R.ResultIterator(_results(spark, sf).orderBy(*S.best_first("cosine")).limit(40).select("id", "score"))
    return spark.createDataFrame(it.skip_n(5).collect_remaining(), "id bigint, score double")


@query(f"{_V}, {_RES} SELECT id, score FROM r")
def f11_identity(spark, sf):
    return R.ResultFilter().apply(_results(spark, sf)).select("id", "score")


# sources and storage


@query("SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings")
def s1_fvecs(spark, sf):
    path = scratch(spark, "fvecs")
    vecs.write_vecs(_vectors(spark, sf).select("id", F.col("embedding").alias("vector")), path)
    return vecs.read_vecs(spark, path).select("id", F.posexplode("vector").alias("pos", "x"))


@query("SELECT o_orderkey AS n, o_custkey AS c FROM orders")
def s2_ivecs(spark, sf):
    path = scratch(spark, "ivecs")
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int")).alias("vector"))
    vecs.write_vecs(o, path, "ivecs")
    return vecs.read_vecs(spark, path, "ivecs").select(F.col("vector")[0].cast("bigint").alias("n"), F.col("vector")[1].cast("bigint").alias("c"))


@query()
def s7_synthetic(spark, sf):
    base = vecs.synthetic(spark, 1000, 32)
    return vecs.ground_truth(vecs.synthetic(spark, 20, 32, seed=43), base, 10)


@query(f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 300), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_distance(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id < 30), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10 AND query_id <> id")
def s8_subset_truth(spark, sf):
    """The first base vectors and queries, and their neighbours anew."""
    base = _vectors(spark, sf).filter("id < 300").select("id", F.col("embedding").alias("vector"))
    return S.batch_top_k(base.filter("id < 30").select(F.col("id").alias("query_id"), "vector"), base, 10, "l2", vector="vector").filter("query_id <> id")


@query("SELECT vec_id AS id, text AS content, label FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id = 7")
def s9_document(spark, sf):
    items = store.ItemStore(spark, scratch(spark, "items"), "zstd")
    items.save("docs", _docs(spark, sf))
    return items.load("docs").filter("id = 7").select("id", "content", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@query(_TOP)
def s10_flat_roundtrip(spark, sf):
    items = store.ItemStore(spark, scratch(spark, "items"), "gzip")
    items.save("flat", _vectors(spark, sf), item_type="flat")
    return S.top_k(items.load("flat"), _first(spark, sf), 10, keep=("label",))


@query(ORACLE_SQL["h9_ann_full_probe"])
def s11_ann_roundtrip(spark, sf):
    """The cells are kept with the rows; nothing is rebuilt on reading."""
    index = _cells(spark, sf).write(scratch(spark, "cells"))
    return index.search(_first(spark, sf), 10, ef=8).drop("metadata")


@query("SELECT * FROM (VALUES ('a', 'flat', 'none'), ('b', 'document', 'none')) t(name, item_type, codec)")
def s14_catalog(spark, sf):
    items = store.ItemStore(spark, scratch(spark, "items"))
    items.save("b", _docs(spark, sf).limit(3))
    items.save("a", _vectors(spark, sf).limit(3), item_type="flat")
    items.save("c", _vectors(spark, sf).limit(1))
    items.delete("c")
    items.delete("c")
    return items.catalog().drop("size")


@query("SELECT vec_id AS id, text AS content, label FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id < 100")
def s15_json(spark, sf):
    docs = _docs(spark, sf).filter("id < 100")
    text = docs.select(F.to_json(F.struct(F.lit("flat").alias("type"), F.struct("*").alias("doc"))).alias("j"))
    back = text.select(F.from_json("j", "type string, doc struct<id:bigint,content:string,embedding:array<float>,metadata:string>").alias("r")).filter("r.type = 'flat'").select("r.doc.*")
    return back.select("id", "content", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


# log and snapshots

_LOGSQL = "WITH w AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_id = 400 THEN 'clear' WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, value FROM events)"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    op = F.when(F.col("event_id") == 400, "clear").when(F.col("event_type") == "error", "remove").otherwise("add")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), op.alias("op"), "value")


@query("SELECT count(*) AS n, CAST(count(*) FILTER (vec_id < 50) AS BIGINT) AS removed, CAST(1 AS BIGINT) AS cleared FROM embeddings")
def w2_log(spark, sf):
    s = store.SnapshotStore(spark, scratch(spark, "log"))
    docs = _docs(spark, sf)
    s.log_add(docs)
    s.log_remove(docs.filter("id < 50").select("id"))
    s.log_clear()
    return s.log().agg(F.count_if(F.col("op") == "add").alias("n"), F.count_if(F.col("op") == "remove").alias("removed"), F.count_if(F.col("op") == "clear").alias("cleared"))


@query("SELECT count(*) AS n, true AS all_good FROM embeddings")
def w3_checksum(spark, sf):
    s = store.SnapshotStore(spark, scratch(spark, "log"))
    s.log_add(_docs(spark, sf))
    return s.log().agg(F.count("*").alias("n"), F.every(F.col("checksum") == store.checksum()).alias("all_good"))


@query(f"{_LOGSQL} SELECT seq, id, op FROM w WHERE seq > 700")
def w4_tail(spark, sf):
    return store.tail(_log(spark, sf), 700).select("seq", "id", "op")


@query(f"{_LOGSQL}, c AS (SELECT coalesce(max(seq), -1) AS cs FROM w WHERE op = 'clear'), l AS (SELECT w.*, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM w, c WHERE w.seq > c.cs AND op <> 'clear') SELECT id, seq, value FROM l WHERE rn = 1 AND op = 'add'")
def w5_replay(spark, sf):
    return store.replay(_log(spark, sf)).select("id", "seq", "value")


@query(f"{_LOGSQL}, c AS (SELECT coalesce(max(seq), -1) AS cs FROM w WHERE op = 'clear'), l AS (SELECT w.*, coalesce(max(seq) FILTER (op = 'remove') OVER (PARTITION BY id), -1) AS gone FROM w, c WHERE w.seq > c.cs AND op <> 'clear') SELECT id, seq, value FROM l WHERE op = 'add' AND seq > gone")
def w5_replay_append(spark, sf):
    return store.replay(_log(spark, sf), unique=False).select("id", "seq", "value")


@query("SELECT count(*) >= 10000 AS by_ops, true AS by_bytes FROM embeddings")
def w6_needs_checkpoint(spark, sf):
    from veclume.plans.config import LogConfig

    base = scratch(spark, "log")
    s = store.SnapshotStore(spark, base)
    s.log_add(_docs(spark, sf))
    small = store.SnapshotStore(spark, base, LogConfig(max_log_bytes=1))
    return spark.createDataFrame([(s.needs_checkpoint(), small.needs_checkpoint())], "by_ops boolean, by_bytes boolean")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 5 THEN 'new' ELSE text END AS content FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id >= 20")
def w7_checkpoint(spark, sf):
    """Add, remove, checkpoint, then a tail of changes on top."""
    s = store.SnapshotStore(spark, scratch(spark, "store"))
    docs = _docs(spark, sf)
    s.log_add(docs)
    s.log_remove(docs.filter("id < 20").select("id"))
    s.checkpoint()
    s.log_add(docs.filter("id % 10 = 5 AND id >= 20").withColumn("content", F.lit("new")))
    return s.state().select(F.col("id").cast("bigint").alias("id"), "content")


@query("SELECT count(*) AS documents FROM embeddings WHERE vec_id >= 20")
def w8_load_checkpoint(spark, sf):
    s = store.SnapshotStore(spark, scratch(spark, "store"))
    docs = _docs(spark, sf)
    s.log_add(docs)
    s.log_remove(docs.filter("id < 20").select("id"))
    s.checkpoint()
    return s.snapshot().agg(F.count("*").alias("documents"))


@query("SELECT CAST(1 AS BIGINT) AS checkpoint_id, count(*) AS documents, CAST(5 AS BIGINT) AS pending_ops FROM embeddings")
def w9_stats(spark, sf):
    s = store.SnapshotStore(spark, scratch(spark, "store"))
    docs = _docs(spark, sf)
    s.log_add(docs)
    s.checkpoint()
    s.log_add(docs.filter("id < 5"))
    return s.stats().select("checkpoint_id", "documents", "pending_ops")


# compression


@query("SELECT doc_id, text FROM documents")
def c4_roundtrip(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    for codec in blobs.CODECS:
        d = d.withColumn("b", blobs.decompressed(blobs.compressed("b", codec)))
    return d.select("doc_id", F.col("b").cast("string").alias("text"))


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS original, true AS smaller, true AS consistent FROM documents")
def c6_stats(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("text").cast("binary").alias("b")).select(F.octet_length("b").alias("n"), F.octet_length(blobs.compressed("b", "gzip")).alias("p"))
    r = d.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    s = blobs.CompressionStats(r.n, r.p, "gzip")
    good = math.isclose(s.space_saved_percent, 100 * (1 - 1 / s.ratio))
    return spark.createDataFrame([(s.original, s.space_saved > 0, good)], "original bigint, smaller boolean, consistent boolean")


# embedding


@query()
def e3_embed(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return d.select("doc_id", E.embed_column("content", E.hashing_embedder(64)).alias("embedding"))


_HID = "h AS (SELECT label, e FROM v WHERE vec_id < 200), m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM h) GROUP BY label, pos)"


@query(f"{_V}, {_HID} SELECT label, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM m")
def e4_mean_pooling(spark, sf):
    """Vectors of a label as token vectors; every second place is padding."""
    x = _vectors(spark, sf).filter("id < 200").groupBy("label").agg(F.collect_list("embedding").alias("h"))
    padded = x.select("label", F.flatten(F.transform("h", lambda v: F.array(v, F.transform(v, lambda y: y * 0 + 9)))).alias("h"), F.flatten(F.transform("h", lambda v: F.array(F.lit(1), F.lit(0)))).alias("m"))
    return padded.select("label", F.posexplode(E.mean_pooling("h", "m")).alias("pos", "x")).withColumn("x", _six(F.col("x")))


@query(f"{_V}, {_HID}, s AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS x FROM m JOIN s USING (label)")
def e5_l2_normalize(spark, sf):
    x = _vectors(spark, sf).filter("id < 200").groupBy("label").agg(F.collect_list("embedding").alias("h"))
    return x.select("label", F.posexplode(E.pooled(F.col("h"), F.transform("h", lambda v: F.lit(1)))).alias("pos", "x")).withColumn("x", _six(F.col("x")))


@query("SELECT count(text) AS total, count(DISTINCT text) AS distinct_texts, round(1 - count(DISTINCT text) / count(text)::DOUBLE, 6) AS hit_rate FROM documents")
def e6_cache_stats(spark, sf):
    return E.CachedEmbedder(E.hashing_embedder(32)).stats(_table(spark, sf, "documents"), "text")


@query()
def e6_cached_embed(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return E.CachedEmbedder(E.hashing_embedder(32), scratch(spark, "embedded")).embed(d).select("doc_id", "embedding")


@query()
def e8_demo_embed(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", E.embed_column("text", lambda texts: np.array([E.sine_embed(t, 16) for t in texts], np.float32)).alias("embedding"))


# bindings


@query(f"WITH d AS ({_DOCS} WHERE e.vec_id < 100 AND e.vec_id <> 1) SELECT CAST(id AS VARCHAR) AS id, content, round({_COS.format(a='embedding::DOUBLE[]', b=_ONE)}, 6) AS score FROM d ORDER BY score DESC, CAST(id AS VARCHAR) LIMIT 5")
def a8_local_store(spark, sf):
    local = X.LocalStore(spark, 64)
    local.add_documents(_docs(spark, sf).filter("id < 100").withColumn("id", F.col("id").cast("string")))
    local.remove_document("1")
    return local.search(_first(spark, sf), 5).drop("metadata")


@query("SELECT count(*) AS n FROM embeddings WHERE vec_id < 40")
def a4_save_load(spark, sf):
    path, local, other = scratch(spark, "local"), X.LocalStore(spark, 64), X.LocalStore(spark, 64)
    local.add_documents(_docs(spark, sf).filter("id < 40").withColumn("id", F.col("id").cast("string")))
    local.save(path)
    other.load(path)
    return other.index.documents.agg(F.count("*").alias("n"))


# evaluation

_FOUND = f"{_V}, s AS (SELECT query_id, vec_id AS id, round({_COS.format(a='qe', b='e')}, 6) AS score FROM q, v), t AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10), f AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE id % 3 <> 0) WHERE r <= 10)"


@query(f"{_FOUND}, h AS (SELECT query_id, count(f.id) / 10.0::DOUBLE AS r FROM t LEFT JOIN f USING (query_id, id) GROUP BY query_id) SELECT round(avg(r), 6) AS recall FROM h")
def m1_recall(spark, sf):
    q, x = _queries(spark, sf), _vectors(spark, sf)
    return M.recall(S.knn_join(q, x.filter("id % 3 <> 0"), 10), S.knn_join(q, x, 10), 10)


@query(f"{_FOUND.replace(_COS.format(a='qe', b='e'), '-list_distance(qe, e)')}, h AS (SELECT query_id, count(f.id) / 10.0::DOUBLE AS r FROM t LEFT JOIN f USING (query_id, id) GROUP BY query_id) SELECT round(avg(r), 6) AS recall FROM h")
def m2_recall_l2(spark, sf):
    q, x = _queries(spark, sf), _vectors(spark, sf)
    return M.recall(S.knn_join(q, x.filter("id % 3 <> 0"), 10, "l2"), S.knn_join(q, x, 10, "l2"), 10)


#: Report runs out of the parts table: brands as libraries, types as algorithms.
_RUNS = "WITH r AS (SELECT p_brand AS library, p_type AS algorithm, 'parts' AS dataset, CAST(p_size AS BIGINT) AS index_size, p_retailprice / 100 AS build_time_sec, p_partkey % 997 / 1.0::DOUBLE AS peak_memory_mb, p_partkey % 101 / 100.0::DOUBLE AS recall_at_10, p_partkey % 89 / 100.0::DOUBLE AS recall_at_100, p_partkey * 7.0::DOUBLE AS qps FROM part)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    p, key = _table(spark, sf, "part"), F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("library"), F.col("p_type").alias("algorithm"), F.lit("parts").alias("dataset"), F.col("p_size").cast("bigint").alias("index_size"), (F.col("p_retailprice") / 100).alias("build_time_sec"),
        (key % 997 / 1.0).cast("double").alias("peak_memory_mb"), (key % 101).cast("double").alias("h"), (key % 89).cast("double").alias("i"), (key * 7).cast("double").alias("qps"), F.lit(None).cast("string").alias("notes"),
    ).withColumn("recall_at_10", F.col("h") / 100.0).withColumn("recall_at_100", F.col("i") / 100.0).drop("h", "i")


@query(f"{_RUNS} SELECT library, algorithm, recall_at_10, qps FROM (SELECT *, row_number() OVER (PARTITION BY library, algorithm ORDER BY recall_at_10 DESC, qps DESC) AS n FROM r) WHERE n = 1")
def m4_best_by_algorithm(spark, sf):
    return M.best_by_algorithm(_runs(spark, sf)).select("library", "algorithm", "recall_at_10", "qps")


@query(f"{_RUNS} SELECT library, algorithm, recall_at_10, qps FROM r WHERE recall_at_10 >= 0.95 ORDER BY qps DESC, library, algorithm LIMIT 5")
def m5_fastest(spark, sf):
    return M.fastest_at_recall(_runs(spark, sf), 0.95).select("library", "algorithm", "recall_at_10", "qps")


@query(f"{_RUNS} SELECT library, algorithm, build_time_sec, peak_memory_mb FROM (SELECT *, row_number() OVER (PARTITION BY library, algorithm ORDER BY build_time_sec, peak_memory_mb) AS n FROM r) WHERE n = 1")
def m6_build_comparison(spark, sf):
    return M.build_comparison(_runs(spark, sf)).drop("notes")


def _winner(what: str, where: str, order: str, value: str) -> str:
    return f"SELECT * FROM (SELECT '{what}' AS what, library, algorithm, {value} AS value FROM r WHERE {where} ORDER BY {value} {order}, library, algorithm LIMIT 1)"


@query(
    _RUNS
    + " UNION ALL ".join(
        [
            _winner("best_recall", "true", "DESC", "recall_at_10"),
            _winner("best_qps", "true", "DESC", "qps"),
            _winner("lowest_memory_at_recall_0.9", "recall_at_10 > 0.9", "ASC", "peak_memory_mb"),
            _winner("fastest_build", "true", "ASC", "build_time_sec"),
            _winner("best_qps_at_recall_0.95", "recall_at_10 >= 0.95", "DESC", "qps"),
        ]
    )
)
def m6_analysis(spark, sf):
    return M.analysis(_runs(spark, sf))


@query("SELECT library, algorithm, qps FROM (" + _RUNS + " SELECT library, algorithm, qps FROM r)")
def s18_results(spark, sf):
    """A report written as JSON arrays, a file for a bounded number of runs, and read again."""
    path = scratch(spark, "results")
    vecs.write_results(_runs(spark, sf), path)
    return vecs.read_results(spark, path).select("library", "algorithm", "qps")


@query(f"{_V} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id <= b.vec_id AND a.vec_id < 150 AND b.vec_id < 150")
def m7_similarity_matrix(spark, sf):
    return S.similarity_matrix(_vectors(spark, sf).filter("id < 150"))
