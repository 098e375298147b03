"""Indexes over documents (id, content, embedding, metadata).

Each is a table with code columns and a small model, and answers ``search`` with
(id, content, score, metadata), best first. Scores differ by index and aren't to
be compared across them. Candidates are cut off in a total order (score, then
id), also before reranking.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.functions.codes import BinaryQuantizer, PQConfig, ProductQuantizer, ScalarQuantizer, binary_memory, pq_memory, sq8_memory
from veclume.functions.vectors import arrow_rows, cosine, literal, matrix
from veclume.operators import maintenance
from veclume.operators.search import DECIMALS, knn_join, top_k
from veclume.operators.training import fit_scalar, train_cells, train_pq
from veclume.plans.config import AnnConfig, QuantizedConfig

RESULT = ("id", "content", "score", "metadata")


class VectorIndex(Protocol):
    """What every index answers to."""

    dim: int
    documents: DataFrame

    def add(self, docs: DataFrame) -> VectorIndex: ...

    def search(self, query: Sequence[float], k: int) -> DataFrame: ...

    def len(self) -> int: ...


class _Index:
    columns: tuple[str, ...] = ()

    def __init__(self, dim: int, documents: DataFrame):
        if not 1 <= dim <= 100_000:
            raise ValueError("an embedding has 1 to 100000 elements")
        self.dim, self.documents = dim, documents

    def _check(self, query: Sequence[float]) -> list[float]:
        if len(query) != self.dim:
            raise ValueError(f"dimension mismatch: expected {self.dim}, got {len(query)}")
        return [float(np.float32(x)) for x in query]

    def _with(self, documents: DataFrame):
        other = object.__new__(type(self))
        other.__dict__ = {**self.__dict__, "documents": documents}
        return other

    def _coded(self, docs: DataFrame) -> DataFrame:
        return docs

    def add(self, docs: DataFrame):
        """Appends; an id may come again. Wrongly sized vectors fail the job that reads the result."""
        return self._with(maintenance.append(self.documents, self._coded(maintenance.strict(docs, self.dim))))

    def remove(self, ids: DataFrame):
        return self._with(maintenance.remove(self.documents, ids)[0])

    def clear(self):
        return self._with(maintenance.clear(self.documents))

    def len(self) -> int:
        return self.documents.count()

    def is_empty(self) -> bool:
        return self.documents.isEmpty()

    def get_all_documents(self) -> DataFrame:
        return self.documents.select("id", "content", "embedding", "metadata")

    def _best(self, score: Column, k: int, frame: DataFrame | None = None) -> DataFrame:
        rows = (self.documents if frame is None else frame).withColumn("score", F.round(score, DECIMALS))
        return rows.orderBy(F.desc("score"), "id").limit(k)


class ExactIndex(_Index):
    """Every document is scored. ``on_duplicate`` says whether an added id replaces or joins the one there."""

    def __init__(self, dim: int, documents: DataFrame, on_duplicate: str = "replace"):
        super().__init__(dim, documents)
        self.on_duplicate = on_duplicate

    def add(self, docs: DataFrame):
        docs = maintenance.strict(docs, self.dim)
        joined = maintenance.upsert(self.documents, docs) if self.on_duplicate == "replace" else maintenance.append(self.documents, docs)
        return self._with(joined)

    def search(self, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
        return top_k(self.documents, self._check(query), k, metric, keep=("content", "metadata")).select(*RESULT)

    def search_batch(self, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        return knn_join(queries, self.documents, k, metric)


class CellIndex(_Index):
    """Approximate search by cells: a document belongs to the nearest of the trained centroids, and a query scans the cells nearest to it.

    The cell is a column that a written table is partitioned by, so a probe
    reads only its cells' files. All cells probed is exact search.
    """

    def __init__(self, dim: int, documents: DataFrame, centroids: np.ndarray, config: AnnConfig = AnnConfig()):
        self.centroids, self.config = centroids / np.maximum(1e-30, np.linalg.norm(centroids, axis=1, keepdims=True)), config
        super().__init__(dim, documents)
        if "cell" not in documents.columns:
            self.documents = self._coded(documents)

    @classmethod
    def build(cls, documents: DataFrame, dim: int, cells: int, config: AnnConfig = AnnConfig()) -> CellIndex:
        return cls(dim, documents, train_cells(documents, cells, seed=config.seed), config)

    def _coded(self, docs: DataFrame) -> DataFrame:
        book = self.centroids

        def run(v: pa.Array) -> pa.Array:
            return pa.array((matrix(v, book.shape[1]) @ book.T).argmax(1).astype(np.int32))

        run.__annotations__ = {"v": pa.Array, "return": pa.Array}
        return docs.withColumn("cell", F.arrow_udf(run, "int")("embedding"))

    def write(self, path: str) -> CellIndex:
        """A table partitioned by cell; the index then reads from it."""
        self.documents.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        return self._with(self.documents.sparkSession.read.parquet(path))

    def probed(self, query: Sequence[float], k: int, ef: int | None = None) -> list[int]:
        config = self.config if ef is None else self.config.with_(ef_search=ef)
        near = np.argsort(-(self.centroids @ np.array(query)), kind="stable")
        return [int(c) for c in near[: config.probe_cells(len(self.centroids), k)]]

    def search(self, query: Sequence[float], k: int, ef: int | None = None) -> DataFrame:
        query = self._check(query)
        some = self.documents.filter(F.col("cell").isin(self.probed(query, k, ef)))
        return top_k(some, query, k, keep=("content", "metadata")).select(*RESULT)

    def search_batch(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        """Queries meet the documents of the cells they probe by an equi-join on the cell; each cell is one product of matrices."""
        config = self.config if ef is None else self.config.with_(ef_search=ef)
        book, probe = self.centroids, config.probe_cells(len(self.centroids), k)

        def cells(v: pa.Array) -> pa.Array:
            near = np.argsort(-(matrix(v, book.shape[1]) @ book.T), axis=1, kind="stable")[:, :probe]
            return pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))

        cells.__annotations__ = {"v": pa.Array, "return": pa.Array}
        q = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").alias("v"), F.explode(F.arrow_udf(cells, "array<int>")("embedding")).alias("cell"))
        x = self.documents.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").alias("v"), "cell")
        from pyspark.sql import Window

        from veclume.operators.search import _local, best_first

        def pair(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            a, b = a.combine_chunks(), b.combine_chunks()
            one = lambda t, c: t.column(c).chunk(0)
            return pa.Table.from_batches([_local(one(a, "query_id").to_numpy(), matrix(one(a, "v")), one(b, "id").to_numpy(), matrix(one(b, "v")), k, "cosine")])

        near = q.groupBy("cell").cogroup(x.groupBy("cell")).applyInArrow(pair, "query_id bigint, id bigint, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first("cosine")))
        return near.withColumn("rank", rank).filter(F.col("rank") <= k)


class _Stored(_Index):
    """An index whose codes can be written with its rows, and whose model beside them; searches then read codes and encode nothing."""

    model_columns = "kind string, model string"

    def _model(self) -> dict:
        raise NotImplementedError

    def write(self, path: str):
        """Rows with codes, and the model. The index then reads from there."""
        spark = self.documents.sparkSession
        self.documents.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(type(self).__name__, json.dumps(self._model()))], self.model_columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return self._with(spark.read.schema(self.documents.schema).parquet(f"{path}/rows"))

    @classmethod
    def read(cls, spark, path: str):
        row = spark.read.schema(cls.model_columns).parquet(f"{path}/model").first()
        if row.kind != cls.__name__:
            raise ValueError(f"{path} holds a {row.kind}")
        other = object.__new__(cls)
        other.__dict__ = {**cls._from_model(json.loads(row.model)), "documents": spark.read.parquet(f"{path}/rows")}
        return other


class SQ8Index(_Stored):
    """One byte an element. Candidates by distance of codes, ranked by distance of the query from what the codes stand for."""

    def __init__(self, dim: int, documents: DataFrame, quantizer: ScalarQuantizer | None = None, config: QuantizedConfig = QuantizedConfig()):
        super().__init__(dim, documents)
        self.quantizer, self.config = quantizer or ScalarQuantizer.for_normalized(dim), config
        self.documents = self._coded(documents)

    @classmethod
    def fit(cls, documents: DataFrame, dim: int, config: QuantizedConfig = QuantizedConfig()) -> SQ8Index:
        return cls(dim, documents, fit_scalar(documents), config)

    def _model(self) -> dict:
        return {"dim": self.dim, "low": self.quantizer.low, "high": self.quantizer.high, "config": asdict(self.config)}

    @classmethod
    def _from_model(cls, m: dict) -> dict:
        return {"dim": m["dim"], "quantizer": ScalarQuantizer(tuple(m["low"]), tuple(m["high"])), "config": QuantizedConfig(**m["config"])}

    def _coded(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("sq8", arrow_rows("embedding", self.quantizer.codes_of, "array<smallint>"))

    def _far(self, query: Sequence[float]) -> Column:
        """Distance of codes, the query's worked out once."""
        codes = self.quantizer.codes_of(np.array([self._check(query)])).astype(np.float64)
        return arrow_rows("sq8", lambda x: np.sqrt(((x - codes) ** 2).sum(1)), "double")

    def candidates(self, query: Sequence[float], n: int) -> DataFrame:
        return self.documents.withColumn("__d", F.round(self._far(query), DECIMALS)).orderBy("__d", "id").limit(n)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        wanted, values = np.array(self._check(query)), self.quantizer.values_of
        far = arrow_rows("sq8", lambda x: np.sqrt(((values(x).astype(np.float64) - wanted) ** 2).sum(1)), "double")
        return self._best(1 / (1 + far), k, self.candidates(query, self.config.beam(k))).select(*RESULT)

    def search_symmetric(self, query: Sequence[float], k: int) -> DataFrame:
        return self._best(1 / (1 + self._far(query)), k).select(*RESULT)

    def memory_usage(self) -> DataFrame:
        return self.documents.agg(sq8_memory(F.count("*"), self.dim).alias("bytes"))


class BinaryIndex(_Stored):
    """One bit an element. Full vectors are kept where asked for, for reranking."""

    def __init__(self, dim: int, documents: DataFrame, full_precision: bool = False, config: QuantizedConfig = QuantizedConfig()):
        super().__init__(dim, documents)
        self.quantizer, self.full_precision, self.config = BinaryQuantizer(dim), full_precision, config
        self.documents = self._coded(documents)

    def _model(self) -> dict:
        return {"dim": self.dim, "full_precision": self.full_precision, "config": asdict(self.config)}

    @classmethod
    def _from_model(cls, m: dict) -> dict:
        return {"dim": m["dim"], "quantizer": BinaryQuantizer(m["dim"]), "full_precision": m["full_precision"], "config": QuantizedConfig(**m["config"])}

    def _coded(self, docs: DataFrame, full: bool = False) -> DataFrame:
        docs = docs.withColumn("bits", self.quantizer.quantize("embedding"))
        return docs if full or self.full_precision else docs.withColumn("embedding", F.lit(None).cast("array<float>"))

    def add_with_full_precision(self, docs: DataFrame):
        return self._with(maintenance.append(self.documents, self._coded(maintenance.strict(docs, self.dim), True)))

    def _far(self, query: Sequence[float]) -> Column:
        query, words = self._check(query), []
        for lo in range(0, self.dim, 64):
            word = sum(1 << i for i, x in enumerate(query[lo : lo + 64]) if x >= 0)
            words.append(word - (1 << 64) if word >> 63 else word)
        return self.quantizer.hamming(F.array(*(F.lit(w).cast("bigint") for w in words)), "bits")

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return self._best(1 - self._far(query) / self.dim, k).select(*RESULT)

    def search_and_rerank(self, query: Sequence[float], candidates: int, k: int) -> DataFrame:
        """The ``candidates`` nearest by bits, ranked by cosine where the vector was kept and by bits elsewhere."""
        some = self.documents.withColumn("__h", self._far(query)).orderBy("__h", "id").limit(max(candidates, 0))
        return self._best(F.coalesce(cosine("embedding", literal(self._check(query))), 1 - F.col("__h") / self.dim), k, some).select(*RESULT)

    def memory_usage(self) -> DataFrame:
        return self.documents.agg(binary_memory(F.count("*"), self.dim, self.full_precision).alias("bytes"))


class PQIndex(_Stored):
    """A code a subspace. Candidates by the query's table, ranked by it or by cosine on kept vectors."""

    def __init__(self, documents: DataFrame, quantizer: ProductQuantizer, config: QuantizedConfig = QuantizedConfig()):
        super().__init__(quantizer.config.dim, documents)
        self.quantizer, self.config = quantizer, config
        self.documents = self._coded(documents)

    @classmethod
    def train(cls, documents: DataFrame, pq: PQConfig, config: QuantizedConfig = QuantizedConfig()) -> PQIndex:
        return cls(documents, train_pq(documents, pq), config)

    def _model(self) -> dict:
        return {"pq": asdict(self.quantizer.config), "books": self.quantizer.books, "config": asdict(self.config)}

    @classmethod
    def _from_model(cls, m: dict) -> dict:
        pq = PQConfig(**m["pq"])
        return {"dim": pq.dim, "quantizer": ProductQuantizer.from_codebooks(pq, m["books"]), "config": QuantizedConfig(**m["config"])}

    def _coded(self, docs: DataFrame) -> DataFrame:
        docs = docs.withColumn("pq", arrow_rows("embedding", self.quantizer.codes_of, "array<smallint>"))
        return docs if self.config.store_original else docs.withColumn("embedding", F.lit(None).cast("array<float>"))

    def _far(self, query: Sequence[float]) -> Column:
        """Distance by the query's table, which is worked out once."""
        books = self.quantizer.arrays()
        table = ((books - np.array(self._check(query)).reshape(len(books), 1, -1)) ** 2).sum(2)
        return arrow_rows("pq", lambda codes: np.sqrt(table[np.arange(len(books)), codes.astype(np.int64)].sum(1)), "double")

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        query = self._check(query)
        some = self.documents.withColumn("__far", self._far(query)).withColumn("__d", F.round("__far", DECIMALS)).orderBy("__d", "id").limit(self.config.beam(k))
        if self.config.rerank_candidates:
            return self._best(F.coalesce(cosine("embedding", literal(query)), 1 / (1 + F.col("__d"))), k, some).select(*RESULT)
        return self._best(1 / (1 + F.col("__far")), k, some).select(*RESULT)

    def search_symmetric(self, query: Sequence[float], k: int) -> DataFrame:
        """Both sides by their codes: the query is what its own codes stand for."""
        q = self.quantizer
        return self._best(1 / (1 + self._far(q.values_of(q.codes_of(np.array([self._check(query)])))[0])), k).select(*RESULT)

    def memory_usage(self) -> DataFrame:
        n = F.count("*")
        return self.documents.agg(F.when(n == 0, F.lit(0)).otherwise(pq_memory(n, self.quantizer, self.config.store_original, self.config.distance_cache)).alias("bytes"))

    def compression_ratio(self) -> DataFrame:
        n = F.count("*")
        held = pq_memory(n, self.quantizer, self.config.store_original, self.config.distance_cache)
        return self.documents.agg(F.when(n == 0, F.lit(0.0)).otherwise(n * 4 * self.dim / held).alias("ratio"))


class LocalStore:
    """The small API of the language bindings: add, search, remove, count, clear, save and load, without metadata unless given."""

    def __init__(self, spark, dim: int, use_ann: bool = False, cells: int = 16):
        self.spark, self.use_ann, self.cells, self._ann = spark, use_ann, cells, None
        self.index = ExactIndex(dim, spark.createDataFrame([], maintenance.DOCUMENT), "append" if use_ann else "replace")

    def add_document(self, ident: str, content: str, embedding: Sequence[float], metadata: str | None = None) -> None:
        self.index = self.index.add(self.spark.createDataFrame([(ident, content, [float(x) for x in self.index._check(embedding)], metadata)], maintenance.DOCUMENT))

    def add_documents(self, docs: DataFrame) -> None:
        self.index = self.index.add(docs)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """Exactly, or with ``use_ann`` by cells at any size, which are trained once for what the store holds."""
        if not self.use_ann or self.index.is_empty():
            return self.index.search(query, k)
        if self._ann is None or self._ann[0] is not self.index:
            self._ann = self.index, CellIndex.build(self.index.documents, self.index.dim, self.cells)
        return self._ann[1].search(query, k)

    def remove_document(self, ident: str) -> bool:
        known = not self.index.documents.filter(F.col("id") == ident).isEmpty()
        self.index = self.index.remove(self.spark.createDataFrame([(ident,)], "id string"))
        return known

    def document_count(self) -> int:
        return self.index.len()

    def clear(self) -> None:
        self.index = self.index.clear()

    def embedding_dim(self) -> int:
        return self.index.dim

    def is_ann(self) -> bool:
        return self.use_ann

    def save(self, path: str) -> None:
        self.index.documents.write.mode("overwrite").parquet(path)

    def load(self, path: str) -> None:
        self.index = self.index._with(self.spark.read.schema(maintenance.DOCUMENT).parquet(path))
