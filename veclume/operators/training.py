"""Fitting quantizers and cells: per-element bounds, k-means++ and Lloyd steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.functions.codes import PQConfig, ProductQuantizer, ScalarQuantizer
from veclume.functions.vectors import matrix


def bounds(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, low, high): the least and greatest value of each element. The groups are as many as elements, so partial sums do the work."""
    return vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def fit_scalar(vectors: DataFrame, vector: str = "embedding") -> ScalarQuantizer:
    rows = bounds(vectors, vector).orderBy("pos").collect()
    if not rows:
        raise ValueError("no vectors to fit to")
    return ScalarQuantizer(tuple(r.low for r in rows), tuple(r.high for r in rows))


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds: each next one drawn in proportion to its squared distance from those chosen; evenly if all are at 0, repeats allowed."""
    chosen = [x[rng.integers(len(x))]]
    far = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        mass = far.sum()
        at = rng.choice(len(x), p=far / mass) if mass > 0 else rng.integers(len(x))
        chosen.append(x[at])
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
    return np.array(chosen)


def lloyd(x: np.ndarray, seeds: np.ndarray, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Exactly so many steps; a centroid that nothing is nearest to moves to some vector."""
    book = seeds.astype(np.float64).copy()
    for _ in range(iterations):
        near = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
        for k in range(len(book)):
            mine = x[near == k]
            book[k] = mine.mean(0) if len(mine) else x[rng.integers(len(x))]
    return book


def lloyd_step(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """(k, n, centroid): one step over a table of any size. ``centroids`` has (k, centroid) and is small.

    Each task sums its vectors by nearest centroid, so the shuffle carries a sum a centroid and task.
    """
    rows = centroids.orderBy("k").collect()
    ids, book = np.array([r.k for r in rows]), np.array([r.centroid for r in rows], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(book), np.zeros(len(book), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), book.shape[1])
            near = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
            np.add.at(total, near, x)
            count += np.bincount(near, minlength=len(book))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int32)), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["k", "n", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            sums = matrix(batch.column(2), book.shape[1])
            for k, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sums):
                held[k] = (held[k][0] + n, held[k][1] + s) if k in held else (n, s)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s / n for n, s in held.values()], pa.list_(pa.float64()))], names=["k", "n", "centroid"])

    part = vectors.select(vector).mapInArrow(run, "k int, n bigint, sums array<double>")
    return part.repartition("k").mapInArrow(merge, "k int, n bigint, centroid array<double>")


def sample_of(vectors: DataFrame, n: int, seed: int, vector: str = "embedding", ident: str = "id") -> np.ndarray:
    """At most ``n`` vectors, those whose ids hash lowest: without repeats and the same each time."""
    rows = vectors.select(vector).orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident).limit(n).collect() if ident in vectors.columns else vectors.select(vector).limit(n).collect()
    return np.array([r[0] for r in rows], np.float64)


def train_pq(vectors: DataFrame, config: PQConfig, vector: str = "embedding", ident: str = "id") -> ProductQuantizer:
    """Codebooks by k-means in each subspace, subspaces side by side, on at most ``config.samples`` vectors."""
    config.validate()
    x = sample_of(vectors, config.samples, config.seed, vector, ident)
    if not len(x) or x.shape[1] != config.dim:
        raise ValueError(f"no vectors of dimension {config.dim} to train on")
    spark, d = vectors.sparkSession, config.sub_dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column(0).to_pylist():
                rng = np.random.default_rng([config.seed, m])
                part = x[:, m * d : (m + 1) * d]
                book = lloyd(part, plus_plus(part, config.centroids, rng), config.iterations, rng)
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([book.astype(np.float32).ravel().tolist()], pa.list_(pa.float32()))], names=["m", "book"])

    subspaces = spark.range(0, config.subspaces, 1, config.subspaces).select(F.col("id").cast("int").alias("m"))
    rows = subspaces.mapInArrow(run, "m int, book array<float>").collect()
    return ProductQuantizer.from_codebooks(config, [np.array(r.book).reshape(-1, d).tolist() for r in sorted(rows, key=lambda r: r.m)])


def train_cells(vectors: DataFrame, cells: int, iterations: int = 5, seed: int = 42, vector: str = "embedding", ident: str = "id") -> np.ndarray:
    """Centroids of cells: seeds from a sample, then Lloyd steps over all vectors."""
    x = sample_of(vectors, max(50 * cells, 1000), seed, vector, ident)
    rng = np.random.default_rng(seed)
    book = plus_plus(x, min(cells, len(x)), rng)
    spark = vectors.sparkSession
    for _ in range(iterations):
        table = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(book)], "k int, centroid array<double>")
        for r in lloyd_step(vectors, table, vector).collect():
            book[r.k] = r.centroid
    return book
