"""Proximity graphs: levels, neighbour selection, edges, and beam search as rounds of joins.

Edges are a table (src, layer, dst, dist). A round of the search takes every
query's frontier one hop along the edges, so a hop is a join for all queries at
once, and keeps the ``ef`` best of each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veclume.functions.vectors import cosine_distance, matrix
from veclume.operators.search import DECIMALS, knn_join
from veclume.plans.config import AnnConfig

_MOST_LEVELS = 32


def levels(vectors: DataFrame, config: AnnConfig = AnnConfig(), ident: str = "id") -> DataFrame:
    """The table with a geometric ``level`` for each row, drawn from its id's hash; never beyond 32."""
    u = (F.expr(f"shiftrightunsigned(xxhash64({int(config.seed)}, {ident}), 11)") + 1) / F.lit(float(1 << 53))
    return vectors.withColumn("level", F.least(F.lit(_MOST_LEVELS), F.floor(-F.log(u) * F.lit(config.level_factor))).cast("int"))


def candidates(vectors: DataFrame, width: int, ident: str = "id", vector: str = "embedding") -> DataFrame:
    """(src, dst, dist): the ``width`` nearest of every row but itself, by an exact join of blocks."""
    q = vectors.select(F.col(ident).alias("query_id"), F.col(vector).alias(vector))
    found = knn_join(q, vectors, width, "cosine", ident=ident, vector=vector, exclude_self=True)
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.round(1 - F.col("score"), DECIMALS).alias("dist"))


def select_simple(edges: DataFrame, m: int) -> DataFrame:
    """The ``m`` nearest of each source."""
    rank = F.row_number().over(Window.partitionBy("src", "layer").orderBy("dist", "dst"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= m)


def pick_diverse(far: np.ndarray, between: np.ndarray, m: int, keep_pruned: bool) -> list[int]:
    """Places of the neighbours kept, candidates being in order of distance: one stays if it is nearer to the source than to any kept before; refilled from the rest where asked."""
    kept: list[int] = []
    for i in range(len(far)):
        if len(kept) >= m:
            break
        if all(between[i, j] >= far[i] for j in kept):
            kept.append(i)
    if keep_pruned:
        kept += [i for i in range(len(far)) if i not in set(kept)][: m - len(kept)]
    return kept


def select_diverse(edges: DataFrame, vectors: DataFrame, m: int, keep_pruned: bool = True, ident: str = "id", vector: str = "embedding") -> DataFrame:
    """The heuristic choice for each source; an ordered fold, so in Python a group at a time."""
    x = vectors.select(F.col(ident).alias("dst"), F.col(vector).alias("v"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("dist", "ascending"), ("dst", "ascending")]).combine_chunks()
        v = matrix(rows.column("v").chunk(0))
        size = np.sqrt((v * v).sum(1))
        unit = v / np.where(size > 0, size, 1.0)[:, None]
        kept = pick_diverse(rows.column("dist").to_numpy(), 1 - np.clip(unit @ unit.T, -1, 1), m, keep_pruned)
        return rows.select(["src", "layer", "dst", "dist"]).take(pa.array(kept, pa.int64()))

    kind = ", ".join(f"{c} {dict(edges.dtypes)[c]}" for c in ("src", "layer", "dst", "dist"))
    return edges.select("src", "layer", "dst", "dist").join(x, "dst").groupBy("src", "layer").applyInArrow(run, kind)


def build(vectors: DataFrame, config: AnnConfig = AnnConfig(), ident: str = "id", vector: str = "embedding") -> DataFrame:
    """(src, layer, dst, dist): candidates among the rows of each layer, chosen, linked both ways and cut to the layer's degree."""
    levelled, out = levels(vectors, config, ident), None
    top = levelled.agg(F.max("level")).first()[0] or 0
    for layer in range(top + 1):
        rows, degree = levelled.filter(F.col("level") >= layer), config.m0 if layer == 0 else config.m
        near = candidates(rows, min(config.ef_construction, max(degree, config.m)), ident, vector).withColumn("layer", F.lit(layer))
        chosen = select_diverse(near, rows, config.m, config.keep_pruned, ident, vector) if config.use_heuristic else select_simple(near, config.m).drop("rank")
        both = chosen.unionByName(chosen.select(F.col("dst").alias("src"), "layer", F.col("src").alias("dst"), "dist")).distinct()
        cut = select_simple(both, degree).drop("rank")
        out = cut if out is None else out.unionByName(cut)
    return out


def beam(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entries: DataFrame, ef: int, k: int, rounds: int, layer: int = 0, distance: Callable[[Column | str, Column | str], Column] = cosine_distance, materialise: Callable[[DataFrame], DataFrame] | None = None, ident: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, dist, rank): best-first search from the entries (id), all queries hop by hop.

    Stops when no query finds anything nearer, or after ``rounds``.
    ``materialise`` writes a round's table and reads it back, so that plans stay short.
    """
    x = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("__x"))
    q = queries.select("query_id", F.col(vector).alias("__q"))
    hops = edges.filter(F.col("layer") == layer).select(F.col("src").alias("id"), "dst")
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    keep = materialise or (lambda df: df.checkpoint())

    def scored(pairs: DataFrame) -> DataFrame:
        far = pairs.join(x, "id").join(q, "query_id").select("query_id", "id", F.round(distance("__q", "__x"), DECIMALS).alias("dist"), F.lit(False).alias("done"))
        return far

    best = keep(scored(q.select("query_id").crossJoin(entries.select("id"))))
    for _ in range(rounds):
        open_ = best.filter("NOT done")
        if open_.isEmpty():
            break
        near = open_.join(hops, "id").select("query_id", F.col("dst").alias("id")).distinct().join(best.select("query_id", "id"), ["query_id", "id"], "left_anti")
        seen = best.withColumn("done", F.lit(True))
        best = keep(seen.unionByName(scored(near)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ef).drop("rank"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "dist", "rank")
