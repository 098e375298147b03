"""Vector arithmetic on array columns.

Two tiers with one meaning. The column tier is higher-order functions, which
Catalyst can move and fold; the Arrow tier is NumPy over whole batches, for hot
paths. Both take floats, add up in double precision and agree to 1e-6. Vectors of unequal
length raise an error in either, rather than give the null that ``zip_with``
would; a null vector gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str


def _col(v: Vector) -> Column:
    return F.col(v) if isinstance(v, str) else v


def literal(values) -> Column:
    """A vector as a constant; floats, so that it meets stored vectors on equal terms."""
    return F.array(*(F.lit(float(x)) for x in values)).cast("array<float>")


def checked(a: Column, b: Column, value: Column) -> Column:
    """``value`` where both vectors have one length."""
    text = F.concat(F.lit("dimension mismatch: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), value).otherwise(F.raise_error(text).cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def dot(a: Vector, b: Vector) -> Column:
    """Inner product; 0 for empty vectors."""
    a, b = _col(a), _col(b)
    return checked(a, b, _dot(a, b))


def l2_squared(a: Vector, b: Vector) -> Column:
    a, b = _col(a), _col(b)
    return checked(a, b, total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2(a: Vector, b: Vector) -> Column:
    """Euclidean distance."""
    return F.sqrt(l2_squared(a, b))


def magnitude(v: Vector) -> Column:
    v = _col(v)
    return F.sqrt(_dot(v, v))


def cosine(a: Vector, b: Vector) -> Column:
    """Cosine similarity within [-1, 1]: 1 for empty vectors, 0 if either has no length."""
    a, b = _col(a), _col(b)
    na, nb = magnitude(a), magnitude(b)
    value = F.when(F.size(a) == 0, F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / (na * nb))))
    return checked(a, b, value)


def cosine_distance(a: Vector, b: Vector) -> Column:
    return F.lit(1.0) - cosine(a, b)


def normalize(v: Vector, least: float = 0.0) -> Column:
    """The vector at length 1; as it is if its length is ``least`` or less (0: only zero vectors)."""
    v = _col(v)
    size = magnitude(v)
    return F.when(size <= F.lit(least), v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def l2_normalize(v: Vector) -> Column:
    """As pooled embeddings are normalised: lengths under 1e-12 stay."""
    v = _col(v)
    size = magnitude(v)
    return F.when(size < F.lit(1e-12), v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def approx_equal(a: Vector, b: Vector, eps: float) -> Column:
    """Of one length, and no element further apart than ``eps``."""
    a, b = _col(a), _col(b)
    near = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda d: F.coalesce(d <= F.lit(float(eps)), F.lit(False)))


METRICS = {"cosine": cosine, "dot": dot, "l2": l2}
#: Whether more is nearer.
DESCENDING = {"cosine": True, "dot": True, "l2": False}


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as rows of doubles. Rows of another length are an error."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    dim = int(sizes[0]) if dim is None and len(sizes) else dim or 0
    if len(sizes) and (sizes != dim).any():
        raise ValueError(f"dimension mismatch: {dim} and {int(sizes[sizes != dim][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def arrow_rows(v: Vector, of: Callable[[np.ndarray], np.ndarray], kind: str) -> Column:
    """``of`` of a list column's rows as a matrix, a value or a list each, in the Arrow tier. Null rows stay null."""

    def run(x: pa.Array) -> pa.Array:
        here = np.flatnonzero(~x.is_null().to_numpy(zero_copy_only=False))
        out = of(matrix(x.take(pa.array(here)))) if len(here) else np.zeros(0)
        if out.ndim == 1:
            whole = np.zeros(len(x), out.dtype)
            whole[here] = out
            return pa.array(whole, mask=~np.isin(np.arange(len(x)), here))
        ends = np.zeros(len(x) + 1, np.int32)
        ends[here + 1] = out.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(out.ravel()))
        return lists if len(here) == len(x) else pa.array([y if k else None for y, k in zip(lists.to_pylist(), np.isin(np.arange(len(x)), here))], lists.type)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(_col(v))


def arrow_score(a: Vector, b: Vector, metric: str = "cosine") -> Column:
    """Score of two columns row by row, in the Arrow tier."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        sizes = [np.asarray(v.value_lengths().fill_null(-1)) for v in (x, y)]
        good = (sizes[0] >= 0) & (sizes[1] >= 0)
        if (sizes[0] != sizes[1])[good].any():
            raise ValueError("dimension mismatch")
        out = np.full(len(x), np.nan)
        for size in np.unique(sizes[0][good]):
            at = np.flatnonzero(good & (sizes[0] == size))
            p, q = (matrix(v.take(pa.array(at)), int(size)) for v in (x, y))
            inner = (p * q).sum(1)
            if metric == "dot":
                out[at] = inner
            elif metric == "l2":
                out[at] = np.sqrt(((p - q) ** 2).sum(1))
            elif not size:
                out[at] = 1.0
            else:
                norm = np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))
                out[at] = np.where(norm > 0, np.clip(inner / np.where(norm > 0, norm, 1.0), -1.0, 1.0), 0.0)
        return pa.array(out, mask=~good)

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(_col(a), _col(b))


def score(a: Vector, b: Vector, metric: str = "cosine", tier: str = "column") -> Column:
    """One entry to both tiers."""
    return METRICS[metric](a, b) if tier == "column" else arrow_score(a, b, metric)
