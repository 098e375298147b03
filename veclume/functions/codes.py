"""Scalar, binary and product codes as column expressions.

A quantizer is a small model held by the driver and folded into expressions as
constants; codes are columns. Codes of one byte are SMALLINT, packed bits are
64-bit words, bit i of a vector being bit ``i % 64`` of word ``i // 64``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from veclume.functions.vectors import Vector, _col, checked, l2, l2_squared, total


class Quantizer(Protocol):
    """What scalar and binary quantizers share, in columns."""

    def quantize(self, v: Vector) -> Column: ...

    def dequantize(self, codes: Vector) -> Column: ...

    def distance_quantized(self, a: Vector, b: Vector) -> Column: ...

    def distance_asymmetric(self, query: Vector, codes: Vector) -> Column: ...


@dataclass(frozen=True)
class ScalarQuantizer:
    """One byte an element between the element's least and greatest value."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    @classmethod
    def with_bounds(cls, dim: int, low: float, high: float) -> ScalarQuantizer:
        return cls((low,) * dim, (high,) * dim)

    @classmethod
    def for_normalized(cls, dim: int) -> ScalarQuantizer:
        return cls.with_bounds(dim, -1.0, 1.0)

    @property
    def dim(self) -> int:
        return len(self.low)

    def params(self) -> Column:
        """Array of (min, max, scale); the scale is a 255th of the range, or 1 where there is none."""
        return F.transform(F.array(*(F.struct(F.lit(a).cast("float").alias("min"), F.lit(b).cast("float").alias("max")) for a, b in zip(self.low, self.high))), lambda p: F.struct(p["min"].alias("min"), p["max"].alias("max"), sq8_scale(p["min"], p["max"]).alias("scale")))

    def quantize(self, v: Vector) -> Column:
        """Codes 0 to 255, cut off, not rounded; beyond the range they stop at its ends and NaN is 0."""

        def code(x: Column, p: Column) -> Column:
            step = ((x - p["min"]).cast("float").cast("double") / p["scale"].cast("double")).cast("float")
            return F.when(F.isnan(step), F.lit(0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(step)))).cast("smallint")

        return F.zip_with(_col(v), self.params(), code)

    def dequantize(self, codes: Vector) -> Column:
        return F.zip_with(_col(codes), self.params(), lambda c, p: (c.cast("float") * p["scale"] + p["min"]).cast("float"))

    def symmetric(self, a: Vector, b: Vector) -> Column:
        """Euclidean distance of codes, in units of codes."""
        return l2(a, b)

    def symmetric_scaled(self, a: Vector, b: Vector) -> Column:
        """The same in units of the vectors, each element by its own scale."""
        return l2(self.dequantize(a), self.dequantize(b))

    def asymmetric(self, query: Vector, codes: Vector) -> Column:
        """Euclidean distance of a vector from what the codes stand for."""
        return l2(query, self.dequantize(codes))

    distance_quantized, distance_asymmetric = symmetric, asymmetric

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = (np.array(x, np.float32) for x in (self.low, self.high))
        return low, np.where(high > low, ((high - low).astype(np.float64) / 255.0).astype(np.float32), np.float32(1))

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        """``quantize`` for rows of a matrix."""
        low, scale = self._arrays()
        step = ((x.astype(np.float32) - low).astype(np.float64) / scale.astype(np.float64)).astype(np.float32)
        return np.where(np.isnan(step), 0, np.clip(np.floor(step), 0, 255)).astype(np.int16)

    def values_of(self, codes: np.ndarray) -> np.ndarray:
        """``dequantize`` for rows of a matrix."""
        low, scale = self._arrays()
        return codes.astype(np.float32) * scale + low


def sq8_scale(low: Column, high: Column) -> Column:
    return F.when(high > low, ((high - low).cast("double") / F.lit(255.0)).cast("float")).otherwise(F.lit(1.0).cast("float"))


@dataclass(frozen=True)
class BinaryQuantizer:
    """One bit an element: set where it isn't negative. NaN is unset."""

    dim: int

    @property
    def byte_len(self) -> int:
        return -(-self.dim // 8)

    def quantize(self, v: Vector) -> Column:
        v, words = _col(v), -(-self.dim // 64)
        on = lambda x: (x >= 0) & ~F.isnan(x)

        def word(w: int) -> Column:
            part = F.transform(F.slice(v, w * 64 + 1, 64), lambda x, i: F.when(on(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
            return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

        return F.array(*(word(w) for w in range(words))) if words else F.array().cast("array<bigint>")

    def signs(self, bits: Vector) -> Column:
        """+1 for a set bit, -1 for another."""
        bits = _col(bits)
        at = F.sequence(F.lit(0), F.lit(self.dim - 1)) if self.dim else F.array().cast("array<int>")
        return F.transform(at, lambda i: F.when(F.expr("0") == F.call_function("getbit", F.element_at(bits, (F.floor(i / 64) + 1).cast("int")), i % 64), F.lit(-1.0)).otherwise(F.lit(1.0)).cast("float"))

    dequantize = signs

    def hamming(self, a: Vector, b: Vector) -> Column:
        a, b = _col(a), _col(b)
        return checked(a, b, total(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))))).cast("int")

    def asymmetric(self, query: Vector, bits: Vector) -> Column:
        """Elements of the query whose sign isn't the bit's."""
        return self.hamming(self.quantize(query), bits)

    def inner(self, query: Vector, bits: Vector) -> Column:
        """Inner product of a vector with the signs."""
        return total(F.zip_with(_col(query), self.signs(bits), lambda x, s: x.cast("double") * s.cast("double")))

    distance_quantized, distance_asymmetric = hamming, asymmetric


@dataclass(frozen=True)
class PQConfig:
    dim: int
    subspaces: int = 8
    bits: int = 8
    iterations: int = 25
    samples: int = 10_000
    seed: int = 42

    def validate(self) -> PQConfig:
        if self.subspaces < 1 or self.dim % self.subspaces:
            raise ValueError(f"dimension {self.dim} isn't a multiple of {self.subspaces} subspaces")
        if not 1 <= self.bits <= 8:
            raise ValueError("a code has 1 to 8 bits")
        return self

    @property
    def sub_dim(self) -> int:
        return self.dim // self.subspaces

    @property
    def centroids(self) -> int:
        return 1 << self.bits

    @property
    def code_size(self) -> int:
        return -(-self.subspaces * self.bits // 8)

    @property
    def compression_ratio(self) -> float:
        return 4.0 * self.dim / self.code_size


@dataclass(frozen=True)
class ProductQuantizer:
    """A codebook of centroids in each of several subspaces."""

    config: PQConfig
    books: tuple[tuple[tuple[float, ...], ...], ...] = field(repr=False)

    @classmethod
    def from_codebooks(cls, config: PQConfig, books) -> ProductQuantizer:
        books = tuple(tuple(tuple(float(x) for x in c) for c in book) for book in books)
        if len(books) != config.subspaces:
            raise ValueError(f"{len(books)} codebooks for {config.subspaces} subspaces")
        if any(len(c) != config.sub_dim for book in books for c in book):
            raise ValueError("a centroid has another dimension than its subspace")
        return cls(config.validate(), books)

    def book(self, m: int) -> Column:
        # one array literal a subspace: parsed once, however many rows there are
        rows = ",".join("array(" + ",".join(f"float('{x!r}')" for x in c) + ")" for c in self.books[m])
        return F.expr(f"array({rows})")

    def part(self, v: Column, m: int) -> Column:
        return F.slice(v, m * self.config.sub_dim + 1, self.config.sub_dim)

    def encode(self, v: Vector) -> Column:
        """The nearest centroid of each subspace; of equals the first."""
        v = _col(v)

        def nearest(m: int) -> Column:
            far = F.transform(self.book(m), lambda c, k: F.struct(l2_squared(self.part(v, m), c).alias("d"), k.alias("k")))
            return F.array_min(far)["k"].cast("smallint")

        return F.array(*(nearest(m) for m in range(self.config.subspaces)))

    def decode(self, codes: Vector) -> Column:
        codes = _col(codes)
        return F.flatten(F.array(*(F.element_at(self.book(m), codes[m].cast("int") + 1) for m in range(self.config.subspaces))))

    def asymmetric(self, query: Vector, codes: Vector) -> Column:
        return l2(query, self.decode(codes))

    def symmetric(self, a: Vector, b: Vector) -> Column:
        return l2(self.decode(a), self.decode(b))

    def table(self, query: Vector) -> Column:
        """Squared distances of the query from every centroid, [subspace][centroid]."""
        query = _col(query)

        def row(m: int) -> Column:
            return F.transform(self.book(m), lambda c: l2_squared(self.part(query, m), c))

        return F.array(*(row(m) for m in range(self.config.subspaces)))

    def table_literal(self, query) -> Column:
        """The same for a query known to the driver, worked out once."""
        d, rows = self.config.sub_dim, []
        for m, book in enumerate(self.books):
            part = query[m * d : (m + 1) * d]
            rows.append("array(" + ",".join(f"double('{sum((a - b) * (a - b) for a, b in zip(part, c))!r}')" for c in book) + ")")
        return F.expr(f"array({','.join(rows)})")

    def with_table(self, table: Vector, codes: Vector) -> Column:
        """Distance by looking the codes up in a query's table."""
        table, codes = _col(table), _col(codes)
        return F.sqrt(total(F.transform(codes, lambda c, m: F.element_at(F.element_at(table, m + 1), c.cast("int") + 1))))

    def pair_table(self) -> Column:
        """Distances between the centroids of each subspace, [subspace][centroid][centroid]."""
        rows = []
        for book in self.books:
            rows.append("array(" + ",".join("array(" + ",".join(f"double('{math.dist(a, b)!r}')" for b in book) + ")" for a in book) + ")")
        return F.expr(f"array({','.join(rows)})")

    def with_pair_table(self, pairs: Vector, a: Vector, b: Vector) -> Column:
        """Distance of two codes from the table of pairs, squared again before it is added."""
        pairs = _col(pairs)
        at = lambda m, i, j: F.element_at(F.element_at(F.element_at(pairs, m + 1), i.cast("int") + 1), j.cast("int") + 1)
        both = F.arrays_zip(_col(a).alias("a"), _col(b).alias("b"))
        return F.sqrt(total(F.transform(both, lambda p, m: at(m, p["a"], p["b"]) * at(m, p["a"], p["b"]))))

    def arrays(self) -> np.ndarray:
        """The codebooks as (subspace, centroid, element)."""
        return np.array(self.books, np.float32).astype(np.float64)

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        """``encode`` for rows of a matrix."""
        d, out = self.config.sub_dim, []
        for m, book in enumerate(self.arrays()):
            part = x[:, m * d : (m + 1) * d].astype(np.float32).astype(np.float64)
            out.append(np.concatenate([((part[lo : lo + 512, None] - book) ** 2).sum(2).argmin(1) for lo in range(0, len(part), 512)] or [np.zeros(0, int)]))
        return np.stack(out, 1).astype(np.int16)

    def values_of(self, codes: np.ndarray) -> np.ndarray:
        """``decode`` for rows of a matrix."""
        codes = codes.astype(np.int64)
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.arrays())], axis=1)

    def error(self, v: Vector) -> Column:
        """Distance of a vector from what its codes stand for."""
        return l2(v, self.decode(self.encode(v)))


def sq8_memory(n: Column, dim: int) -> Column:
    return n * (dim + 100)


def binary_memory(n: Column, dim: int, full: bool) -> Column:
    return n * (-(-dim // 8) + (4 * dim if full else 0) + 100)


def pq_memory(n: Column, q: ProductQuantizer, originals: bool, cached: bool = True) -> Column:
    """Bytes of codes, kept originals, 100 a row, the codebook and the table of pairs."""
    c = q.config
    pairs = c.subspaces * c.centroids * c.centroids * 4 if cached else 0
    return n * (c.subspaces + (4 * c.dim if originals else 0) + 100) + c.subspaces * c.centroids * c.sub_dim * 4 + pairs
