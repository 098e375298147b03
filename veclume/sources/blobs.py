"""Compressed blobs: a four-byte header that names the codec, and the compressed bytes.

Tables need none of this, as Parquet has codecs of its own; it is for documents
and indexes kept as single values.
"""

from __future__ import annotations

import gzip
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
#: name -> (number in the header, compress, decompress)
CODECS = {
    "none": (0, bytes, bytes),
    "gzip": (1, lambda b: gzip.compress(b, mtime=0), gzip.decompress),
    "lz4": (2, lambda b: _arrow("lz4", b), lambda b: _unarrow("lz4", b)),
    "zstd": (3, lambda b: _arrow("zstd", b), lambda b: _unarrow("zstd", b)),
}


def _arrow(codec: str, b: bytes) -> bytes:
    return len(b).to_bytes(4, "little") + pa.Codec(codec if codec != "lz4" else "lz4_raw").compress(b, asbytes=True)


def _unarrow(codec: str, b: bytes) -> bytes:
    return pa.Codec(codec if codec != "lz4" else "lz4_raw").decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True)


def best_codec() -> str:
    """The fastest that is there."""
    return next(c for c in ("lz4", "zstd", "gzip") if c == "gzip" or pa.Codec.is_available("lz4_raw" if c == "lz4" else c))


def compress(data: bytes, codec: str | None = None) -> bytes:
    number, pack, _ = CODECS[codec or best_codec()]
    return bytes([number, VERSION, 0, 0]) + pack(data)


def decompress(blob: bytes) -> bytes:
    if len(blob) < 4:
        raise ValueError("a blob has a header of four bytes")
    if blob[1] != VERSION:
        raise ValueError(f"version {blob[1]} of the header isn't known")
    for number, _, unpack in CODECS.values():
        if number == blob[0]:
            return unpack(blob[4:])
    raise ValueError(f"codec {blob[0]} isn't known")


def compressed(column: Column | str, codec: str | None = None) -> Column:
    name = codec or best_codec()

    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else compress(x, name) for x in v.to_pylist()], pa.binary())

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(column)


def decompressed(column: Column | str) -> Column:
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decompress(x) for x in v.to_pylist()], pa.binary())

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(column)


@dataclass(frozen=True)
class CompressionStats:
    original: int
    packed: int
    codec: str
    duration_ms: float = 0.0

    @property
    def ratio(self) -> float:
        return self.original / self.packed if self.packed else 0.0

    @property
    def space_saved(self) -> int:
        return self.original - self.packed

    @property
    def space_saved_percent(self) -> float:
        return 100.0 * self.space_saved / self.original if self.original else 0.0

    @property
    def throughput_mbps(self) -> float:
        return self.original / 1e6 / (self.duration_ms / 1000) if self.duration_ms else 0.0
