"""Text to vectors: pooling, a deterministic embedder for use without model files, and embedding each text once."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.functions.vectors import l2_normalize

Embedder = Callable[[list[str]], np.ndarray]


def mean_pooling(hidden: Column | str, mask: Column | str) -> Column:
    """Mean of the token vectors that the mask counts; none counted is an error."""
    hidden, mask = (F.col(c) if isinstance(c, str) else c for c in (hidden, mask))
    count = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double"))
    at = F.sequence(F.lit(0), F.size(hidden[0]) - 1)
    pairs = F.arrays_zip(hidden.alias("h"), mask.alias("m"))
    mean = F.transform(at, lambda i: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.element_at(p["h"], i + 1).cast("double") * p["m"].cast("double")) / count)
    return F.when(count > 0, mean).otherwise(F.raise_error(F.lit("no token counts")).cast("array<double>"))


def pooled(hidden: Column | str, mask: Column | str) -> Column:
    return l2_normalize(mean_pooling(hidden, mask))


def hashing_embedder(dim: int = 384) -> Embedder:
    """Words and their three-letter pieces hashed to signed places, at length 1. A text without words is the zero vector."""

    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def places(word: str) -> tuple[np.ndarray, np.ndarray]:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            marked = f"^{word}$"
            hashes = [xxhash.xxh64_intdigest(p) for p in (word, *(marked[i : i + 3] for i in range(len(marked) - 2)))]
            known[word] = np.array([h % dim for h in hashes]), np.array([(1.0 if i else 2.0) * (1 if h >> 63 else -1) for i, h in enumerate(hashes)])
        return known[word]

    def some(texts: list[str]) -> np.ndarray:
        ids: dict[str, int] = {}
        words = [[ids.setdefault(w, len(ids)) for w in t.lower().split()] for t in texts]
        flat = np.array([w for ws in words for w in ws], np.int64)
        if not len(flat):
            return np.zeros((len(texts), dim))
        pieces = [places(w) for w in ids]
        size = np.array([len(p) for p, _ in pieces])
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        n = size[flat]
        at = np.repeat(begin[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())
        spot = np.repeat(row, n) * dim + np.concatenate([p for p, _ in pieces])[at]
        return np.bincount(spot, np.concatenate([w for _, w in pieces])[at], len(texts) * dim).reshape(len(texts), dim)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.concatenate([np.zeros((0, dim)), *(some(texts[lo : lo + 128]) for lo in range(0, len(texts), 128))])
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size < 1e-12, 1.0, size)).astype(np.float32)

    return embed


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked means of (texts, tokens, dim), each at length 1 unless shorter than 1e-12."""
    count = mask.sum(axis=1, keepdims=True)
    if (count == 0).any():
        raise ValueError("no token counts")
    mean = (hidden * mask[:, :, None]).sum(axis=1) / count
    size = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(size < 1e-12, 1.0, size)


class OnnxEmbedder:
    """A sentence encoder from an ONNX model and a tokenizer file, opened once in each process that embeds.

    Inputs are the ids, the mask and, where the model asks for them, token
    types; texts of a batch are padded with zeros to the longest. The output
    ``last_hidden_state`` is pooled.
    """

    _open: dict[tuple[str, str], tuple] = {}

    def __init__(self, model: str, tokenizer: str, dim: int = 384, threads: int = 4):
        for path in (model, tokenizer):
            if not os.path.exists(path):
                raise FileNotFoundError(path)
        self.model, self.tokenizer, self.dim, self.threads = model, tokenizer, dim, threads

    def _session(self) -> tuple:
        key = (self.model, self.tokenizer)
        if key not in self._open:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
            options.intra_op_num_threads = self.threads
            self._open[key] = onnxruntime.InferenceSession(self.model, options), Tokenizer.from_file(self.tokenizer)
        return self._open[key]

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not texts:
            raise ValueError("nothing to embed")
        session, tokenizer = self._session()
        coded = tokenizer.encode_batch(texts)
        longest = max(len(c.ids) for c in coded)
        ids, mask, kinds = (np.zeros((len(texts), longest), np.int64) for _ in range(3))
        for row, c in enumerate(coded):
            n = len(c.ids)
            ids[row, :n], mask[row, :n], kinds[row, :n] = c.ids, c.attention_mask, c.type_ids
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds}
        hidden = session.run(["last_hidden_state"], {i.name: given[i.name] for i in session.get_inputs()})[0]
        return pool(hidden, mask).astype(np.float32)


def sine_embed(text: str, dim: int = 384) -> list[float]:
    """The demo's embedding: a 32-bit string hash drives sines."""
    h = 0
    units = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    for c in units.tolist():
        h = ((h << 5) - h + c) & 0xFFFFFFFF
        h = h - (1 << 32) if h >> 31 else h
    return [math.sin(h * (i + 1) * 0.001) * 0.5 for i in range(dim)]


def embed_column(text: Column | str, embedder: Embedder | None) -> Column:
    """A batch at a time. Null texts have null vectors; without an embedder this is an error."""
    if embedder is None:
        raise RuntimeError("no embedder is configured")

    def run(v: pa.Array) -> pa.Array:
        texts = v.to_pylist()
        known = [t for t in texts if t is not None]
        rows = iter(embedder(known)) if known else iter(())
        return pa.array([None if t is None else next(rows) for t in texts], pa.list_(pa.float32()))

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<float>")(text)


class CachedEmbedder:
    """Embeds each distinct text once: against a stored table of texts, if there is one, and within a call."""

    def __init__(self, embedder: Embedder, store: str | None = None):
        self.embedder, self.store = embedder, store

    def _held(self, spark) -> DataFrame:
        if self.store and self._exists(spark):
            return spark.read.parquet(self.store).dropDuplicates(["digest"])
        return spark.createDataFrame([], "digest binary, embedding array<float>")

    def _exists(self, spark) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.store)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def embed(self, docs: DataFrame, text: str = "content") -> DataFrame:
        """``docs`` with an ``embedding``; order of rows isn't kept, as in any table."""
        spark = docs.sparkSession
        keyed = docs.withColumn("__digest", F.unhex(F.sha2(F.col(text), 256)))
        held = self._held(spark).select(F.col("digest").alias("__digest"), "embedding")
        missing = keyed.filter(F.col(text).isNotNull()).select("__digest", F.col(text).alias("__t")).dropDuplicates(["__digest"]).join(held, "__digest", "left_anti")
        new = missing.select("__digest", embed_column("__t", self.embedder).alias("embedding"))
        if self.store:
            new.select(F.col("__digest").alias("digest"), "embedding").write.mode("append").parquet(self.store)
            known = self._held(spark).select(F.col("digest").alias("__digest"), "embedding")
        else:
            known = held.unionByName(new)
        return keyed.join(known, "__digest", "left").drop("__digest")

    def cache_size(self, spark) -> int:
        """How many texts the stored table knows."""
        return self._held(spark).count()

    def clear_cache(self, spark) -> None:
        if self.store:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.store)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def stats(self, docs: DataFrame, text: str = "content") -> DataFrame:
        """(total, distinct_texts, hit_rate): the share of texts that repeat an earlier one."""
        n, d = F.count(text), F.countDistinct(text)
        return docs.agg(n.alias("total"), d.alias("distinct_texts"), F.when(n > 0, F.round(1 - d / n, 6)).otherwise(F.lit(0.0)).alias("hit_rate"))
