"""Vector files: ``.fvecs`` and ``.ivecs`` as a data source, ``.npy``, a synthetic set, and benchmark reports.

A record of a vecs file is a 32-bit count and as many 32-bit values, little
endian, one dimension throughout a file. So a file can be cut at any multiple of
its record, and large ones are read by several tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from veclume.operators.evaluation import RESULT_SCHEMA
from veclume.operators.search import knn_join

_TYPES = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int")}
_SPLIT = 64 << 20
#: Runs in one file of a report.
_RUNS = 10_000


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, which executors open for themselves, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Part(InputPartition):
    def __init__(self, path: str, start: int, records: int, first: int):
        self.path, self.start, self.records, self.first = path, start, records, first


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int):
        self.path, self.kind, self.split = path, kind, split

    def partitions(self) -> list[_Part]:
        store, at = _files(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            files = sorted((f for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(f".{self.kind}")), key=lambda f: f.path)
        elif info.type == fs.FileType.File:
            files = [info]
        else:
            raise FileNotFoundError(self.path)
        out, first = [], 0
        for file in files:
            f, size = file.path, file.size
            if not size:
                continue
            with store.open_input_file(f) as h:
                dim = int(np.frombuffer(h.read(4), "<i4")[0])
            record = 4 * (dim + 1)
            if dim < 0 or size % record:
                raise ValueError(f"{f}: {size} bytes are no whole number of records of dimension {dim}")
            step = max(1, self.split // record)
            for lo in range(0, size // record, step):
                n = min(step, size // record - lo)
                out.append(_Part(f, lo * record, n, first + lo))
            first += size // record
        return out

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        kind, _ = _TYPES[self.kind]
        if part is None:  # no files, or empty ones
            return
        with _files(self.path)[0].open_input_file(part.path) as h:
            h.seek(part.start)
            dim = int(np.frombuffer(h.read(4), "<i4")[0])
            h.seek(part.start)
            rows = np.frombuffer(h.read(part.records * 4 * (dim + 1)), "<i4").reshape(part.records, dim + 1)
        if (rows[:, 0] != dim).any():
            raise ValueError(f"{part.path}: records differ in dimension")
        flat = np.ascontiguousarray(rows[:, 1:]).view(kind).ravel()
        at = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32) if dim else np.zeros(part.records + 1, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + part.records)), pa.ListArray.from_arrays(at, pa.array(flat))], names=["id", "vector"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind = path, kind
        if overwrite:  # asked for on the driver, before any task writes
            store, at = _files(path)
            if store.get_file_info(at).type == fs.FileType.Directory:
                store.delete_dir_contents(at)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, at = _files(self.path)
        store.create_dir(at, recursive=True)
        context = TaskContext.get()
        part = f"{at}/part-{context.partitionId():05d}.{self.kind}"
        new = f"{part}.{context.taskAttemptId()}.tmp"
        with store.open_output_stream(new) as h:
            for row in rows:
                v = np.asarray(row["vector"], _TYPES[self.kind][0])
                h.write(np.int32(len(v)).astype("<i4").tobytes() + v.tobytes())
        store.move(new, part)
        return WriterCommitMessage()


class _Vecs(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"id bigint, vector array<{_TYPES[self.kind][1]}>"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.kind, int(self.options.get("splitBytes", _SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.kind, overwrite)


class Fvecs(_Vecs):
    kind = "fvecs"


class Ivecs(_Vecs):
    kind = "ivecs"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fvecs)
    spark.dataSource.register(Ivecs)


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(id, vector) of a file, or of a folder's files in order of name. The path is one that all executors see."""
    register(spark)
    return spark.read.format(kind).load(path)


def write_vecs(vectors: DataFrame, path: str, kind: str = "fvecs", order: str = "id") -> None:
    """A folder of files that hold the rows in order."""
    register(vectors.sparkSession)
    vectors.repartitionByRange(order).sortWithinPartitions(order).select(order, "vector").write.format(kind).mode("append").save(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, vector) of ``.npy`` matrices, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.load(io.BytesIO(raw.as_py()), allow_pickle=False).astype(np.float32)
                x = x.reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32()))], names=["path", "id", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, id bigint, vector array<float>")


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(id, vector) of whole numbers 0 to 255, a function of seed, row and element: the same however it is partitioned."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(256)).cast("float"))
    return spark.range(n).select("id", draw.alias("vector"))


def ground_truth(queries: DataFrame, base: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, id, score, rank) by Euclidean distance."""
    return knn_join(queries.select(F.col("id").alias("query_id"), "vector"), base, k, "l2", vector="vector")


def write_results(results: DataFrame, path: str) -> None:
    """Runs of a benchmark as a folder of JSON arrays, a batch of ``_RUNS`` runs at most in each file.

    An array is parsed whole by the task that reads it, so it must not grow with the report.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _RUNS):
                yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(batch.column(0).slice(lo, _RUNS).to_pylist()) + "]"])], names=["value"])

    rows = results.select(F.to_json(F.struct("*")).alias("value"))
    rows.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a benchmark from a JSON array, or from a folder of files with an array each. A file is read by one task."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)
