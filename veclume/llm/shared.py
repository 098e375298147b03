"""What the corpus operators share: the scratch folder, materialised tables, Arrow text access and safe column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in, but only for a
    single-machine master: on a cluster that would lose rows, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="veclume-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/veclume/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing written.

    What isn't discarded before is deleted when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    return out


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more. Other tables are left alone."""
    path = getattr(df, "_written_at", None)
    if path:
        fs, at = _file(df.sparkSession, path)
        fs.cancelDeleteOnExit(at)
        fs.delete(at, True)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Python see at most so many rows at once: Spark's 10,000 texts make batches of tens of megabytes, held several times over by each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken``, whatever its case."""
    low, name = {c.lower() for c in taken}, f"__{base}"
    while name in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def pieces(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_count(text: str = "text"):
    """Words between white space, the token count used where no tokenizer is asked for. A null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("bigint")


def words_of(column: str = "text"):
    """A text as its words: lower case, everything but letters and digits as single spaces."""
    return F.regexp_replace(F.lower(F.col(column).cast("string")), r"[^\p{L}\p{N}]+", " ")
