"""Storage of documents: a catalogue of items, and snapshots with a log of changes.

A snapshot is a folder of Parquet, and the manifest, whose last version is the
one that counts, names it. A log is a folder of Parquet parts; each change has a
sequence number and a checksum. The state is the snapshot with the log's tail
replayed on it: of each id the last change after the last clear.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from veclume.operators.maintenance import DOCUMENT
from veclume.plans.config import LogConfig

LOG = "seq bigint, ts timestamp, op string, id string, doc struct<content:string,embedding:array<float>,metadata:string>, checkpoint_id bigint, checksum bigint"


class Files:
    """The few file operations needed, on whatever file system the path is of."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base = spark._jvm, base.rstrip("/")
        self.fs = self.path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def _versions(self, name: str) -> list[int]:
        folder, _, base = name.rpartition("/")
        return sorted(int(n.rpartition(".")[2]) for n in self.list(folder) if n.startswith(f"{base}.") and n.rpartition(".")[2].isdigit())

    def write(self, name: str, text: str) -> None:
        """All or nothing: the next version is a file of its own, there whole once it is renamed, and older ones go after it.

        Of two writers at once the second fails, since a rename replaces no file.
        """
        known = self._versions(name)
        new, at = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(f"{name}.{(known[-1] if known else 0) + 1:010d}")
        out = self.fs.create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.fs.exists(at) or not self.fs.rename(new, at):
            self.fs.delete(new, False)
            raise OSError(f"{name} was replaced by another writer")
        for n in known:
            self.delete(f"{name}.{n:010d}")

    def written(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> str:
        """The last version of a file that ``write`` wrote."""
        known = self._versions(name)
        if not known:
            raise FileNotFoundError(name)
        handle = self.fs.open(self.path(f"{name}.{known[-1]:010d}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(handle)).decode()
        finally:
            handle.close()


class ItemStore:
    """Named tables below one folder, each with its metadata."""

    def __init__(self, spark: SparkSession, base: str, compression: str = "none"):
        self.spark, self.base, self.compression, self.files = spark, base.rstrip("/"), compression, Files(spark, base)
        if self.files.exists(base) and self.files.fs.getFileStatus(self.files.path(base)).isFile():
            raise NotADirectoryError(base)
        self.files.fs.mkdirs(self.files.path(base))

    def _at(self, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith((".", "_")):
            raise ValueError(f"{name!r} can't name an item")
        return f"{self.base}/{name}"

    def save(self, name: str, df: DataFrame, item_type: str = "document", **facts) -> None:
        at, now = self._at(name), time.time()
        old = self.metadata(name) if self.exists(name) else None
        version = f"v-{uuid.uuid4().hex}"
        df.write.option("compression", self.compression if self.compression != "none" else "uncompressed").parquet(f"{at}/{version}")
        self.files.write(f"{at}/meta.json", json.dumps({"version": 1, "name": name, "created_at": old["created_at"] if old else now, "updated_at": now, "item_type": item_type, "codec": self.compression, "data": version, "size": self.files.size(f"{at}/{version}"), **facts}))
        if old:
            self.files.delete(f"{at}/{old['data']}")

    def load(self, name: str) -> DataFrame:
        meta = self.metadata(name)
        if meta["version"] != 1:
            raise ValueError(f"version {meta['version']} of {name} isn't known")
        return self.spark.read.parquet(f"{self._at(name)}/{meta['data']}")

    def metadata(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self._at(name)}/meta.json"))

    def exists(self, name: str) -> bool:
        return self.files.written(f"{self._at(name)}/meta.json")

    def delete(self, name: str) -> None:
        """Deleting what isn't there is fine."""
        self.files.delete(self._at(name))

    def clear(self) -> None:
        for name in self.list():
            self.delete(name)

    def list(self) -> list[str]:
        return [n for n in self.files.list(self.base) if self.exists(n)]

    def total_size(self) -> int:
        return sum(self.metadata(n)["size"] for n in self.list())

    def catalog(self) -> DataFrame:
        rows = [(n, m["item_type"], m["codec"], int(m["size"])) for n, m in ((n, self.metadata(n)) for n in self.list())]
        return self.spark.createDataFrame(rows, "name string, item_type string, codec string, size bigint")


def checksum() -> Column:
    """CRC of a change: its number, kind, id, document and checkpoint."""
    return F.crc32(F.to_json(F.struct("seq", "op", "id", "doc", "checkpoint_id"), {"ignoreNullFields": "true"}).cast("binary"))


def tail(log: DataFrame, after: int) -> DataFrame:
    return log.filter(F.col("seq") > after)


def verified(log: DataFrame) -> DataFrame:
    """The log; reading a change whose checksum is wrong is an error."""
    broken = F.raise_error(F.concat(F.lit("bad checksum at change "), F.col("seq").cast("string"))).cast("bigint")
    return log.withColumn("checksum", F.when(F.col("checksum") == checksum(), F.col("checksum")).otherwise(broken))


def replay(log: DataFrame, unique: bool = True, after: int = -1) -> DataFrame:
    """The rows that a log leaves: after the last clear, of each id the last change if that is an add.

    Without ``unique`` every add after the last clear and after its id's last removal stays.
    Where nothing was cleared changes count if their number is above ``after``.
    """
    cut = log.agg(F.coalesce(F.max(F.when(F.col("op") == "clear", F.col("seq"))), F.lit(after)).alias("__cut"))
    live = log.crossJoin(F.broadcast(cut)).filter(F.col("seq") > F.col("__cut")).filter(F.col("op").isin("add", "remove")).drop("__cut")
    if unique:
        last = Window.partitionBy("id").orderBy(F.desc("seq"))
        return live.withColumn("__r", F.row_number().over(last)).filter("__r = 1 AND op = 'add'").drop("__r")
    gone = F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(Window.partitionBy("id")), F.lit(-1))
    return live.withColumn("__gone", gone).filter((F.col("op") == "add") & (F.col("seq") > F.col("__gone"))).drop("__gone")


class SnapshotStore:
    """Snapshots and a log below one folder."""

    def __init__(self, spark: SparkSession, base: str, config: LogConfig = LogConfig()):
        self.spark, self.base, self.config, self.files = spark, base.rstrip("/"), config, Files(spark, base)
        self.files.fs.mkdirs(self.files.path(f"{base}/log"))

    def manifest(self) -> dict:
        at = f"{self.base}/manifest.json"
        return json.loads(self.files.read(at)) if self.files.written(at) else {"version": 1, "checkpoint_id": 0, "checkpoint_seq": -1, "snapshot": None, "documents": 0, "checkpoints": [], "covered": []}

    def parts(self, manifest: dict | None = None) -> list[str]:
        """The log's parts that the snapshot doesn't cover. A part that is being written isn't one yet."""
        covered = set((self.manifest() if manifest is None else manifest)["covered"])
        return [p for p in self.files.list(f"{self.base}/log") if not p.startswith(("_", ".")) and p not in covered]

    def log(self, parts: list[str] | None = None) -> DataFrame:
        parts = self.parts() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*(f"{self.base}/log/{p}" for p in parts))

    def next_seq(self) -> int:
        """From the parts' names, which hold each one's last number, so that no crash makes a number come twice."""
        return max([self.manifest()["checkpoint_seq"], *(int(p.rpartition("_")[2]) for p in self.files.list(f"{self.base}/log") if not p.startswith(("_", ".")))]) + 1

    def _append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Number the rows and add them as one part of the log; a batch written again replaces itself.

        A part is written under another name and counts once it is renamed.
        Appends at one time may take the same numbers: their order is open.
        """
        part = f"part-{time.time_ns():020d}-{uuid.uuid4().hex}" if batch is None else f"batch-{batch:020d}"
        first, at, seen = self.next_seq(), f"{self.base}/log/_{part}-{uuid.uuid4().hex}", Observation()
        # positions within a partition on top of the partition's number: in order, no shuffle, gaps are fine
        numbered = rows.withColumn("seq", F.lit(first) + F.monotonically_increasing_id()).withColumn("ts", F.current_timestamp())
        kept = numbered.withColumn("checksum", checksum()).select("seq", "ts", "op", "id", "doc", "checkpoint_id", "checksum")
        kept.observe(seen, F.count("*").alias("n"), F.max("seq").alias("last")).write.option("compression", self.config.compression).mode("overwrite").parquet(at)
        n, last = seen.get["n"], seen.get["last"]
        if batch is not None:
            for old in self.files.list(f"{self.base}/log"):
                if old.startswith(f"{part}_"):
                    self.files.delete(f"{self.base}/log/{old}")
        if not self.files.fs.rename(self.files.path(at), self.files.path(f"{self.base}/log/{part}_{first if last is None else last:020d}")):
            raise OSError(f"{part} could not be added to the log")
        return n

    _NO_DOC = "cast(null as struct<content:string,embedding:array<float>,metadata:string>)"

    def log_add(self, docs: DataFrame, batch: int | None = None) -> int:
        doc = F.struct("content", F.col("embedding").cast("array<float>").alias("embedding"), F.col("metadata").cast("string").alias("metadata"))
        return self._append(docs.select(F.lit("add").alias("op"), F.col("id").cast("string").alias("id"), doc.alias("doc"), F.lit(None).cast("bigint").alias("checkpoint_id")), batch)

    def log_remove(self, ids: DataFrame, batch: int | None = None) -> int:
        return self._append(ids.select(F.lit("remove").alias("op"), F.col("id").cast("string").alias("id"), F.expr(self._NO_DOC).alias("doc"), F.lit(None).cast("bigint").alias("checkpoint_id")), batch)

    def log_clear(self) -> int:
        return self._append(self.spark.range(1).select(F.lit("clear").alias("op"), F.lit(None).cast("string").alias("id"), F.expr(self._NO_DOC).alias("doc"), F.lit(None).cast("bigint").alias("checkpoint_id")))

    def pending(self, parts: list[str] | None = None) -> DataFrame:
        return verified(self.log(parts))

    def needs_checkpoint(self) -> bool:
        return self.pending().count() >= self.config.checkpoint_ops or self.files.size(f"{self.base}/log") >= self.config.max_log_bytes

    def snapshot(self, manifest: dict | None = None) -> DataFrame | None:
        name = (self.manifest() if manifest is None else manifest)["snapshot"]
        return self.spark.read.schema(DOCUMENT).parquet(f"{self.base}/{name}") if name else None

    def state(self) -> DataFrame:
        """Snapshot and tail as documents."""
        manifest = self.manifest()
        return self._state(manifest, self.parts(manifest))

    def _state(self, manifest: dict, parts: list[str]) -> DataFrame:
        held = self.snapshot(manifest)
        log = self.pending(parts).select("seq", "op", "id", "doc")
        if held is not None:
            # what the snapshot has comes before every change that it doesn't cover
            doc = F.struct("content", "embedding", "metadata").cast("struct<content:string,embedding:array<float>,metadata:string>")
            log = log.unionByName(held.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("add").alias("op"), "id", doc.alias("doc")))
        return replay(log, after=-2).select("id", "doc.content", "doc.embedding", "doc.metadata")

    def checkpoint(self) -> dict:
        """Write the state as a snapshot, point the manifest at it, drop what it covers.

        What it covers is the parts listed at the start: an append that comes
        meanwhile stays in the log. The manifest names them, so that a crash
        before they are deleted doesn't count them twice.
        """
        old = self.manifest()
        parts = self.parts(old)
        last = max([old["checkpoint_seq"], *(int(p.rpartition("_")[2]) for p in parts)])
        name = f"snapshots/{old['checkpoint_id'] + 1:05d}-{uuid.uuid4().hex}"
        seen = Observation()
        self._state(old, parts).observe(seen, F.count("*").alias("n")).write.option("compression", self.config.compression).parquet(f"{self.base}/{name}")
        kept = [*old["checkpoints"], name]
        drop = kept[: -max(1, self.config.keep_checkpoints)]
        left = set(old["covered"]) & set(self.files.list(f"{self.base}/log"))
        new = {"version": 1, "checkpoint_id": old["checkpoint_id"] + 1, "checkpoint_seq": last, "snapshot": name, "documents": seen.get["n"], "checkpoints": [c for c in kept if c not in drop], "covered": sorted({*parts, *left})}
        self.files.write(f"{self.base}/manifest.json", json.dumps(new))
        for part in new["covered"]:
            self.files.delete(f"{self.base}/log/{part}")
        for snapshot in drop:
            self.files.delete(f"{self.base}/{snapshot}")
        return new

    def stats(self) -> DataFrame:
        m = self.manifest()
        return self.spark.createDataFrame([(m["checkpoint_id"], m["checkpoint_seq"], m["documents"], self.pending().count(), self.files.size(f"{self.base}/log"))], "checkpoint_id bigint, checkpoint_seq bigint, documents bigint, pending_ops bigint, log_bytes bigint")
