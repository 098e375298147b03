"""Batch ingest: numbering, progress, quarantine, and Structured Streaming into a store."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veclume.operators import maintenance
from veclume.plans.config import BatchConfig
from veclume.sources.scratch import written
from veclume.sources.store import SnapshotStore


@dataclass(frozen=True)
class BatchProgress:
    completed: int
    failed: int
    batches: int
    total: int | None
    elapsed_ms: float

    def percent(self) -> float | None:
        return None if not self.total else 100.0 * self.completed / self.total

    def docs_per_sec(self) -> float:
        return self.completed / (self.elapsed_ms / 1000) if self.elapsed_ms > 0 else 0.0

    def eta_ms(self) -> float | None:
        if not self.total or not self.completed:
            return None
        return max(0, self.total - self.completed) * self.elapsed_ms / self.completed


def batch_numbers(docs: DataFrame, order: str, config: BatchConfig = BatchConfig()) -> DataFrame:
    """The rows with the number of the batch they fall into, in order of a column.

    Rows are counted partition by partition after a range partitioning, so no
    task sees them all.
    """
    spread = docs.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    # written once: partitions must be the same when they are counted and when they are numbered, whatever is lost
    spread = written(spread, "batches")
    counts = spread.groupBy("__p").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    at = F.row_number().over(Window.partitionBy("__p").orderBy(order)) + F.col("__before") - 1
    return spread.join(F.broadcast(before), "__p").withColumn("batch", F.floor(at / config.batch_size).cast("int")).drop("__p", "__before")


def batch_counts(docs: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """(completed, batches): a last, partial batch counts as one."""
    n = F.count("*")
    return docs.agg(n.alias("completed"), F.ceil(n / config.batch_size).alias("batches"))


def progress(docs: DataFrame, config: BatchConfig) -> DataFrame:
    """(batch, completed, percent) as each batch ends; rows carry their batch."""
    total = docs.count() if config.total is None else config.total
    sizes = docs.groupBy("batch").count()
    done = F.sum("count").over(Window.orderBy("batch"))
    return sizes.select("batch", done.alias("completed"), F.round(100 * done / total, 6).alias("percent"))


def ingest(docs: DataFrame, dim: int, config: BatchConfig = BatchConfig()) -> tuple[DataFrame, DataFrame]:
    """(documents to index, errors). Without ``continue_on_error`` a bad row fails the job when it is read and nothing is committed; with it such rows go to the errors."""
    if not config.validate:
        return docs, docs.sparkSession.createDataFrame([], "id string, error string")
    if config.continue_on_error:
        return maintenance.split_valid(docs, dim)
    return maintenance.strict(docs, dim), docs.sparkSession.createDataFrame([], "id string, error string")


def stream_into(stream: DataFrame, store: SnapshotStore, dim: int, checkpoint: str, config: BatchConfig = BatchConfig(), on_progress: Callable[[BatchProgress], None] | None = None, once: bool = True) -> StreamingQuery:
    """Append a stream of documents to a store's log, a micro-batch at a time.

    A micro-batch is logged under its number, so one that is tried again after
    a failure replaces what it had written. Progress counts from the start of
    this run, its clock too.
    """
    done, began = {"completed": 0, "failed": 0, "batches": 0}, time.perf_counter()

    def write(batch: DataFrame, number: int) -> None:
        good, bad = ingest(batch, dim, config)
        done["completed"] += store.log_add(good, batch=number)
        done["failed"] += bad.count()
        done["batches"] += 1
        if on_progress:
            on_progress(BatchProgress(done["completed"], done["failed"], done["batches"], config.total, (time.perf_counter() - began) * 1000))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
