"""Adding to, removing from and describing a table of documents (id, content, embedding, metadata)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

DOCUMENT = StructType([StructField("id", StringType()), StructField("content", StringType()), StructField("embedding", ArrayType(FloatType())), StructField("metadata", StringType())])


def split_valid(docs: DataFrame, dim: int, ident: str = "id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows that an index of ``dim`` takes, and (id, error) of the others: wrongly sized, null or not finite."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    error = F.when(v.isNull(), F.lit("no embedding")).when(F.size(v) != dim, F.concat(F.lit(f"dimension mismatch: expected {dim}, got "), F.size(v).cast("string"))).when(broken, F.lit("embedding isn't finite"))
    marked = docs.withColumn("__error", error)
    return marked.filter("__error IS NULL").drop("__error"), marked.filter("__error IS NOT NULL").select(F.col(ident).alias("id"), F.col("__error").alias("error"))


def strict(docs: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """The rows as they are; a wrongly sized vector fails the job, so that nothing is committed."""
    v = F.col(vector)
    text = F.concat(F.lit(f"dimension mismatch: expected {dim}, got "), F.coalesce(F.size(v).cast("string"), F.lit("null")))
    return docs.withColumn(vector, F.when(F.size(v) == dim, v).otherwise(F.raise_error(text).cast(docs.schema[vector].dataType)))


def upsert(current: DataFrame, added: DataFrame, ident: str = "id", order: str | None = None) -> DataFrame:
    """Later rows replace earlier ones of their id; among the added the greatest ``order`` wins."""
    rows = current.withColumn("__side", F.lit(0)).withColumn("__seq", F.lit(None).cast("bigint"))
    new = added.withColumn("__side", F.lit(1)).withColumn("__seq", F.col(order).cast("bigint") if order else F.lit(None).cast("bigint"))
    if order and order not in current.columns:
        new = new.drop(order)
    last = Window.partitionBy(ident).orderBy(F.desc("__side"), F.desc_nulls_last("__seq"))
    return rows.unionByName(new).withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r", "__side", "__seq")


def append(current: DataFrame, added: DataFrame) -> DataFrame:
    """All rows, ids repeated or not. Columns that one side lacks are null."""
    return current.unionByName(added, allowMissingColumns=True)


def remove(current: DataFrame, ids: DataFrame, ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """What stays and what was removed."""
    return current.join(ids.select(ident), ident, "left_anti"), current.join(ids.select(ident), ident, "left_semi")


def clear(current: DataFrame) -> DataFrame:
    return current.limit(0)


def describe(current: DataFrame, vector: str = "embedding") -> DataFrame:
    """(len, is_empty, embedding_dim) of an index."""
    return current.agg(F.count("*").alias("len"), (F.count("*") == 0).alias("is_empty"), F.max(F.size(vector)).alias("embedding_dim"))
