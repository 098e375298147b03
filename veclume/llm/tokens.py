"""Token counts with a cache keyed by digests.

A count depends on the text as it is encoded (line ends as ``\\n``, white space
at the ends gone) and on the tokenizer. Both are known by SHA-256 digests: of
the normalised text, and of the tokenizer's file with the way it is used. The
corpus' distinct digests are joined with the stored counts on both; texts whose
digest misses are encoded, once for each distinct one, and what was encoded is
appended to the cache.

Only digests take part in the join with the cache. Of the texts no more than the
misses are moved, to meet their equals: while the misses are few enough, their
hashes are broadcast and turn the other texts away where they lie; beyond that
the texts meet the misses by a shuffle, after which the rows are the same.

``token_lengths`` is a column function for callers that need a row's length
where the row lies, without a cache.

Cases: a null text has a null count and never enters the cache; an empty or
blank one has 0 tokens; a very long text is one row of a batch, which its task
holds three times over (JVM, Arrow, Python); a null doc_id stays null; repeated
rows are all reported; equal texts are ties of no consequence, as one count
stands for all; an empty table gives no rows and adds nothing to the cache; other
columns, whatever their names, aren't read; special tokens in a text are
ordinary text; ids are whole numbers, and one that can't be cast to BIGINT ends
the job. Appends that ran twice (a job tried again, two jobs at once) leave
equal rows, which reading merges.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.llm.shared import discard, materialise, new_path, text_batches

TOKENIZERS = os.environ.get("VECLUME_TOKENIZERS", "/opt/tokenizers")
#: The vocabulary that is used where none is named.
VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
#: How byte-level vocabularies without a rule of their own split text, as the published ones do.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "tokenizer string, digest binary, n_tokens int"
#: Misses of up to this many distinct texts are found by a broadcast of their hashes, by a shuffle beyond.
BROADCAST_MISSES = 1_000_000
_OPEN: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer: its kind, how text is split for it, and its file."""
    h = hashlib.sha256(f"{os.path.splitext(path)[1]}\0{SPLIT}\0normal-1\0".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def open_tokenizer(path: str) -> Callable[[list[str]], list[list[int]]]:
    """texts -> ids, by the library that the file is for. Opened once in each process."""
    if path in _OPEN:
        return _OPEN[path]
    kind = os.path.splitext(path)[1]
    if kind == ".tiktoken":
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        one = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        made = lambda texts: [one.encode_ordinary(t) for t in texts]
    elif kind == ".model":
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        made = lambda texts: piece.encode(texts, num_threads=1)
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        made = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    _OPEN[path] = made
    return made


def normalised(column: str = "text"):
    ends = F.replace(F.replace(F.col(column).cast("string"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(ends, F.lit(" \t\n\x0b\f\r"))


def stored(cache: str, tokenizer: str, spark) -> DataFrame:
    """The cache's counts for one tokenizer; empty where there is no cache yet."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, stored int")
    return spark.read.schema(SCHEMA).parquet(cache).filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("stored"))


def token_lengths(tokenizer: str | None = None):
    """A column function: text -> tokens of it, encoded where the row lies; a null has none of either."""
    path = tokenizer or VOCABULARY

    def run(texts: pa.Array) -> pa.Array:
        encode, out = open_tokenizer(path), []
        for lo in range(0, len(texts), 64):
            part = texts.slice(lo, 64).to_pylist()
            known = iter(encode([t for t in part if t is not None]))
            out += [None if t is None else len(next(known)) for t in part]
        return pa.array(out, pa.int32())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return lambda column="text": F.arrow_udf(run, "int")(normalised(column))


def _fill(docs: DataFrame, path: str, cache: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append what misses to the cache: (doc_id, digest) of all rows, (digest, stored) of the distinct ones, (digest, n_tokens) of the misses."""
    spark = docs.sparkSession
    text_batches(spark)
    of = tokenizer_digest(path)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = materialise(texts.select("doc_id", "digest"), "digests")
    known = materialise(keys.select("digest").filter("digest IS NOT NULL").distinct().join(stored(cache, of, spark), "digest", "left"), "known")
    misses = known.filter("stored IS NULL").select("digest")
    few = misses.count()
    if not few:
        return keys, known, spark.createDataFrame([], "digest binary, n_tokens int")
    some = texts.filter("text IS NOT NULL").select("digest", "text")
    if few <= BROADCAST_MISSES:
        # two digests of one hash would only bring a text along that the cache has
        mark = F.broadcast(misses.select(F.xxhash64("digest").alias("mark")))
        some = some.withColumn("mark", F.xxhash64("digest")).join(mark, "mark", "left_semi").drop("mark")
    else:
        some = some.join(misses, "digest", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = open_tokenizer(path)
        for batch in batches:
            out: list[int] = []
            for lo in range(0, batch.num_rows, 64):
                out += map(len, encode(batch.column(1).slice(lo, 64).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["digest", "n_tokens"])

    new = materialise(some.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(run, "digest binary, n_tokens int"), "encoded")
    new.select(F.lit(of).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return keys, known, new


def fill_cache(docs: DataFrame, tokenizer: str | None, cache: str) -> None:
    """Have the cache know every text of ``docs``."""
    for table in _fill(docs, tokenizer or VOCABULARY, cache):
        discard(table)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, cached) for every row of ``docs``; ``cached`` says that the cache had the count.

    ``tokenizer`` is a vocabulary file that every executor can read. ``cache``
    is a folder that all executors share; left out, it is a new one.
    """
    spark = docs.sparkSession
    tables = _fill(docs, tokenizer or VOCABULARY, cache or new_path(spark, "token-cache"))
    keys, known, new = tables
    counts = known.filter("stored IS NOT NULL").select("digest", F.col("stored").alias("n_tokens"), F.lit(True).alias("cached")).unionByName(new.select("digest", "n_tokens", F.lit(False).alias("cached")))
    counted = materialise(keys.join(counts, "digest", "left").select("doc_id", "n_tokens", F.coalesce("cached", F.lit(False)).alias("cached")), "counted")
    for table in tables:
        discard(table)
    return counted
