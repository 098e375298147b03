import pytest
from pyspark.sql import functions as F

from veclume.llm import tokens as T
from veclume.llm.shared import new_path

PATH = f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_against_the_library(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40")
    encode = T.open_tokenizer(f"{T.TOKENIZERS}/{name}")
    want = {r.doc_id: len(encode([r.text.replace("\r\n", "\n").strip()])[0]) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(docs, f"{T.TOKENIZERS}/{name}").collect()} == want


def test_byte_level_tokens_decode_to_the_text():
    import tiktoken

    one = tiktoken.Encoding("x", pat_str=T.SPLIT, mergeable_ranks={__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    for text in ["héllo wörld\n\n  x", "日本語 \U0001f600", "<|endoftext|>"]:
        assert one.decode(T.open_tokenizer(PATH)([text])[0]) == text


def test_only_distinct_misses_are_encoded(spark, monkeypatch):
    cache = new_path(spark, "cache")
    first = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, " a b c\r\n"), (4, "d e")], "doc_id bigint, text string")
    rows = T.count_tokens(first, cache=cache).collect()
    assert {(r.doc_id, r.n_tokens, r.cached) for r in rows} == {(1, 3, False), (2, 3, False), (3, 3, False), (4, 2, False)}
    assert spark.read.parquet(cache).count() == 2
    second = spark.createDataFrame([(5, "a b c"), (6, "new text")], "doc_id bigint, text string")
    assert {(r.doc_id, r.cached) for r in T.count_tokens(second, cache=cache).collect()} == {(5, True), (6, False)}
    assert spark.read.parquet(cache).count() == 3


def test_another_tokenizer_misses(spark):
    cache, docs = new_path(spark, "cache"), spark.createDataFrame([(1, "internationalisation")], "doc_id bigint, text string")
    T.count_tokens(docs, cache=cache)
    other = T.count_tokens(docs, f"{T.TOKENIZERS}/piece_bpe_32k.model", cache).first()
    assert not other.cached and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_the_cache_is_believed(spark):
    cache, docs = new_path(spark, "cache"), spark.createDataFrame([(1, "x y")], "doc_id bigint, text string")
    digest = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"))
    for _ in range(2):  # an append that ran twice
        digest.select(F.lit(T.tokenizer_digest(PATH)).alias("tokenizer"), "digest", F.lit(77).alias("n_tokens")).write.mode("append").parquet(cache)
    assert T.count_tokens(docs, PATH, cache).collect()[0][:] == (1, 77, True)


def test_hard_cases(hard, clashing, nothing):
    rows = T.count_tokens(hard).collect()
    assert len(rows) == hard.count()
    by = {r.doc_id: r.n_tokens for r in rows if r.doc_id is not None}
    assert by[3] is None and by[4] == 0 and by[5] == 0 and by[9] == by[10] > 5 and by[7] == by[6] + 1
    assert sorted(map(str, rows)) == sorted(map(str, T.count_tokens(clashing).collect()))
    assert T.count_tokens(nothing).count() == 0


def test_query_finds_half_of_the_texts_in_the_cache(spark, sf):
    from veclume.llm.queries import op10_token_counts

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("even", F.expr("pmod(xxhash64(doc_id), 2) = 0")).collect()
    plain = lambda r: r.text.replace("\r\n", "\n").replace("\r", "\n").strip()
    before, encode = {plain(r) for r in docs if r.even}, T.open_tokenizer(PATH)
    want = sorted((r.doc_id, len(encode([plain(r)])[0]), plain(r) in before) for r in docs)
    assert sorted(map(tuple, op10_token_counts(spark, sf).collect())) == want
    assert len({w[2] for w in want}) == 2


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_misses_by_broadcast_and_by_shuffle(spark, sf, monkeypatch, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    want = sorted(map(tuple, T.count_tokens(docs).collect()))
    monkeypatch.setattr(T, "BROADCAST_MISSES", most)
    cache = new_path(spark, "cache")
    T.fill_cache(docs.filter("doc_id < 20"), None, cache)
    got = sorted(map(tuple, T.count_tokens(docs, cache=cache).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and sum(g[2] for g in got) >= 20
    # what the cache has is known without any text being moved or encoded
    monkeypatch.setattr(T, "open_tokenizer", None)
    assert all(r.cached for r in T.count_tokens(docs, cache=cache).collect())


def test_lengths_where_rows_lie(spark, hard):
    want = {(r.doc_id, r.n_tokens) for r in T.count_tokens(hard).collect()}
    assert {tuple(r) for r in hard.select("doc_id", T.token_lengths()("text")).collect()} == want
