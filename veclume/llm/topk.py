"""Exact top-k text search by a three-phase uniform threshold.

Every row of the query table is a query. Scores are BM25 over words (letters and
digits, lower case), each word's contribution held as a whole number of
thousandths, so that sums are exact in any order. The vocabulary of the queries is dealt to ``sites``;
a document's score is the sum of its local scores, one a site, none negative.

1. Each site's ``k`` best local scores are gathered for every query. A document
   scores at least the sum of what was gathered of it; the k-th best of these
   sums, divided by the number of sites, is the cutoff.
2. The cutoffs are broadcast. A document below the cutoff at every site can't be
   among the best, so the sites report all entries that reach it. The sums now
   bound each document from below, and from above with the cutoff in place of
   what wasn't reported; those whose upper bound misses the k-th best lower
   bound go.
3. The scores of those that remain are resolved exactly, and the best k stay.

Cases: an empty table of queries or documents gives no rows; a very long text is
hashed in parts and scored as a whole; other columns, whatever their names,
aren't read; ids of documents are whole numbers, and one that can't be cast to
BIGINT ends the job; equal scores go by doc_id; documents that share no word with a query
aren't results, so a query may have fewer than k; a null or empty text matches
nothing but counts as a document; a null doc_id takes no part; of rows that
repeat a doc_id the one with the most words (then the largest word list) counts.
A null query id or text asks nothing; rows that repeat a query id are one query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veclume.llm.near_dedup import shingles
from veclume.llm.shared import materialise, text_batches, utf8, words_of

_ROWS, _QUERIES = 1024, 256


def _hashes(words: list[str]) -> np.ndarray:
    raw = "".join(words).encode()
    at = np.cumsum([0, *(len(w.encode()) for w in words)])
    return shingles(np.frombuffer(raw, np.uint8), at, 1)[0]


class Vocabulary:
    """Places of the words of all queries; a word is known by its 64-bit hash."""

    def __init__(self, words: list[str]):
        self.hashes = _hashes(words) if words else np.zeros(0, np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(len(words) * 8 + 2))))
        order = np.argsort(self.hashes)
        self.sorted, self.place = self.hashes[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are words of the vocabulary, and which."""
        at = np.flatnonzero(self.maybe[self._slot(h)])
        k = np.minimum(np.searchsorted(self.sorted, h[at]), max(0, len(self.sorted) - 1))
        hit = self.sorted[k] == h[at] if len(self.sorted) else np.zeros(0, bool)
        return at[hit], self.place[k[hit]]


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts): the number of words of each document, and the query words among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = Vocabulary(words), max(1, len(words))
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = utf8(batch.column(1))
            # a document of 2 MB is hashed on its own; others together
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (2 << 20), side="right")) - 1)
                hi = min(hi, len(ids))
                at = offsets[lo : hi + 1]
                h, per = shingles(raw[at[0] : at[-1]], at - at[0], 1)
                spot, term = known.find(h)
                row = np.repeat(np.arange(hi - lo), per)[spot]
                pair, count = np.unique(row * width + term, return_counts=True)
                ends = np.searchsorted(pair // width, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pair % width, count)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(per), *lists], names=["doc_id", "n", "terms", "counts"])
                lo = hi

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(words_of(), F.lit(""))).filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


class Scorer:
    """Local scores of blocks of postings at each site, exact whole numbers held as doubles."""

    def __init__(self, idf: np.ndarray, wants: list[dict[int, int]], sites: int, mean: float, k1: float, b: float):
        self.idf, self.mean, self.k1, self.b, self.queries, self.sites = idf, mean, k1, b, len(wants), sites
        self.local = np.arange(len(idf)) // sites  # terms come by falling document frequency, dealt in turn
        self.site = np.arange(len(idf)) % sites
        self.size = -(-len(idf) // sites)
        self.wants = wants

    def matrix(self, site: int, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((self.size, hi - lo))
        for q in range(lo, hi):
            for t, c in self.wants[q].items():
                if self.site[t] == site:
                    out[self.local[t], q - lo] = c
        return out

    def impacts(self, terms: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        tf = counts.astype(np.float64)
        return np.floor(self.idf[terms] * (tf * (self.k1 + 1.0)) / (tf + self.k1 * (1.0 - self.b + self.b * n / self.mean)) * 1000.0 + 0.5)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(site, first query, ids, scores[documents, queries])."""
        ready = {(s, q): self.matrix(s, q, min(self.queries, q + _QUERIES)) for s in range(self.sites) for q in range(0, self.queries, _QUERIES)} if self.queries <= 4 * _QUERIES else None
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                ids, n = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                per = np.asarray(part.column(2).value_lengths())
                terms, counts = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                row = np.repeat(np.arange(len(ids)), per)
                score = self.impacts(terms, counts, n[row])
                for s in range(self.sites):
                    mine = self.site[terms] == s
                    dense = np.zeros((len(ids), self.size))
                    dense[row[mine], self.local[terms[mine]]] = score[mine]
                    for q in range(0, self.queries, _QUERIES):
                        weights = ready[s, q] if ready else self.matrix(s, q, min(self.queries, q + _QUERIES))
                        yield s, q, ids, dense @ weights


_ENTRY = "q int, site int, doc_id bigint, score bigint"


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    q, s, d, v = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(d.astype(np.int64)), pa.array(v.astype(np.int64))], names=["q", "site", "doc_id", "score"])


def top_k(queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text", k: int = 10, sites: int = 4, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query id, rank, doc_id, score): the k best documents of every query, score in thousandths.

    The queries' words are held by the driver and each worker; the corpus isn't.
    """
    spark = docs.sparkSession
    text_batches(spark)
    asked = queries.select(F.col(query_id).alias("id"), words_of(query_text).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL").groupBy("id").agg(F.max("t").alias("t")).orderBy("id").collect()
    bags = [Counter(r.t.split()) for r in asked]
    words = sorted(set().union(*bags)) if bags else []
    found = materialise(postings(docs, words), "postings")
    if not found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        best = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("terms"), F.desc("counts"))
        found = materialise(found.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r"), "postings")
    total, mean = found.agg(F.count("*"), F.avg("n")).first()
    df = np.zeros(len(words))
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r.t] = r["count"]
    idf = np.log(1.0 + (total - df + 0.5) / (df + 0.5))
    # by falling document frequency, so that dealing the words in turn balances the sites
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    place = {w: int(rank[i]) for i, w in enumerate(words)}
    wants = [{place[w]: c for w, c in bag.items()} for bag in bags]
    scorer = Scorer(idf[order], wants, sites, float(mean or 1.0) or 1.0, k1, b)
    turn = pa.array(rank.astype(np.int32))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(2)
            moved = pa.ListArray.from_arrays(terms.offsets, turn.take(terms.values)) if len(words) else terms
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), moved, batch.column(3)], names=batch.schema.names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each site in this partition, for each query: phase one."""
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for s, q, ids, score in scorer.blocks(ranked(batches)):
            for c in range(score.shape[1]):
                some = np.flatnonzero(score[:, c] > 0)
                old = held.get((q + c, s))
                i, v = ids[some], score[some, c]
                if old is not None:
                    if len(old[1]) == k:
                        good = v >= old[1].min()
                        i, v = i[good], v[good]
                    if not len(i):
                        continue
                    i, v = np.concatenate([old[0], i]), np.concatenate([old[1], v])
                if len(i) > k:
                    top = np.lexsort((i, -v))[:k]
                    i, v = i[top], v[top]
                held[q + c, s] = i, v
        yield _entries([(np.full(len(i), q), np.full(len(i), s), i, v) for (q, s), (i, v) in held.items()])

    first = found.mapInArrow(local, _ENTRY)
    of_site = Window.partitionBy("q", "site").orderBy(F.desc("score"), "doc_id")
    first = first.withColumn("r", F.row_number().over(of_site)).filter(F.col("r") <= k)
    sums = first.groupBy("q", "doc_id").agg(F.sum("score").alias("low"))
    kth = Window.partitionBy("q").orderBy(F.desc("low"), "doc_id")
    tau = {r.q: r.low for r in sums.withColumn("r", F.row_number().over(kth)).filter(F.col("r") == k).select("q", "low").collect()}
    # with fewer than k documents gathered every score counts
    cut = np.array([max(1, -(-tau.get(q, 0) // sites)) for q in range(len(bags))], np.float64)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All entries that reach the cutoff: phase two."""
        rows, held = [], 0
        for s, q, ids, score in scorer.blocks(ranked(batches)):
            d, c = np.nonzero(score >= cut[q : q + score.shape[1]])
            if len(d):
                rows.append((c + q, np.full(len(d), s), ids[d], score[d, c]))
                held += len(d)
            if held > 100_000:
                yield _entries(rows)
                rows, held = [], 0
        yield _entries(rows)

    cuts = spark.createDataFrame([(q, int(c)) for q, c in enumerate(cut)], "q int, cut bigint")
    second = found.mapInArrow(reaching, _ENTRY).groupBy("q", "doc_id").agg(F.sum("score").alias("low"), F.count("*").alias("seen"))
    second = materialise(second.join(F.broadcast(cuts), "q").withColumn("high", F.col("low") + (sites - F.col("seen")) * (F.col("cut") - 1)), "second")
    low = second.withColumn("r", F.row_number().over(kth)).filter(F.col("r") == k).select("q", F.col("low").alias("floor"))
    left = second.join(low, "q", "left").filter("high >= coalesce(floor, 0)").select("q", "doc_id")
    left = left.groupBy("doc_id").agg(F.collect_list("q").alias("qs"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The exact scores of what remains: phase three."""
        for batch in batches:
            rows = []
            for i, n, terms, counts, qs in zip(*(c.to_pylist() for c in batch.columns)):
                t = np.array(terms, np.int64)
                place = rank[t] if len(t) else t
                score = dict(zip(place.tolist(), scorer.impacts(place, np.array(counts, np.int64), np.float64(n)).tolist())) if len(t) else {}
                for q in qs:
                    v = sum(c * score.get(w, 0.0) for w, c in wants[q].items())
                    rows.append((np.array([q]), np.array([0]), np.array([i]), np.array([v])))
            yield _entries(rows)

    exact = found.join(left, "doc_id").select("doc_id", "n", "terms", "counts", "qs").mapInArrow(resolve, _ENTRY)
    last = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    names = spark.createDataFrame([(q, r.id) for q, r in enumerate(asked)], f"q int, `{query_id}` {dict(queries.dtypes)[query_id]}")
    out = exact.filter("score > 0").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return out.join(F.broadcast(names), "q").select(query_id, "rank", "doc_id", "score")
