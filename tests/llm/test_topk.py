import math
import random
from collections import Counter

import duckdb

from veclume.llm import topk as K
from veclume.llm.queries import ORACLE_SQL, op8_top_k


def _plain(docs, queries, k, k1=1.2, b=0.75):
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    bags = {i: Counter(split(t)) for i, t in docs}
    n = {i: sum(c.values()) for i, c in bags.items()}
    mean = sum(n.values()) / len(n) or 1.0
    df = Counter(w for c in bags.values() for w in c)
    out = set()
    for q, text in queries:
        scores = []
        for i, bag in bags.items():
            s = 0
            for w, c in Counter(split(text)).items():
                if bag[w]:
                    idf = math.log(1.0 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                    s += c * math.floor(idf * (bag[w] * (k1 + 1.0)) / (bag[w] + k1 * (1.0 - b + b * n[i] / mean)) * 1000.0 + 0.5)
            if s:
                scores.append((-s, i))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def _rows(frame):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()}


def test_against_scoring_everything(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(40)]  # copies tie
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "item_id bigint, text string")
    for k, sites in ((1, 4), (5, 3), (10, 1), (400, 4)):
        assert _rows(K.top_k(q, d, k=k, sites=sites)) == _plain(docs, queries, k), (k, sites)


def test_query_against_its_sql(spark, sf):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert _rows(op8_top_k(spark, sf)) == set(map(tuple, db.sql(ORACLE_SQL["op8_top_k"]).select("item_id", "rank", "doc_id", "score").fetchall()))


def test_hard_cases(spark, hard, clashing, nothing):
    q = spark.createDataFrame([(1, "quick FOX!"), (2, None), (None, "fox"), (3, "zzz unseen"), (4, ""), (1, "quick FOX!"), (5, "fuchs")], "item_id bigint, text string")
    got = _rows(K.top_k(q, hard, k=3))
    assert {(a, r, i) for a, r, i, _ in got} == {(1, 1, 2), (1, 2, 1), (5, 1, 9), (5, 2, 10)}
    assert got == _rows(K.top_k(q, clashing, k=3))
    assert K.top_k(q, nothing).count() == 0
    assert K.top_k(q.limit(0), hard).count() == 0
