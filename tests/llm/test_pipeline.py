"""The pipeline on a small table, each stage against a plain version on the same rows."""

import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from veclume.llm import language as L
from veclume.llm.shared import materialise
from veclume.llm.tokens import VOCABULARY, open_tokenizer

from .test_language import _phrases
from .test_line_dedup import _distance
from .test_mixing import _plain as _rates
from .test_near_dedup import _jaccard, _shingles
from .test_packing import _plain as _packed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tokens(texts):
    return [len(x) for x in open_tokenizer(VOCABULARY)([t.replace("\r\n", "\n").replace("\r", "\n").strip(" \t\n\x0b\f\r") for t in texts])]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The rows before the first stage and after each."""
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        frames.append(materialise(stage(spark, frames[-1], sf), name))
    return frames


def test_columns(steps):
    for frame in steps[:-1]:
        assert frame.columns == COLUMNS and frame.dtypes == steps[0].dtypes


def test_language(steps):
    learnt = L.learn(steps[0])
    kept = {r.doc_id: r for r in steps[1].collect()}
    for r in steps[0].collect():
        z = L.letters(r.text)
        if len(z) > 3000:
            continue  # the plain parse is slow
        cost = {name: _phrases(r.text, text) * math.log2(len(L.letters(text))) for name, text in learnt}
        best = min(cost, key=cost.get)
        assert (r.doc_id in kept) == (len(z) > 1 and (len(z) < 100 or cost[best] / len(z) <= 4.5))
        if r.doc_id in kept:
            assert kept[r.doc_id].lang == best and kept[r.doc_id].text == r.text


def test_lines(steps):
    first, want = {}, {}
    for r in sorted(steps[1].collect(), key=lambda r: r.doc_id):
        left = []
        for x in r.text.split("\n"):
            b = x.encode()
            if x.strip():
                near = b in first or len(b) >= 20 and any(len(y) >= 20 and abs(len(b) - len(y)) <= 2 and sum((Counter(b) - Counter(y)).values()) <= 2 and _distance(b, y) <= 2 for y in first)
                first[b] = 1
                if near:
                    continue
            left.append(x)
        if any(x.strip() for x in left) or "\n".join(left) == r.text:
            want[r.doc_id] = "\n".join(left)
    got = {r.doc_id: (r.text, r.n_chars) for r in steps[2].collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())


def test_near_duplicates(steps):
    sets = {r.doc_id: _shingles(r.text) for r in steps[2].collect() if r.text.split()}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if _jaccard(sets[a], sets[b]) >= 0.56]
    kept = {r.doc_id for r in steps[3].collect()}
    gone = {r.doc_id for r in steps[2].collect()} - kept
    assert sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
    for i in gone:
        assert max(_jaccard(sets[i], sets[j]) for j in sets if j != i) > 0.33


def test_mixing(steps, spark):
    rows = steps[3].withColumn("u", F.expr("shiftrightunsigned(xxhash64(11, doc_id, text), 11)") / float(1 << 53)).collect()
    words = _tokens(r.text for r in rows)
    total = Counter()
    for r, w in zip(rows, words):
        total[r.source] += w
    whole = sum(math.sqrt(v) for v in total.values())
    rates = _rates(words, [r.source for r in rows], {s: math.sqrt(v) / whole for s, v in total.items()}, sum(words), 1e-4)
    want = Counter({r.doc_id: math.floor(q + r.u) for r, q in zip(rows, rates) if math.floor(q + r.u)})
    assert Counter(r.doc_id for r in steps[4].collect()) == want


def test_packing(steps):
    want, rows = Counter(), steps[4].collect()
    for r, n in zip(rows, _tokens(r.text for r in rows)):
        want[r.doc_id] += n
    got = Counter()
    for r in steps[5].collect():
        assert r.tokens == sum(r.lengths) <= r.tier
        for i, n in zip(r.doc_ids, r.lengths):
            got[i] += n
    assert got == +want
    tiers, pieces = (2048, 8192, 32768), [min(32768, n - o) for n in _tokens(r.text for r in rows) for o in range(0, n, 32768)]
    assert sorted((r.tier, r.tokens) for r in steps[5].collect()) == _packed(pieces, tiers)


def test_run_is_the_stages_in_order(spark, sf, steps):
    key = lambda rows: sorted(map(str, rows))
    assert key(P.run(spark, sf).collect()) == key(steps[-1].collect())
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "mixing", "packing"]


def test_hard_cases(spark, sf, clashing, nothing):
    docs = clashing
    for name, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == clashing.columns and docs.count() > 0
    assert P.STAGES[-1][1](spark, docs, sf).count() > 0
    docs = nothing
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.count() == 0
