import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclume.llm import mixing as M


def _plain(words, sources, weights, total, slack):
    """The dual minimised by plain Newton steps on all rows."""
    names = sorted(weights)
    t = np.array(words, float)
    middle = (t * np.log1p(t)).sum() / t.sum()
    spread = math.sqrt((t * np.log1p(t) ** 2).sum() / t.sum() - middle**2) or 1.0
    x = np.array([[float(s == n) for n in names] for s in sources])
    x = np.concatenate([x, ((np.log1p(t) - middle) / spread)[:, None]], 1)
    want = np.array([weights[n] * total for n in names] + [0.0])
    lam = np.zeros(len(names) + 1)
    ridge = np.diag([0.0] * len(names) + [slack * total])
    for _ in range(200):
        r = t * np.exp(x @ lam)
        lam -= 0.5 * np.linalg.solve(x.T @ (x * r[:, None]) + ridge, x.T @ r - want + ridge @ lam)
    return np.exp(x @ lam)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormal(3, 1) + 1)), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1]))) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_rates_against_plain_newton(docs):
    targets = {"a": 0.4, "b": 0.35, "c": 0.25}
    got = sorted(M.mixture(docs, targets=targets).collect())
    rates = _plain([r.tokens for r in got], [r.source for r in got], targets, sum(r.tokens for r in got), 1e-4)
    assert np.allclose([r.rate for r in got], rates, rtol=1e-5)


def test_conditions_hold(docs):
    targets = {"a": 1, "b": 2, "c": 1}
    rows = M.mixture(docs, targets=targets, tokens=50_000).collect()
    for s, w in targets.items():
        assert math.isclose(sum(r.tokens * r.rate for r in rows if r.source == s), 50_000 * w / 4, rel_tol=1e-6)
    t = np.array([r.tokens for r in rows], float)
    seen = t * np.array([r.rate for r in rows])
    assert abs((seen * np.log1p(t)).sum() / seen.sum() - (t * np.log1p(t)).sum() / t.sum()) < 0.01
    for r in rows:
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
    assert abs(sum(r.copies * r.tokens for r in rows) / 50_000 - 1) < 0.1


def test_copies_are_rows(docs):
    n = M.mixture(docs).agg(F.sum("copies")).first()[0]
    assert M.apply_mixture(docs).count() == n


def test_default_targets_temper_the_shares(docs):
    rows = M.mixture(docs).collect()
    share = lambda key: {s: sum(key(r) for r in rows if r.source == s) for s in "abc"}
    words, seen = share(lambda r: r.tokens), share(lambda r: r.tokens * r.rate)
    root = {s: math.sqrt(words[s]) for s in "abc"}
    for s in "abc":
        assert math.isclose(seen[s] / sum(seen.values()), root[s] / sum(root.values()), rel_tol=1e-6)


def test_sources_without_target_go(docs):
    rows = M.mixture(docs, targets={"b": 1.0, "zz": 1.0}).collect()
    assert all((r.rate == 0 and r.copies == 0) == (r.source != "b") for r in rows)


def test_alike_lengths(spark):
    rows = [(i, "x y z", "ab"[i % 4 > 0]) for i in range(40)]
    got = M.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), targets={"a": 0.5, "b": 0.5}).collect()
    assert {(r.source, round(r.rate, 6)) for r in got} == {("a", 2.0), ("b", round(2 / 3, 6))}


def test_hard_cases(hard, clashing, nothing):
    rows = M.mixture(hard).collect()
    assert len(rows) == hard.count()
    assert all(r.tokens == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert all(math.isfinite(r.rate) for r in rows)
    again = M.mixture(hard).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.tokens, r.rate, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    kept = M.apply_mixture(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r.copies for r in rows)
    assert M.mixture(nothing).count() == 0 and M.apply_mixture(nothing).count() == 0


def test_no_words_at_all(spark):
    got = M.apply_mixture(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string"))
    assert got.count() == 2


def test_lengths_from_a_column(spark):
    # source b has as many words, but three times the tokens
    rows = [(i, "one two three four " * (1 + i % 7), "ab"[i % 2], (4 + 8 * (i % 2)) * (1 + i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")
    got = M.mixture(docs, targets={"a": 1, "b": 1}, lengths="n_tokens").collect()
    assert {r.doc_id: r.tokens for r in got} == {r[0]: r[3] for r in rows}
    total = {s: sum(r.tokens * r.rate for r in got if r.source == s) for s in "ab"}
    assert math.isclose(total["a"], total["b"], rel_tol=1e-6) and math.isclose(sum(total.values()), sum(r[3] for r in rows), rel_tol=1e-6)
    assert M.apply_mixture(docs, lengths="n_tokens").columns == docs.columns


def test_tokens_of_a_vocabulary_meet_the_targets(spark, sf):
    from veclume.llm.queries import op4_mixture
    from veclume.llm.tokens import count_tokens

    want = {r.doc_id: r.n_tokens for r in count_tokens(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    rows = op4_mixture(spark, sf).collect()
    assert {r.doc_id: r.tokens for r in rows} == want
    root = {s: math.sqrt(sum(r.tokens for r in rows if r.source == s)) for s in {r.source for r in rows}}
    for s, v in root.items():
        assert math.isclose(sum(r.tokens * r.rate for r in rows if r.source == s), sum(want.values()) * v / sum(root.values()), rel_tol=1e-6)
    rates = _plain([r.tokens for r in rows], [r.source for r in rows], {s: v / sum(root.values()) for s, v in root.items()}, sum(want.values()), 1e-4)
    assert np.allclose([r.rate for r in rows], rates, rtol=1e-5)


def test_many_sources_by_shuffle(spark, docs, monkeypatch):
    want = sorted(M.mixture(docs).collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    got = sorted(M.mixture(docs).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r.rate for r in got], [r.rate for r in want], rtol=1e-7)


def test_unmet_conditions_are_said(docs):
    with pytest.warns(UserWarning, match="off by"):
        rows = M.mixture(docs, targets={"a": 1, "b": 8, "c": 1}, rounds=1).collect()
    total = {s: sum(r.tokens * r.rate for r in rows if r.source == s) for s in "abc"}
    assert math.isclose(total["b"], 8 * total["a"], rel_tol=1e-6)
