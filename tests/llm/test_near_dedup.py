import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from veclume.llm import near_dedup as N

from .conftest import LINE


def _shingles(text, width=3):
    w = re.findall(r"[^\W_]+", text.lower()) or text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_shingles_are_those_of_the_words():
    texts = ["a b c d", "", "one", "x  y\nz", "a b c"]
    raw = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, per = N.shingles(np.frombuffer(raw, np.uint8), at, 3)
    assert per.tolist() == [2, 0, 1, 1, 1]
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    alone, _ = N.shingles(np.frombuffer(b"x y z", np.uint8), np.array([0, 5]), 3)
    assert alone[0] == h[3]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    odd = N._odd(N.SEEDS, 1)
    for share in (0.0, 0.5, 0.8):
        both, n = int(1000 * share), 1000
        common = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 1 << 63, n - both, dtype=np.uint64)]) for _ in range(2)]
        values = N.signatures(np.concatenate(sets), np.array([n, n]), odd)
        s = N.sketch(values)
        assert abs(N.likeness(s[:1], s[1:])[0] - both / (2 * n - both)) < 0.15


def test_groups_against_all_pairs(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, ident = [], 0
    for g in range(60):
        base = [random.choice(vocabulary) for _ in range(random.randint(30, 300))]
        for _ in range(random.choice([1, 1, 2, 3, 12])):
            words = [random.choice(vocabulary) if random.random() < 0.02 else w for w in base]
            docs.append((ident, " ".join(words)))
            ident += 1
    random.shuffle(docs)
    rows = N.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    group = {r.doc_id: r.group_id for r in rows}
    sets = {i: _shingles(t) for i, t in docs}
    hit = sure = 0
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        j = _jaccard(x, y)
        if j >= 0.6:
            sure += 1
            hit += a in group and group[a] == group.get(b)
    assert sure > 100 and hit / sure >= 0.95
    # clean documents are in no group, and a group keeps its smallest id
    for a in group:
        assert max(_jaccard(sets[a], sets[b]) for b in sets if b != a) > 0.35
    for r in rows:
        assert r.keep == (r.doc_id == r.group_id) and r.group_id == min(d for d, g in group.items() if g == r.group_id)


def test_a_large_group_of_copies_is_one_group(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(LINE).alias("text"))
    got = N.near_duplicates(many).agg(F.count("*"), F.countDistinct("group_id"), F.max("group_id")).first()
    assert tuple(got) == (3000, 1, 0)


def test_components_of_a_path(spark):
    path = spark.range(1, 400).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert N.components(path).agg(F.count("*"), F.max("root")).first()[:] == (400, 0)


def test_hard_cases(hard, clashing, nothing):
    groups = {r.doc_id: r.group_id for r in N.near_duplicates(hard).collect()}
    assert groups == {6: 6, 7: 6, 9: 9, 10: 9}
    assert N.near_duplicates(nothing).count() == 0 and N.drop_near_duplicates(nothing).count() == 0
    kept = N.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x))
    assert ids == [None, None, 1, 2, 3, 4, 5, 6, 8, 9, 11, 12]


def test_rows_that_repeat_an_id_are_one_document(spark):
    rows = [(1, "b b b b"), (1, "a a a a"), (1, None), (2, "c c c c")]
    kept = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a a a a"), (2, "c c c c")]


def test_candidates_against_every_pair():
    rng = np.random.default_rng(8)
    for region, neighbours in ((4, 1), (8, 2), (3, 4)):
        label = rng.integers(0, 3, (300, 4)).astype("u4")
        label[100:180] = label[100]  # more equal labels than a region holds
        tree = np.repeat([0, 1], [190, 110]).astype(np.int32)
        order = np.lexsort([*label.T[::-1], tree])
        tree, label = tree[order], label[order]
        common = np.cumprod((label[:, None] == label) & (tree[:, None] == tree)[:, :, None], axis=2).sum(2)
        want = set()
        for i in range(300):
            for j in range(i):
                d = common[i, j]
                share = (common[i] >= d).sum()
                head = d == 4 and share > region and not (common[j, :j] == 4).any()
                if d and (share <= region or i - j <= neighbours or head):
                    want.add((i, j))
        got = {(a, b) for i, j in N.candidates(tree, label, 0, 300, neighbours, region) for a, b in zip(i.tolist(), j.tolist())}
        assert got == want


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join("x" * int(n) + str(i) for i, n in enumerate(rng.integers(0, 40, 500))), "y" * 3000, "a  b\n" * 700, "z" * 900 + " end  ", " " * 700, "one" + " " * 600]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        for width in (1, 2, 3, 5):
            monkeypatch.setattr(N, "_LONG", 1 << 20)
            want = N.shingles(raw, np.array([0, len(raw)]), width)
            for most in (64, 100, 999):
                monkeypatch.setattr(N, "_LONG", most)
                got = N.shingles(raw, np.array([0, len(raw)]), width)
                assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_a_group_of_a_million(spark):
    star = spark.range(1, 1_000_000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    assert N.components(star).agg(F.count("*"), F.max("root")).first()[:] == (1_000_000, 0)
