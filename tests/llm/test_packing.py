import random
from collections import Counter

import pytest

from veclume.llm import packing as P


def _check(pieces, windows, tiers, step_tokens):
    placed = Counter((i, o, n) for w in windows for n, i, o in w[5])
    assert placed == Counter((i, o, n) for n, i, o in pieces)
    for size, _, step, tokens, cost, held in windows:
        assert size in tiers and tokens == sum(p[0] for p in held) <= size and cost == sum(p[0] ** 2 for p in held)
        assert max(p[0] for p in held) > max([t for t in tiers if t < size], default=0) or size == min(tiers)
    for size in tiers:
        steps = Counter(w[2] for w in windows if w[0] == size)
        if steps:
            assert max(steps.values()) * size <= step_tokens + size and max(steps.values()) - min(steps.values()) <= 1


def test_windows_hold_every_piece_once():
    rng = random.Random(2)
    pieces = [(min(512, int(rng.paretovariate(1.1) * 12)), i, 0) for i in range(3000)]
    windows = P.pack(pieces, (64, 128, 512), 2048)
    _check(pieces, windows, (64, 128, 512), 2048)
    assert sum(w[3] for w in windows) / sum(w[0] for w in windows) > 0.97


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    windows = P.pack([(90, 1, 0), (30, 2, 0), (8, 3, 0), (2, 4, 0)], (10, 50, 100), 100)
    assert windows[0][5] == [(90, 1, 0), (8, 3, 0), (2, 4, 0)] and windows[1][5] == [(30, 2, 0)]


def test_steps_have_nearly_equal_cost():
    rng = random.Random(3)
    windows = P.pack([(rng.randint(1, 100), i, 0) for i in range(4000)], (100,), 1000)
    cost = Counter()
    for w in windows:
        cost[w[2]] += w[4]
    assert max(cost.values()) < 1.1 * min(cost.values())


def test_long_documents_are_cut_and_nothing_is_lost(spark):
    docs = spark.createDataFrame([(1, "a " * 250), (2, "b " * 10), (3, "c " * 100)], "doc_id bigint, text string")
    rows = P.pack_documents(docs, (10, 50, 100), 200).collect()
    held = sorted((i, o, n) for r in rows for i, o, n in zip(r.doc_ids, r.offsets, r.lengths))
    assert held == [(1, 0, 100), (1, 100, 100), (1, 200, 50), (2, 0, 10), (3, 0, 100)]
    assert all(r.tokens == r.tier for r in rows)


def _plain(lengths, tiers):
    """Best fit by decreasing length, piece by piece: how full the windows of each tier are."""
    pools, out = {t: [] for t in tiers}, []
    for n in sorted(lengths, reverse=True):
        pools[min(t for t in tiers if t >= n)].append(n)
    for k in range(len(tiers) - 1, -1, -1):
        gaps = []
        for lower in range(k, -1, -1):
            rest = []
            for n in pools[tiers[lower]]:
                fits = [g for g in gaps if g >= n]
                if fits:
                    gaps.remove(min(fits))
                    gaps.append(min(fits) - n)
                elif lower == k:
                    gaps.append(tiers[k] - n)
                else:
                    rest.append(n)
            pools[tiers[lower]] = rest
        out += [(tiers[k], tiers[k] - g) for g in gaps]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_the_histogram_packs_as_pieces_do_one_by_one(seed):
    rng = random.Random(seed)
    tiers = [(8, 20, 64), (50,), (16, 17, 100)][seed % 3]
    lengths = [min(max(tiers), int(rng.paretovariate(0.9) * 3)) for _ in range(400 + 300 * seed)]
    windows = P.pack([(n, i, 0) for i, n in enumerate(lengths)], tiers, max(tiers) * 3)
    _check([(n, i, 0) for i, n in enumerate(lengths)], windows, tiers, max(tiers) * 3)
    assert sorted((w[0], w[3]) for w in windows) == _plain(lengths, tiers)


@pytest.mark.parametrize("salts", [1, 7, 256])
def test_the_table_packs_as_its_pieces_in_one_process(spark, sf, salts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tiers = (128, 512, 2048)
    rows = P.pack_documents(docs, tiers, 4096, salts=salts).collect()
    pieces = [(min(2048, n - o), r.doc_id, o) for r in docs.collect() for n in [len(r.text.split())] for o in range(0, n, 2048)]
    _check(pieces, [(r.tier, r.window, r.step, r.tokens, r.cost, list(zip(r.lengths, r.doc_ids, r.offsets))) for r in rows], tiers, 4096)
    assert sorted((r.tier, r.tokens) for r in rows) == _plain([p[0] for p in pieces], tiers)
    assert len({(r.tier, r.window) for r in rows}) == len(rows)


def test_partitions_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda d: sorted(map(str, P.pack_documents(d, (128, 512, 2048), 4096).collect()))
    assert key(docs) == key(docs.repartition(13))


def test_copies_go_to_different_windows(spark):
    docs = spark.createDataFrame([(i // 5, "w " * 20) for i in range(500)], "doc_id bigint, text string")
    rows = P.pack_documents(docs, (100,), 1000).collect()
    assert len(rows) == 100 and all(len(set(r.doc_ids)) == 5 for r in rows)


def test_hard_cases(hard, clashing, nothing):
    rows = P.pack_documents(hard).collect()
    held = Counter(i for r in rows for i in r.doc_ids)
    assert held == {1: 1, 2: 1, 6: 3, 7: 3, None: 1, 8: 1, 9: 1, 10: 2, 11: 1, 12: 1}
    assert sorted(map(str, rows)) == sorted(map(str, P.pack_documents(clashing).collect()))
    assert P.pack_documents(nothing).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(hard, (8192,), 100)


def test_lengths_are_tokens_of_the_vocabulary(spark, sf):
    from veclume.llm.queries import op5_packing
    from veclume.llm.tokens import VOCABULARY, count_tokens, open_tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    got, ends = Counter(), {}
    for r in op5_packing(spark, sf).collect():
        assert r.tokens == sum(r.lengths) <= r.tier
        for i, o, n in zip(r.doc_ids, r.offsets, r.lengths):
            got[i] += n
            ends[i] = max(ends.get(i, 0), o + n)
    assert got == ends == {i: n for i, n in want.items() if n}
    solid = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9000))  # no white space: a single word
    rows = P.pack_documents(spark.createDataFrame([(1, solid)], "doc_id bigint, text string"), (128, 1024), 4096, tokenizer=VOCABULARY).collect()
    assert len(rows) > 1 and sum(r.tokens for r in rows) == len(open_tokenizer(VOCABULARY)([solid])[0])
