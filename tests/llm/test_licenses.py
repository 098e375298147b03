import random

import numpy as np

from veclume.llm import licenses as L


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 400, dtype=np.uint64)
    kept = set(L.winnow(h, 4))
    for i in range(len(h) - 3):
        spots = [p for p in range(i, i + 4) if p in kept]
        assert spots and h[i : i + 4].min() in h[spots]
    assert L.winnow(h[:2], 4) and L.winnow(h[:0], 4) == []


def _plain(doc, template):
    """Best local alignment without a band: (score, words matched)."""
    best, score = (0, 0), [[(0, 0)] * (len(doc) + 1) for _ in range(len(template) + 1)]
    for j in range(1, len(template) + 1):
        for i in range(1, len(doc) + 1):
            same = template[j - 1] == doc[i - 1]
            s, h = score[j - 1][i - 1]
            options = [(s + (2 if same else -1), h + same), (score[j - 1][i][0] - 1, score[j - 1][i][1]), (score[j][i - 1][0] - 1, score[j][i - 1][1])]
            score[j][i] = max(max(options), (0, 0)) if max(options)[0] > 0 else (0, 0)
            best = max(best, score[j][i])
    return best


def test_alignment_is_the_best_where_the_band_holds_it():
    rng = random.Random(4)
    for _ in range(60):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 25))]
        doc = list(template)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(doc))
            doc[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["y", "z"]])
        front = [rng.choice("pqrs") for _ in range(rng.randint(0, 6))]
        hits, a, b = L.align(front + doc, template, len(front), 10)
        assert hits == _plain(front + doc, template)[1]
        assert 0 <= a <= b <= len(front) + len(doc)


def _texts():
    words = [f"w{i}" for i in range(400)]
    rng, out = random.Random(6), []
    for i in range(200):
        body = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        name = rng.choice([*L.TEMPLATES, None, None])
        text = " ".join(body)
        if name:
            notice = L.TEMPLATES[name].split()
            if len(notice) > 40:
                for _ in range(len(notice) // 15):
                    notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(body))
            text = " ".join([*body[:at], *notice, *body[at:]])
        out.append((i, text, name))
    return out


def test_against_aligning_everything(spark):
    texts = _texts()
    got = {}
    for r in L.scan(spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, name in texts:
        share = {n: _plain(L._words(text), L._words(t))[1] / len(L._words(t)) for n, t in L.TEMPLATES.items()} if len(text) < 500 else {}
        if name is None:
            assert i not in got
            assert all(s < 0.8 for s in share.values())
        else:
            assert [r.license for r in got[i]] == [name], (name, got.get(i))
            r = got[i][0]
            inside = L._words(text[r.start : r.end])
            assert r.coverage >= 0.8 and len(inside) <= 1.2 * len(L._words(L.TEMPLATES[name]))
            if share:
                assert abs(r.coverage - share[name]) < 1e-6


def test_spans_and_overlaps(spark):
    text = "é Préface. Licensed under CC BY-NC 4.0! Then: RELEASED   under the mit license\nAll rights reserved; all rights reserved."
    rows = L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("start").collect()
    assert [(r.license, text[r.start : r.end]) for r in rows] == [
        ("CC-BY-NC-4.0-short", "Licensed under CC BY-NC 4.0"),
        ("MIT-notice", "RELEASED   under the mit license"),
        ("all-rights-reserved", "All rights reserved"),
        ("all-rights-reserved", "all rights reserved"),
    ]


def test_hard_cases(hard, clashing, nothing, spark):
    assert L.scan(hard).count() == 0 and L.scan(nothing).count() == 0 and L.scan(clashing).count() == 0
    notice = "Released under the MIT License."
    rows = [(None, notice), (1, notice), (1, notice), (2, None), (3, "word " * 100_000 + notice)]
    got = sorted((r.doc_id or 0, r.license, r.coverage) for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, "MIT-notice", 1.0), (1, "MIT-notice", 1.0), (1, "MIT-notice", 1.0), (3, "MIT-notice", 1.0)]


def test_whole_texts(spark):
    whole = {n: t for n, t in L.TEMPLATES.items() if n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC-text", "zlib", "Unlicense")} | L.whole_texts()
    assert len(whole) == 14
    mit = L.TEMPLATES["MIT"]
    rows = [(n, f"Some words before. {t} And after.") for n, t in whole.items()]
    rows += [("opening only", L.TEMPLATES["MIT-grant"]), ("MIT without its opening", mit[mit.index("a copy of this") :])]
    names = dict(enumerate(n for n, _ in rows))
    got = {}
    for r in L.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")).collect():
        got.setdefault(names[r.doc_id], []).append((r.license, r.coverage, r.end - r.start))
    for name, text in whole.items():
        assert [(n, c) for n, c, _ in got[name]] == [(name, 1.0)]
        assert got[name][0][2] >= len(text.strip()) - 60  # the span is all of the text, but for signs at its ends
    assert [n for n, _, _ in got["opening only"]] == ["MIT-grant"]
    assert [n for n, _, _ in got["MIT without its opening"]] == ["MIT"]


def test_one_word_edits_of_short_notices(spark):
    texts = []
    for name, t in L.TEMPLATES.items():
        notice = t.split()
        if len(L._words(t)) < L.SHORT:
            edits = [notice[:k] + put + notice[k + cut :] for k in range(len(notice)) for put, cut in ((["changed"], 1), (["extra"], 0), ([], 1))]
            texts += [(name, " ".join(["some", "words", *e, "and", "then", "others"])) for e in edits]
    rows = L.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string")).collect()
    got, most = {(r.doc_id, r.license): r.coverage for r in rows}, {}
    for r in rows:
        most[r.doc_id] = max(r.matched, most.get(r.doc_id, 0))
    for i, (name, text) in enumerate(texts):
        n = len(L._words(L.TEMPLATES[name]))
        matched = _plain(L._words(text), L._words(L.TEMPLATES[name]))[1]
        if matched / n < 0.8:
            assert (i, name) not in got
        elif (i, name) in got:
            assert abs(got[i, name] - matched / n) < 1e-6, (name, text)
        else:
            assert most.get(i, 0) >= matched, (name, text)  # a notice that matches more stands there


def test_openings_of_other_licenses_are_not_mit(spark):
    from veclume.llm.licenses import TEMPLATES, scan

    texts = [TEMPLATES["BSL-1.0"], TEMPLATES["Unicode-3.0"], TEMPLATES["MIT"], TEMPLATES["BSL-1.0-grant"], TEMPLATES["Unicode-grant"], TEMPLATES["MIT-grant"]]
    docs = spark.createDataFrame([(i, f"Some words before. {t} Some words after.") for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.license, r.coverage) for r in scan(docs).collect()) == [(i, n, 1.0) for i, n in enumerate(["BSL-1.0", "Unicode-3.0", "MIT", "BSL-1.0-grant", "Unicode-grant", "MIT-grant"])]
