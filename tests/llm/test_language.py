import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veclume.llm import language as L
from veclume.llm.shared import utf8

EN = "the cat sat on the mat and the dog ran to the river while a bird sang in the old tree " * 4
DE = "die katze saß auf der matte und der hund lief zum fluss während ein vogel im alten baum sang " * 4


def _phrases(text: str, learnt: str) -> int:
    z, x, at, count = L.letters(text), L.letters(learnt), 0, 0
    while at < len(z):
        size = 1
        while at + size <= len(z) and z[at : at + size] in x:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def test_suffix_automaton_accepts_exactly_the_factors():
    text = "abcabxabcd"
    codes = [ord(c) for c in text]
    _, at, to = L.suffix_automaton(codes, 128)
    nexts = dict(zip(at.tolist(), to.tolist()))

    def accepts(w):
        s = 0
        for c in w:
            s = nexts.get(s * 128 + ord(c))
            if s is None:
                return False
        return True

    for n in range(1, 5):
        for w in {"".join(p) for p in __import__("itertools").product("abcx", repeat=n)}:
            assert accepts(w) == (w in text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abßé Ä.\n9日\U0001f600", max_size=40), min_size=1, max_size=8))
def test_side_by_side_parse_is_the_plain_one(texts):
    a = L.Automata((("de", DE), ("en", EN)))
    codes, sizes = a.encode(*utf8(pa.array(texts)))
    codes = np.append(codes, 0).astype(codes.dtype)
    found = a.phrases(codes, sizes)
    few, L._FEW = L._FEW, 0
    try:
        assert (a.phrases(codes, sizes) == found).all()
    finally:
        L._FEW = few
    for k, t in enumerate(texts):
        if L.letters(t):
            assert sizes[k] == len(L.letters(t))
            assert [found[0, k], found[1, k]] == [_phrases(t, DE), _phrases(t, EN)]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    got = {r.doc_id: r.language for r in L.identify_languages(test, train).collect()}
    true = {r.doc_id: r.lang for r in test.select("doc_id", "lang").collect()}
    assert np.mean([got[i] == true[i] for i in true]) > 0.95


def test_clean_documents_are_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert L.keep_identified(docs).count() >= 0.97 * docs.count()


def test_noise_is_rejected(spark):
    noise = "qzxv jkwp vxqz zzkq wpvj " * 20
    docs = spark.createDataFrame([(1, EN, "en"), (2, DE, "de"), (3, noise, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.language, r.accepted) for r in L.identify_languages(docs).collect()}
    assert got[1] == ("en", True) and got[2] == ("de", True) and not got[3][1]


def test_hard_cases(hard, clashing, nothing):
    rows = L.identify_languages(hard).collect()
    assert len(rows) == hard.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (3, 4, 5, 8):
        assert (by[i].language, by[i].accepted) == (None, False)
    assert by[9].language == by[10].language == "de" and by[1].language == "en"
    kept = L.keep_identified(clashing)
    assert kept.columns == clashing.columns
    assert {1, 2, 6, 7, 9, 10} <= {r.doc_id for r in kept.collect()}
    assert L.identify_languages(nothing).count() == 0 and L.keep_identified(nothing).count() == 0


def test_without_labels_nothing_is_identified(spark):
    docs = spark.createDataFrame([(1, EN, None)], "doc_id bigint, text string, lang string")
    assert [(r.language, r.accepted) for r in L.identify_languages(docs).collect()] == [(None, False)]
