import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veclume.llm import line_dedup as D


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=14).map(lambda b: bytes(x % 3 for x in b)), st.binary(max_size=14).map(lambda b: bytes(x % 3 for x in b)), st.integers(0, 5))
def test_banded_distance(a, b, most):
    assert D.edit_distance(a, b, most) == min(_distance(a, b), most + 1)


def _edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        k, at = rng.randrange(3), rng.randrange(len(out))
        if k == 0:
            out[at] = rng.choice("abcdé")
        elif k == 1:
            out.insert(at, rng.choice("abcdé"))
        else:
            out.pop(at)
    return "".join(out)


def _plain(docs, edits, least):
    """Every pair of lines, in order."""
    lines = [(i, k, x.encode()) for i, t in docs for k, x in enumerate(t.split("\n")) if len(x.encode()) >= least]
    lines.sort()
    first, gone = {}, set()
    for i, k, x in lines:
        if x in first:
            gone.add((i, k))
        else:
            if any(abs(len(x) - len(y)) <= edits and _distance(x, y) <= edits for y in first):
                gone.add((i, k))
            first[x] = (i, k)
    return gone


def test_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(18, 60))) for _ in range(60)]
    docs = [(i, "\n".join(_edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(4))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for edits in (1, 2, 3):
        got = {(r.doc_id, r.line_no) for r in D.repeated_lines(frame, edits, 20).collect()}
        assert got == _plain(docs, edits, 20), edits


def test_text_keeps_its_other_lines(spark):
    a, b, c = "a line that is long enough to be judged", "another line that is long enough too", "short"
    docs = [(1, f"{a}\n{c}\n{b}", 9), (2, f"{c}\n{a}!\n{c}", 9), (3, a, 9), (4, c, 9)]
    got = {r.doc_id: (r.text, r.n_chars) for r in D.drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint")).collect()}
    assert got == {1: (f"{a}\n{c}\n{b}", 9), 2: (f"{c}\n{c}", 11), 4: (c, 9)}


def test_hard_cases(hard, clashing, nothing):
    got = sorted((r.doc_id, r.line_no, r.keep_doc_id, r.keep_line_no, r.edits) for r in D.repeated_lines(hard).collect())
    assert got == [(2, 0, 1, 0, 0), (10, 0, 9, 0, 0), (10, 0, 9, 0, 0)]
    kept = D.drop_repeated_lines(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x))
    assert ids == [None, None, 1, 3, 4, 5, 6, 7, 8, 9, 11, 12]
    assert D.repeated_lines(nothing).count() == 0 and D.drop_repeated_lines(nothing).count() == 0


def test_repeated_rows_keep_what_they_share(spark):
    a = "a line that is long enough to be judged"
    rows = [(5, a), (5, a), (5, a + "\n" + a)]
    got = sorted(r.text for r in D.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [a, a, a]


def test_many_copies_of_a_line(spark):
    a = "a line that is long enough to be judged"
    docs = spark.range(5000).selectExpr("id doc_id", f"'{a}' text")
    assert D.repeated_lines(docs).count() == 4999


def test_exact_repeats_of_short_lines(spark):
    long = "a line of more than twenty bytes"
    docs = [(1, f"And ornd.\n\n{long}\né"), (2, f"And ornd.\n \n{long}!\nAnd orne."), (3, "é\n\n \nAnd ornd.")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.line_no, r.keep_doc_id, r.keep_line_no, r.edits) for r in D.repeated_lines(frame, short=True).collect())
    assert got == [(2, 0, 1, 0, 0), (2, 2, 1, 2, 1), (3, 0, 1, 3, 0), (3, 3, 1, 0, 0)]
    assert {r.doc_id: r.text for r in D.drop_repeated_lines(frame, short=True).collect()} == {1: docs[0][1], 2: " \nAnd orne."}
    key = lambda rows: sorted(tuple(r) for r in rows if r.edits or r.line_no == 2)
    assert key(D.repeated_lines(frame).collect()) == key(D.repeated_lines(frame, short=True).collect())


def test_parities_bound_the_distance():
    import pyarrow as pa

    rng = random.Random(4)
    lines = ["".join(rng.choice("abc 019é") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    bits = D.parities(pa.array(lines)).to_numpy(zero_copy_only=False).view("uint32")
    for a in range(0, 300, 3):
        for b in range(300):
            assert int(bits[a] ^ bits[b]).bit_count() <= 2 * _distance(lines[a].encode(), lines[b].encode())
    assert D.parities(pa.array([None, "", "aa"])).to_pylist() == [None, 0, 0]


def test_a_segment_of_many_lines(spark):
    rng = random.Random(7)
    head = "every line begins alike: "
    docs = [(i, head + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50))) for i in range(3000)]
    docs += [(3000 + i, _edited(rng, docs[i * 31][1], 2)) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [sorted(map(tuple, D.repeated_lines(frame, crowded=most).collect())) for most in (50, 4096)]
    near = {3000 + i for i in range(40) if _distance(docs[3000 + i][1].encode(), docs[i * 31][1].encode()) <= 2}
    assert len(near) > 10 and got[0] == got[1] and {r[0] for r in got[0]} == near


def test_many_thousand_lines_that_share_a_segment(spark):
    from pyspark.sql import functions as F

    line = F.concat(F.lit("a third of the line is the same "), F.sha2(F.col("id").cast("string"), 256))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), line.alias("text"))
    more = docs.filter("doc_id % 1000 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat(F.col("text"), F.lit("!")).alias("text"))
    got = {(r.doc_id, r.keep_doc_id, r.edits) for r in D.repeated_lines(docs.unionByName(more)).collect()}
    assert got == {(1_000_000 + i, i, 1) for i in range(0, 20_000, 1000)}
