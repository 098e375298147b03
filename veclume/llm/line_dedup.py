"""Near-duplicate lines by a segment-partition edit join.

A line repeats another if at most ``edits`` byte insertions, deletions or
replacements (of its UTF-8 form) turn one into the other. Split a line into
``edits + 1`` segments: whatever is within that distance holds one of them
unchanged, at a place that the lengths confine to a few offsets. Each distinct
line is indexed by the hashes of its segments, and probes the index of each
length it may match with the substrings that can hold a segment. Lines that meet
are a pair if the parities of their bytes differ by no more than edits can
change, which nearly all that merely share a segment fail; pairs are verified by
a banded bit-parallel edit distance. A segment that very many lines share is
divided among tasks.

Lines are ordered by (doc_id, line number). A line goes if some earlier line
repeats it, so each chain of repeats keeps its first line. Lines under
``min_bytes`` are too short to judge by edits. They stay, unless ``short`` asks
for their exact repeats, which need no least length; blank lines always stay.

Cases: a null text has no lines; a null doc_id names no lines, so that document
is neither changed nor a source; an empty text is one blank line; a very long
line is a line like others; rows that repeat a doc_id share their lines'
addresses, and a line goes from each row that has it there; repeated rows keep
the lines they have in common; of lines equally near the earliest is named. A
document that loses every line goes. An empty table gives no rows; other columns
come along whatever their names; ids are whole numbers, and one that can't be
cast to BIGINT ends the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veclume.llm.shared import discard, fresh, materialise, text_batches, utf8

#: Lines asked for by key are found by a broadcast of their keys up to this many, by a shuffle beyond.
BROADCAST_KEYS = 1_000_000


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """Edit distance if it is ``most`` or less, else ``most + 1``.

    The column of the distance matrix inside the band of ``2 * most + 1``
    diagonals is held as two words of vertical differences and moved along the
    diagonal one byte of ``b`` a step.
    """
    n, m, beyond = len(a), len(b), most + 1
    if abs(n - m) > most:
        return beyond
    head, limit = 0, min(n, m)
    while head < limit and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < limit - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    n, m = len(a), len(b)
    if not n or not m or not most:
        return min(n + m, beyond)
    if n < m:
        a, b, n, m = b, a, m, n
    most = min(most, n)  # the distance is n at most
    # bit k of column i stands for the byte of a at i + most - width + 1 + k: the word follows the diagonal
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    match: dict[int, tuple[int, int]] = {}
    for r in range(min(n, most)):
        word, since = match.get(a[r], (0, 0))
        match[a[r]] = (word >> (r - most - since) | top if word else top, r - most)
    plus, minus, score, under = full & (full << (width - most - 1)), 0, most, top >> 1
    give_up = 2 * most + m - n
    for i in range(m):
        r = i + most
        if r < n:
            word, since = match.get(a[r], (0, i))
            match[a[r]] = (word >> (i - since) | top, i)
        word, since = match.get(b[i], (0, i))
        x = word >> (i - since)
        down = (((x & plus) + plus) ^ plus) | x | minus
        right = minus | (full & ~(down | plus))
        left = down & plus
        if r < n:
            if not down & top:
                score += 1
                if score > give_up:
                    return beyond
        else:
            score += bool(right & under) - bool(left & under)
            under >>= 1
        down = (down & full) >> 1
        plus = left | (full & ~(down | right))
        minus = down & right
    return min(score, beyond)


def _keys(edits: int) -> tuple[list[str], list[str]]:
    """SQL for the index keys and the probe keys of a line, from its bytes ``b`` and their number ``n``."""
    parts = edits + 1

    def segment(i: int, gap: int) -> tuple[str, str, str]:
        length = f"(n - {gap})"
        base, longer = f"cast({length} div {parts} as int)", f"({parts} - {length} % {parts})"
        return length, f"({i} * {base} + greatest(0, {i} - {longer}) + 1)", f"({base} + if({i} >= {longer}, 1, 0))"

    index, probe = [], []
    for i in range(parts):
        for gap in range(edits + 1):
            length, start, size = segment(i, gap)
            before, after = i, edits - i
            for off in range(max(-before, gap - after), min(before, gap + after) + 1):
                at = f"({start} + {off})"
                probe.append(f"if({at} >= 1 and {at} + {size} - 1 <= n, xxhash64({i}, {length}, substring(b, {at}, {size})), null)")
        length, start, size = segment(i, 0)
        index.append(f"xxhash64({i}, {length}, substring(b, {start}, {size}))")
    return index, probe


def _lines(docs: DataFrame, min_bytes: int, short: bool = False) -> DataFrame:
    """(doc_id, line_no, line) of every line that is long enough, or with ``short`` isn't blank."""
    some = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return some.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter((F.octet_length("line") >= min_bytes) | (F.col("line").rlike(r"\S") if short else F.lit(False)))


#: The kind of a byte, one of 32; letters, and digits among themselves, are of kinds of their own.
_KIND = np.array([1 << ((b + 7 * (b >> 5)) & 31) for b in range(256)], np.uint32)


def parities(lines: pa.Array) -> pa.Array:
    """Of each kind of byte whether a line has an odd number of it: an edit changes two at most. Null for a null."""
    raw, at = utf8(lines)
    out = np.zeros(len(lines), np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.bitwise_xor.reduceat(_KIND[raw], at[some])
    return pa.array(out.view(np.int32), mask=lines.is_null().to_numpy(zero_copy_only=False))


parities.__annotations__ = {"lines": pa.Array, "return": pa.Array}


def _verified(pairs: DataFrame, edits: int) -> DataFrame:
    """Pairs whose lines are within ``edits``: the later line and the earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [edit_distance(x, y, edits) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            near = pa.array([d <= edits for d in found], pa.bool_())
            kept = batch.append_column("edits", pa.array(found, pa.int32())).filter(near)
            yield kept.select(["doc_id", "line_no", "h", "keep_doc_id", "keep_line_no", "edits"])

    late = "(doc_a, line_a) > (doc_b, line_b)"
    pick = lambda a, b: F.expr(f"if({late}, {a}, {b})")
    ordered = pairs.select(
        pick("doc_a", "doc_b").alias("doc_id"), pick("line_a", "line_b").alias("line_no"), pick("h_a", "h_b").alias("h"), pick("doc_b", "doc_a").alias("keep_doc_id"), pick("line_b", "line_a").alias("keep_line_no"), "text_a", "text_b"
    )
    return ordered.mapInArrow(run, "doc_id bigint, line_no int, h bigint, keep_doc_id bigint, keep_line_no int, edits int")


def repeated_lines(docs: DataFrame, edits: int = 2, min_bytes: int = 20, short: bool = False, crowded: int = 4096) -> DataFrame:
    """(doc_id, line_no, h, keep_doc_id, keep_line_no, edits) of every line that goes.

    The kept line is the earliest that it repeats: byte for byte if there is
    one (``edits`` 0), else within the threshold. ``h`` is the line's hash.
    ``short`` adds exact repeats of lines under ``min_bytes``. A segment that more
    than ``crowded`` lines share is met in parts, with the same result.
    """
    if min_bytes <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits")
    text_batches(docs.sparkSession)
    index, probe = _keys(edits)
    keyed = _lines(docs, min_bytes, short).withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    first = Window.partitionBy("h", "h2").orderBy("doc_id", "line_no")
    placed = keyed.withColumns({"keep_doc_id": F.first("doc_id").over(first), "keep_line_no": F.first("line_no").over(first), "line": F.when((F.row_number().over(first) == 1) & (F.octet_length("line") >= min_bytes), F.col("line"))})
    placed = materialise(placed.drop("h2").withColumn("parity", F.arrow_udf(parities, "int")("line")), "lines")
    exact = placed.filter("doc_id <> keep_doc_id OR line_no <> keep_line_no").select("doc_id", "line_no", "h", "keep_doc_id", "keep_line_no", F.lit(0).alias("edits"))

    distinct = placed.filter("line IS NOT NULL").select("h", "parity", F.col("line").cast("binary").alias("b"), F.octet_length("line").alias("n"))
    keys = lambda sql, s: distinct.select(F.explode(F.expr(f"array({', '.join(sql)})")).alias("key"), F.col("h").alias(f"h_{s}"), F.col("parity").alias(f"parity_{s}")).filter("key IS NOT NULL")
    held, asked = keys(index, "a"), keys(probe, "b")
    # a key that very many lines have is divided: each part of them meets all that ask for it, in a task of its own
    crowd = materialise(held.groupBy("key").count().filter(F.col("count") > crowded).select("key", F.ceil(F.col("count") / crowded).cast("int").alias("parts")), "crowd")
    crowds, on = crowd.count(), ["key"]
    if crowds:
        small = F.broadcast(crowd) if crowds <= BROADCAST_KEYS else crowd
        parts, on = F.coalesce("parts", F.lit(1)), ["key", "part"]
        held = held.join(small, "key", "left").withColumn("part", F.pmod(F.xxhash64("h_a"), parts).cast("int")).drop("parts")
        asked = asked.join(small, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    near = (F.col("h_a") != F.col("h_b")) & (F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 2 * edits)
    met = held.join(asked, on).filter(near).select(F.least("h_a", "h_b").alias("h_a"), F.greatest("h_a", "h_b").alias("h_b"))
    pairs = materialise(met.distinct(), "pairs")

    wanted = materialise(pairs.select(F.explode(F.array("h_a", "h_b")).alias("h")).distinct(), "wanted")
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = materialise(placed.filter("line IS NOT NULL").select("h", "doc_id", "line_no", F.col("line").cast("binary").alias("text")).join(some, "h", "left_semi"), "texts")
    side = lambda s: texts.select(F.col("h").alias(f"h_{s}"), F.col("doc_id").alias(f"doc_{s}"), F.col("line_no").alias(f"line_{s}"), F.col("text").alias(f"text_{s}"))
    found = _verified(pairs.join(side("a"), "h_a").join(side("b"), "h_b"), edits)
    found = found.groupBy("doc_id", "line_no", "h").agg(F.min(F.struct("keep_doc_id", "keep_line_no", "edits")).alias("k")).select("doc_id", "line_no", "h", "k.*")
    found = materialise(found, "near-lines")
    for done in (crowd, pairs, wanted, texts):
        discard(done)
    return exact.unionByName(found)


def drop_repeated_lines(docs: DataFrame, edits: int = 2, min_bytes: int = 20, short: bool = False) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones, and without documents left blank by that. ``n_chars`` follows the text."""
    text_batches(docs.sparkSession)
    gone, mark, text = fresh(docs.columns, "gone"), fresh(docs.columns, "mark"), fresh(docs.columns, "text")
    lists = repeated_lines(docs, edits, min_bytes, short).groupBy(F.col("doc_id").alias(mark)).agg(F.collect_list(F.struct("line_no", "h")).alias(gone))

    def cut(texts: pa.Array, gones: pa.Array) -> pa.Array:
        out = []
        for whole, drops in zip(texts.to_pylist(), gones.to_pylist()):
            if whole is None or drops is None:
                out.append(whole)
                continue
            rows, left = whole.split("\n"), dict.fromkeys(range(whole.count("\n") + 1))
            for d in drops:
                if d["line_no"] < len(rows) and xxhash.xxh64_intdigest(rows[d["line_no"]].encode(), 42) == d["h"] % (1 << 64):
                    left.pop(d["line_no"], None)
            kept = [rows[k] for k in left]
            out.append("\n".join(kept) if any(x.strip() for x in kept) or len(kept) == len(rows) else None)
        return pa.array(out, pa.string())

    cut.__annotations__ = {"texts": pa.Array, "gones": pa.Array, "return": pa.Array}
    joined = docs.join(lists, docs["doc_id"].cast("bigint") == lists[mark], "left")
    done = joined.withColumn(text, F.arrow_udf(cut, "string")(F.col("text").cast("string"), F.col(gone))).filter(f"{gone} IS NULL OR {text} IS NOT NULL")
    columns: list[Column] = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(text).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return done.select(*columns)
