"""MinHash near-duplicate groups from an LSH forest.

Every document gets ``trees`` labels of ``depth`` min-hash values and a compact
sketch. Each tree is one sorted order of its labels, in which rows that share a
prefix stand together. The length of the prefix that counts adapts to the region:
a row's region is the shortest shared prefix, of one value at least, that no more
than ``region`` rows have, and all pairs of a region are candidates. So where few
documents share a value one is enough, and where many do it takes more. Besides,
every row is a candidate with the ``neighbours`` rows before it, which share its
longest prefixes, so that rows of crowded places that have no region have
partners too, and rows whose labels are equal throughout, which no longer prefix
can part, meet the first of them however many they are. A candidate pair becomes
an edge if the sketches put its Jaccard similarity at ``threshold`` or more, and
connected components of the edges are the groups.

Words are runs of letters and digits, lower case, so that copies with other
punctuation or capitals are near; a text without any is taken by what stands
between its white space.

Cases: a null, empty or blank text has no words and is in no group; a null doc_id
can be named by no group and is left alone; rows that repeat a doc_id are copies
of one document; repeated rows and equal texts are one group however many; fewer
than ``shingle`` words make a single shingle; a very long text is hashed in
parts, with the shingles of the whole; ties go to the smallest doc_id; an empty
table has no groups. Other columns, whatever their names, aren't read. Ids are
whole numbers, and one that can't be cast to BIGINT ends the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veclume.llm.shared import discard, fresh, materialise, mix64, pieces, text_batches, utf8, words_of

U = np.uint64
SEEDS = 128
TREE = ["tree", "label", "sketch", "doc_id", "twin"]
_BASE = U(0x9E3779B97F4A7C15)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


#: A single text of more bytes is hashed in parts of about so many.
_LONG = 4 << 20


def _blank(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of consecutive documents, and how many each document has."""
    if len(offsets) != 2 or len(raw) <= _LONG:
        return _shingles(raw, offsets, width)
    out, lo, step, n = [np.zeros(0, U)], 0, _LONG, len(raw)
    while lo < n:
        hi = min(n, lo + step)
        if hi < n:  # to the end of a word
            ends = np.flatnonzero(_blank(raw[hi : hi + _LONG]))
            if not len(ends):
                step += _LONG
                continue
            hi += int(ends[0])
        space = _blank(raw[lo:hi])
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(starts) < width and hi < n:
            step += _LONG
            continue
        if len(starts) >= width or len(out) == 1:
            out.append(_shingles(raw[lo:hi], np.array([0, hi - lo]), width)[0])
        # the next part begins with the words that shingles across the border need
        lo, step = (hi if hi == n or width == 1 else lo + int(starts[1 - width])), _LONG
    whole = np.concatenate(out)
    return whole, np.array([len(whole)])


def _shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, docs = len(raw), len(offsets) - 1
    space = np.ones(n + 1, bool)
    space[:n] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    before = np.ones(n + 1, bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first))
    if not len(starts):
        return np.zeros(0, U), np.zeros(docs, np.int64)
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(~space[:n] & (space[1:] | last[1:])) + 1
    power = np.ones(n + 1, U)
    power[1:] = _BASE
    np.cumprod(power, out=power)
    back = np.ones(n + 1, U)
    back[1:] = U(pow(int(_BASE), -1, 1 << 64))
    np.cumprod(back, out=back)
    total = np.zeros(n + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * power[:n], out=total[1:])
    words = mix64((total[ends] - total[starts]) * back[starts])
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    mixed = words.copy()
    turn = 0x9FB21C651E98DF25
    left = np.repeat(bounds[1:], counts) - np.arange(len(words))
    for k in range(1, width):
        mixed[:-k] += np.where(left[:-k] > k, words[k:] * U(pow(turn, k, 1 << 64)), U(0))
    usable = (left >= width) | (np.arange(len(words)) == np.repeat(bounds[:-1], counts))
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return mix64(mixed[usable]), per


def signatures(hashes: np.ndarray, per: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Min-hash values, one row a document with shingles."""
    have = per[per > 0]
    out = np.empty((len(odd), len(have)), U)
    starts = np.concatenate([[0], np.cumsum(have)[:-1]]).astype(np.int64)
    block = 1 << 15
    if len(hashes) <= block or len(have) == 1:
        for p, a in enumerate(odd):
            out[p] = np.minimum.reduceat(hashes * a, starts)
        return out.T
    lo = 0
    while lo < len(have):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + block, side="right")) - 1)
        end = starts[hi] if hi < len(have) else len(hashes)
        part, at = hashes[starts[lo] : end], starts[lo:hi] - starts[lo]
        for p, a in enumerate(odd):
            out[p, lo:hi] = np.minimum.reduceat(part * a, at)
        lo = hi
    return out.T


def sketch(values: np.ndarray) -> np.ndarray:
    """Four bits of each min-hash value, sixteen to a word."""
    nibble = mix64(values) >> U(60)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(nibble.reshape(len(values), -1, 16) << shifts, axis=2)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity as two sketches tell it; chance agreement of four bits is taken out."""
    x = a ^ b
    x = x | (x >> U(1))
    x = (x | (x >> U(2))) & U(0x1111111111111111)
    agree = 1 - np.bitwise_count(x).sum(axis=1) / (a.shape[1] * 16)
    return (agree - 1 / 16) / (15 / 16)


def forest(docs: DataFrame, trees: int, depth: int, shingle: int, seed: int) -> DataFrame:
    """(tree, label, sketch, doc_id, twin), ``trees`` rows for each document that has words; label is binary so that byte order sorts it.

    Of documents with one sketch that a task meets, only the first gets into
    the trees; the others name it as their twin, in a row of tree -1. So a text
    that comes a million times is in no tree more often than there are tasks.
    """
    if trees * depth > SEEDS:
        raise ValueError(f"trees * depth may be {SEEDS} at most")
    odd = _odd(SEEDS, seed)
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = utf8(batch.column(1))
            for lo, hi in pieces(offsets):
                at = offsets[lo : hi + 1]
                hashes, per = shingles(raw[at[0] : at[-1]], at - at[0], shingle)
                if not len(hashes):
                    continue
                values = signatures(hashes, per, odd)
                rows = np.flatnonzero(per > 0) + lo
                keep = ids.take(pa.array(rows))
                marks = np.ascontiguousarray(sketch(values)).view(np.uint8).reshape(len(rows), -1)
                labels = (mix64(values) & U(0xFFFFFFFF)).astype(">u4")
                names = keep.to_numpy(zero_copy_only=False)
                twins = np.array([seen.setdefault(m.tobytes(), i) for m, i in zip(marks, names.tolist())], np.int64)
                new = np.array([seen[m.tobytes()] == i for m, i in zip(marks, names.tolist())])
                if not new.all():
                    n = int((~new).sum())
                    none = pa.nulls(n, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), none, none, pa.array(names[~new]), pa.array(twins[~new])], names=TREE)
                if not new.any():
                    continue
                labels, marks, names = labels[new], marks[new], pa.array(names[new])
                for t in range(trees):
                    label = np.ascontiguousarray(labels[:, t * depth : (t + 1) * depth]).view(np.uint8).reshape(len(labels), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(labels), t, np.int32)), _binary(label), _binary(marks), names, pa.nulls(len(labels), pa.int64())], names=TREE)

    plain = words_of("text")
    words = F.when(F.trim(plain) == "", F.col("text").cast("string")).otherwise(plain)
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), words.alias("text")).mapInArrow(run, "tree int, label binary, sketch binary, doc_id bigint, twin bigint")


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(column), -1).view(kind)


def candidates(tree: np.ndarray, label: np.ndarray, first: int, last: int, neighbours: int, region: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), j < i, of rows in sorted order that are candidates, for i from ``first`` to ``last``.

    Right for rows that have ``region`` rows after them or none at all, and
    twice as many before them or all.
    """
    n, depth = label.shape
    if not n:
        return
    same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
    prefix = np.concatenate([[0], np.cumprod(same, axis=1, dtype=np.int8).sum(1)])
    # how many rows share the first d values with a row
    size = np.empty((depth + 1, n), np.int64)
    size[0] = n + region
    for d in range(1, depth + 1):
        run = np.cumsum(prefix < d)
        size[d] = np.bincount(run)[run]
    at = np.arange(first, last)
    long = at[size[depth, at] > region]
    if len(long):
        begun = np.maximum.accumulate(np.where(prefix < depth, np.arange(n), 0))
        head = begun[long]
        yield long[head < long], head[head < long]
    common = np.full(len(at), depth, np.int64)
    for back in range(1, max(region, neighbours + 1)):
        common = np.minimum(common, prefix[at - back + 1])
        live = (common > 0) & (at >= back)
        live &= (back <= neighbours) | (size[common, at] <= region)
        at, common = at[live], common[live]
        if not len(at):
            break
        yield at, at - back


def edges(rows: DataFrame, threshold: float, neighbours: int, region: int) -> DataFrame:
    """Pairs (a < b) of documents that are candidates in some tree and alike. The scan streams: it holds a batch and a few regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0
        for batch in chain(batches, (None,)):
            if batch is not None:
                twins = batch.filter(pc.less(batch.column(0), 0))
                if twins.num_rows:
                    pair = np.stack([twins.column(3).to_numpy(zero_copy_only=False), twins.column(4).to_numpy(zero_copy_only=False)], 1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair.min(1)), pa.array(pair.max(1))], names=["a", "b"])
                    batch = batch.filter(pc.greater_equal(batch.column(0), 0))
                if not batch.num_rows:
                    continue
                now = (batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), "<u4"), _matrix(batch.column(2), "<u8"), batch.column(3).to_numpy(zero_copy_only=False))
                held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            if held is None:
                continue
            tree, label, mark, ids = held
            last = len(ids) if batch is None else len(ids) - region
            if last <= done:
                continue
            lows, highs = [], []
            for i, j in candidates(tree, label, done, last, neighbours, region):
                near = likeness(mark[i], mark[j]) >= threshold
                a, b = ids[i[near]], ids[j[near]]
                lows.append(np.minimum(a, b))
                highs.append(np.maximum(a, b))
            keep = max(0, last - 2 * region)
            held, done = tuple(x[keep:].copy() for x in held), last - keep
            if lows:
                low, high = np.concatenate(lows), np.concatenate(highs)
                pairs = np.unique(np.stack([low, high], 1)[low != high], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    head = F.coalesce(F.substring("label", 1, 4), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 4).cast("binary"))
    cut = rows.withColumn("head", head).repartition("tree", "head").sortWithinPartitions("tree", "label", "doc_id")
    return cut.select(*TREE).mapInArrow(run, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node it is connected with.

    Alternates the large-star and small-star steps. The smallest neighbour of a
    node comes from partial minima and is joined back, so that no task sorts
    all neighbours of a large group's root; the rounds grow with the logarithm
    of the longest path.
    """
    pairs, seen = materialise(pairs.select("a", "b"), "edges"), None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = materialise(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "stars")
        # every (u, v) here has v < u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).filter("a < b").distinct()
        before, pairs = pairs, materialise(small.select("a", "b"), "edges")
        discard(before)
        discard(large)
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    nodes = pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.45, trees: int = 12, depth: int = 8, shingle: int = 3, neighbours: int = 4, seed: int = 7, region: int = 32) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near duplicate; group_id is the group's smallest doc_id, which is kept."""
    found = components(edges(forest(docs, trees, depth, shingle, seed), threshold, neighbours, region))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group.

    Of rows that repeat a doc_id the one with the smallest text stays; rows
    without a doc_id all stay.
    """
    mark, order = fresh(docs.columns, "id"), fresh([*docs.columns], "order")
    gone = materialise(near_duplicates(docs, **options).filter("NOT keep").select(F.col("doc_id").alias(mark)), "gone")
    kept = docs.join(gone, docs["doc_id"].cast("bigint") == gone[mark], "left_anti")
    again = materialise(docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias(mark)).count().filter("count > 1").select(mark), "again")
    if again.isEmpty():
        return kept
    single = kept.join(again, kept["doc_id"].cast("bigint") == again[mark], "left_anti")
    several = kept.join(again, kept["doc_id"].cast("bigint") == again[mark], "left_semi")
    first = Window.partitionBy(several["doc_id"].cast("bigint")).orderBy(F.col("text").asc_nulls_last())
    return single.unionByName(several.withColumn(order, F.row_number().over(first)).filter(F.col(order) == 1).drop(order))
