"""Hierarchical packing into windows of several lengths.

A document goes to the shortest tier whose window holds it; one that is longer
than the longest window is cut into full windows and a rest, which is routed
like a document. The longest tier is packed first, best fit by decreasing
length; what gaps its windows have left are filled, again longest first and best
fit, from the next shorter tier down; then the next tier is packed with what
remains. The windows of a tier are dealt to steps of ``step_tokens`` each in
turns, back and forth by attention cost, so that the steps of a tier have nearly
the same number of windows and cost.

Which lengths share a window depends on how many pieces have each length and on
nothing else. So the driver packs the histogram of lengths, which has no more
rows than the longest window has tokens however large the corpus is: ``plan``
gives patterns of lengths with the number of windows of each. The pieces of a
length are numbered in the cluster and their numbers look up window and step. The
whole corpus is packed as one, and a packing doesn't depend on how the table is
partitioned.

Lengths and offsets are in tokens of a ``tokenizer``, as ``tokens`` counts them
(of the text with ``\\n`` as line ends and no white space at its ends), encoded
where the text lies; with a ``cache`` they come from there. Without a tokenizer
words between white space stand for tokens; a word is 2.3 to 3 tokens in the
texts at hand, and a text without white space is one word, so such windows are
for what counts words only.

Cases: a null or blank text has no tokens and is in no window; a very long text
becomes many pieces; a null doc_id is packed as null; repeated rows are packed
as often as they come, and as pieces of one length with one doc_id have adjacent
numbers, copies go to different windows unless a pattern has only one; ties in
length go by the hash of the doc_id, then doc_id and offset; other columns,
whatever their names, aren't read; ids are whole numbers, and one that can't be
cast to BIGINT ends the job. An empty table gives no windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veclume.llm.shared import materialise, text_batches, word_count
from veclume.llm.tokens import count_tokens, token_lengths


@dataclass
class Pattern:
    """``many`` windows of one tier that hold the same lengths: ``held`` is (length, how often) in the order placed."""

    tier: int
    many: int
    held: list[tuple[int, int]]
    window: int = 0  # number of the first of them in the tier
    place: int = 0  # and its place in the tier's order of cost

    @property
    def cost(self) -> int:
        return sum(n * n * r for n, r in self.held)


class _Bins:
    """Open windows of one tier, those with equal gap and content counted rather than listed."""

    def __init__(self, size: int):
        self.size, self.gaps, self.at = size, [], defaultdict(list)

    def _put(self, gap: int, many: int, held: tuple) -> None:
        if not many:
            return
        if not self.at[gap]:
            insort(self.gaps, gap)
        self.at[gap].append((many, held))

    def place(self, length: int, n: int, new: bool) -> int:
        """Put ``n`` pieces into the fullest windows that they fit, and the rest into new ones where that is allowed; how many are left."""
        while n:
            k = bisect_left(self.gaps, length)
            if k < len(self.gaps):
                gap = self.gaps[k]
                many, held = self.at[gap].pop()
                if not self.at[gap]:
                    self.gaps.pop(k)
            elif new:
                gap, many, held = self.size, n, None
            else:
                break
            # the fullest window stays the fullest while it takes more of the same
            each = gap // length
            full = min(many, n // each)
            self._put(gap - each * length, full, (held, length, each))
            n -= full * each
            some = n if full < many and n < each else 0
            if some:
                self._put(gap - some * length, 1, (held, length, some))
                n = 0
            if gap < self.size or held is not None:
                self._put(gap, many - full - bool(some), held)
        return n

    def patterns(self) -> list[Pattern]:
        out = []
        for gap in self.gaps:
            for many, held in self.at[gap]:
                items: list[tuple[int, int]] = []
                while held is not None:
                    held, length, each = held
                    items.append((length, each))
                out.append(Pattern(self.size, many, items[::-1]))
        return out


def plan(counts: dict[int, int], tiers: tuple[int, ...]) -> list[Pattern]:
    """Patterns of windows that hold ``counts[length]`` pieces of each length, none above the longest tier."""
    tiers, left, out = tuple(sorted(tiers)), dict(counts), []
    pools: list[list[int]] = [[] for _ in tiers]
    for length in sorted(left, reverse=True):
        pools[bisect_left(tiers, length)].append(length)
    for k in range(len(tiers) - 1, -1, -1):
        bins = _Bins(tiers[k])
        for lower in range(k, -1, -1):
            for length in pools[lower]:
                left[length] = bins.place(length, left[length], lower == k)
        found = bins.patterns()
        window = place = 0
        for p in found:
            p.window, window = window, window + p.many
        for p in sorted(found, key=lambda p: (-p.cost, p.window)):
            p.place, place = place, place + p.many
        out += found
    return out


def steps_of(patterns: list[Pattern], step_tokens: int) -> dict[int, int]:
    """How many steps each tier's windows are dealt to."""
    windows: Counter[int] = Counter()
    for p in patterns:
        windows[p.tier] += p.many
    return {tier: -(-n * tier // step_tokens) for tier, n in windows.items()}


class Slots:
    """Where the pieces of each length go: piece number x of a length -> tier, window, step."""

    def __init__(self, patterns: list[Pattern], step_tokens: int):
        steps, taken, rows = steps_of(patterns, step_tokens), Counter(), []
        for p in patterns:
            for length, each in p.held:
                rows.append((length, taken[length], p.tier, p.window, p.many, p.place, steps[p.tier]))
                taken[length] += each * p.many
        rows.sort()
        self.length, self.first, self.tier, self.window, self.many, self.place, self.steps = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 7))
        self.key = (self.length << 44) + self.first

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + number, side="right") - 1
        # neighbours in number go to different windows
        i = (number - self.first[at]) % self.many[at]
        turn, step = np.divmod(self.place[at] + i, self.steps[at])
        return self.tier[at], self.window[at] + i, np.where(turn % 2 == 0, step, self.steps[at] - 1 - step)


def pack(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...], step_tokens: int) -> list[tuple]:
    """Windows (tier, number, step, tokens, cost, pieces) of pieces (length, id, offset), in one process."""
    pieces = sorted(pieces, key=lambda p: (-p[0], p[1:]))
    length, seen = np.array([p[0] for p in pieces], np.int64), Counter()
    number = np.zeros(len(pieces), np.int64)
    for k, p in enumerate(pieces):
        number[k], seen[p[0]] = seen[p[0]], seen[p[0]] + 1
    held = defaultdict(list)
    if pieces:
        for key, p in zip(zip(*(c.tolist() for c in Slots(plan(seen, tiers), step_tokens).find(length, number))), pieces):
            held[key].append(p)
    return [(*key, sum(p[0] for p in b), sum(p[0] ** 2 for p in b), b) for key, b in sorted(held.items(), key=lambda x: (-x[0][0], x[0][1]))]


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = (2048, 8192, 32768), step_tokens: int = 262_144, tokenizer: str | None = None, cache: str | None = None, salts: int = 256) -> DataFrame:
    """One row for each window: its tier (length), number and step, its tokens and attention cost, and the pieces it holds, longest first.

    ``tokenizer`` is a vocabulary file and ``cache`` a folder of stored counts, as
    ``count_tokens`` takes them; without a tokenizer words are counted. Pieces of
    one length are numbered by so many tasks as there are ``salts``.
    """
    if not tiers or min(tiers) < 1 or step_tokens < max(tiers):
        raise ValueError("windows need at least a token, and a step at least the longest window")
    most = max(tiers)
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    text_batches(docs.sparkSession)
    if tokenizer is None:
        sized = docs.select(doc_id, word_count().cast("int").alias("n"))
    elif cache is None:
        sized = docs.select(doc_id, token_lengths(tokenizer)("text").alias("n"))
    else:
        sized = count_tokens(docs, tokenizer, cache).select("doc_id", F.col("n_tokens").alias("n"))
    sized = materialise(sized, "lengths").filter("n > 0").withColumn("h", F.xxhash64("doc_id"))
    pieces = sized.select("doc_id", "h", F.pmod("h", F.lit(salts)).cast("int").alias("salt"), "n", F.explode(F.expr(f"sequence(0, n - 1, {most})")).alias("offset")).withColumn("length", F.least(F.lit(most), F.col("n") - F.col("offset"))).drop("n")

    counts = materialise(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    slots = Slots(plan({r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, tiers), step_tokens)
    # the pieces of a length are numbered salt by salt
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("h", "doc_id", "offset"))
    numbered = pieces.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("inside") - 1)

    def find(length: pa.Array, number: pa.Array) -> pa.Array:
        tier, window, step = slots.find(length.to_numpy().astype(np.int64), number.to_numpy().astype(np.int64))
        return pa.StructArray.from_arrays([pa.array(tier.astype(np.int32)), pa.array(window), pa.array(step)], names=["tier", "window", "step"])

    find.__annotations__ = {"length": pa.Array, "number": pa.Array, "return": pa.Array}
    where = F.arrow_udf(find, "struct<tier int, window bigint, step bigint>")("length", "number")
    placed = numbered.select(where.alias("at"), "doc_id", "offset", "length").select("at.*", "doc_id", "offset", "length")
    held = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("short"), "doc_id", "offset", "length")))
    windows = placed.groupBy("tier", "window", "step").agg(F.sum("length").cast("int").alias("tokens"), F.sum(F.col("length").cast("bigint") * F.col("length")).alias("cost"), held.alias("held"))
    return windows.select("tier", "window", "step", "tokens", "cost", F.col("held.doc_id").alias("doc_ids"), F.col("held.offset").alias("offsets"), F.col("held.length").alias("lengths"))
