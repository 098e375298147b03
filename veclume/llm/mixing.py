"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the number of times it is to be seen. Among all rates
whose tokens fall to the sources as the targets say, and whose mean log length
(over tokens) stays that of the corpus, the ones nearest to 1 in relative
entropy are exponential tilts: ``rate = exp(lam[source] + gamma * z)``, ``z``
being the standardised log length. The multipliers minimise a convex dual, found
by damped Newton steps on all of them together. Its Hessian is an arrow, diagonal
in the sources with one row and column for the length, so a step needs a handful
of sums over the sources: the multipliers are a table, each evaluation is an
aggregation over the corpus' cells (source, length, number), and the driver sees
one row of sums however many sources there are. Rates become whole copies by
adding a uniform number drawn from the row's hash and cutting off the fraction,
so the expectation is exact and a rerun gives the same copies.

Tokens are those of a ``tokenizer``, counted where the text lies; or what a
column of ``lengths`` says; else words between white space.

Cases: a null source is a source of its own; a source with no tokens can't be
weighted, and its documents get rate 0, as does a source whose target is 0 or
missing from given targets; a null or blank text has 0 tokens and its source's
rate at that length; a very long text is a cell of its own; rows that are wholly
alike share a draw, but not their number of rows; documents of one source and
length tie in rate and differ by draw; no tokens at all leave every document
once; an empty table stays empty; other columns come along whatever their names.
``slack`` softens the length condition, so that the dual has a minimum when all
lengths are alike. Where the sources' lengths can't meet the length condition (a
few tiny texts against huge ones) ``gamma`` stops at ``steepest`` either way, as
it may after ``rounds`` steps, and a warning says so; the tokens of the sources
are as asked for all the same, the mean log length isn't.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.llm.shared import discard, fresh, materialise, text_batches, word_count
from veclume.llm.tokens import token_lengths

#: The table of multipliers, one row a source, is broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_SOURCES = 200_000


def _key(column: str = "source") -> Column:
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def _small(table: DataFrame, rows: int) -> DataFrame:
    # this side has a row a source; without the hint Spark may send the other one
    return F.broadcast(table) if rows <= BROADCAST_SOURCES else table


def solve(cells: DataFrame, state: DataFrame, sources: int, total: float, middle: float, spread: float, slack: float, tolerance: float, rounds: int, steepest: float) -> tuple[DataFrame, float, int, float]:
    """(key, lam) of the sources, the length's multiplier, the steps taken, and how far off the conditions were then.

    ``cells`` has (key, t, n): n documents of t tokens. ``state`` has (key, want, lam): the tokens wanted of a source and where to begin.
    """
    z = (F.log1p("t") - F.lit(middle)) / F.lit(spread)

    def evaluate(at: DataFrame, gamma: float) -> tuple[DataFrame, dict]:
        mass = F.col("n") * F.col("t") * F.exp(F.col("lam") + F.lit(float(gamma)) * z)
        sums = cells.join(_small(at.select("key", "lam"), sources), "key").groupBy("key").agg(F.sum(mass).alias("a"), F.sum(mass * z).alias("b"), F.sum(mass * z * z).alias("c"))
        return summed(at.select("key", "want", "lam").join(_small(sums, sources), "key"), gamma)

    def summed(sums: DataFrame, gamma: float) -> tuple[DataFrame, dict]:
        held = materialise(sums, "multipliers")
        g = F.col("a") - F.col("want")
        row = held.agg(
            F.sum("a").alias("a"), F.sum(F.col("lam") * F.col("want")).alias("lw"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.min("a").alias("least"),
            F.sum(F.col("b") * F.col("b") / F.col("a")).alias("bb"), F.sum(F.col("b") * g / F.col("a")).alias("bg"), F.sum(g * g / F.col("a")).alias("gg"),
            F.max(F.abs(g) / F.col("want")).alias("off"), F.max(F.abs(g) / F.col("a")).alias("most_g"), F.max(F.abs(F.col("b")) / F.col("a")).alias("most_b"),
        ).first().asDict()
        row["value"] = row["a"] - row["lw"] + slack * total * gamma * gamma / 2
        row["slope"] = row["b"] + slack * total * gamma
        return held, row

    gamma, steps = 0.0, 0
    now, s = evaluate(state, gamma)
    while True:
        off = max(s["off"], abs(s["slope"]) / total)
        if off < tolerance or steps == rounds or abs(gamma) >= steepest:
            break
        if s["off"] > 1:
            # far from the targets steps on an exponential are short, but for this gamma the best lam is known outright
            scale = F.col("want") / F.col("a")
            centred, s = summed(now.select("key", "want", (F.col("lam") + F.log(scale)).alias("lam"), F.col("want").alias("a"), (F.col("b") * scale).alias("b"), (F.col("c") * scale).alias("c")), gamma)
            discard(now)
            now = centred
        dg = -(s["slope"] - s["bg"]) / (s["c"] + slack * total - s["bb"])
        descent = -s["gg"] - dg * s["bg"] + s["slope"] * dg
        size = min(1.0, (steepest - math.copysign(gamma, gamma * dg)) / max(1e-12, abs(dg)))
        size, moved = min(size, 500.0 / max(1e-12, s["most_g"] + s["most_b"] * abs(dg))), False
        while not moved and size >= 1e-9:
            dl = -((F.col("a") - F.col("want")) + F.col("b") * F.lit(dg)) / F.col("a")
            then, t = evaluate(now.select("key", "want", (F.col("lam") + F.lit(size) * dl).alias("lam")), gamma + size * dg)
            # an overflow compares as false
            moved = t["least"] > 0 and t["value"] <= s["value"] + 1e-4 * size * descent + 1e-9 * abs(s["value"])
            if moved:
                discard(now)
                now, s, gamma, steps = then, t, gamma + size * dg, steps + 1
            else:
                discard(then)
                size /= 2
        if not moved:
            break
    # what is left of the sources' conditions is set right outright
    lam = materialise(now.select("key", F.round(F.col("lam") + F.log(F.col("want") / F.col("a")), 9).alias("lam")), "multipliers")
    discard(now)
    return lam, round(gamma, 9), steps, off


def mix_rates(
    docs: DataFrame, targets: dict[str | None, float] | None = None, exponent: float = 0.5, tokens: float | None = None, seed: int = 11, slack: float = 1e-4, tolerance: float = 1e-9, rounds: int = 50, steepest: float = 16.0, lengths: str | None = None, tokenizer: str | None = None, keep: list[str] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (of its columns those to ``keep``, else all) with the number of tokens, the rate and the copies of each row, and the names of these three columns.

    ``tokenizer`` is a vocabulary file to count tokens with, ``lengths`` a column
    of ``docs`` with counts; with neither, words between white space are counted.

    ``targets`` are the sources' shares of tokens, scaled to sum to 1; left out,
    they are the shares of the corpus raised to ``exponent``. ``tokens`` is the
    size of the mixture, that of the corpus if left out.
    """
    spark = docs.sparkSession
    names = {k: fresh(docs.columns, k) for k in ("tokens", "rate", "copies", "key", "lam", "draw")}
    if lengths is not None:
        length = F.coalesce(F.col(lengths).cast("bigint"), F.lit(0))
    elif tokenizer is not None:
        text_batches(spark)
        length = F.coalesce(token_lengths(tokenizer)("text").cast("bigint"), F.lit(0))
    else:
        length = word_count()
    draw = F.expr(f"shiftrightunsigned(xxhash64({seed}, doc_id, text), 11)") / F.lit(float(1 << 53))
    rows = docs.select(*(docs.columns if keep is None else keep), length.alias(names["tokens"]), _key().alias(names["key"]), draw.alias(names["draw"]))
    if tokenizer is not None:
        rows = materialise(rows, "counted")  # so that texts are encoded once
    cells = materialise(rows.select(F.col(names["key"]).alias("key"), F.col(names["tokens"]).alias("t")).groupBy("key", "t").agg(F.count("*").alias("n")), "cells")
    w = F.col("n") * F.col("t")
    per = materialise(cells.groupBy("key").agg(F.sum(w).alias("w"), F.sum(w * F.log1p("t")).alias("m"), F.sum(w * F.log1p("t") ** 2).alias("v")), "sources")
    live = per.filter("w > 0")
    if targets is None:
        wanted = live.withColumn("weight", F.col("w").cast("double") ** F.lit(exponent))
    else:
        given = spark.createDataFrame([("-" if k is None else f"={k}", float(x)) for k, x in targets.items()], "key string, weight double")
        wanted = live.join(_small(given, len(targets)), "key").filter("weight > 0")
    size = live.agg(F.sum("w"), F.sum("m"), F.sum("v")).first()
    whole, sources = wanted.agg(F.sum("weight"), F.count("*")).first()
    if not whole:
        # nothing to weight: all stay where there are no tokens at all, and none where no target is met
        lam, gamma, middle, spread, sources = per.select("key", F.lit(None if size[0] else 0.0).cast("double").alias("lam")), 0.0, 0.0, 1.0, per.count()
    else:
        total = float(tokens or size[0])
        middle = size[1] / size[0]
        spread = math.sqrt(max(0.0, size[2] / size[0] - middle * middle)) or 1.0
        want = F.col("weight") / F.lit(float(whole)) * F.lit(total)
        state = wanted.select("key", want.alias("want"), F.log(want / F.col("w")).alias("lam"))
        lam, gamma, steps, off = solve(cells.filter("t > 0"), state, sources, total, middle, spread, slack, tolerance, rounds, steepest)
        if off >= tolerance:
            warnings.warn(f"the mixture's conditions are off by {off:.1e} after {steps} Newton steps", stacklevel=2)
    discard(cells)
    table = _small(lam.select(F.col("key").alias(names["key"]), F.col("lam").alias(names["lam"])), sources)
    t, rate = F.col(names["tokens"]), F.col(names["rate"])
    z = (F.log1p(t) - F.lit(middle)) / F.lit(spread)
    out = rows.join(table, names["key"], "left")
    out = out.withColumn(names["rate"], F.coalesce(F.exp(F.col(names["lam"]) + F.lit(gamma) * z), F.lit(0.0)))
    out = out.withColumn(names["copies"], F.floor(rate + F.col(names["draw"])).cast("int")).drop(names["key"], names["lam"], names["draw"])
    return out, names


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, tokens, rate, copies), a row for every row of ``docs``."""
    out, names = mix_rates(docs, keep=["doc_id", "source"], **options)
    return out.select("doc_id", "source", F.col(names["tokens"]).alias("tokens"), F.round(names["rate"], 9).alias("rate"), F.col(names["copies"]).alias("copies"))


def apply_mixture(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as its copies say."""
    out, names = mix_rates(docs, **options)
    extra = fresh(out.columns, "copy")
    return out.filter(F.col(names["copies"]) > 0).withColumn(extra, F.explode(F.expr(f"sequence(1, `{names['copies']}`)"))).select(*docs.columns)
