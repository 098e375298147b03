"""Preference formatting: one prompt for a chosen and a rejected conversation, and their completions with loss masks.

The longest common prefix of turns of the two is rendered once, as the prompt;
what follows is the completion of each. A turn is rendered as
``<|im_start|>role\\ntext<|im_end|>\\n``. A completion's mask is the list of its
spans that are trained on, in characters: what the assistant says, with the end
mark. Everything else of it (other roles, headers) is masked, as is the prompt.
A role or text that has one of the two marks in it is rendered with a blank
before the mark's ``|>``, so that no words can open or end a turn.

Cases: turns are equal if role and text are, nulls being equal to each other; a
null role is rendered as ``user`` and a null text as empty; if one conversation
begins the other, its completion is empty; alike conversations express no
preference and give no row; a null or empty conversation has no turns; a very
long text is rendered whole; a null id stays null; repeated pairs are all
formatted; an empty table gives no rows; other columns, whatever their names,
aren't read; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
IGNORED = -100


def _plain(part: str) -> str:
    """A role or text in which the marks of turns are no marks any more."""
    for mark in (OPEN, CLOSE):
        part = f"replace({part}, '{mark}', '{mark[:-2]} |>')"
    return part


def _rendered(turns: str) -> str:
    return f"transform({turns}, t -> concat('{OPEN}', coalesce(t.role, 'user'), '\\n', coalesce(t.text, ''), '{CLOSE}\\n'))"


def _spans(turns: str) -> str:
    """Character spans of the assistant's words, from one pass over the turns."""
    head = f"s.at + {len(OPEN)} + length(coalesce(t.role, 'user')) + 1"
    end = f"{head} + length(coalesce(t.text, '')) + {len(CLOSE)}"
    return (
        f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)), (s, t) -> named_struct('at', {end} + 1, "
        f"'spans', if(t.role <=> 'assistant', concat(s.spans, array(named_struct('start', {head}, 'end', {end}))), s.spans)), s -> s.spans)"
    )


def format_preferences(pairs: DataFrame, pair_id: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) of conversations given as arrays of (role, text)."""
    p = pairs.select(F.col(pair_id).alias("pair_id"), *(F.coalesce(F.col(c).cast(TURNS), F.expr(f"cast(array() as {TURNS})")).alias(n) for c, n in ((chosen, "c"), (rejected, "r"))))
    apart = "filter(sequence(0, least(size(c), size(r))), i -> i = least(size(c), size(r)) OR NOT (get(c, i) <=> get(r, i)))[0]"
    p = p.withColumn("n", F.expr(apart)).filter("n < greatest(size(c), size(r))")
    plain = lambda turns: F.expr(f"transform({turns}, t -> named_struct('role', {_plain('t.role')}, 'text', {_plain('t.text')}))")
    p = p.select("pair_id", "n", plain("slice(c, 1, n)").alias("same"), plain("slice(c, n + 1, size(c))").alias("c"), plain("slice(r, n + 1, size(r))").alias("r"))
    whole = lambda turns, name: F.expr(f"array_join({_rendered(turns)}, '')").alias(name)
    return p.select(
        "pair_id", F.col("n").alias("prompt_turns"), whole("same", "prompt"), whole("c", "chosen"), whole("r", "rejected"), F.expr(_spans("c")).alias("chosen_spans"), F.expr(_spans("r")).alias("rejected_spans")
    )


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order; equal turn numbers go by role and text, nulls first. A null conv_id names none."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.expr("transform(t, x -> named_struct('role', x.role, 'text', x.text))").alias("turns"))


def stale_reply_pairs(rows: DataFrame) -> DataFrame:
    """Pairs from plain conversations, for want of judged ones.

    Chosen is the conversation up to its last assistant turn. In rejected that
    turn repeats the assistant's first reply, or, where that is no other text,
    echoes the turn before. Conversations without an assistant give no pair.
    """
    c = conversations(rows).withColumn("last", F.expr("array_max(filter(sequence(1, size(turns)), i -> turns[i - 1].role <=> 'assistant'))")).filter("last IS NOT NULL")
    first = "filter(turns, t -> t.role <=> 'assistant')[0].text"
    reply = f"if({first} <=> turns[last - 1].text, if(last > 1, turns[last - 2].text, ''), {first})"
    return c.select(F.col("conv_id").alias("pair_id"), F.expr("slice(turns, 1, last)").alias("chosen"), F.expr(f"concat(slice(turns, 1, last - 1), array(named_struct('role', 'assistant', 'text', {reply})))").alias("rejected"))


def spans_text(column: str):
    """Spans as text, ``start:end`` with commas between."""
    return F.expr(f"array_join(transform({column}, s -> concat(s.start, ':', s.end)), ',')")


def encode_preferences(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """(pair_id, prompt_ids, chosen_ids, chosen_labels, rejected_ids, rejected_labels).

    Completions are encoded span by span, so no token crosses a mask's edge;
    labels repeat the ids where they are trained on and are -100 elsewhere.
    """
    from veclume.llm.tokens import open_tokenizer

    def cut(text: str, spans: list[dict]) -> list[tuple[str, bool]]:
        out, at = [], 0
        for s in spans:
            out += [(text[at : s["start"]], False), (text[s["start"] : s["end"]], True)]
            at = s["end"]
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = open_tokenizer(tokenizer)
        for batch in batches:
            got: dict[str, list] = {k: [] for k in ("prompt_ids", "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels")}
            for prompt, c, r, cs, rs in zip(*(batch.column(k).to_pylist() for k in ("prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"))):
                got["prompt_ids"].append(encode([prompt])[0])
                for name, text, spans in (("chosen", c, cs), ("rejected", r, rs)):
                    parts = cut(text, spans)
                    ids = encode([x for x, _ in parts]) if parts else []
                    got[f"{name}_ids"].append([i for part in ids for i in part])
                    got[f"{name}_labels"].append([i if on else IGNORED for part, (_, on) in zip(ids, parts) for i in part])
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), *(pa.array(v, pa.list_(pa.int32())) for v in got.values())], names=["pair_id", *got])

    kind = formatted.schema["pair_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"pair_id {kind}, prompt_ids array<int>, chosen_ids array<int>, chosen_labels array<int>, rejected_ids array<int>, rejected_labels array<int>")
