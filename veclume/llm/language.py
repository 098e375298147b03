"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A
document is parsed against each: a phrase is the longest stretch, from where the
last one ended, that occurs anywhere in the labelled text. The fewer phrases,
normalised by what naming a place in the labelled text costs and by the length
of the document, the closer the language: ``bits = phrases * log2(n) / chars``.

Text is read as lower-case letters with single spaces between words. All
documents of a batch are parsed side by side, one character a step, for all
languages at once; the automata are laid out as one table of transitions that
also says how many phrases a step ends.

Cases: a null or empty text or one without letters has no language and is
rejected; a very long one is parsed to its end; repeated rows are all reported;
an empty table gives no rows; other columns come along whatever their names; one
of ``judge_chars`` or more that costs over ``max_bits`` a character in every
language is rejected as none of them, keeping its nearest language; shorter ones
are accepted. Equal costs go to the label that sorts first. Letters no label has
seen are phrases of their own. A null label is never learnt from; a null doc_id
stays null. With no labelled text at all every document is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veclume.llm.shared import fresh, pieces, text_batches, utf8

_READY: dict[tuple, Automata] = {}
_TILE = 64
#: Bytes of text parsed side by side, and documents too few for that.
_SIDE, _FEW = 12 << 20, 16
TYPE = "struct<language string, phrases int, chars int, bits double, accepted boolean>"


def suffix_automaton(codes: list[int], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The automaton of all factors of ``codes``, which are below ``width``: the number of states, and its transitions as ``state * width + code`` and next state. State 0 is the empty factor."""
    nexts: dict[int, int] = {}
    length, link, last = [0], [-1], 0
    for c in codes:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and p * width + c not in nexts:
            nexts[p * width + c] = now
            p = link[p]
        if p >= 0:
            q = nexts[p * width + c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(length)
                for k in range(width):
                    t = nexts.get(q * width + k)
                    if t is not None:
                        nexts[copy * width + k] = t
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts.get(p * width + c) == q:
                    nexts[p * width + c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return len(length), np.fromiter(nexts.keys(), np.int64, len(nexts)), np.fromiter(nexts.values(), np.int64, len(nexts))


def letters(text: str) -> str:
    """The text as it is parsed: lower-case letters, words between single spaces, a space at either end."""
    out = "".join(_lower(c) if c.isalpha() else " " for c in text)
    return f" {' '.join(out.split())} " if out.strip() else ""


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


class Automata:
    """The labelled text of all languages as one table of transitions.

    An entry holds the row of the next state times four, plus the phrases that
    end on the way: one if the character can't be appended, one more if it
    occurs nowhere.
    """

    def __init__(self, learnt: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in learnt]
        parsed = [letters(text) for _, text in learnt]
        self.lengths = [max(2, len(x)) for x in parsed]
        alphabet = sorted(set("".join(parsed)) | {" "})
        self.codes = {c: k + 2 for k, c in enumerate(alphabet)}  # 0 ends a document, 1 is any other letter
        width = self.width = len(alphabet) + 2
        kind = np.int32 if (2 * sum(self.lengths) + 8) * width * 4 < 1 << 31 else np.int64
        rows, self.roots = [np.zeros(width, kind)], []
        base = 1
        for x in parsed:
            states, at, to = suffix_automaton([self.codes[c] for c in x], width)
            root = np.full(width, -1, np.int64)
            root[at[at < width]] = to[at < width]
            missed = np.where(root >= 0, (root + base) * width * 4 + 1, base * width * 4 + 2).astype(kind)
            full = np.tile(missed, states)
            full[at] = (to + base) * width * 4
            full[:width] = np.where(root >= 0, (root + base) * width * 4, base * width * 4 + 1)
            full[::width] = 1  # the phrase that was begun
            full[0] = 0
            rows.append(full)
            self.roots.append(base * width)
            base += states
        self.table = np.concatenate(rows)
        self.classes = np.empty(0x10000, np.uint8 if width < 256 else np.uint16)
        self.classes[:] = [self._code(chr(c)) if not 0xD800 <= c < 0xE000 else 2 for c in range(0x10000)]
        self.space = self.codes[" "]

    def _code(self, c: str) -> int:
        return self.codes.get(_lower(c), 1) if c.isalpha() else self.codes[" "]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of consecutive documents and how many each has."""
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = heads[offsets]
        codes = self.classes[np.minimum(points, 0xFFFF)]  # one byte where the alphabet allows
        for far in np.flatnonzero(points > 0xFFFF):
            codes[far] = self._code(chr(points[far]))
        docs = len(at) - 1
        codes = np.insert(codes, np.concatenate([at[:-1], at[1:]]), self.space)
        # a space came in before and after each document
        at = at + 2 * np.arange(docs + 1)
        blank = codes == self.space
        after = np.zeros(len(codes), bool)
        after[1:] = blank[:-1]
        after[at[:-1]] = False
        keep = ~(blank & after)
        sizes = np.concatenate([[0], np.cumsum(keep)])[at]
        return codes[keep], np.diff(sizes)

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each document in each language, (languages, documents). ``codes`` end in a 0 of their own."""
        docs = len(sizes)
        order = np.argsort(-sizes, kind="stable")
        long = sizes[order]
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
        state = np.repeat(np.array(self.roots, self.table.dtype)[:, None], docs, 1)
        total = np.zeros((len(self.roots), docs), np.int32)
        at, steps = 0, np.arange(_TILE)
        while True:
            live = int(np.searchsorted(-long, -at, side="right"))  # documents with at characters or more: their end is a step too
            if live <= _FEW:
                break
            state, where = state[:, :live], start[:live, None] + at + steps
            beyond = (at + steps)[None, :] >= long[:live, None]
            where[beyond] = len(codes) - 1
            tile = np.ascontiguousarray(codes[where].T).astype(self.table.dtype)
            count = total[:, :live]
            for row in tile:
                v = self.table.take(state + row)
                count += v & 3
                state = v >> 2
            at += _TILE
        # the last few documents are too narrow for steps side by side
        table = memoryview(self.table)
        for d in range(live):
            rest = codes[start[d] + at : start[d] + long[d]].tolist()
            for lang in range(len(self.roots)):
                s, n = int(state[lang, d]), 0
                for c in rest:
                    v = table[s + c]
                    n += v & 3
                    s = v >> 2
                total[lang, d] += n + (table[s] & 3)
        out = np.empty_like(total)
        out[:, order] = total
        return out

    def identify(self, texts: pa.Array, judge_chars: int, max_bits: float) -> pa.StructArray:
        raw, offsets = utf8(texts)
        n, counted, found = len(texts), [np.zeros(0, np.int64)], [np.zeros((len(self.names), 0), np.int32)]
        for lo, hi in pieces(offsets, _SIDE):
            at = offsets[lo : hi + 1]
            parts = [self.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in pieces(at - at[0])]
            counted += [p[1] for p in parts]
            if self.names:
                found.append(self.phrases(np.concatenate([*(p[0] for p in parts), np.zeros(1, self.classes.dtype)]), np.concatenate([p[1] for p in parts])))
        sizes = np.concatenate(counted)
        if self.names and n:
            found = np.concatenate(found, axis=1)
            cost = found * np.log2(self.lengths)[:, None]
            best = cost.argmin(axis=0)
            counts = found[best, np.arange(n)]
            bits = cost[best, np.arange(n)] / np.maximum(sizes, 1)
        else:
            best, counts, bits = np.zeros(n, int), np.zeros(n, int), np.zeros(n)
        known = (sizes > 1) & bool(self.names)
        accepted = known & ((sizes < judge_chars) | (bits <= max_bits))
        names = np.array([*self.names, None], object)[np.where(known, best, len(self.names))]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(known, counts, 0).astype(np.int32)), pa.array(np.where(known, sizes, 0).astype(np.int32)), pa.array(np.round(np.where(known, bits, 0.0), 6)), pa.array(accepted)],
            names=["language", "phrases", "chars", "bits", "accepted"],
        )


def learn(labelled: DataFrame, label: str = "lang", text: str = "text", train_docs: int = 64, train_chars: int = 20_000, doc_chars: int = 2_000) -> tuple[tuple[str, str], ...]:
    """The labelled text of each language: at most ``train_chars`` characters of the ``train_docs`` documents whose hashes are smallest, and of each ``doc_chars``, so that no long one makes up the sample.

    These are the bounds of the classifier's labelled sample; nothing else here is
    bounded. The set of labels is taken to be small.
    """
    some = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).filter("label IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    ranked = some.select("label", "h").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("r") <= train_docs)
    chosen = ranked.select("label", "h").distinct()
    rows = some.join(F.broadcast(chosen), ["label", "h"], "left_semi").groupBy("label", "h").agg(F.min(F.substring("text", 1, doc_chars)).alias("text")).orderBy("label", "h").collect()
    learnt: dict[str, str] = {}
    for r in rows:
        learnt[r.label] = (learnt.get(r.label, "") + " " + r.text)[: train_chars + 1]
    return tuple((k, v) for k, v in sorted(learnt.items()) if letters(v))


def identifier(learnt: tuple[tuple[str, str], ...], judge_chars: int = 100, max_bits: float = 4.5):
    """A column function: text -> struct(language, phrases, chars, bits, accepted). Each Python worker builds the automata once, from the labelled text."""

    def run(texts: pa.Array) -> pa.Array:
        if learnt not in _READY:
            _READY.clear()
            _READY[learnt] = Automata(learnt)
        return _READY[learnt].identify(texts, judge_chars, max_bits)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # else a filter on the result would run it once more
    return F.arrow_udf(run, TYPE).asNondeterministic()


def identify_languages(docs: DataFrame, labelled: DataFrame | None = None, judge_chars: int = 100, max_bits: float = 4.5, **bounds) -> DataFrame:
    """(doc_id, language, phrases, chars, bits, accepted), a row for every document."""
    text_batches(docs.sparkSession)
    of = identifier(learn(docs if labelled is None else labelled, **bounds), judge_chars, max_bits)
    return docs.select("doc_id", of(F.col("text").cast("string")).alias("r")).select("doc_id", "r.*")


def keep_identified(docs: DataFrame, labelled: DataFrame | None = None, judge_chars: int = 100, max_bits: float = 4.5, **bounds) -> DataFrame:
    """The documents that are accepted, with ``lang`` set to the language found."""
    text_batches(docs.sparkSession)
    of = identifier(learn(docs if labelled is None else labelled, **bounds), judge_chars, max_bits)
    found = fresh(docs.columns, "found")
    marked = docs.withColumn(found, of(F.col("text").cast("string"))).filter(F.col(f"{found}.accepted"))
    return marked.withColumn("lang", F.col(f"{found}.language")).select(*docs.columns)
