"""Filters, pages and iteration over search results.

Filters come after the search unless ``prefilter`` is used, so a filtered
result may have fewer than k rows. Metadata is JSON text; keys are literal and
top-level, and values are compared with their type.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def _member(metadata: str, name: str) -> Column:
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.try_variant_get(F.try_parse_json(F.col(metadata)), path, "variant")


def has_field(name: str, metadata: str = "metadata") -> Column:
    """The key is there; a JSON null counts."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(metadata))).startswith("OBJECT"), F.lit(False)) & _member(metadata, name).isNotNull()


def metadata_equals(name: str, value, metadata: str = "metadata") -> Column:
    """The key's value is this one, as JSON: 1 isn't 1.0, and the order of keys doesn't matter."""
    member = _member(metadata, name)
    wanted = F.parse_json(F.lit(json.dumps(value)))
    typed = F.schema_of_variant(member) == F.schema_of_variant(wanted)
    return F.coalesce(typed & (F.to_json(member) == F.to_json(wanted)), F.lit(False))


def min_score(least: float, score: str = "score") -> Column:
    """NaN passes, as no comparison says it is less."""
    return F.isnan(score) | ~(F.col(score) < F.lit(float(least)))


@dataclass
class ResultFilter:
    """Predicates that must all hold, and a limit on what is left."""

    predicates: list[Column] = field(default_factory=list)
    limit: int | None = None

    def filter(self, predicate: Column) -> ResultFilter:
        return ResultFilter([*self.predicates, predicate], self.limit)

    def min_score(self, least: float) -> ResultFilter:
        return self.filter(min_score(least))

    def has_metadata_field(self, name: str) -> ResultFilter:
        return self.filter(has_field(name))

    def metadata_equals(self, name: str, value) -> ResultFilter:
        return self.filter(metadata_equals(name, value))

    def max_results(self, n: int) -> ResultFilter:
        return ResultFilter(self.predicates, n)

    def apply(self, results: DataFrame, order: list[Column] | None = None) -> DataFrame:
        for p in self.predicates:
            results = results.filter(p)
        if self.limit is not None:
            results = (results.orderBy(*order) if order else results).limit(self.limit)
        return results

    def prefilter(self, documents: DataFrame) -> DataFrame:
        """The same predicates before the search, which then fills its k; scores don't exist yet there."""
        for p in self.predicates:
            documents = documents.filter(p)
        return documents


def page(results: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """The rows of a page, counted from 0; none beyond the last."""
    if size < 1 or number < 0:
        raise ValueError("pages are counted from 0 and hold a result at least")
    return results.orderBy(*order).offset(number * size).limit(size)


def page_info(results: DataFrame, number: int, size: int) -> DataFrame:
    """(page, page_size, total_results, total_pages, has_next, has_prev)."""
    n = F.count("*")
    pages = F.ceil(n / size)
    return results.agg(F.lit(number).alias("page"), F.lit(size).alias("page_size"), n.alias("total_results"), pages.alias("total_pages"), (F.lit(number + 1) < pages).alias("has_next"), F.lit(number > 0).alias("has_prev"))


class ResultIterator:
    """Results one by one, fetched a partition at a time."""

    def __init__(self, results: DataFrame):
        self._rows: Iterator[Row] = results.toLocalIterator()
        self._next: list[Row] = []

    def peek(self) -> Row | None:
        if not self._next:
            row = next(self._rows, None)
            if row is None:
                return None
            self._next.append(row)
        return self._next[0]

    def skip_n(self, n: int) -> ResultIterator:
        for _ in range(n):
            if next(self, None) is None:
                break
        return self

    def collect_remaining(self) -> list[Row]:
        return list(self)

    def __iter__(self) -> ResultIterator:
        return self

    def __next__(self) -> Row:
        return self._next.pop() if self._next else next(self._rows)
