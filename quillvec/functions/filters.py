"""Predicates over integer labels, compiled to Spark columns.

Fields are positions in an array column `labels`; a name is an ordinary column, whose predicate Parquet scans push down.

A predicate over a missing field matches nothing.  `column` gives the plain test, null there, for a `where`, which takes null as false, as
do `And` and `Or` of tests; wrapped tests would not be pushed down.  `truth` is never null, for a column of results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Field = int | str


class Filter:
    def column(self, labels: str = "labels") -> Column:
        raise NotImplementedError

    def truth(self, labels: str = "labels") -> Column:
        return F.coalesce(self.column(labels), F.lit(False))

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))


def _field(field: Field, labels: str) -> Column:
    return F.col(field) if isinstance(field, str) else F.get(F.col(labels), field)


@dataclass(frozen=True)
class Everything(Filter):
    """Matches all rows."""

    def column(self, labels: str = "labels") -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Equal(Filter):
    field: Field
    value: int

    def column(self, labels: str = "labels") -> Column:
        return _field(self.field, labels) == self.value


@dataclass(frozen=True)
class OneOf(Filter):
    """Matches nothing if there are no values."""

    field: Field
    values: tuple[int, ...]

    def column(self, labels: str = "labels") -> Column:
        return _field(self.field, labels).isin(list(self.values)) if self.values else F.lit(False)


@dataclass(frozen=True)
class Less(Filter):
    field: Field
    value: int

    def column(self, labels: str = "labels") -> Column:
        return _field(self.field, labels) < self.value


@dataclass(frozen=True)
class Greater(Filter):
    field: Field
    value: int

    def column(self, labels: str = "labels") -> Column:
        return _field(self.field, labels) > self.value


@dataclass(frozen=True)
class Between(Filter):
    """Both ends included."""

    field: Field
    low: int
    high: int

    def column(self, labels: str = "labels") -> Column:
        return _field(self.field, labels).between(self.low, self.high)


@dataclass(frozen=True)
class And(Filter):
    """Matches all rows if there are no parts."""

    parts: tuple[Filter, ...] = ()

    def column(self, labels: str = "labels") -> Column:
        return reduce(lambda a, b: a & b, (p.column(labels) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Or(Filter):
    """Matches nothing if there are no parts."""

    parts: tuple[Filter, ...] = ()

    def column(self, labels: str = "labels") -> Column:
        return reduce(lambda a, b: a | b, (p.column(labels) for p in self.parts), F.lit(False))
