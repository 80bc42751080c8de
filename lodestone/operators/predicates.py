"""Predicates and blank-aware helpers of the record model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(col: Column) -> Column:
    """Null or empty string."""
    return F.coalesce(col.cast("string"), F.lit("")) == ""


def is_blank_array(col: Column) -> Column:
    """Null or no elements."""
    return F.coalesce(F.size(col), F.lit(0)) <= 0


def matches(where: Mapping[str, object], columns: Mapping[str, Column] | None = None) -> Column:
    """All of: equality, membership (list), exclusion ({"not": [...]}).

    A missing value fails equality and membership and passes exclusion; nulls in an exclusion list
    are ignored (``NOT IN`` with a null would drop every row)."""
    tests = []
    for name, want in where.items():
        c = (columns or {}).get(name, F.col(name))
        if isinstance(want, Mapping):
            tests.append(~F.coalesce(c.isin([x for x in want["not"] if x is not None]), F.lit(False)))
        elif isinstance(want, (list, tuple, set)):
            tests.append(F.coalesce(c.isin([x for x in want if x is not None]), F.lit(False)))
        else:
            tests.append(F.coalesce(c == F.lit(want), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


MAX_FILTER_KEYS, MAX_FILTER_VALUES = 16, 32


def metadata_matches(meta: Column, wanted: Mapping[str, Sequence[str]]) -> Column:
    """AND over keys, OR over values on ``map<string,array<string>>``; a missing key fails."""
    if len(wanted) > MAX_FILTER_KEYS or any(len(v) > MAX_FILTER_VALUES for v in wanted.values()):
        raise ValueError("too many filter keys or values")
    tests = [F.coalesce(F.arrays_overlap(F.try_element_at(meta, F.lit(k)), F.array(*map(F.lit, v))), F.lit(False)) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def display(col: Column) -> Column:
    """Booleans as a circle, blanks as a dash."""
    return F.when(is_blank(col), "―").otherwise(F.when(col.cast("string") == "true", "○").otherwise(col.cast("string")))


def declared_place(value: Column, declared: Sequence[str]) -> Column:
    """1-based place of a value among the declared ones, as a sort key; others share the place after them."""
    at = F.array_position(F.array(*map(F.lit, declared)), value) if declared else F.lit(0)
    return F.when(at > 0, at).otherwise(F.lit(len(declared) + 1)).cast("long")
