"""Filters from keyword arguments: ranges, lists and their negations, as one Column."""

from __future__ import annotations

import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = (int, float, datetime.date, datetime.datetime)


def as_list(v: Any) -> list:
    return [v] if isinstance(v, str) or not hasattr(v, "__iter__") else list(v)


def as_range(v: Any) -> tuple | None:
    """(low, high) of a number, time or pair of them; else None."""
    if isinstance(v, NUMERIC):
        return v, v
    if isinstance(v, tuple) and len(v) == 2 and all(isinstance(x, NUMERIC) for x in v):
        return min(v), max(v)
    return None


def build_filter(literal_not: bool = False, **wanted: Any) -> Column:
    """AND of one predicate a key; `key_not` negates; None is ignored; no key matches all.

    A scalar number or a pair is an inclusive range, anything else a list. Every key must exist. literal_not keeps an
    older reading of excluded ranges, below the low and above the high bound at once, which nothing satisfies."""
    parts = []
    for key, v in wanted.items():
        if v is None:
            continue
        negated = key.endswith("_not")
        c = F.col(key.removesuffix("_not"))
        r = as_range(v)
        if r is None:
            p = ~c.isin(as_list(v)) if negated else c.isin(as_list(v))
        elif negated:
            p = (c < r[0]) & (c > r[1]) if literal_not else (c < r[0]) | (c > r[1])
        else:
            p = c.between(*r)
        parts.append(c.isNotNull() & p)
    return reduce(Column.__and__, parts, F.lit(True))


def any_of(*alternatives: dict[str, Any]) -> Column:
    """OR of filters given as keyword arguments; no alternative matches nothing."""
    return reduce(Column.__or__, [build_filter(**a) for a in alternatives], F.lit(False))


def set_equal(array: Column, values: list) -> Column:
    """The array holds exactly these values, each once, in any order."""
    wanted = F.array(*[F.lit(v) for v in values])
    return (F.size(array) == len(values)) & (F.size(F.array_except(wanted, array)) == 0)


def older_than(stamp: Column, days: int = 7, now: Column | None = None) -> Column:
    return stamp < (F.current_timestamp() if now is None else now) - F.make_interval(days=F.lit(days))
