"""Ordered folds over arrays, in the JVM and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_come(candidates: Column, kind: str, a: str, b: str) -> Column:
    """Of an ordered array of structs, those whose fields ``a`` and ``b`` no kept one before has; ``kind`` is the array's type."""
    taken = lambda kept, x: F.exists(kept, lambda k: (k[a] == x[a]) | (k[b] == x[b]))
    return F.aggregate(candidates, F.array().cast(kind), lambda kept, x: F.when(taken(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def first_come_sql(candidates: str, a: str, b: str) -> str:
    """The same of a list whose elements are lists of one struct."""
    return f"list_reduce({candidates}, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.{a} = x[1].{a} OR k.{b} = x[1].{b})) > 0 THEN kept ELSE list_concat(kept, x) END)"
