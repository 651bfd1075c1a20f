"""Running folds over the items of an array, in DataFrame functions.

The functions of the engine have no scan, and a fold that appends to a list copies it for each item.  Here a list is cut into blocks: the
blocks' totals are folded first, then each block from its start on, so nothing longer than a block is copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(items: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item of a list (of zero's type), the fold of all items before it."""
    def fold(list_: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.filter(F.array(start), lambda x: F.lit(False)).alias("out"))
        return F.aggregate(list_, state, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def run(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        whole = once(cut, lambda blocks: F.flatten(F.zip_with(
            blocks, fold(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: op(s, x))), zero), lambda b, start: fold(b, start))))
        return F.when(F.size(all_) > 0, whole).otherwise(all_)

    return once(items, run)
