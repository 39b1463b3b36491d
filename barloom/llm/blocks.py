"""Running states over the elements of an array, in DataFrame operations only.

A fold copies its state at every element, so one that gathers its elements in the state costs the square of their number.
Here the array is cut into blocks of ``BLOCK``: one fold carries the small state from block to block, then each block is
folded by itself from its carry, with at most ``BLOCK`` states in hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often it is used in there."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def states_before(values: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The state before each element of ``values``, from ``zero`` by ``step(state, element)``; ``kind`` is the state's type."""
    none = F.array().cast(f"array<{kind}>")

    def cut(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    def carried(state: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, state["at"], step).alias("at"), F.array_append(state["all"], state["at"]).alias("all"))

    def each(state: Column, x: Column) -> Column:
        return F.struct(step(state["at"], x).alias("at"), F.array_append(state["all"], state["at"]).alias("all"))

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), none.alias("all"))

    def inside(blocks: Column) -> Column:
        carries = F.aggregate(blocks, start(zero), carried, lambda s: s["all"])
        return bound(carries, lambda c: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, start(F.get(c, i)), each, lambda s: s["all"]))))

    return bound(bound(values, cut), inside)
