"""Ordered-series primitives that keep working when one series holds most of the rows.

A window keyed by series alone is one task per series. Here every series is cut into chunks:

* ``running`` - running sum / count / min / max. Rows are windowed per (series, chunk); the chunk
  totals, one row per chunk, carry the result across chunks.
* ``with_ordinal`` - dense 0-based position in the series, a running count.
* ``spread_halo`` / ``drop_halo`` - bounded row frames. Each chunk also receives the few rows
  before and after it, so a frame of that size sees exactly the rows it would see unchunked.

Chunks come from the data (order value or ordinal, divided), never from partition ids, so a lost
task recomputes the same chunks. Series columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scalars import long

CHUNK_ROWS = 1 << 16
_CHUNK = "__chunk"

_AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _combine(kind: str, carry: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    pick = F.least if kind == "min" else F.greatest
    return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(pick(carry, here))


def chunk_of(order: Column, span: int) -> Column:
    return order - F.pmod(order, long(span))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    span: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running aggregates per key in ``order``; the first order column is a long and forms chunks.

    ``aggs`` maps a new column to (sum | count | min | max, expression). A running last value is the
    ``max`` of a struct that starts with the order columns.
    """
    base = df.withColumn(_CHUNK, chunk_of(F.col(order[0]), span))
    totals = base.groupBy(*keys, _CHUNK).agg(
        *[_AGGREGATES[kind](expr).alias(name) for name, (kind, expr) in aggs.items()]
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, _CHUNK,
        *[
            _AGGREGATES["sum" if kind == "count" else kind](F.col(name)).over(before).alias(f"__carry_{name}")
            for name, (kind, _) in aggs.items()
        ],
    )
    here = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    # The window comes first: its sort by (keys, chunk, order) already serves the join on (keys, chunk).
    local = base.select(
        *df.columns, _CHUNK,
        *[_AGGREGATES[kind](expr).over(here).alias(f"__here_{name}") for name, (kind, expr) in aggs.items()],
    )
    return local.join(carry, [*keys, _CHUNK]).select(
        *df.columns,
        *[
            _combine(kind, F.col(f"__carry_{name}"), F.col(f"__here_{name}")).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    )


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str = "bar_index", span: int = CHUNK_ROWS
) -> DataFrame:
    order = [order] if isinstance(order, str) else list(order)
    out = running(df, keys, order, {name: ("count", F.lit(1))}, span=span)
    return out.withColumn(name, F.col(name) - 1)


def spread_halo(
    df: DataFrame, keys: Sequence[str], ordinal: str, before: int, after: int, rows: int = CHUNK_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Copy edge rows into the neighbouring chunks and give the window to evaluate frames on.

    ``ordinal`` is the dense position. Frames may reach ``before`` rows back and ``after`` ahead.
    """
    if before > rows or after > rows:
        raise ValueError("The halo must not be longer than a chunk.")
    home = chunk_of(F.col(ordinal), rows)
    at = F.pmod(F.col(ordinal), long(rows))
    targets = F.array_compact(
        F.array(
            home,
            F.when(at >= rows - before, home + long(rows)),
            F.when((at < after) & (home > 0), home - long(rows)),
        )
    )
    spread = df.withColumn(_CHUNK, F.explode(targets))
    return spread, Window.partitionBy(*keys, _CHUNK).orderBy(ordinal)


def drop_halo(df: DataFrame, ordinal: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return df.where(F.col(_CHUNK) == chunk_of(F.col(ordinal), rows)).drop(_CHUNK)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    strictly_before: bool,
    tie_break: Sequence[str] = (),
    span: int = CHUNK_ROWS,
) -> DataFrame:
    """For every left row the ``value`` struct of the last right row at or before (or before) ``at``."""
    position = F.struct(F.col(at), *[F.col(c) for c in tie_break], F.col(value).alias("__payload"))
    fields = [f for f in left.columns if f not in (*keys, at)]
    first = 0 if strictly_before else 1
    asks = left.select(*keys, at, F.lit(first).alias("__side"), F.struct(*fields).alias("__row"))
    facts = right.select(*keys, at, F.lit(1 - first).alias("__side"), position.alias("__fact"))
    both = asks.unionByName(facts, allowMissingColumns=True)
    seen = running(both, keys, [at, "__side"], {"__last": ("max", F.col("__fact"))}, span=span)
    return seen.where(F.col("__row").isNotNull()).select(
        *keys, at, *[F.col("__row")[f].alias(f) for f in fields], F.col("__last")["__payload"].alias(value)
    )
