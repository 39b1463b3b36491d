"""Exact top-k search by inner product with a pivot table.

Vectors get one more component, ``sqrt(M**2 - |x|**2)`` with M the largest norm, zero for queries. The distance between
a query and a row then is ``|q|**2 + M**2 - 2 <q, x>``: the nearest rows are those with the largest products. The table
holds the distance of every row to ``PIVOTS`` pivots. By the triangle inequality the largest difference of two rows of
the table is a lower bound of a distance, so an upper bound of a product. Each query evaluates its candidates in the order
of their bounds and stops when the k-th best product found is above the next bound.

Queries and rows meet in blocks: one task per pair of blocks, with at most k results per query each; the pivots' own
products give every block a first threshold. Blocks are dealt by a hash of the row, so equal vectors spread.

Defined results: rows with a null id, a null vector or a null or non-finite component take no part; shorter vectors
count as padded with zeros; rows with a repeated id are rows of their own, and only a row itself is left out of its
candidates; equal products are ranked by id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.stage import again, groups_for, stage

PIVOTS = 32
BLOCK_ROWS = 8192
STEP = 1024
SCALE = 256


def _block(values: list, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def usable(table: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, row, x, norm2) with integer components ``floor(scale * component)``."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))
    fine = F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(
        F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))), F.lit(False))
    rows = table.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _exact(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Integer products: in doubles where every partial sum fits, with Python's integers beyond."""
    if largest < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return (a.astype(np.int64).astype(object) @ b.T.astype(np.int64).astype(object)).astype(np.int64)


def top_products(table: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score, evaluated): the ``k`` largest products of every row that ``queries`` selects."""
    rows = stage(usable(table, vector))
    largest, width, n = rows.agg(F.max("norm2"), F.max(F.size("x")), F.count(F.lit(1))).first()
    largest, width = float(largest or 0.0), int(width or 0)
    chosen = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(pivots).toPandas()
    p = _block(list(chosen["x"]), width)
    p_last, p_id = np.sqrt(np.maximum(largest - chosen["norm2"].to_numpy(float), 0.0)), chosen["row"].to_numpy()

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, norm2 = _block(list(pdf["x"]), width), pdf["norm2"].to_numpy(float)
            last = np.sqrt(np.maximum(largest - norm2, 0.0))
            as_row = np.sqrt(np.maximum(2 * largest - 2 * (x @ p.T + last[:, None] * p_last[None]), 0.0))
            as_query = np.sqrt(np.maximum(norm2[:, None] + largest - 2 * (x @ p.T), 0.0))
            yield pd.DataFrame({**{c: pdf[c] for c in ("vec_id", "row", "x", "norm2", "asks")}, "as_row": list(as_row), "as_query": list(as_query)})

    marked = rows.withColumn("asks", F.coalesce(queries, F.lit(False)))
    pivoted = stage(marked.mapInPandas(distances, "vec_id long, row long, x array<long>, norm2 double, asks boolean, as_row array<double>, as_query array<double>"))
    row_blocks = groups_for(n, BLOCK_ROWS)
    query_blocks = groups_for(pivoted.filter("asks").count(), BLOCK_ROWS)

    # Blocks are ints on both sides: an int and a long of one value are dealt to different tasks.
    asked = pivoted.filter("asks").select("vec_id", "row", "x", "norm2", F.col("as_query").alias("d"), F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("q"))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    held = again(pivoted).select("vec_id", "row", "x", "norm2", F.col("as_row").alias("d"), F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int").alias("b"))
    held = held.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):  # a side without rows has no columns either
            have = have.sort_values(["vec_id", "row"], ignore_index=True)
            x, d = _block(list(have["x"]), width), np.array(have["d"].tolist(), np.float32).T.copy()
            ids, tags = have["vec_id"].to_numpy(), have["row"].to_numpy()
            slack = 1e-5 * largest + 1.0  # rounding of the table
            for a in ask.itertuples(index=False):
                q = _block([a.x], width)
                low = np.zeros(len(have), np.float32)
                for mine, theirs in zip(np.array(a.d, np.float32), d):
                    np.maximum(low, np.abs(theirs - mine), out=low)
                bound = (a.norm2 + largest - np.maximum(low.astype(float), 0.0) ** 2) / 2 + slack
                known = np.sort(_exact(q, p[p_id != a.row], largest)[0])
                floor = known[-k] if len(known) >= k else -np.inf  # k rows reach this product
                able = np.flatnonzero((bound >= floor) & (tags != a.row))
                able = able[np.argsort(-bound[able], kind="stable")]
                best_score, best_at, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                while seen < len(able) and (len(best_score) < k or bound[able[seen]] >= best_score[-1]):
                    part = able[seen : seen + STEP]
                    score = np.concatenate([best_score, _exact(q, x[part], largest)[0]])
                    at = np.concatenate([best_at, part])
                    top = np.lexsort((at, -score))[:k]  # places follow the ids
                    best_score, best_at, seen = score[top], at[top], seen + len(part)
                out += [(a.vec_id, a.row, int(ids[i]), int(tags[i]), int(s), seen if nth == 0 else 0) for nth, (i, s) in enumerate(zip(best_at, best_score))]
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "row", "score", "evaluated"])

    met = asked.groupBy("q", "b").cogroup(held.groupBy("q", "b")).applyInPandas(
        search, "query_id long, query_row long, vec_id long, row long, score long, evaluated long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "evaluated")
