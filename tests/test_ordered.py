import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.ordered import as_of, drop_halo, running, spread_halo, with_ordinal


def rows(n=120, seed=7):
    """One key holds most rows, ids have gaps."""
    rnd, out = random.Random(seed), []
    for key, size in (("hot", n), ("cold", 5), ("one", 1)):
        at = -20
        for _ in range(size):
            at += rnd.choice([1, 1, 3, 40])
            out.append((key, at, rnd.randrange(-9, 9)))
    return out


@pytest.mark.parametrize("span", [4, 1 << 16])
def test_running_and_ordinal(spark, span):
    data = rows()
    df = spark.createDataFrame(data, "k string, at long, v long")
    out = running(df, ["k"], ["at"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "n": ("count", F.lit(1))}, span=span)
    out = with_ordinal(out, ["k"], "at", "i", span)
    got = {(r.k, r.at): (r.total, r.top, r.n, r.i) for r in out.collect()}
    for key in ("hot", "cold", "one"):
        seen = []
        for k, at, v in sorted(d for d in data if d[0] == key):
            seen.append(v)
            assert got[(k, at)] == (sum(seen), max(seen), len(seen), len(seen) - 1)


@pytest.mark.parametrize("rows_per_chunk", [4, 1 << 16])
def test_halo_equals_plain_window(spark, rows_per_chunk):
    from pyspark.sql import Window

    df = with_ordinal(spark.createDataFrame(rows(), "k string, at long, v long"), ["k"], "at", "i")
    plain = Window.partitionBy("k").orderBy("i")
    exprs = lambda w: {"back": F.sum("v").over(w.rowsBetween(-3, -1)), "ahead": F.max("v").over(w.rowsBetween(1, 2)), "lag": F.lag("v", 3).over(w)}
    spread, w = spread_halo(df, ["k"], "i", 3, 2, rows_per_chunk)
    a = drop_halo(spread.withColumns(exprs(w)), "i", rows_per_chunk)
    b = df.withColumns(exprs(plain))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("strict", [True, False])
def test_as_of(spark, strict):
    left = [("a", t) for t in range(0, 30, 2)] + [("b", 3)]
    right = [("a", t, 1000 + t) for t in (4, 9, 10, 20)]
    l = spark.createDataFrame(left, "k string, at long").withColumn("row", F.col("at") * 10)
    r = spark.createDataFrame(right, "k string, at long, x long").select("k", "at", F.struct("x").alias("fact"))
    got = {(x.k, x.at): (x.fact.x if x.fact else None) for x in as_of(l, r, ["k"], "at", "fact", strict, span=8).collect()}
    for k, t in left:
        known = [x for kk, at, x in right if kk == k and (at < t if strict else at <= t)]
        assert got[(k, t)] == (known[-1] if known else None)
