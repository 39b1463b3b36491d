"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits, each the majority over the hashes of its word shingles. For a radius r every bit
position is given a vector of r + 1 bits; table v keeps the positions whose vector has an odd product with v. The
vectors of at most r differing positions span less than all r + 1 dimensions, so some v of the 2**(r+1) - 1 is
orthogonal to all of them, and its table keeps none of the differing positions: the pair collides there. No pair
within the radius is missed.

Documents with equal fingerprints are one node. A bucket of a table is cut into connected parts by the Hamming distance
and returns one edge per node at most, never its pairs; a bucket above ``BUCKET_ROWS`` nodes is dealt into tiles
(chunk against chunk) that run as separate tasks. The edges then shrink to stars, in rounds of two joins each, written
to the shared folder.

Defined results: null and empty texts have fingerprint zero; a null ``doc_id`` belongs to its component but never names
it unless the component has no other id; repeated rows are one row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.stage import drop, groups_for, shuffled, stage

RADIUS = 4
SHINGLE_WORDS = 4
BUCKET_ROWS = 4096
TASK_ROWS = 1 << 17
_SPACES = bytes(range(9, 14))
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _SPACES, bytes(range(97, 123)) + b" " * len(_SPACES))


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The XXH64 of all word shingles in their order; none without words."""
    parts = (text or "").encode().translate(_LOWER).split(b" ")
    parts = [p for p in parts if p]
    if not parts:
        return np.zeros(0, np.uint64)
    joined, length = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    n = max(1, len(parts) - words + 1)
    first = start[:n].tolist()
    last = (start + length - 1)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, n)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The majority bits over the XXH64 of all shingles, as an unsigned number."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tie, fp): a hash of the text that tells rows with one id apart, and the fingerprint's bits as a long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter((fingerprint(t, words) for t in pdf["text"]), np.uint64, len(pdf)).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tie": pdf["tie"], "fp": fp})

    # Ids as text: a null among them would turn a column of longs into doubles.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id string, tie long, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def masks(radius: int, bits: int = 64) -> list[int]:
    """The position masks of all tables, as unsigned numbers. The vectors of the positions are dealt out evenly."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _components(fp: np.ndarray, radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """Edges (node, root) of the connected parts of distinct fingerprints; with ``split``, links across it only."""
    x = fp.view(np.uint64)
    if split is None:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    else:
        near = np.zeros((len(x), len(x)), bool)
        near[:split, split:] = np.bitwise_count(x[:split, None] ^ x[None, split:]) <= radius
        near[split:, :split] = near[:split, split:].T
    left, edges = np.ones(len(x), bool), []
    for root in range(len(x)):
        if not left[root]:
            continue
        left[root] = False
        frontier = near[root] & left
        while frontier.any():
            left &= ~frontier
            edges += [(int(fp[i]), int(fp[root])) for i in np.flatnonzero(frontier)]
            frontier = near[frontier].any(axis=0) & left
    return edges


def _edges(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(pairs, np.int64).reshape(-1, 2), columns=["u", "v"])


def near_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect exactly what links within the radius connect."""

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks(radius))])
    dealt = nodes.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    shared = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stage(shuffled(dealt).join(shared, ["t", "key"]))

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "key", "fp"], ignore_index=True)
        fp = pdf["fp"].to_numpy()
        new = np.flatnonzero(np.r_[True, (pdf["t"].to_numpy()[1:] != pdf["t"].to_numpy()[:-1]) | (pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1])])
        size = np.diff(np.r_[new, len(fp)])
        two = new[size == 2]
        near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius]
        found = [_edges([e for a, n in zip(new[size > 2], size[size > 2]) for e in _components(fp[a : a + n], radius)])]
        return pd.concat([*found, pd.DataFrame({"u": fp[near + 1], "v": fp[near]})]).drop_duplicates()

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf["chunk"] == key[2]]["fp"].to_numpy(), pdf[pdf["chunk"] != key[2]]["fp"].to_numpy()
        if key[2] == key[3]:
            return _edges(_components(own, radius))
        return _edges(_components(np.concatenate([own, other]), radius, len(own)))

    tasks = groups_for(met.count(), TASK_ROWS)
    usual = met.filter(F.col("n") <= BUCKET_ROWS).groupBy(F.pmod(F.xxhash64("t", "key"), F.lit(tasks)).alias("task")).applyInPandas(
        lambda pdf: small(pdf), "u long, v long")
    chunks = F.ceil(F.col("n") / (BUCKET_ROWS // 2)).cast("int")
    hot = met.filter(F.col("n") > BUCKET_ROWS).withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    hot = hot.select("*", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"))
    hot = hot.select("t", "key", "fp", "chunk", F.least("chunk", "c").alias("a"), F.greatest("chunk", "c").alias("b"))
    return usual.unionByName(hot.groupBy("t", "key", "a", "b").applyInPandas(tile, "u long, v long")).distinct()


def stars(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges (u, v) to (node, root): every node of a component but the smallest, with the smallest.

    Alternates two steps until nothing changes: a node hands its smallest neighbour to its larger neighbours, then to
    its smaller ones. A round is written to the shared folder; only its row count and checksum come to the driver. ``rows``: about how many edges at most, if known.
    """
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        around = shuffled(now.select(F.explode(both).alias("e")).select("e.u", "e.v"), 2 * mark[0])
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        after = stage(smaller.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), mark[0])
        drop(now)
        now = after


def near_components(docs: DataFrame, text: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tie, fp, root, component_id), one row per row of ``docs``; ``root`` is a fingerprint of the component."""
    prints = stage(fingerprints(docs, text, words))
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = stars(near_edges(nodes.select("fp"), radius))
    rooted = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id (null: last) of every ``root`` of ``found`` (doc_id, tie, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tie")
    stay = found.groupBy("root").agg(F.min(order).alias("stay")).select("stay.doc_id", "stay.tie")
    tagged = docs.withColumn("__tie", F.xxhash64(text))
    same = tagged["doc_id"].eqNullSafe(stay["doc_id"]) & (tagged["__tie"] == stay["tie"])
    return tagged.join(stay, same, "left_semi").dropDuplicates(["doc_id", "__tie"]).drop("__tie")


def keep_one(docs: DataFrame, text: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest id (null: last)."""
    return one_of_each(docs, near_components(docs, text, radius, words), text)


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
