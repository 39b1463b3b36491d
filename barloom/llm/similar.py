"""Near copies by SimHash, and by the exact Jaccard similarity of word-shingle sets for the pairs that it leaves apart.

With a ``radius`` the fingerprints within so many bits link first, by the covering tables of ``simhash``: at 4 bits pairs of a
similarity of about 0.96. A prefix-filtered set join over what is still apart then links every pair of similarity s or more. A
component is what both kinds of links connect.

A text is the set of the XXH64 of its word shingles. Two sets of similarity s or more share at least s times the size of
each, so, whatever the common order of the shingles, each has one of the shared ones among its first
size - ceil(s * size) + 1: its prefix. Pairs that share a shingle of both prefixes are the candidates, and no pair at s or
more is missed. The order is that of the hashes, with shingles of more than ``HOT_TEXTS`` texts last, so that a phrase of
many texts does not pair them all. Prefixes in the order of the hashes tell which texts hold such a shingle; of those texts
all shingles are counted, as the next ones of a common passage would only take the place of the first.

Candidates pass three bounds that no pair at s or more fails (sizes, places of the shared shingle, parity sketches) and
are then confirmed by intersecting the whole sets. Every bucket first tries its texts of other components against the one with
the smallest share of rare shingles, so that copies of an original meet the original or the copy closest to it; what that links is one
component. Only pairs across components are tried after it, and not by a bucket's own square: the smaller text of a pair
must have the shared shingle in a shorter prefix (n - 2s / (1 + s) * n places, a ninth at 0.8), and the place in the larger
one bounds the size of the smaller, so rows meet by shingle and class of sizes. Texts of one passage with more than a ninth
of their own are no candidates, and with less they are near copies of the passage.

Defined results: texts with the same set are one node; texts without words are alike; a text shorter than a shingle is
one shingle; a null ``doc_id`` and repeated rows as in ``simhash``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.simhash import majority, near_edges, one_of_each, shingle_hashes, stars
from barloom.llm.stage import shuffled, stage

WORDS = 5
SIMILARITY = 0.8
HOT_TEXTS = 256
MOST_HOT = 1 << 20
SIZE_CLASS = 1.03
TURN_CHARS = 1 << 20
_ROUNDING = 1e-9


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes in rising order."""
    return np.unique(shingle_hashes(text, words))


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut by their characters, so that the shingles of few texts are in memory together."""
    for pdf in batches:
        turn = pdf["text"].str.len().fillna(0).astype("int64").cumsum().to_numpy() // TURN_CHARS
        cut = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(pdf)]
        for a, z in zip(cut, cut[1:]):
            yield pdf.iloc[a:z]


def _lists(sets: Iterable[np.ndarray]) -> pd.Series:
    """Sets as a column of longs; one without rows is a column of lists too, which Arrow asks for."""
    return pd.Series([s.view(np.int64) for s in sets], dtype=object)


def _is_hot(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot) or not len(hashes):
        return np.zeros(len(hashes), bool)
    return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes


def prefix(hashes: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the common order."""
    length = min(len(hashes), len(hashes) - math.ceil(similarity * len(hashes) - _ROUNDING) + 1)
    late = _is_hot(hashes, hot)
    return np.r_[hashes[~late], hashes[late]][:length]


def sketch(hashes: np.ndarray) -> bytes:
    """Bit i: is the number of hashes that are i modulo the bits odd? At least as many bits as hashes, a power of two."""
    bits = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference: the longer sketch is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _prefixes(docs: DataFrame, text: str, words: int, similarity: float, hot: np.ndarray) -> DataFrame:
    """(doc_id, tie, fp, node, n, rare, sketch, keys), one row per row of ``docs``; ``fp`` is the fingerprint, ``node`` names the
    set, ``rare`` is the share that is not hot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _turns(batches):
            prints, sets = np.zeros(len(pdf), np.uint64), []
            for i, t in enumerate(pdf["text"]):
                hashes = shingle_hashes(t, words)
                prints[i] = majority(hashes)
                sets.append(np.unique(hashes))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "tie": pdf["tie"].to_numpy(), "fp": prints.view(np.int64),
                "node": np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64),
                "n": np.fromiter(map(len, sets), np.int32, len(sets)), "rare": [1.0 - float(_is_hot(s, hot).mean()) if len(s) else 0.0 for s in sets], "sketch": [sketch(s) for s in sets],
                "keys": _lists(prefix(s, similarity, hot) for s in sets),
            })

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, tie long, fp long, node long, n int, rare double, sketch binary, keys array<long>")
    return stage(made.withColumn("doc_id", F.col("doc_id").cast("long")))


def _shared(rows: DataFrame) -> DataFrame:
    counts = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    return stage(counts.filter("texts > 1"))


def _hot(shared: DataFrame, total: int) -> np.ndarray:
    """The shingles of more than ``HOT_TEXTS`` texts; at most ``MOST_HOT`` come to the driver."""
    found = shared.filter(F.col("texts") > max(HOT_TEXTS, total // MOST_HOT)).select("key").collect()
    return np.sort(np.array([r.key for r in found], np.int64).view(np.uint64))


def _all_hot(docs: DataFrame, text: str, words: int, similarity: float, hot: np.ndarray) -> np.ndarray:
    """``hot`` and all other hot shingles of the texts that have one of ``hot`` in their prefix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.uint64)
        for pdf in _turns(batches):
            sets = [shingle_set(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"keys": _lists(s for s in sets if _is_hot(prefix(s, similarity, none), hot).any())})

    keys = docs.select(F.col(text).alias("text")).mapInPandas(run, "keys array<long>").select(F.explode("keys").alias("key"))
    counts = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > HOT_TEXTS))
    return np.union1d(hot, _hot(counts, counts.agg(F.sum("texts")).first()[0] or 0))


def _sets(docs: DataFrame, text: str, words: int, rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(node, hashes) of the given nodes, ``most`` at most, from one text of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _turns(batches):
            yield pd.DataFrame({"node": pdf["node"].to_numpy(), "hashes": _lists(shingle_set(t, words) for t in pdf["text"])})

    one = stage(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("r")).select("node", "r.*"), most)
    tagged = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    found = tagged.join(one, (tagged["tie"] == one["tie"]) & tagged["__id"].eqNullSafe(one["doc_id"])).select("node", "text")
    return stage(found.mapInPandas(run, "node long, hashes array<long>").dropDuplicates(["node"]))


def _fits(n_a: Column, n_b: Column, similarity: float) -> Column:
    return F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b) - _ROUNDING


def _passed(pairs: DataFrame, sketches: DataFrame, similarity: float, most: int | None = None) -> DataFrame:
    """Of the pairs (a, b), ``most`` at most if known, those that the sketches leave possible."""
    part = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            least = np.fromiter((least_difference(x, y) for x, y in zip(pdf["s_a"], pdf["s_b"])), np.int64, len(pdf))
            yield pdf[least <= part * (pdf["n_a"] + pdf["n_b"]) + _ROUNDING][["a", "b"]]

    of = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    return stage(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(run, "a long, b long"), most)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the similarity."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}"))
    both = F.size(F.array_intersect("h_a", "h_b"))
    either = F.size("h_a") + F.size("h_b") - both
    return stage(pairs.join(of("a"), "a").join(of("b"), "b").filter(both >= similarity * either - _ROUNDING).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(SIZE_CLASS)).cast("int")


def candidate_pairs(placed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of different ``root`` that can reach the similarity, of rows (key, node, n, place, root)."""
    part = similarity / (1 + similarity)
    n, left = F.col("n"), F.col("n") - F.col("place")
    index = placed.filter(left >= 2 * part * n - _ROUNDING).select("key", _size_class(n).alias("class"), *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "place", "root")])
    # The smaller text is at least ``similarity`` as large, and the place here bounds it from above.
    low, high = similarity * n - _ROUNDING, F.least(n.cast("double"), left / part - n + _ROUNDING)
    classes = F.when(low <= high, F.sequence(_size_class(F.ceil(low)), _size_class(F.floor(high))))
    probe = placed.select("key", F.explode(classes).alias("class"), *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "root")])
    pairs = index.join(shuffled(probe), ["key", "class"]).filter("root_a <> root_b AND (n_a < n_b OR (n_a = n_b AND node_a < node_b))")
    most_shared = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = pairs.filter(_fits(F.col("n_a"), F.col("n_b"), similarity) & (most_shared >= part * (F.col("n_a") + F.col("n_b")) - _ROUNDING))
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _alike_prints(rows: DataFrame, radius: int, texts: int) -> DataFrame:
    """Edges (u, v) of sets whose fingerprints SimHash links, of rows (fp, node): each set with the smallest of its component."""
    prints = stage(rows.select("fp", "node").distinct(), texts)
    linked = stars(near_edges(prints.select("fp").distinct(), radius), texts).select(F.col("node").alias("fp"), "root")
    rooted = prints.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("node").alias("v"))
    return stage(rooted.join(least, "root").filter("node <> v").select(F.col("node").alias("u"), "v").distinct(), texts)


def similar_components(
    docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int | None = None
) -> DataFrame:
    """(doc_id, tie, root), one row per row of ``docs``; rows linked by pairs at the similarity or above, or
    by fingerprints within ``radius``, share ``root``."""
    rows = _prefixes(docs, text, words, similarity, np.zeros(0, np.uint64))
    shared = _shared(rows)
    texts, total = rows.agg(F.count(F.lit(1)), F.sum(F.size("keys"))).first()
    hot = _hot(shared, total or 0)
    if len(hot):
        hot = _all_hot(docs, text, words, similarity, hot)
        rows = _prefixes(docs, text, words, similarity, hot)
        shared = _shared(rows)
    alike = _alike_prints(rows, radius, texts) if radius is not None else rows.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    known = stars(alike, texts)
    met = rows.select("node", "n", "rare", F.posexplode("keys").alias("place", "key"))
    met = shuffled(met).join(shared.select("key"), "key")
    met = stage(met.select("key", "node", "n", "rare", "place").distinct())
    places = met.count()
    sketches = stage(rows.join(met.select("node").distinct(), "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"]), texts)

    # Every text of a bucket against the one with least of its own, unless the fingerprints linked them.
    rooted = met.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("key").agg(F.min(F.struct("rare", "node", "n", "root")).alias("one"))
    near = rooted.join(first, "key").filter(F.col("root") != F.col("one.root")).filter(_fits(F.col("n"), F.col("one.n"), similarity))
    tried = _passed(near.select(F.least("one.node", "node").alias("a"), F.greatest("one.node", "node").alias("b")).distinct(), sketches, similarity, places)
    sets = _sets(docs, text, words, rows, tried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts)
    linked = alike.unionByName(_confirmed(tried, sets, similarity))

    # Pairs of a bucket that this left in different components.
    part = stars(linked, places)
    placed = met.join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    placed = stage(placed.join(open_keys, "key", "left_semi"), places)
    rest = _passed(candidate_pairs(placed, similarity).join(tried, ["a", "b"], "left_anti"), sketches, similarity)
    wanted = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    more = _sets(docs, text, words, rows, wanted.join(sets, "node", "left_anti"), texts)
    linked = linked.unionByName(_confirmed(rest, sets.unionByName(more), similarity))

    found = rows.select("doc_id", "tie", "node").join(stars(linked, places), "node", "left")
    return found.select("doc_id", "tie", F.coalesce("root", "node").alias("root"))


def keep_one(
    docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest id (null: last)."""
    return one_of_each(docs, similar_components(docs, text, words, similarity, radius), text)
