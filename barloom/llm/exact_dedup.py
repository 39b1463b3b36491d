"""Exact deduplication of batches against immutable snapshots.

Every snapshot keeps static binary fuse filters over the digests it holds, one filter per digest shard. The digests of
an incoming batch, one row per distinct digest, are screened by the filters of all earlier snapshots. Negatives are new
and form groups among themselves; positives join the snapshot's exact bucket (the digest), where false positives fall
out. Members of a group are then compared byte by byte with the member that stays.

Defined results: a null text counts as empty; a null ``doc_id`` is smaller than every other; of repeated rows with the
largest id exactly one stays; an empty table gives an empty result. Other columns are never read, whatever their names.
Scale: a group of copies is one row per batch before anything is screened, so a hot text costs one row per task; texts
are shuffled once, for members of groups only the second time. A filter covers ``SHARD_DIGESTS`` digests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.stage import groups_for, shuffled, stage

SHARD_DIGESTS = 1 << 17
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three table places per key, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * segment)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary fuse filter with 16-bit prints over distinct uint64 keys: (seed, segment, segments, table)."""
    n = len(keys)
    size = max(n, 2)
    segment = 1 << min(18, max(2, int(math.log(size) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(size))
    segments = max(1, math.ceil(size * factor / segment) - 2)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += 1 + segments // 10
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at = _places(h, segment, segments)
        slots = (segments + 2) * segment
        degree = np.bincount(at.ravel(), minlength=slots)
        owner = np.zeros(slots, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left, single = [], n, np.flatnonzero(degree == 1)
        while len(single):
            key, pick = np.unique(owner[single], return_index=True)
            rounds.append((key, single[pick]))
            left -= len(key)
            touched = at[:, key].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(key, 3))
            touched = np.unique(touched)
            single = touched[degree[touched] == 1]
        if left:
            continue
        table, prints = np.zeros(slots, np.uint16), _prints(h)
        for key, slot in reversed(rounds):  # a slot of a round belongs to one key of that round only
            table[slot] = prints[key] ^ np.bitwise_xor.reduce(table[at[:, key]], axis=0)
        return seed, segment, segments, table.tobytes()
    raise ValueError("no filter could be built; are the keys distinct?")


def may_contain(built: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one in 65,536 of all others."""
    seed, segment, segments, table = built
    h = _mixed(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return np.bitwise_xor.reduce(np.frombuffer(table, np.uint16)[_places(h, segment, segments)], axis=0) == _prints(h)


def snapshot_filters(digests: DataFrame) -> DataFrame:
    """(snapshot, shard, key) with distinct keys to one filter row per snapshot and shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy(np.int64)).view(np.uint64)
        seed, segment, segments, table = build_filter(keys)
        return pd.DataFrame({
            "snapshot": [int(pdf["snapshot"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])],
            "seed": [seed], "segment": [segment], "segments": [segments], "table": [table],
        })

    return digests.groupBy("snapshot", "shard").applyInPandas(
        build, "snapshot long, shard long, seed long, segment long, segments long, table binary"
    )


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows (shard, batch, key) that a filter of an earlier snapshot lets through, with that snapshot."""

    def look_up(rows: pd.DataFrame, built: pd.DataFrame) -> pd.DataFrame:
        found, keys = [], rows["key"].to_numpy(np.int64).view(np.uint64)
        for f in built.itertuples(index=False):
            hit = may_contain((f.seed, f.segment, f.segments, f.table), keys) & (rows["batch"].to_numpy() > f.snapshot)
            found.append(pd.DataFrame({"key": rows["key"][hit], "batch": rows["batch"][hit], "snapshot": f.snapshot}))
        return pd.concat(found) if found else pd.DataFrame({"key": [], "batch": [], "snapshot": []}, dtype="int64")

    return incoming.select("shard", "batch", "key").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(
        look_up, "key long, batch long, snapshot long"
    )


def exact_groups(docs: DataFrame, batch: Column, text: str = "text", digest: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per row of ``docs``.

    ``batch`` numbers the batches from 0 in order of arrival; a stored batch is the snapshot that later ones are
    screened against. ``digest`` defaults to the SHA-256 of the text. A weaker one costs time, not correctness.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    named = docs.select("doc_id", batch.cast("long").alias("batch"), content.alias("content"), (F.sha2(content, 256) if digest is None else digest).alias("digest"))

    # Duplicates inside a batch are grouped first: a text occurs once per batch from here on.
    held = stage(named.groupBy("batch", "digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    shards = groups_for(held.count(), SHARD_DIGESTS)
    held = held.withColumn("key", F.xxhash64("digest")).withColumn("shard", F.pmod("key", F.lit(shards)))
    filters = stage(snapshot_filters(held.select(F.col("batch").alias("snapshot"), "shard", "key")))
    positive = screen(held, filters)

    # Positives meet the snapshot's exact bucket; a false positive finds no equal digest there.
    bucket = held.select(F.col("batch").alias("snapshot"), "key", F.col("digest").alias("stored"))
    true = positive.join(shuffled(held.select("batch", "key", "digest")), ["batch", "key"]).join(shuffled(bucket), ["snapshot", "key"])
    known = stage(true.filter("digest = stored").select("digest").distinct())
    merged = held.join(known, "digest", "left_semi").groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    alone = held.join(known, "digest", "left_anti").select("digest", "keep_id", F.col("n").alias("group_size"))
    groups = stage(merged.unionByName(alone))

    # Byte checks: every member against the one that stays. Single texts never travel with their text.
    several = groups.filter("group_size > 1")
    members = stage(named.select("doc_id", "digest", "content").join(several, "digest"))
    stays = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", F.col("content").alias("stay_text"))
    stays = stays.groupBy("digest").agg(F.max("stay_text").alias("stay_text"))
    checked = members.join(stays, "digest").select("doc_id", "digest", "content", F.col("content").eqNullSafe(F.col("stay_text")).alias("same"))
    other = stage(checked.filter(~F.col("same")).select("doc_id", "digest", "content"))
    if other.isEmpty():
        rows = named.select("doc_id", "digest").join(groups, "digest").withColumn("part", F.lit(""))
    else:  # digests that two texts share: these few groups are formed by the text itself
        mixed = other.select("digest").distinct()
        by_text = members.join(mixed, "digest", "left_semi")
        own = by_text.groupBy("content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        rows = named.select("doc_id", "digest").join(groups, "digest").join(mixed, "digest", "left_anti").withColumn("part", F.lit("")).unionByName(
            by_text.select("doc_id", "digest", "content").join(own, "content").withColumn("part", F.sha2("content", 256)).drop("content"))
    return _one_kept(rows)


def _one_kept(rows: DataFrame) -> DataFrame:
    """Mark the row that stays. Rows that repeat an id within a group are counted and dealt out again, the first kept."""
    each = rows.groupBy("digest", "part", "keep_id", "group_size", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "digest",
    )


def keep_one(docs: DataFrame, batch: Column, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns."""
    stay = exact_groups(docs, batch, text).filter("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__stay"))
    tagged = docs.withColumn("__digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    # Joined by digest and id, so that a large group of copies is spread.
    same = tagged["doc_id"].eqNullSafe(stay["__id"]) & (tagged["__digest"] == stay["__stay"])
    return tagged.join(stay, same, "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")
