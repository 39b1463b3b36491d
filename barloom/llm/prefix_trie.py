"""Prefix trie of conversations as balanced parentheses, one sequence per shard of the sorted paths.

A conversation is the path of the digests of its turns, 16 bytes a turn, so that paths sort and share prefixes as
conversations do. Equal paths are one row with their number, least id and the digest of their ids. The distinct paths are
sorted over the cluster; every run of about ``SHARD_TURNS`` turns is a shard and becomes a sequence of parentheses in the
order of the trie, an opening one per node. Over the running excess a range min-max tree of blocks answers findclose for
all nodes together; the closing place delimits the subtree, the rank of the pairs "()" there counts its leaves, and
differences of running sums give members and savings.

A node can lie in two shards only if it is on the first or the last path of a shard. These spines go up to the next
level with what hangs off them (members, children, leaves, savings); all other nodes of the shard are final. The spines
are sorted and encoded in the same way, level by level, until they fit one shard. A hot first turn is thus a node of every
spine and a group of no task.

Defined results: rows without ``conv_id`` belong to no conversation; null roles and texts are empty; turns are ordered null
first, ties by role and text, and a repeated row is a turn of its own; further columns are not read; an empty table has no
nodes. The ids that end at one node are hashed in order by one task that streams them, as SHA-256 is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.ordered import with_ordinal
from barloom.llm.stage import again, groups_for, stage

BASE_EVERY = 20
MOST_SHARED = 4
SHARD_TURNS = 1 << 17
LEAST_PATHS = 8
BLOCK = 64
_DIGEST = 16
_NO_ID = np.iinfo(np.int64).max
_NONE = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, turn digest, words), ``nth`` from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.col("turn").isNotNull().alias("given"),
        role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), text.alias("own"),
    )
    return with_ordinal(rows, ["conv_id"], ["turn", "given", "role", "own"], "nth").select("conv_id", "nth", "digest", "words")


def shared_turns(conv_id: Column, most: int = MOST_SHARED) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(most))


def rebuilt(conversations: DataFrame, base_every: int = BASE_EVERY, most: int = MOST_SHARED) -> DataFrame:
    """(conv_id, path, words) of every conversation with the first turns of its base in place of its own."""
    turns = stage(turns_in_order(conversations))
    h = shared_turns(F.col("conv_id"), most)
    first = again(turns).filter(F.col("nth") < most - 1).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "words"))).alias("first"))
    own = turns.filter(F.col("nth") >= h).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "words"))).alias("own"))
    ids = again(turns).select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % base_every)
    none = F.expr("cast(array() AS array<struct<nth: bigint, digest: string, words: int>>)")
    both = ids.join(first, "base", "left").join(own, "conv_id", "left")
    whole = F.concat(F.slice(F.coalesce("first", none), F.lit(1), h.cast("int")), F.coalesce("own", none))
    both = both.select("conv_id", whole.alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words"))


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(path, words, n, least, ends): equal paths once, with the SHA-256 of their ids. Ids stream through in order."""
    near = conversations.repartition("path").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, words, n, least, ids = None, None, 0, 0, hashlib.sha256()
        for pdf in batches:
            out = []
            for p, w, i in zip(pdf["path"], pdf["words"], pdf["conv_id"].tolist()):
                if p != path:
                    if n:
                        out.append((path, words, n, least, ids.hexdigest()))
                    path, words, n, least, ids = p, w, 1, i, hashlib.sha256(str(i).encode())
                else:
                    n += 1
                    ids.update(f",{i}".encode())
            yield pd.DataFrame(out, columns=["path", "words", "n", "least", "ends"])
        if n:
            yield pd.DataFrame([(path, words, n, least, ids.hexdigest())], columns=["path", "words", "n", "least", "ends"])

    return near.select("conv_id", "path", "words").mapInPandas(run, "path binary, words array<int>, n long, least long, ends string")


class Parentheses:
    """A balanced sequence (opening: true) with findclose over range min-max blocks of its excess."""

    def __init__(self, opening: np.ndarray):
        self.opening = opening
        self.excess = np.cumsum(np.where(opening, 1, -1))
        leaves = max(1, -(-len(opening) // BLOCK))
        width = 1 << (leaves - 1).bit_length()
        padded = np.full(width * BLOCK, np.iinfo(np.int64).max)
        padded[: len(opening)] = self.excess
        self.padded = padded
        lowest = padded.reshape(width, BLOCK).min(axis=1)
        self.levels = [lowest]  # least excess of each block, then of pairs of these, up to the root
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def _scan(self, start: np.ndarray, stop: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first places from ``start`` before ``stop`` with the excess ``goal``, or -1; at most a block is looked at."""
        found = np.full(len(start), -1)
        for step in range(BLOCK):
            at = start + step
            open_ = np.flatnonzero((found < 0) & (at < stop))
            if not len(open_):
                break
            hit = open_[self.padded[at[open_]] == goal[open_]]
            found[hit] = at[hit]
        return found

    def close_of(self, at: np.ndarray) -> np.ndarray:
        """Places of the closing parentheses of the opening ones at ``at``: the next place with one excess less."""
        goal = self.excess[at] - 1
        block = at // BLOCK
        out = self._scan(at + 1, (block + 1) * BLOCK, goal)
        far = np.flatnonzero(out < 0)
        node, level = block[far], np.zeros(len(far), np.int64)
        # Up to the first block to the right (or right sibling of an ancestor) that goes low enough, then down into it.
        climbing = np.ones(len(far), bool)
        for k, lowest in enumerate(self.levels[:-1]):
            now = np.flatnonzero(climbing)
            right = now[(node[now] & 1) == 0]
            right = right[lowest[node[right] + 1] <= goal[far][right]]
            node[right] += 1
            level[right] = k
            climbing[right] = False
            node[np.flatnonzero(climbing)] >>= 1
        for k in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            node[down] *= 2
            node[down[self.levels[k - 1][node[down]] > goal[far][down]]] += 1
            level[down] = k - 1
        out[far] = self._scan(node * BLOCK, (node + 1) * BLOCK, goal[far])
        return out

    def rank_leaves(self) -> np.ndarray:
        """How many pairs "()" begin before each place."""
        pair = self.opening[:-1] & ~self.opening[1:]
        return np.r_[0, np.cumsum(pair), pair.sum()][: len(self.opening) + 1]


def _least_in(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minima of values[first:last] for all pairs of bounds, from minima over powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    power = np.frexp((last - first).astype(float))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(power):
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(table[k][first[at]], table[k][last[at] - (1 << k)])
    return out


#: What a row brings for each depth of its path (from the root): members that are in no node below, their least id, and
#: children, leaves and savings of the subtrees that hang off there; the digest of the ids that end there, or null.
_SUMS = ["n", "kids", "leaves", "saved"]


def encode(paths: list[bytes], words: list[np.ndarray], brought: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
    """All nodes of the trie of sorted, distinct paths, in its order: the columns of a final row, and ``spine``."""
    digests = [np.frombuffer(p, f"S{_DIGEST}") if p else np.zeros(0, f"S{_DIGEST}") for p in paths]
    lengths = np.array([len(d) for d in digests])
    shared = np.zeros(len(paths), np.int64)  # depth of the node shared with the path before
    for i in range(1, len(paths)):
        k = min(lengths[i - 1], lengths[i])
        apart = np.flatnonzero(digests[i - 1][:k] != digests[i][:k])
        shared[i] = apart[0] if len(apart) else k
    new = lengths - shared
    new[0] += 1  # the root
    opening = np.repeat(np.tile([False, True], len(paths)), np.stack([np.r_[0, lengths[:-1] - shared[1:]], new], axis=1).ravel())
    opening = np.r_[opening, np.zeros(2 * new.sum() - len(opening), bool)]
    tree = Parentheses(opening)
    at = np.flatnonzero(opening)
    close = tree.close_of(at)
    depth = tree.excess[at] - 1
    nodes, size = len(at), (close - at + 1) // 2
    first = np.arange(nodes)

    # Nodes of each path by depth, their parents, names (MD5 of the path so far) and words.
    sums = {c: np.zeros(nodes, np.int64) for c in _SUMS}
    least, ends, parent = np.full(nodes, _NO_ID), np.full(nodes, None, object), np.full(nodes, -1)
    name, weight, stack, hashes = np.empty(nodes, object), np.zeros(nodes, np.int64), np.zeros(lengths.max(initial=0) + 1, np.int64), {0: hashlib.md5(b"")}
    spine, made = np.zeros(nodes, bool), 0
    for i, (path, length) in enumerate(zip(paths, lengths.tolist())):
        low = length + 1 - int(new[i])
        for d in range(low, length + 1):
            if d:
                hashes[d] = hashes[d - 1].copy()
                hashes[d].update(path[(d - 1) * _DIGEST : d * _DIGEST])
                parent[made], weight[made] = stack[d - 1], words[i][d - 1]
            name[made], stack[d], made = hashes[d].digest(), made, made + 1
        line = stack[: length + 1]
        for c in _SUMS:
            sums[c][line] += brought[c][i]
        least[line] = np.minimum(least[line], brought["least"][i])
        for d in np.flatnonzero([e is not None for e in brought["ends"][i]]):
            ends[line[d]] = brought["ends"][i][d]
        if i in (0, len(paths) - 1):
            spine[line] = True

    before = lambda x: np.r_[0, np.cumsum(x)]
    within = lambda x: before(x)[first + size] - before(x)[first]
    n = within(sums["n"])
    rank = tree.rank_leaves()
    # Of the pairs "()" those with children that hang off elsewhere are no leaves.
    leaves = rank[close] - rank[at] + within(sums["leaves"]) - within((size == 1) & (sums["kids"] > 0))
    kids = sums["kids"] + np.bincount(parent[parent >= 0], minlength=nodes)
    own_saved = (n - 1) * weight
    return {
        "name": name, "parent": parent, "depth": depth, "least": _least_in(least, first, first + size), "n": n, "kids": kids, "leaves": leaves,
        "saved": within(own_saved + sums["saved"]), "ends": ends, "spine": spine, "own": sums, "own_least": least, "size": size,
    }


_NODE = "name binary, conv_id long, depth long, parent_conv_id long, above binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SPINE = "path binary, words array<int>, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"


def _spines(paths: list[bytes], words: list[np.ndarray], made: dict) -> list[tuple]:
    """The first and the last path with what hangs off each of their nodes; a node of both is told in the first."""
    spine, parent = made["spine"], made["parent"]
    hang = np.flatnonzero(~spine & spine[parent])  # roots of the subtrees that hang off
    add = {c: made["own"][c].copy() for c in _SUMS}
    least = made["own_least"].copy()
    for c in _SUMS:
        np.add.at(add[c], parent[hang], 1 if c == "kids" else made[c][hang])
    np.minimum.at(least, parent[hang], made["least"][hang])
    lines = np.flatnonzero(spine)
    # In the order of the trie the first path's nodes come first; the last path's others follow.
    first = lines[: len(paths[0]) // _DIGEST + 1]
    out, told = [], 0
    for i in dict.fromkeys((0, len(paths) - 1)):
        length = len(paths[i]) // _DIGEST + 1
        if i:
            rest = lines[len(first):]
            told = length - len(rest)
            line = np.r_[np.full(told, -1), rest]
        else:
            line = first
        pick = lambda x, none: [none if j < 0 else x[j] for j in line.tolist()]  # noqa: E731, B023
        out.append((paths[i], words[i].tolist(), *[[int(v) for v in pick(x, none)] for x, none in ((add["n"], 0), (least, _NO_ID), (add["kids"], 0), (add["leaves"], 0), (add["saved"], 0))], pick(made["ends"], None)))
    return out


def _shard(paths: list[bytes], words: list[np.ndarray], brought: dict, last: bool) -> pd.DataFrame:
    """The final nodes of a shard and, unless it is the only one, its spines, as rows of both columns."""
    made = encode(paths, words, brought)
    done = np.flatnonzero(~made["spine"] | last)
    parent = made["parent"][done]
    known = (parent >= 0) & (last | ~made["spine"][parent])
    text = lambda values, mask: [v if m else None for v, m in zip(values, mask)]
    nodes = {
        "name": made["name"][done], "conv_id": made["least"][done], "depth": made["depth"][done],
        "parent_conv_id": text(made["least"][parent].tolist(), known), "above": text(made["name"][parent], (parent >= 0) & ~known),
        "n_convs": made["n"][done], "n_children": made["kids"][done], "n_leaves": made["leaves"][done], "saved_tokens": made["saved"][done],
        "ends_sha256": [e or _NONE for e in made["ends"][done]],
    }
    rows = [dict(zip(nodes, r)) for r in zip(*[v.tolist() if isinstance(v, np.ndarray) else v for v in nodes.values()])]
    spines = [] if last else [dict(zip(("path", "words", "n", "least", "kids", "leaves", "saved", "ends"), s)) for s in _spines(paths, words, made)]
    return pd.DataFrame({"node": rows + [None] * len(spines), "spine": [None] * len(rows) + spines})


def _level(sorted_paths: DataFrame, shard_turns: int, last: bool) -> DataFrame:
    """(node, spine) of all shards of a level; a shard is a run of sorted rows within a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths: list[bytes] = []
        words: list[np.ndarray] = []
        brought: dict[str, list] = {c: [] for c in (*_SUMS, "least", "ends")}
        turns = 0
        for pdf in batches:
            for r in zip(*[pdf[c] for c in ("path", "words", *brought)]):
                if turns > shard_turns and len(paths) >= LEAST_PATHS and not last:
                    yield _shard(paths, words, brought, last)
                    paths, words, brought, turns = [], [], {c: [] for c in brought}, 0
                paths.append(bytes(r[0]))
                words.append(r[1])
                for c, v in zip(brought, r[2:]):
                    brought[c].append(v)
                turns += len(r[1]) + 1
        if paths:
            yield _shard(paths, words, brought, last)

    node = "node struct<" + ", ".join(": ".join(c.split(" ")) for c in _NODE.split(", ")) + ">"
    spine = "spine struct<" + ", ".join(": ".join(c.split(" ")) for c in _SPINE.split(", ")) + ">"
    return sorted_paths.mapInPandas(run, f"{node}, {spine}")


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of (path, words, n, least, ends), equal paths being one row."""
    def at_end(value: Column, none: Column) -> Column:
        return F.concat(F.array_repeat(none, F.size("words")), F.array(value))

    zero = F.lit(0).cast("long")
    rows = stage(paths.select(
        "path", "words", at_end(F.col("n"), zero).alias("n"), at_end(F.col("least"), F.lit(int(_NO_ID))).alias("least"), *[at_end(zero, zero).alias(c) for c in ("kids", "leaves", "saved")],
        at_end(F.col("ends"), F.lit(None).cast("string")).alias("ends")))
    found = []
    while True:
        turns, count = rows.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0)), F.count(F.lit(1))).first()
        last = turns <= shard_turns or count <= LEAST_PATHS
        # Enough paths in each shard, however long, that the next level has fewer.
        shards = max(1, min(groups_for(turns, shard_turns), count // LEAST_PATHS))
        near = rows.repartition(1) if last else rows.repartitionByRange(shards, "path")
        level = stage(_level(near.sortWithinPartitions("path"), shard_turns, last))
        found.append(level.filter("node IS NOT NULL").select("node.*"))
        if last:
            break
        rows = stage(again(level).filter("spine IS NOT NULL").select("spine.*"))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    # A node below a spine learns its parent's least id where that became final.
    known = nodes.filter("above IS NULL")
    parents = nodes.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_found"))
    below = nodes.filter("above IS NOT NULL").join(parents, "above").withColumn("parent_conv_id", F.col("parent_found"))
    return known.drop("above", "name").unionByName(below.drop("above", "name", "parent_found"))


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    paths = distinct_paths(rebuilt(conversations))
    return trie(paths, shard_turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
