import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import prefix_trie

CONVERSATION = "conv_id long, turn long, role string, text string, path string, n int, words string"


def brute(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(x, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: 0 for p in nodes}
    leaves, saved = dict(kids), dict(kids)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].split()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(n=160, seed=4):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        first = "system: hot" if draw.random() < 0.5 else draw.choice(["a b", "c", None])
        rows.append((c, 0 if c % 7 else None, draw.choice(["system", None]), first, "p", 1, "w"))
        for t in range(draw.choice([0, 1, 2, 3, 3, 12])):
            rows.append((c, t + 1, draw.choice(["user", "user", "assistant"]), draw.choice(["a b c", "d", "", None]), None, None, None))
    rows += [(1000 + i, t, "user", f"copy {t}", None, None, None) for i in range(40) for t in range(5)]
    rows += [(2001, t, "user", "repeat", None, None, None) for t in (1, 1, 1, None)] + [(None, 1, "user", "no id", None, None, None)]
    return rows + [(3001, t, "user", f"long {t}", None, None, None) for t in range(300)] + [((1 << 53) + 1, 0, "user", "a b", None, None, None)]


@pytest.mark.parametrize("shard_turns", [1 << 17, 60, 1])
def test_nodes_equal_brute_force_over_any_shards(spark, shard_turns):
    rows = talks()
    got = prefix_trie.prefix_nodes(spark.createDataFrame(rows, CONVERSATION), shard_turns)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_closing_places_and_leaf_pairs():
    draw = random.Random(8)
    for size in (1, 2, 40, 3000):
        bits, open_ = [], 0
        while len(bits) < 2 * size:
            left = 2 * size - len(bits)
            up = open_ == 0 or (open_ < left and draw.random() < 0.55)
            bits.append(up)
            open_ += 1 if up else -1
        bits = np.array([True, *bits, False])
        stack, close = [], {}
        for i, b in enumerate(bits.tolist()):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree, at = prefix_trie.Parentheses(bits), np.flatnonzero(bits)
        assert tree.close_of(at).tolist() == [close[i] for i in at.tolist()]
        assert tree.rank_leaves()[-1] == sum(close[i] == i + 1 for i in at.tolist())


def test_turnless_absent_base_and_no_rows(spark):
    rows = [(c, 0, "user", "x", None, None, None) for c in range(21, 40)]
    got = prefix_trie.prefix_nodes(spark.createDataFrame(rows, CONVERSATION))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], CONVERSATION)).count() == 0
