import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, packing, simhash, similar, substring_dedup
from barloom.llm.queries import tokenizer_path
from barloom.llm.stage import stage

from .fixtures import frame, rows

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("size", [1, 2, 3, 100, 5000])
def test_fuse_filter_holds_all_keys_and_few_others(size):
    keys = np.unique(np.random.default_rng(size).integers(0, 2**63, size).astype(np.uint64))
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.may_contain(built, keys).all()
    others = np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64)
    assert exact_dedup.may_contain(built, others).mean() < 0.001


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_against_dictionary(spark, weak):
    # With a digest of two values almost every member fails the byte check and is grouped by its text.
    digest = F.pmod(F.length(F.coalesce("text", F.lit(""))), F.lit(2)).cast("string") if weak else None
    got = exact_dedup.exact_groups(frame(spark), F.pmod(F.xxhash64("doc_id"), F.lit(3)), digest=digest).collect()
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r[0], keep[r[1] or ""], len(groups[r[1] or ""])) for r in rows())
    assert Counter((g.doc_id, g.keep_id, g.group_size) for g in got) == want
    assert sum(g.kept for g in got) == len(groups)
    assert all(g.doc_id == g.keep_id for g in got if g.kept)
    if not weak:
        assert {g.digest for g in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_exact_keep_one_returns_whole_rows(spark):
    kept = exact_dedup.keep_one(frame(spark), F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    assert kept.columns == frame(spark).columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows()})


def brute_print(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if label[j] < label[i] and (a ^ b).bit_count() <= radius:
                    label[i], changed = label[j], True
    return label


def test_simhash_components_against_all_pairs(spark):
    data = rows()
    prints = [brute_print(r[1]) for r in data]
    label = brute_components(prints)
    least = {}
    for r, part in zip(data, label):
        if r[0] is not None:
            least[part] = min(least.get(part, r[0]), r[0])
    want = Counter((r[0], p, least.get(part)) for r, p, part in zip(data, prints, label))
    got = simhash.near_components(frame(spark)).select("doc_id", simhash.hex_print(F.col("fp")).alias("p"), "component_id").collect()
    assert Counter((g.doc_id, int(g.p, 16), g.component_id) for g in got) == want


def test_covering_tables_miss_no_pair():
    draw = np.random.default_rng(0)
    tables = simhash.masks(4)
    assert len(tables) == 31
    for _ in range(3000):
        diff = sum(1 << int(i) for i in draw.choice(64, draw.integers(1, 5), replace=False))
        assert any(diff & m == 0 for m in tables)


def test_hot_buckets_are_tiled_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    draw = np.random.default_rng(5)
    centre = int(draw.integers(0, 2**62))
    prints = sorted({centre ^ sum(1 << int(i) for i in draw.choice(62, 3, replace=False)) for _ in range(80)} | {int(x) for x in draw.integers(0, 2**62, 40)})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {r.node: r.root for r in simhash.stars(simhash.near_edges(nodes)).collect()}
    label = brute_components(prints)
    assert [root.get(p, p) for p in prints] == [prints[part] for part in label]


def test_simhash_keep_one(spark):
    kept = simhash.keep_one(frame(spark)).collect()
    assert len(kept) == len(set(brute_components([brute_print(r[1]) for r in rows()])))


def brute_removed(data, length):
    first = {}
    for i, raw in data:
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in data:
        keep = np.ones(len(raw), bool)
        for a in range(len(raw) - length + 1):
            if first[raw[a : a + length]] < i:
                keep[a : a + length] = False
        spans = sum(1 for a in range(len(raw)) if not keep[a] and (a == 0 or keep[a - 1]))
        left = np.frombuffer(raw, np.uint8)[keep].tobytes()
        out.append((None if i == 2**63 - 1 else i, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup_against_dictionary(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1500)
    if hot:
        monkeypatch.setattr(substring_dedup, "HOT_DOCUMENTS", 2)
    data = [(2**63 - 1 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows()]
    got = substring_dedup.remove_repeats(frame(spark)).collect()
    assert Counter(tuple(g) for g in got) == brute_removed(data, 50)


def test_merged_ranges_cover_the_same_places():
    draw = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 200):
        start = draw.integers(0, 900, n)
        ranges = np.stack([start, start + draw.integers(1, 30, n)], axis=1)
        got = substring_dedup.merged(ranges)
        cover = lambda r: {i for x, y in r.tolist() for i in range(x, y)}
        assert cover(got) == cover(ranges) and (got[1:, 0] > got[:-1, 1]).all()


@pytest.mark.parametrize("hot", [False, True])
def test_ranges_decided_in_a_chunk_are_few_and_spread(spark, monkeypatch, hot):
    """They went, window by window, with the chunk's first row, so those of all chunks to the shard of the smallest number."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 4000)
    if hot:
        monkeypatch.setattr(substring_dedup, "HOT_DOCUMENTS", 2)
    passage = " ".join(f"shared{i}" for i in range(40))
    data = [(i, f"{passage} own{i}", *[None] * 7) for i in range(150)]
    chunked = stage(substring_dedup.chunks(frame(spark, data).coalesce(1)))
    shared = stage(substring_dedup.shared_names(substring_dedup.names(chunked, 3, substring_dedup.LENGTH)))
    sent = substring_dedup.pieces(chunked, shared, 64, substring_dedup.LENGTH).collect()
    decided = [(r.shard, np.frombuffer(r.removed, np.int64).reshape(-1, 2)) for r in sent if len(r.removed)]
    assert len(decided) == chunked.count() > 10
    assert len({s for s, _ in decided}) > 3
    assert all((x[1:, 0] > x[:-1, 1]).all() for _, x in decided)
    assert max(len(x) for _, x in decided) <= 12


def test_suffix_array_is_sorted():
    draw = np.random.default_rng(2)
    for alphabet in (1, 2, 30):
        data = np.r_[draw.integers(97, 97 + alphabet, 700).astype(np.uint8), np.zeros(58, np.uint8)]
        order = substring_dedup.suffix_array(data, 50)
        cut = [data[i : i + 50].tobytes() for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(700))
        same = substring_dedup.equal_windows(data, order, 50)
        assert same.tolist() == [False] + [a == b for a, b in zip(cut, cut[1:])]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none, F.lit(0)).count() == 0
    assert simhash.near_components(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def shingles(text, k=5):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited_texts():
    """Texts and copies with words changed here and there, and one boilerplate sentence in many others."""
    draw = np.random.default_rng(12)
    word = lambda: f"w{draw.integers(0, 3000)}"
    notice = " ".join(word() for _ in range(12))
    out = []
    for k in range(40):
        base = [word() for _ in range(int(draw.integers(3, 260)))]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(int(draw.integers(0, 6))):
                copy[int(draw.integers(0, len(copy)))] = word()
            out.append(" ".join(copy))
        out.append(" ".join(word() for _ in range(30)) + " " + notice)
        out.append(notice + f" {k}")
    return out


@pytest.mark.parametrize("hot", [2, 1000])
def test_similar_components_miss_no_pair(spark, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT_TEXTS", hot)
    data = rows() + [(1000 + i, t, *[None] * 7) for i, t in enumerate(edited_texts())]
    sets = [shingles(r[1]) for r in data]
    label, changed = list(range(len(data))), True
    links = [(i, j) for i in range(len(data)) for j in range(i) if alike(sets[i], sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != label[j]:
                label[i] = label[j] = low
                changed = True
    prints = [brute_print(r[1]) for r in data]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in links) > 50
    least = {}
    for r, part in zip(data, label):
        least[part] = min(least.get(part, 1 << 60), 1 << 60 if r[0] is None else r[0])
    got = similar.keep_one(frame(spark, data)).collect()
    assert sorted(1 << 60 if r.doc_id is None else r.doc_id for r in got) == sorted(least.values())
    assert similar.keep_one(frame(spark, [])).count() == 0


def test_near_copies_of_the_pipeline_reach_the_similarity(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    near = " ".join("changed" if i in (50, 100, 150) else w for i, w in enumerate(words))
    docs = frame(spark, [(1, " ".join(words), *[None] * 7), (2, near, *[None] * 7)])
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [1]
    assert (brute_print(" ".join(words)) ^ brute_print(near)).bit_count() > 4


def test_near_copies_of_the_pipeline_link_by_simhash(spark):
    """Texts of one passage stay below the similarity; those whose fingerprints lie within the radius are linked all the same."""
    import corpus_pipeline

    passage = " ".join(f"shared{i}" for i in range(150))
    data = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(22)), *[None] * 7) for i in range(120)]
    label = brute_components([simhash.fingerprint(r[1], similar.WORDS) for r in data])
    assert 1 < len(set(label)) < len(data)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, data), "").collect()}
    assert len(kept) == len(set(label)) and len({label[i] for i in kept}) == len(kept)
    assert similar.keep_one(frame(spark, data)).count() == len(data)


def test_texts_of_one_passage_are_no_candidates(spark, monkeypatch):
    """Texts with a long passage in common and more than a ninth of their own cost no pairs, however many they are."""
    from barloom.llm.stage import stage

    monkeypatch.setattr(similar, "HOT_TEXTS", 64)
    met = []
    inner = similar.candidate_pairs
    monkeypatch.setattr(similar, "candidate_pairs", lambda placed, s: met.append(stage(inner(placed, s))) or met[-1])
    passage = " ".join(f"shared{i}" for i in range(150))
    for n, pure in ((300, 0), (600, 0), (600, 6)):
        data = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(22)), *[None] * 7) for i in range(n)]
        # The passage alone is as much as 0.86 of each of them, and links them all.
        data += [(n + i, passage + f" tail{i % 3}", *[None] * 7) for i in range(pure)]
        kept = {r.doc_id for r in similar.keep_one(frame(spark, data)).collect()}
        assert kept == ({0} if pure else {*range(n)})
        assert met[-1].count() <= 20


def test_near_copies_where_some_texts_hold_no_hot_phrase(spark, monkeypatch):
    # Partitions without a text of the phrase answer with no rows at all.
    monkeypatch.setattr(similar, "HOT_TEXTS", 3)
    phrase = " ".join(f"p{i}" for i in range(40))
    data = [(i, f"{phrase} {i}", "en", "s", 1, None, None, None, None) for i in range(8)]
    data += [(100 + i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 1, None, None, None, None) for i in range(24)]
    kept = {r.doc_id for r in similar.keep_one(frame(spark, data)).collect()}
    assert kept == {0, *range(100, 124)}


def test_stage_of_few_rows_is_few_files(spark):
    many = spark.range(1000).repartition(50, "id")
    assert len(stage(many, 1000).inputFiles()) == 1
    assert sorted(r.id for r in stage(many, 1000).collect()) == list(range(1000))
    edges = spark.range(200).select(F.col("id").alias("u"), F.pmod("id", F.lit(7)).alias("v"))
    linked = simhash.stars(edges.repartition(50, "u"))
    assert len(linked.inputFiles()) == 1
    assert {(r.node, r.root) for r in linked.collect()} == {(i, i % 7) for i in range(7, 200)}


def broadcast_alone(plan):
    """What a plan broadcasts by Spark's guess of its size: the lines below a broadcast, down to what is shuffled and so measured."""
    depth = lambda line: re.search(r"[A-Za-z*]", line).start()
    lines, parts = [x for x in plan.splitlines() if re.search("[A-Za-z]", x)], []
    for i, line in enumerate(lines):
        if "- BroadcastExchange" in line:
            parts.append([])
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line) or "- Exchange" in below:
                    break
                parts[-1].append(below)
    return ["\n".join(p) for p in parts]


def staged_plans(monkeypatch, *modules):
    plans = []

    def seen(df, rows=None):
        plans.append(plan_of(df))
        return stage(df, rows)

    for module in modules:
        monkeypatch.setattr(module, "stage", seen)
    return plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exploded_fingerprints_are_broadcast(spark, monkeypatch):
    """Spark takes an explode for as large as its input: 31 rows for each fingerprint went through the driver's memory."""
    plans = staged_plans(monkeypatch, simhash)
    assert not simhash.near_edges(stage(spark.range(300).select(F.xxhash64("id").alias("fp")))).count()
    assert not [p for plan in plans for p in broadcast_alone(plan) if "Generate" in p]


def test_many_edges_are_not_broadcast(spark, monkeypatch):
    from barloom.llm import stage as stages

    monkeypatch.setattr(stages, "BROADCAST_ROWS", 100)
    plans = staged_plans(monkeypatch, simhash)
    linked = simhash.stars(spark.range(200).select(F.col("id").alias("u"), F.pmod("id", F.lit(7)).alias("v")))
    assert {(r.node, r.root) for r in linked.collect()} == {(i, i % 7) for i in range(7, 200)}
    assert not [p for plan in plans for p in broadcast_alone(plan) if "Generate" in p]
    assert any("SortMergeJoin" in plan for plan in plans)


def test_no_exploded_shingles_are_broadcast(spark, monkeypatch):
    plans = staged_plans(monkeypatch, simhash, similar)
    assert similar.similar_components(frame(spark), radius=4).count() == len(rows())
    placed = stage(spark.range(50).selectExpr("id % 5 AS key", "id AS node", "CAST(40 + id % 3 AS INT) AS n", "CAST(id % 2 AS INT) AS place", "id AS root"))
    plans.append(plan_of(similar.candidate_pairs(placed)))
    assert any("Generate" in plan for plan in plans)
    assert not [p for plan in plans for p in broadcast_alone(plan) if "Generate" in p]


def test_tables_of_a_row_a_document_are_not_broadcast(spark, monkeypatch):
    """Digests and pieces are read as small files, of which a broadcast would make many times as much."""
    plans = staged_plans(monkeypatch, exact_dedup)
    assert exact_dedup.exact_groups(frame(spark), F.pmod(F.xxhash64("doc_id"), F.lit(3))).count() == len(rows())
    assert not [p for plan in plans for p in broadcast_alone(plan) if "xxhash64(digest" in p]
    plans = [plan_of(packing.pack(frame(spark), tokenizer_path()))]
    assert "SortMergeJoin" in plans[0] and not broadcast_alone(plans[0])
