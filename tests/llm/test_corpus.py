import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing, ngram_lm, packing, quality
from barloom.llm.queries import tokenizer_path

from .fixtures import frame, rows

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Shares by weight; whoever is above its limit is fixed there and the rest shared anew."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 2.0 * sizes[s] for s in free if share[s] > 2.0 * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above


def test_mix_meets_targets_and_repeats(spark):
    data = rows()
    size = Counter()
    for r in data:
        size[r[3]] += len(WORD.findall((r[1] or "").encode()))
    want = brute_targets(size)
    docs = frame(spark)
    out, slots = mixing.mix(docs, block_words=16, shard_blocks=32)
    got = out.collect()
    assert Counter((g.doc_id, g["size"]) for g in got) == Counter((r[0], len(WORD.findall((r[1] or "").encode()))) for r in data)
    taken = Counter()
    for g in got:
        assert g.source_size == size[g.source]
        assert g.target == pytest.approx(want[g.source])
        assert 0 <= g.taken <= 2 * g["size"]
        taken[g.source] += g.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 8
    again = mixing.mix(docs.repartition(3), block_words=16, shard_blocks=32)[0].collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    blocks = slots.groupBy("source", "epoch", "block").agg(F.countDistinct("shard").alias("n")).collect()
    assert {b.n for b in blocks} == {1} and max(b.epoch for b in blocks) <= 1


def test_shard_counts_follow_the_weights(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.lit(200)).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    _, slots = mixing.mix(docs, weights=(2, 1), block_words=20, shard_blocks=500)
    counts = {(r.shard, r.source): r.n for r in slots.select("shard", "source", "epoch", "block").distinct().groupBy("shard", "source").agg(F.count("*").alias("n")).collect()}
    shares = [counts[s, "a"] / (counts[s, "a"] + counts[s, "b"]) for s in range(9)]
    assert np.std(shares) > 0.003 and abs(np.mean(shares) - 2000 / 4500) < 0.05


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection(spark, size):
    df = spark.range(size).select("id", F.lit(size).cast("long").alias("size"), F.lit(4).alias("key"))
    image = [r.id for r in mixing.permuted(df, "id", "size", "key").collect()]
    assert sorted(image) == list(range(size))
    back = mixing.permuted(mixing.permuted(df.withColumn("was", F.col("id")), "id", "size", "key"), "id", "size", "key", back=True)
    assert back.filter("id <> was").count() == 0
    assert size < 50 or np.mean(np.array(image) == np.arange(size)) < 0.1


@pytest.mark.parametrize("copies", [1, 3])
def test_small_sources_do_not_vanish(spark, copies):
    # Sources of 1 to 150 words, several documents each, beside a large one; blocks of the production size.
    data = [(n * 10 + k, "w " * (n if copies == 1 else n // copies + (k < n % copies)), f"s{n:03d}") for n in range(1, 151) for k in range(copies)]
    data += [(5000 + i, "w " * 100, "z") for i in range(20)]
    out = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"))[0].collect()
    taken, target, size = Counter(), {}, {}
    for g in out:
        taken[g.source] += g.taken
        target[g.source], size[g.source] = g.target, g.source_size
        assert g.taken <= 2 * g["size"]
    assert brute_targets(size) == pytest.approx(target)
    assert min(taken.values()) > 0 and len(taken) == 151
    assert max(abs(taken[s] - target[s]) for s in taken) <= 64
    whole = [s for s in taken if target[s] == 2 * size[s]]
    assert whole and all(taken[s] == target[s] for s in whole)


@pytest.mark.parametrize("big", [0, 3000])
def test_copies_of_a_source_come_near_its_words(spark, monkeypatch, big):
    draw = np.random.default_rng(2)
    data = [(i, "w " * int(draw.integers(1, 60)), ["a", "b", None][i % 3]) for i in range(600)] + ([(9000, "w " * big, "b")] if big else [])
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mixed_documents(docs).collect()
    target = {r.source: r.target for r in mixing.mix(docs)[0].collect()}
    for source, want in target.items():
        got = sum(len(r.text.split()) for r in out if r.source == source)
        longest = max(len(t.split()) for _, t, s in data if s == source)
        assert abs(got - want) <= longest + 64, source
    assert max(Counter(r.doc_id for r in out).values()) <= 2


def test_mixed_documents_keeps_columns(spark):
    docs = frame(spark).withColumnsRenamed({"digest": "part", "spans": "copies", "rules": "row"}).withColumn("from", F.lit(1))
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    own = Counter((r[0], r[1]) for r in rows())
    assert all(n <= 2 * own[k] for k, n in times.items())


def lm_tokens(text):
    return WORD.findall((text or "").encode().translate(LOWER)) + [b""]


def test_lm_scores_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(ngram_lm, "BUCKET_KEYS", 700)
    data = rows()
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 1 for r in data]
    count, pairs = Counter(), Counter()
    for r, h in zip(data, held):
        if not h:
            t = lm_tokens(r[1])
            count.update(t)
            pairs.update(zip([b""] + t[:-1], t))
    n, v, m = sum(count.values()), len(count), 3.0

    def p1(w):
        return (count[w] + 0.5) / (n + 0.5 * (v + 1))

    want = Counter()
    for r, h in zip(data, held):
        t = lm_tokens(r[1])
        base = sum(math.log10(p1(w)) for w in t)
        full = sum(math.log10((pairs[a, w] + m * p1(w)) / (count[a] + m)) for a, w in zip([b""] + t[:-1], t))
        want[r[0], h, len(t), sum(count[w] > 0 for w in t), n, round(base, 6), round(full, 6)] += 1
    got = ngram_lm.score(frame(spark), ngram_lm.crc_remainder(F.col("doc_id"), 5) == 1, prior=m).collect()
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 6)) for g in got) == want


def test_lm_probabilities_add_up_to_one(spark):
    # Texts of one word: the chances of all words at the start, of the end token and of one unseen word are all there is.
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b b"), (3, "a"), (4, "b"), (5, "c"), (6, "unseen"), (7, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram_lm.score(docs, F.col("doc_id") > 2).collect()}
    count, n, v, m = {"a": 2, "b": 3, "c": 1, "": 2}, 8, 4, ngram_lm.PRIOR
    first = {"a": 1, "b": 1}
    p1 = {w: (c + 0.5) / (n + 0.5 * (v + 1)) for w, c in (count | {"u": 0}).items()}
    start = {w: (first.get(w, 0) + m * p1[w]) / (2 + m) for w in p1}
    assert sum(start.values()) == pytest.approx(1.0)
    assert got[7] == pytest.approx(math.log10(start[""]))
    end_after_c = (1 + m * p1[""]) / (1 + m)
    assert got[5] == pytest.approx(math.log10(start["c"]) + math.log10(end_after_c))


def test_lm_edges(spark):
    assert ngram_lm.score(frame(spark, []), F.lit(True)).count() == 0
    only_held_out = ngram_lm.score(frame(spark), F.lit(True)).collect()
    assert len(only_held_out) == len(rows()) and {g.train_tokens for g in only_held_out} == {0}


def quality_rows(n=400):
    draw = np.random.default_rng(1)
    words = ["tree", "house", "river", "stone", "cloud", "light", "winter", "garden"]
    out = []
    for i in range(n):
        text = " ".join(draw.choice(words, 40)).capitalize() + "."
        good = i % 4 != 0
        if not good:
            text = (text.upper() if i % 8 else (text[:30] + "\n") * 8) + "!!! $$$"
        out.append((i, text, int(good)))
    return out


def test_quality_learns_the_labels(spark):
    data = quality_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.pmod("doc_id", F.lit(4)) < 4)
    scored = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert np.mean([(scored[i] >= 0.7) == bool(g) for i, _, g in data]) > 0.98


def test_quality_held_out_and_edges(spark):
    data = quality_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") < 250)
    scored = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    held = [(scored[i], g) for i, _, g in data if i >= 250]
    assert np.mean([(s >= 0.7) == bool(g) for s, g in held]) > 0.9
    odd = quality.score(frame(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r.quality_score <= 1 for r in odd)
    assert quality.score(frame(spark), model).columns == [*frame(spark).columns, "quality_score"]
    assert quality.score(frame(spark, []), model).count() == 0
    alone = quality.train(docs, labels.filter("quality = 1"), F.lit(True))
    assert {r.quality_score for r in quality.score(docs, alone).collect()} == {0.5}


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    data = rows() + [(500, "an <|endoftext|> inside,  two  blanks\tand é́ composed", "en", "s0", 1, None, None, None, None)]
    got = packing.pack(frame(spark, data), tokenizer_path(), max_tokens=256, with_ids=True).collect()
    want = Counter()
    for r in data:
        ids = np.array(encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            piece = ids[at : at + 256].tobytes()
            want[r[0], k, at, len(piece) // 4, zlib.crc32(piece), piece] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32, bytes(g.ids)) for g in got) == want
    in_sequence = {}
    for g in got:
        in_sequence.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for members in in_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 256


ODD = [
    "Une été maison. Été\tmaison, MAISON! été? Maison", "it's. IT'S... they're, o'clock 'tis 'S", "3.5, a1.b2; x.&&& &. $$$. l'été.",
    "ÀÞ ÿ ß ª º µ «été» naïve.Café", "H\u0331. h\u0331 \u0130stanbul ΣΑΣ. Ünïcode\u2019s été. MAISON.", "a\u0085b c\u00a0d.\x1ce \x00f. g\ufeffh",
    "an <|endoftext|>. <|ENDOFTEXT|> End.<|startoftext|>Été.", "", None, " ", ".", "...", "日本。 語. été", "a\r\nb.\x0bc\x0c d",
]


def test_encoder_against_the_tokenizer_with_a_small_table(monkeypatch):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    coder = packing.Encoder(tokenizer_path())
    for texts in [ODD, ODD[::-1], *[[t] for t in ODD], ODD]:
        # A slice, as turns of a batch are.
        ids, ends = coder.batch(pa.array(["before", *texts]).slice(1))
        got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
        assert got == [encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    coder.batch(pa.array(["one two"]))
    assert sorted(coder.words.to_pylist()) == [" ", "one", "two"]


def test_encoder_meets_a_word_once_in_any_form():
    coder, met = packing.Encoder(tokenizer_path()), []
    model, whole = coder.model, coder.encode
    coder.model = lambda word: met.append(word) or model(word)
    coder.encode = lambda part, **more: met.append(part) or whole(part, **more)
    for _ in range(2):
        coder.batch(pa.array(["Une été maison. Été\nmaison, MAISON! Été?\tune"]))
    assert len(met) == 3 + 4


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_packing_keeps_every_capacity(rule):
    lengths = np.random.default_rng(4).integers(1, 400, 700)
    for documents, attention in ((2048, None), (3, None), (2048, 170_000), (2048, 90_000)):
        attention = attention or 512**2
        if attention < 399**2:
            with pytest.raises(ValueError):
                packing.pack_lengths(lengths, 512, documents, attention, rule=rule)
            continue
        bins, _ = packing.pack_lengths(lengths, 512, documents, attention, rule=rule)
        for b in np.unique(bins):
            mine = lengths[bins == b]
            assert mine.sum() <= 512 and len(mine) <= documents
            assert (mine**2).sum() <= attention
    bins, _ = packing.pack_lengths(lengths, 512, rule=rule)
    assert len(np.unique(bins)) <= 1.02 * math.ceil(lengths.sum() / 512) + 1


def test_packing_attention_capacity_binds():
    lengths = np.full(10, 100)
    bins, _ = packing.pack_lengths(lengths, 1000, max_attention=30_000)
    assert np.bincount(bins).max() == 3
    with pytest.raises(ValueError):
        packing.pack_lengths(lengths, 1000, max_attention=5_000)


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0
    assert mixing.mix(frame(spark, []))[0].count() == 0
