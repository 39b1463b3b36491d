from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import quality
from barloom.llm.queries import tokenizer_path

from .fixtures import frame, rows
from .test_corpus import quality_rows
from .test_dedup import brute_components, brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stored(spark, tmp_path):
    good = [(i + 1000, t, "en", f"q{i % 3}", len(t), None, None, None, None) for i, t, _ in quality_rows()]
    frame(spark, rows() + good).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 1000, g) for i, _, g in quality_rows()], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_every_stage_against_brute_force(spark, tmp_path):
    sf_dir = stored(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen[name] = (docs.collect(), stage(spark, docs, sf_dir))
        seen[name][1].write.parquet(f"{sf_dir}/{n}")
        docs = spark.read.parquet(f"{sf_dir}/{n}")
        seen[name] = (seen[name][0], docs.collect())
        if n < 4:
            assert sorted(docs.columns) == sorted(COLUMNS)

    # Quality: the same model, applied to each text in plain Python.
    before, after = seen["quality_classifier"]
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score = model.score(np.stack([quality.features(r.text) for r in before]))
    assert Counter(map(str, after)) == Counter(str(r) for r, s in zip(before, score) if s >= 0.7)
    labels = {i + 1000: g for i, _, g in quality_rows()}
    kept = {r.doc_id for r in after}
    assert np.mean([(i in kept) == bool(g) for i, g in labels.items()]) > 0.98

    before, after = seen["exact_dedup"]
    largest = {}
    for r in before:
        key = -1 if r.doc_id is None else r.doc_id
        largest[r.text or ""] = max(largest.get(r.text or "", -1), key)
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in after) == Counter(largest.items())

    before, after = seen["simhash_near_dedup"]
    label = brute_components([brute_print(r.text) for r in before])
    least = {}
    for r, part in zip(before, label):
        least[part] = min(least.get(part, 1 << 60), 1 << 60 if r.doc_id is None else r.doc_id)
    assert sorted(1 << 60 if r.doc_id is None else r.doc_id for r in after) == sorted(least.values())

    before, after = seen["source_mixing"]
    own, mixed = Counter(before), Counter(after)
    assert set(mixed) <= set(own) and all(n <= 2 * own[r] for r, n in mixed.items())
    words = lambda counted: sum(n * len((r.text or "").split()) for r, n in counted.items())
    assert abs(words(mixed) / words(own) - 1.5) < 0.2

    before, after = seen["best_fit_packing"]
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    want = Counter()
    for r in before:
        want[r.doc_id] += len(encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for p in after:
        got[p.doc_id] += p.length
    assert got == want


def test_run_equals_the_stages_and_reruns_agree(spark, tmp_path):
    sf_dir = stored(spark, tmp_path)
    pick = lambda: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert pick() == pick()


def test_empty_documents(spark, tmp_path):
    frame(spark, []).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
