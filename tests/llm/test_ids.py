"""Ids above 2^53 beside null ids, and columns with the operators' own names, through every operator that runs Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import quality
from barloom.llm.queries import QUERIES

from .test_corpus import quality_rows

BIG = (1 << 53) + 1


def documents(spark):
    rows = [(i + 5000, t, "en", f"q{i % 2}", BIG + i) for i, t, _ in quality_rows()]
    rows += [(BIG, "some words of a text that is long enough, said once.", "en", "s", BIG), (None, "a text without an id, and of other words.", "en", "s", None), (BIG + 2, None, "en", None, BIG + 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids"))
    documents(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i + 5000, g) for i, _, g in quality_rows()], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", ["op2_lm_scoring", "op4_quality_classifier", "op9_best_fit_packing", "op10_simhash", "op8_suffix_array_dedup"])
def test_ids_are_kept(spark, sf_dir, name):
    want = Counter(r.doc_id for r in documents(spark).collect())
    assert Counter(r.doc_id for r in QUERIES[name](spark, sf_dir).collect()) == want


def test_scores_leave_all_columns_as_they_are(spark):
    docs = documents(spark).withColumns({"quality_score": F.lit("old"), "__tie": F.col("n_chars") + 1, "__share": F.lit(1.5)})
    model = quality.train(docs, docs.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    kept = [c for c in docs.columns if c != "quality_score"]
    scored = quality.score(docs, model)
    assert scored.columns == [*kept, "quality_score"]
    assert Counter(map(tuple, scored.select(*kept).collect())) == Counter(map(tuple, docs.select(*kept).collect()))


def test_pipeline_keeps_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    known = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() and {r.doc_id for r in docs.collect()} <= known
