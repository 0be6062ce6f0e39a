"""The stages one after the other: what each keeps, and odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from millrace.llm import jaccard, quality, substrings
from millrace.llm.common import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Each stage's written result, by its name; the first input has odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "src0", 0), (None, "no id here at all", "en", None, 17)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = {"": docs}
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test-stage")
        out[name] = docs
    return out


def test_columns_and_sizes(kept):
    names = [n for n, _ in pipeline.STAGES]
    for name in names[:-1]:
        assert sorted(kept[name].columns) == sorted(pipeline.COLUMNS)
        assert kept[name].count() > 0
    assert {"doc_id", "sequence_id", "offset"} <= set(kept[names[-1]].columns)


def test_quality_stage_keeps_what_scores_enough(spark, kept):
    forest = quality.train(kept[""], spark.read.parquet(f"{SF}/labels.parquet"))
    want = quality.classify(kept[""], forest).filter(F.col("quality_score") >= 0.3)
    assert want.count() == kept["quality classifier"].count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    good = kept[""].join(labels, "doc_id").count()
    assert kept["quality classifier"].join(labels, "doc_id").count() >= 0.9 * good


def test_one_of_each_class_stays(kept):
    classes = jaccard.link(kept["quality classifier"]).filter("component_id = doc_id").select("doc_id").distinct()
    left = kept["n-gram Jaccard join"].filter("doc_id IS NOT NULL").select("doc_id").distinct()
    assert sorted(r[0] for r in classes.collect()) == sorted(r[0] for r in left.collect())


def test_repeats_go(kept):
    again = substrings.remove_repeats(kept["n-gram Jaccard join"])
    want = again.filter("n_removed < n_bytes OR n_bytes = 0").agg(F.sum(F.length("text")), F.count("*")).first()
    got = kept["suffix-array dedup"].agg(F.sum(F.length("text")), F.count("*")).first()
    assert tuple(want) == tuple(got)


def test_mix_takes_one_and_a_half_times_the_words(kept):
    words = lambda df: df.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()[0]
    before, after = words(kept["suffix-array dedup"]), words(kept["mixing sources to target weights"])
    assert after == pytest.approx(1.5 * before, abs=25)
    assert kept["best-fit packing"].select("doc_id").distinct().count() <= kept["suffix-array dedup"].count()


def test_empty_table_runs_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
