"""Held-out accuracy of the learned operators, and their odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, quality, toxicity
from millrace.llm.common import held_out

SF = "/root/testdata/sf0.1"
ODD = [(1, None, "en"), (2, "", "en"), (3, "    \n\n", None), (None, "ascii words", "en"), (5, "ÄÖ ß", "de"), (5, "ÄÖ ß", "de"), (6, "12 !!", "en"), (7, "word " * 30_000, "en")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark, docs, labels):
    forest = quality.train(docs, labels)
    out = quality.classify(docs.select("doc_id", "text"), forest).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    right = out.select(F.avg(((F.col("quality_score") >= 0.3) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.97
    odd = quality.classify(spark.createDataFrame(ODD, SCHEMA).withColumn("quality_score", F.lit("clash")), forest)
    rows = odd.collect()
    assert len(rows) == len(ODD) and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert quality.classify(docs.limit(0), forest).count() == 0


def test_quality_without_labels(spark, docs, labels):
    forest = quality.train(docs, labels.limit(0))
    assert forest.score(quality.statistics(["a", None])).tolist() == [0.5, 0.5]


def test_trees_learn_a_rule():
    x = np.random.default_rng(0).random((2000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    assert ((quality.fit(x, y).score(x) > 0.5) == y).mean() > 0.97


def test_statistics_do_not_depend_on_the_block():
    texts = ["one two two", "", None, "é\nb\nb", "A!! B!!"]
    whole = quality.statistics(texts)
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], quality.statistics([t])[0])


def test_toxicity_on_held_out_rows(spark, docs, labels):
    net = toxicity.train(docs, labels)
    out = toxicity.classify(docs.select("doc_id", "text"), net).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    found = out.groupBy("toxic").agg(F.avg((F.col("toxicity") >= 0.5).cast("int")).alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in found}
    assert share[1] > 0.9 and share[0] < 0.02
    rows = toxicity.classify(spark.createDataFrame(ODD, SCHEMA), net).collect()
    assert len(rows) == len(ODD) and all(0 <= r["toxicity"] < 0.5 for r in rows)


def test_toxicity_with_one_class():
    net = toxicity.fit(["a b", "c"], np.array([0, 0]), ["en", None])
    assert (net.scores(["a", None, ""]) < 0.5).all()


def test_language_on_held_out_rows(spark, docs):
    field = language.train(docs, 1000)
    out = language.identify(docs.filter(held_out(F.col("doc_id"))), field)
    assert out.select(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.97
    rows = language.identify(spark.createDataFrame(ODD, SCHEMA), field).collect()
    assert [r["language"] == "und" for r in rows] == [True, True, True, False, False, False, True, False]
    mixed = language.label_words("der und die nicht einach keit the of and with thing ouble", field)
    assert {lang for _, lang, _ in mixed[:4]} == {"de"} and {lang for _, lang, _ in mixed[-4:]} == {"en"}


def test_a_rare_language_is_learned(spark, monkeypatch):
    rows = [(i, "ein Text" if i % 2 else "a text", "de" if i % 2 else "en") for i in range(6000)]
    rows += [(i, "tekst", "nl") for i in range(6000, 6004)] + [(8000, None, "fr"), (8001, "nobody knows", None), (None, "no id", "pt")]
    seen = {}
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.update({x: langs.count(x) for x in langs}, n=len(texts)))
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 500, 300)
    assert seen["nl"] >= 2 and seen["de"] + seen["en"] + seen["nl"] == seen["n"] <= 500 and set(seen) == {"de", "en", "nl", "n"}
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5000, 300)
    assert seen["de"] == seen["en"] == 300


def test_language_without_anything_to_learn(spark):
    field = language.train(spark.createDataFrame([], SCHEMA))
    assert {r["language"] for r in language.identify(spark.createDataFrame(ODD, SCHEMA), field).collect()} == {"und"}


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    local, start, step = rng.random((4, 2)) + 0.1, rng.random(2), rng.random((2, 2))
    p, _ = language.forward_backward(local, np.array([0, 1, 1, 4]), start, step)
    weights = {}
    for path in np.ndindex(2, 2, 2):
        w = start[path[0]]
        for k in range(3):
            w *= local[1 + k, path[k]] * (step[path[k - 1], path[k]] if k else 1)
        weights[path] = w
    total = sum(weights.values())
    for k in range(3):
        assert p[1 + k, 1] == pytest.approx(sum(w for path, w in weights.items() if path[k] == 1) / total)


def test_samples_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5][:40]
    rows = [(i, "en" if i % 2 else "de", f"text {i}") for i in ids]
    rows += [(ids[0], "en", f"again {k}") for k in range(500)] + [(ids[1], "de", "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in ids], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, langs: seen.update(toxic=texts))
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.update(language=texts))
    for most, n in ((1 << 30, 40), (1000, 39)):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", most)
        monkeypatch.setattr(language, "SAMPLE_BYTES", most)
        toxicity.train(docs, labels)
        language.train(docs)
        for texts in seen.values():
            assert len(texts) in (n, 40) and sum(map(len, texts)) <= most
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.update(quality=x))
    quality.train(docs, labels.withColumnRenamed("toxic", "quality"), rows=30)
    assert len(seen["quality"]) == 30


def test_lines_differ_in_their_middle():
    same, other = "one two three four five six seven", "one two three FOUR five six seven"
    repeated, different = (quality.statistics([f"{same}\n{x}"])[0] for x in (same, other))
    assert (repeated != different).any()
    kinds = quality.statistics(["\n".join([same, other, same, "", ""])])[0][-3]
    assert kinds == np.float32(3 / 5)
