"""A pipeline over the text operators: quality, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, packing, quality, substrings
from millrace.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# No stage but the first could be said in SQL, and that learns its trees from the labels.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels beside the documents.

    Null texts are scored as empty ones, repeated rows alike, and long texts whole. Columns beside those
    of ``documents`` are dropped, here and in every stage. No labels: every score is one half, which accepts.
    """
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.classify(docs, forest)
    return _columns(scored.filter(F.col("quality_score") >= quality.PREDICT_FROM))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    Texts that are null or have no words are near nothing and stay. Rows that repeat a kept id stay with it,
    and rows with a null id, which link with nothing, stay too. Of equal texts the smallest id stays.
    """
    classes = jaccard.link(docs)
    rest = classes.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    # the same join at every size: the others grow with the documents
    return _columns(docs.join(rest.hint("merge"), "doc_id", "left_anti"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings that earlier ones hold; those with nothing left go.

    Null texts stay null, empty ones stay; rows of one id do not shorten each other; null ids count as one
    id before all others. n_chars counts what is left.
    """
    left = substrings.remove_repeats(_columns(docs))
    left = left.withColumn("n_chars", F.length("text").cast("long"))
    return _columns(left.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0)))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, in order of their training positions.

    A pass that takes only the first words of a document has a row with those words. Null sources are one
    source; documents without words, null texts among them, are never taken; ties in the walk's hash go by
    doc_id and size.
    """
    return _columns(mixing.training_rows(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences: a row for each piece, null texts as empty ones."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
