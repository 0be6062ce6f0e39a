"""Duplicate postings: clusters by shared signals, the record to keep, and its provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.urls import canonical_url
from millrace.operators.components import components
from millrace.operators.tables import cut


def first_of_source(postings: DataFrame) -> DataFrame:
    """Exact duplicates within a source: the first by ingest_seq stays."""
    key = F.coalesce(F.nullif("external_id", F.lit("")), "url")
    order = Window.partitionBy("source", key).orderBy("ingest_seq")
    return postings.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def told_apart(postings: DataFrame) -> DataFrame:
    """What clusters are found by, written, so that every URL is read once: ingest_seq, identity, canonical and source id."""
    ext = F.concat("source", F.lit(":"), F.nullif("external_id", F.lit("")))
    own = [c for c in ("source", "authority") if c in postings.columns]
    if "description" in postings.columns:
        own.append(F.length("description").alias("n_text"))
    return cut(postings.select("ingest_seq", "identity", canonical_url(F.col("url")).alias("canonical"), ext.alias("ext"), *own), "told")


def _signals(marked: DataFrame) -> DataFrame:
    """(signal, node): canonical URLs and source ids; empty ones give no signal."""
    own = F.array(F.concat(F.lit("url:"), F.nullif("canonical", F.lit(""))), F.concat(F.lit("ext:"), "ext"))
    return marked.select("node", F.explode(own).alias("signal")).filter("signal IS NOT NULL")


def clustered(told: DataFrame) -> DataFrame:
    """What ``told_apart`` wrote, with each posting's cluster: the smallest ingest_seq that shared signals reach.

    Postings of one identity are one node from the start, named by the first of them, so that an identity that
    many share costs a row of an aggregation and links are drawn between nodes only. A signal that two
    postings share names their link in the aggregation that finds it; only where more than two share one
    are its postings asked for again, in a join that adaptive execution can split. Each is linked to the
    first node of its signal, which joins the same postings as all pairs would. Whatever the order, the
    result is the same; ``ingest_seq`` tells postings apart.
    """
    heads = told.filter("identity IS NOT NULL").groupBy("identity").agg(F.min("ingest_seq").alias("head"))
    heads = cut(heads, "heads")
    marked = told.join(heads, "identity", "left").withColumn("node", F.coalesce("head", "ingest_seq")).drop("head")
    shared = _signals(marked).groupBy("signal").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    shared = cut(shared.filter("a < b"), "shared")
    links, wide = shared.select("a", "b"), shared.filter("n > 2").select("signal", "a")
    if not wide.isEmpty():
        more = _signals(marked).join(wide, "signal").filter("node <> a")
        links = links.unionByName(more.select("a", F.col("node").alias("b")))
    found = cut(components(links).toDF("node", "cluster"), "components")
    return marked.join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")).drop("node")


def clusters(postings: DataFrame) -> DataFrame:
    """(ingest_seq, cluster): the smallest ingest_seq that shared signals reach, whatever the order."""
    return clustered(told_apart(postings.select("ingest_seq", "identity", "url", "source", "external_id"))).select("ingest_seq", "cluster")


def resolve(postings: DataFrame) -> DataFrame:
    """One row for each cluster: the most authoritative record, its provenance, and a description.

    The record with the highest authority stays, then one with a description, then the longest, then
    the first. A missing description is borrowed from the first record that has one. Which record that is
    is decided without the texts; only the records and descriptions chosen are fetched.
    """
    marked = clustered(told_apart(postings))
    n_text = F.coalesce("n_text", F.lit(0))
    best = F.struct(F.col("authority"), n_text.alias("n"), (-F.col("ingest_seq")).alias("first"))
    chosen = marked.groupBy("cluster").agg(
        F.max(best).alias("best"),
        F.count("*").alias("n_postings"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(F.when(n_text > 0, F.col("ingest_seq"))).alias("text_seq"),
    )
    chosen = chosen.select("cluster", (-F.col("best.first")).alias("canonical_seq"), "n_postings", "sources", F.when(F.col("best.n") == 0, F.col("text_seq")).alias("text_seq"))
    chosen = cut(chosen, "chosen")
    urls = marked.select("cluster", "canonical").distinct().groupBy("cluster").agg(F.count("canonical").alias("n_urls"))
    wanting = chosen.filter("text_seq IS NOT NULL").select("text_seq", F.col("cluster").alias("_of"))
    texts = postings.select(F.col("ingest_seq").alias("text_seq"), F.col("description").alias("borrowed"))
    borrowed = texts.join(wanting, "text_seq").select(F.col("_of").alias("cluster"), "borrowed")
    kept = postings.select(F.col("ingest_seq").alias("canonical_seq"), "identity", "title", "url", "authority", "description")
    out = kept.join(chosen, "canonical_seq").join(urls, "cluster", "left").join(borrowed, "cluster", "left")
    return out.select(
        "cluster",
        "canonical_seq",
        "identity",
        "title",
        "url",
        "authority",
        F.coalesce(F.nullif("description", F.lit("")), "borrowed", F.lit("")).alias("description"),
        "n_postings",
        "n_urls",
        "sources",
    )


def provenance(postings: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster, links): every place where a cluster's job was seen, once for each canonical URL.

    The first posting of a URL names its source; links are in order of falling authority, then of URL.
    """
    marked = postings.join(found, "ingest_seq")
    link = F.coalesce(F.nullif("apply_url", F.lit("")), "url") if "apply_url" in postings.columns else F.col("url")
    # out of an array of one, so that the filter stays above and no URL is read twice
    marked = marked.withColumn("link", link).withColumn("canonical", F.explode_outer(F.array(canonical_url(link)))).filter("canonical <> ''")
    one = marked.groupBy("cluster", "canonical").agg(F.min_by(F.struct("authority", "link", "source", "external_id"), "ingest_seq").alias("l"))
    # a job is seen at few places; the array is of one job's different URLs
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("l.authority")).alias("o"), "canonical", "l")))
    links = F.transform(ordered, lambda x: x["l"])
    return one.groupBy("cluster").agg(links.alias("links"))
