"""Writers of results: CSV, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.gates import why

FLAT = ["identity", "title", "company", "url", "workplace", "employment_type", "decision", "score", "is_uncertain", "salary_min", "salary_period", "posted_at", "source", "external_id", "authority"]


def flat(judged: DataFrame) -> DataFrame:
    """One flat row for each judged posting, with its place and a one-line reason."""
    place = [F.col(f"location.{c}").alias(c) for c in ("city", "region", "country")]
    return judged.select(*FLAT, *place, F.col("location.raw").alias("location_raw"), why().alias("why"))


def to_csv(judged: DataFrame, path: str) -> None:
    flat(judged).write.option("header", True).csv(path)


def to_json(judged: DataFrame, path: str) -> None:
    judged.write.json(path)


def to_markdown(judged: DataFrame, path: str) -> None:
    """A section for each posting."""
    f = flat(judged)
    unsure = F.when(F.col("is_uncertain"), " (unconfirmed)").otherwise("")
    line = F.concat(
        F.lit("## "), "title", F.lit(" - "), "company", unsure, F.lit("\n\n- score: "), F.col("score").cast("string"),
        F.lit("\n- where: "), F.coalesce("location_raw", F.lit("")), F.lit("\n- why: "), "why", F.lit("\n- "), F.coalesce("url", F.lit("")), F.lit("\n"),
    )
    f.select(line.alias("value")).write.text(path)


FORMATS = {"csv": to_csv, "json": to_json, "markdown": to_markdown}
