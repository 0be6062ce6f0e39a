"""Mixing sources to target weights with time-varying schedules (DataFrame functions only).

Every source has a weight schedule over training time t in [0, 1], w(t) = w * (1 + a * (2t - 1)).
Integrated, the share of a source's words that is due by t is u(t) = (1 - a) * t + a * t^2; the
inverse of that gives the training position of the document that holds a given share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
SLOPES = (0.5, 0.0, -0.5)  # a source's slope, repeated in the order of the sources
ROWS_PER_SPAN = 1000
SPANS_PER_STRETCH = 1000


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, passes=MAX_PASSES) -> DataFrame:
    """(source, source_size) -> with weight, slope and target, one row per source.

    The targets are the water-filling solution: sorted by size over weight, the sources that fill up
    form a prefix, and every other source takes ``weight`` times the level that the rest share out.
    The table has a row per source, so that one ordered window over it stays small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("slope", _cycle(SLOPES, F.col("rank")))
    s = s.withColumn("cap", F.col("source_size") * float(passes))
    fill = F.col("cap") / F.col("weight")
    before = Window.orderBy(fill, "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (
        s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("demand", F.sum("source_size").over(whole) * share)
        .withColumn("level_here", (F.col("demand") - F.col("cap_before")) / F.col("weight_left"))
    )
    # the level at the first source that does not fill up; sources before it do
    in_order = Window.orderBy(fill, "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", F.first(F.when(F.col("level_here") <= fill, F.col("level_here")), True).over(in_order))
    target = F.when(F.col("level").isNull() | (F.col("level") > fill), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "weight", "slope", target.alias("target"))


def position(share_due: Column, slope: Column) -> Column:
    """Training time in [0, 1] at which ``share_due`` of a source's words have been asked for."""
    b = F.lit(1.0) - slope
    root = (-b + F.sqrt(b * b + 4 * slope * share_due)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, share_due).otherwise(root)


def _sized(docs: DataFrame, carry: list[str]) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # a source in two columns that are never null, so that windows and joins on it share one shuffle
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("named"),
        F.xxhash64("doc_id", F.lit(17)).alias("h"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )


def _starts(span_sums: DataFrame) -> DataFrame:
    """The span sums with ``span_start``, the words of a source before each span.

    Spans are added up in stretches of ``SPANS_PER_STRETCH`` first: a source of ten billion rows has ten
    thousand stretches, and no window holds more rows than that.
    """
    source = ["no_source", "named"]
    before = (Window.unboundedPreceding, -1)
    dealt = span_sums.withColumn("stretch", F.floor(F.col("span") / SPANS_PER_STRETCH))
    within = Window.partitionBy(*source, "stretch").orderBy("span").rowsBetween(*before)
    sums = dealt.groupBy(*source, "stretch").agg(F.sum("span_size").alias("stretch_size"))
    along = Window.partitionBy(*source).orderBy("stretch").rowsBetween(*before)
    sums = sums.withColumn("stretch_start", F.coalesce(F.sum("stretch_size").over(along), F.lit(0))).drop("stretch_size")
    inside = F.coalesce(F.sum("span_size").over(within), F.lit(0))
    return dealt.withColumn("inside", inside).join(sums, [*source, "stretch"]).withColumn("span_start", F.col("stretch_start") + F.col("inside"))


def mix(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` with the words that the mix takes and where in training.

    Columns: doc_id, size (words; null text: 0), source_size, target, taken (0 to 2 * size, repeats
    counted), position (training time of the first pass; null if nothing is taken), slice_from and
    slice_words (the words of the last, partial pass: the first ``slice_words`` ones).
    A source is walked in the order of a hash of the row; whole passes take every document and the
    last pass stops inside one document, so that a source's words meet its target to within one word.
    Null sources form one source (after the others); rows of the same id and text are told apart by
    nothing, and either may come first; documents without words take nothing. An empty table gives an
    empty result. Columns named in ``carry`` come along as ``carried_`` and their name; others are ignored.

    The walk needs running sums inside a source. A source may hold a third of all rows, so a source is
    dealt into spans by ranges of the hash, small enough for one task; span sums are added up first, in two levels.
    """
    sized = cut(_sized(docs, []), "mix-sizes")
    n_rows = sized.count()
    spans = max(1, n_rows // ROWS_PER_SPAN)
    span = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * spans).cast("long")
    sized = sized.withColumn("span", span)
    span_sums = sized.groupBy("source", "no_source", "named", "span").agg(F.sum("size").alias("span_size"))
    targets = source_targets(span_sums.groupBy("source").agg(F.sum("span_size").alias("source_size")))
    starts = _starts(span_sums)
    plan = starts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    plan = plan.select("no_source", "named", "p.span", "span_start", "source_size", "slope", "target")
    inside = Window.partitionBy("no_source", "named", "span").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    if carry:  # the sizes above are without the columns that are carried along
        sized = _sized(docs, carry).withColumn("span", span)
    walked = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = walked.join(plan, ["no_source", "named", "span"])
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    whole = F.least(whole, F.lit(MAX_PASSES)).cast("long")
    left = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    start = F.col("span_start") + F.col("within")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - start))
    rows = rows.select(
        "doc_id", "size", "source_size", "target", "slope", "h",
        start.alias("start"), whole.alias("passes"), part.cast("long").alias("slice_words"),
        "source", *[f"carried_{c}" for c in carry or []],
    )
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("slice_words"))
    due = F.least(F.col("start") / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(due, F.col("slope"))))
    return rows


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in order of their training positions.

    The last pass over a source ends inside a document: that row's text is its first words, joined by
    blanks. Documents that the mix does not take have no row; n_chars (added, or replaced) counts
    what each row holds.
    """
    columns = [c for c in docs.columns if c not in ("doc_id", "source", "n_chars")]
    rows = mix(docs, columns).filter(F.col("taken") > 0)
    last = F.col("passes") - F.when(F.col("slice_words") > 0, 0).otherwise(1)
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    due = (F.col("pass") * F.col("source_size") + F.col("start")) / F.greatest(F.col("target"), F.lit(1.0))
    rows = rows.withColumn("position", position(F.least(due, F.lit(1.0)), F.col("slope")))
    words = F.slice(F.regexp_extract_all("carried_text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("slice_words").cast("int"))
    cut_short = (F.col("pass") == F.col("passes")) & (F.col("slice_words") < F.col("size"))
    text = F.when(cut_short, F.array_join(words, " ")).otherwise(F.col("carried_text"))
    rows = rows.withColumn("carried_text", text).withColumn("n_chars", F.length("carried_text").cast("long"))
    kept = [F.col(f"carried_{c}").alias(c) for c in columns]
    return rows.orderBy("position", "h", "pass").select("doc_id", "source", *kept, "n_chars")


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sort a mix by training position (what is never taken comes first)."""
    return mixed.orderBy("position", "h")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, range-sorted by training position."""
    out = by_position(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")
