"""Incremental state over tables: verdict history, new versus seen, upserts, board health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FAILURES = 5
NOT_COUNTED = ["rate_limited", "blocked", "host_blocked", "unavailable"]


def latest_verdicts(matches: DataFrame) -> DataFrame:
    """The last row of each (search, identity) by run_seq; filters on results come after it."""
    order = Window.partitionBy("search", "identity").orderBy(F.desc("run_seq"))
    return matches.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def with_is_new(current: DataFrame, history: DataFrame) -> DataFrame:
    """``current`` verdicts with is_new: no earlier *match* of the posting for the search.

    Earlier rejections do not count; rejected rows carry the flag too.
    """
    before = history.filter("decision = 'match'").select("search", "identity").distinct().withColumn("_seen", F.lit(True))
    return current.join(before, ["search", "identity"], "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def first_last_seen(seen: DataFrame, keys: list[str]) -> DataFrame:
    return seen.groupBy(*keys).agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count("*").alias("times"))


def current_status(events: DataFrame) -> DataFrame:
    """(identity, status, previous, changes) from (identity, seq, status) events."""
    order = Window.partitionBy("identity").orderBy("seq")
    e = events.withColumn("previous", F.lag("status").over(order))
    e = e.withColumn("changes", F.count(F.when(~F.col("status").eqNullSafe(F.col("previous")), 1)).over(order))
    last = Window.partitionBy("identity").orderBy(F.desc("seq"))
    return e.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").select("identity", "status", "previous", "changes")


def board_health(outcomes: DataFrame) -> DataFrame:
    """(board, consecutive_failures, last_success, last_outcome, evicted) from (board, seq, ts, kind).

    A success resets; some kinds are recorded but not counted; boards go at ``MAX_FAILURES``.
    """
    board = Window.partitionBy("board")
    o = outcomes.withColumn("last_ok", F.max(F.when(F.col("kind") == "ok", F.col("seq"))).over(board))
    counted = (F.col("kind") != "ok") & ~F.col("kind").isin(NOT_COUNTED) & (F.col("seq") > F.coalesce("last_ok", F.lit(-1)))
    out = o.groupBy("board").agg(
        F.count_if(counted).alias("consecutive_failures"),
        F.max(F.when(F.col("kind") == "ok", F.col("ts"))).alias("last_success"),
        F.max_by("kind", "seq").alias("last_outcome"),
    )
    return out.withColumn("evicted", F.col("consecutive_failures") >= MAX_FAILURES)


def informative(description: Column, workplace: Column, salary: Column, posted: Column) -> Column:
    return F.struct(
        F.length(F.coalesce(description, F.lit(""))).alias("text"),
        (workplace != "unknown").alias("workplace"),
        salary.isNotNull().alias("salary"),
        posted.isNotNull().alias("posted"),
    )


def upsert_jobs(stored: DataFrame, incoming: DataFrame, seen: Column, fields: list[str]) -> DataFrame:
    """The job table after a run: (identity, authority, fields..., first_seen, last_seen).

    New jobs are inserted. A job's fields are replaced if the incoming authority is higher, or equal
    and nothing gets lost: the description is not shorter, workplace, pay and date do not vanish. Else
    only last_seen moves. ``stored`` and ``incoming`` hold one row for each identity.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col("s.identity") == F.col("i.identity"), "full")
    is_new, is_gone = F.col("s.identity").isNull(), F.col("i.identity").isNull()

    def of(x, name):
        return F.col(f"{x}.{name}")

    kept = (
        (F.length(F.coalesce(of("i", "description"), F.lit(""))) >= F.length(F.coalesce(of("s", "description"), F.lit(""))))
        & ((of("s", "workplace") == "unknown") | (of("i", "workplace") != "unknown"))
        & (of("s", "salary_min").isNull() | of("i", "salary_min").isNotNull())
        & (of("s", "posted_at").isNull() | of("i", "posted_at").isNotNull())
    )
    higher = of("i", "authority") > of("s", "authority")
    replace = is_new | (~is_gone & (higher | ((of("i", "authority") == of("s", "authority")) & kept)))
    columns = [F.when(replace, of("i", c)).otherwise(of("s", c)).alias(c) for c in ["authority", *fields]]
    return both.select(
        F.coalesce(of("s", "identity"), of("i", "identity")).alias("identity"),
        *columns,
        F.coalesce(of("s", "first_seen"), seen).alias("first_seen"),
        F.when(is_gone, of("s", "last_seen")).otherwise(seen).alias("last_seen"),
    )


def upsert_provenance(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each (identity, url): the first first_seen is kept, last_seen refreshed."""
    both = stored.unionByName(incoming)
    return both.groupBy("identity", "url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def results(matches: DataFrame, jobs: DataFrame, status: DataFrame, search: str, *, only_new=False, decision=None, statuses=None, min_score=None, limit=100, order="score") -> DataFrame:
    """What a search has found: latest verdicts joined to jobs and statuses, filtered, ordered, limited."""
    out = latest_verdicts(matches.filter(F.col("search") == search))
    out = out.join(jobs, "identity").join(status.select("identity", "status"), "identity", "left")
    out = out.withColumn("status", F.coalesce("status", F.lit("new")))
    if only_new:
        out = out.filter("is_new")
    if decision:
        out = out.filter(F.col("decision") == decision)
    if statuses:
        out = out.filter(F.col("status").isin(statuses))
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    keys = {
        "score": [F.desc("score"), F.desc("last_seen")],
        "date": [F.coalesce("posted_at", "first_seen").desc()],
        "company": [F.asc("company"), F.desc("score")],
        "title": [F.asc("title")],
    }
    return out.orderBy(*keys.get(order, keys["score"]), "identity").limit(limit)


def delete_search(searches: DataFrame, children: dict[str, DataFrame], name: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All tables without a search and what hangs on it."""
    return searches.filter(F.col("name") != name), {k: v.filter(F.col("search") != name) for k, v in children.items()}
