"""What happens to jobs after a run: statuses, verification, explanations, runs and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["new", "seen", "saved", "applied", "rejected", "closed"]  # fixed values
KEPT_WHEN_GONE = ["applied", "saved"]  # fixed values


def split_statuses(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status events with a known status, and the others."""
    known = F.coalesce(F.col("status").isin(STATUSES), F.lit(False))
    return events.filter(known), events.filter(~known)


def apply_status_events(history: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, current, rejected) after status events (identity, seq, status, note).

    Known statuses are appended to the history; the current status is the last one of each job.
    """
    known, rejected = split_statuses(events)
    history = history.unionByName(known)
    last = F.struct("seq", "status", "note")
    current = history.groupBy("identity").agg(F.max(last).alias("l")).select("identity", "l.status", "l.note", F.col("l.seq").alias("changed"))
    return history, current, rejected


def write_verification(jobs: DataFrame, current: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, current) after checks (identity, state, seq), of which a job's last decides.

    Live and gone are written to the job, inconclusive ones change nothing. A job that is gone is closed,
    unless it was applied to or saved; a job without a status gets one.
    """
    told = checks.filter(F.col("state") != "inconclusive").groupBy("identity").agg(F.max(F.struct("seq", "state")).alias("c"))
    jobs = jobs.join(told, "identity", "left")
    jobs = jobs.withColumn("verification", F.coalesce("c.state", "verification")).withColumn("verified_at", F.coalesce("c.seq", "verified_at")).drop("c")
    gone = told.filter("c.state = 'gone'").select(F.col("identity").alias("_gone"), F.col("c.seq").alias("_at"))
    both = current.join(gone, current["identity"] == gone["_gone"], "full")
    closes = F.col("_gone").isNotNull() & ~F.coalesce(F.col("status").isin(KEPT_WHEN_GONE), F.lit(False))
    current = both.select(
        F.coalesce("identity", "_gone").alias("identity"),
        F.when(closes, "closed").otherwise(F.col("status")).alias("status"),
        "note",
        F.when(closes, F.col("_at")).otherwise(F.col("changed")).alias("changed"),
    )
    return jobs, current


def verification_summary(checks: DataFrame) -> DataFrame:
    """One row: checked, live, gone, inconclusive."""
    return checks.agg(F.count("*").alias("checked"), *[F.count_if(F.col("state") == s).alias(s) for s in ("live", "gone", "inconclusive")])


EXPLANATION = "struct<gates:array<struct<gate:string,outcome:string,rule:string,evidence:string,detail:string>>,signals:array<struct<name:string,points:double,evidence:string>>>"


def explanation() -> Column:
    """A judged posting's gates and signals as JSON."""
    gates = F.transform("gates", lambda g: F.struct(*[g[c].alias(c) for c in ("gate", "outcome", "rule", "evidence", "detail")]))
    return F.to_json(F.struct(gates.alias("gates"), F.col("signals")))


def explained(json: Column) -> Column:
    """The gates and signals of an explanation; empty for null and for what is no explanation."""
    read = F.from_json(json, EXPLANATION)
    return F.coalesce(read, F.from_json(F.lit('{"gates": [], "signals": []}'), EXPLANATION))


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The last row of each key: latest runs, latest explanations."""
    order = Window.partitionBy(*keys).orderBy(F.desc(by))
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def start_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Runs after new ones (run, search, started_at) began."""
    return runs.unionByName(started.withColumn("status", F.lit("running")), allowMissingColumns=True)


def finish_runs(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with what is known of their end (run, finished_at, status, found, matched, rejected, new_count)."""
    ends = ["finished_at", "status", "found", "matched", "rejected", "new_count"]
    f = finished.select(F.col("run").alias("_run"), *[F.col(c).alias(f"_{c}") for c in ends])
    both = runs.join(f, runs["run"] == f["_run"], "left")
    return both.select("run", "search", "started_at", *[(F.coalesce(f"_{c}", c) if c in runs.columns else F.col(f"_{c}")).alias(c) for c in ends])


def searches_with_runs(searches: DataFrame, runs: DataFrame) -> DataFrame:
    """(name, runs, last_run) of all searches by name; those that never ran have 0 and null."""
    told = runs.groupBy(F.col("search").alias("_name")).agg(F.count("*").alias("runs"), F.max("started_at").alias("last_run"))
    both = searches.select("name").join(told, F.col("name") == F.col("_name"), "left")
    return both.select("name", F.coalesce("runs", F.lit(0)).alias("runs"), "last_run").orderBy("name")


def save_spec(searches: DataFrame, spec: DataFrame) -> DataFrame:
    """Searches with new ones added and those of the same name replaced."""
    return searches.join(spec.select("name"), "name", "left_anti").unionByName(spec)


def coverage_rollup(reports: DataFrame) -> DataFrame:
    """One row for each run from (run, source, status): sources, those fully searched, and names of the others."""
    status, source = F.col("status"), F.col("source")
    ok, reached = status == "ok", status.isin("ok", "partial")
    names = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, source))), ",")
    return reports.groupBy("run").agg(
        F.count("*").alias("sources"), F.count_if(ok).alias("fully_searched"), names(reached).alias("searched"), names(~status.isin("ok", "skipped")).alias("degraded")
    )


def nested_job(flat: DataFrame) -> DataFrame:
    """Flat job rows with their place and pay as structs; pay is null unless a minimum or maximum is known."""
    place = F.struct(F.col("location_raw").alias("raw"), "city", "region", "country")
    money = F.struct(F.col("salary_min").alias("minimum"), F.col("salary_max").alias("maximum"), F.coalesce("salary_currency", F.lit("USD")).alias("currency"), F.coalesce("salary_period", F.lit("year")).alias("period"))
    known = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    gone = ["location_raw", "city", "region", "country", "salary_min", "salary_max", "salary_currency", "salary_period"]
    return flat.withColumn("location", place).withColumn("salary", F.when(known, money)).drop(*gone)


def flat_job(nested: DataFrame) -> DataFrame:
    """The inverse of ``nested_job``, but for the default currency and period of pay that is known."""
    place = [F.col(f"location.{a}").alias(b) for a, b in (("raw", "location_raw"), ("city", "city"), ("region", "region"), ("country", "country"))]
    money = [F.col(f"salary.{a}").alias(b) for a, b in (("minimum", "salary_min"), ("maximum", "salary_max"), ("currency", "salary_currency"), ("period", "salary_period"))]
    return nested.select("*", *place, *money).drop("location", "salary")


def job_detail(jobs: DataFrame, sources: DataFrame, current: DataFrame, explanations: DataFrame, identity: str) -> DataFrame:
    """One job with its status, its links by authority, and its latest explanation in each search."""
    job = jobs.filter(F.col("identity") == identity).join(current.select("identity", "status"), "identity", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    links = sources.filter(F.col("identity") == identity).groupBy("identity").agg(F.sort_array(F.collect_set(F.struct("authority", "url", "source")), asc=False).alias("links"))
    told = latest(explanations.filter(F.col("identity") == identity), ["identity", "search"], "run_seq")
    told = told.groupBy("identity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("search", "explanation")))).alias("explanations"))
    return job.join(links, "identity", "left").join(told, "identity", "left")
