"""One run of a search: duplicates, verdicts, what is new, and the state after it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import cluster, gates, state
from millrace.operators.store import Store, Version
from millrace.operators.tables import cut, shared_dir
from millrace.plans.postings import normalised, postings
from millrace.plans.searches import ACCOUNTING, TODAY

JOB_FIELDS = ["title", "company", "url", "description", "workplace", "salary_min", "posted_at"]


@dataclass
class State:
    """Tables that a run reads and whose successors it returns."""

    jobs: DataFrame
    job_sources: DataFrame
    matches: DataFrame
    status: DataFrame


def since_date(today: date, rules: gates.Rules) -> date | None:
    """Postings before this date cannot pass; readers may prune partitions by it."""
    return None if rules.max_age_days is None else today - timedelta(days=rules.max_age_days)


def discovery_terms(rules: gates.Rules) -> list[str]:
    """Search terms for sources: only what is wanted, in order, each once."""
    return _once(rules.titles + rules.related_titles + rules.required_keywords + rules.keywords)


def _once(phrases: list[str]) -> list[str]:
    """Each phrase once whatever its case, as it comes first."""
    kept: dict[str, str] = {}
    for p in phrases:
        kept.setdefault(p.lower(), p)
    return list(kept.values())


def cleaned(rules: gates.Rules, allowed_countries: tuple[str, ...] = ("US",)) -> gates.Rules:
    """Phrases with single blanks and each once whatever its case; countries in capitals and allowed."""
    out = gates.Rules(**rules.__dict__)
    for name, value in rules.__dict__.items():
        if isinstance(value, list):
            plain = [" ".join(v.split()) for v in value]
            setattr(out, name, _once([p for p in plain if p]))
    out.countries = [c.upper() for c in out.countries]
    if bad := sorted(set(out.countries) - set(allowed_countries)):
        raise ValueError(f"countries not allowed: {bad}")
    return out


def judged_jobs(raw: DataFrame, rules: gates.Rules, today: date) -> DataFrame:
    """Raw postings of all sources -> one judged row for each job, keyed by identity."""
    first = cut(cluster.first_of_source(raw), "first")
    jobs = normalised(first)
    kept = cluster.resolve(jobs).select("canonical_seq", "n_postings", F.col("description").alias("_borrowed"))
    one = jobs.join(kept, jobs["ingest_seq"] == kept["canonical_seq"]).withColumn("description", F.col("_borrowed")).drop("_borrowed", "canonical_seq")
    # a row for each cluster, written: everything after this asks for it several times
    one = cut(one, "resolved")
    one = one.withColumn("searchable", gates.searchable_text(F.col("title"), F.col("company"), F.col("description"), F.col("location_raw")))
    # clusters of one identity may differ in other signals; the most authoritative of them stays
    best = one.groupBy("identity").agg(F.max_by("ingest_seq", F.struct("authority", F.length("description"), -F.col("ingest_seq"))).alias("ingest_seq"))
    return gates.evaluate(one.join(best, ["identity", "ingest_seq"], "left_semi"), rules, today)


VERDICT = ["search", "identity", "run_seq", "decision", "score", "is_new"]


def found_in(raw: DataFrame, rules: gates.Rules, today: date, run_seq: int) -> DataFrame:
    """A run's judged jobs, written."""
    judged = judged_jobs(raw, rules, today)
    return cut(judged.withColumn("search", F.lit(rules.name)).withColumn("run_seq", F.lit(run_seq)), "run")


def advance(found: DataFrame, today: date, before: State | None) -> tuple[State, DataFrame]:
    """The tables after a run and its verdicts, before anything is written.

    ``before`` may hold only the rows that share a bucket with the run's jobs; so do the new tables, but
    ``matches``, which has the run's own rows only.
    """
    seen = F.lit(today)
    history = before.matches if before else found.limit(0).withColumn("is_new", F.lit(True)).select(*VERDICT)
    current = state.with_is_new(found, history)
    incoming = found.select("identity", "authority", *JOB_FIELDS)
    none = incoming.limit(0).withColumn("first_seen", seen).withColumn("last_seen", seen)
    jobs = state.upsert_jobs(before.jobs if before else none, incoming, seen, JOB_FIELDS)
    links = found.select("identity", "url", seen.alias("first_seen"), seen.alias("last_seen"))
    sources = state.upsert_provenance(before.job_sources if before else links.limit(0), links)
    fresh = found.select("identity", F.lit("new").alias("status"))
    status = fresh if before is None else before.status.unionByName(fresh.join(before.status, "identity", "left_anti"))
    return State(jobs, sources, current.select(*VERDICT), status), current


def summed_up(current: DataFrame) -> DataFrame:
    return current.groupBy("search", "run_seq").agg(
        F.count("*").alias("found"),
        F.count_if(F.col("decision") == "match").alias("matched"),
        F.count_if(F.col("decision") == "rejected").alias("rejected"),
        F.count_if(F.col("is_new") & (F.col("decision") == "match")).alias("new_matches"),
    )


def run_search(raw: DataFrame, rules: gates.Rules, today: date, run_seq: int, before: State | None = None) -> tuple[State, DataFrame]:
    """The state after a run, and the run's summary (found, matched, rejected, new).

    Whether a job is new is asked before anything is written; rejected jobs carry the flag too, and a
    job without a status gets ``new``.
    """
    after, current = advance(found_in(raw, rules, today, run_seq), today, before)
    current = cut(current, "verdicts")
    own = current.select(*VERDICT)
    matches = before.matches.unionByName(own) if before else own
    tables = [cut(t, n) for t, n in ((after.jobs, "jobs"), (after.job_sources, "job-sources"), (matches, "matches"), (after.status, "status"))]
    return State(*tables), summed_up(current)


KEYED, LOGS = ("jobs", "job_sources", "status"), ("matches",)


def stored_state(store: Store, version: Version | None, buckets: list[int] | None = None) -> State | None:
    """A version's state, or its rows in some buckets; None where there are none."""
    tables = [store.read(version, t, buckets) if version else None for t in ("jobs", "job_sources", "matches", "status")]
    return State(*tables) if all(t is not None for t in tables) else None


def run_on_store(store: Store, raw: DataFrame, rules: gates.Rules, today: date, batch: int) -> Version:
    """A run whose state lives in a store; a batch that was committed before changes nothing.

    Only the buckets that hold the run's jobs are read and written again. The run's verdicts are a log.
    """
    before = store.latest()
    if before and before.batch >= batch:
        return before
    found = found_in(raw, rules, today, batch)
    touched = store.touched(found)
    after, _ = advance(found, today, stored_state(store, before, touched))
    return store.commit(batch, {t: getattr(after, t) for t in KEYED}, {t: getattr(after, t) for t in LOGS}, touched, before)


def stream_runs(spark: SparkSession, landed: DataFrame, rules: gates.Rules, today: date, root: str | None = None) -> State | None:
    """Runs the search over each micro-batch of landed raw postings; a batch is a run. Returns the state.

    State and progress lie under ``root`` (by default in the shared folder, one for each search). A query
    that was stopped at any point goes on from the last committed batch, also in another session: batches
    that Spark hands over again after a failure are skipped or done anew as a whole.
    """
    root = root or f"{shared_dir(spark)}/runs-{rules.name}"
    store = Store(spark, f"{root}/state")

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            run_on_store(store, batch, rules, today, number)

    query = landed.writeStream.option("checkpointLocation", f"{root}/progress")
    query.foreachBatch(run).trigger(availableNow=True).start().awaitTermination()
    return stored_state(store, store.latest())


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over halves of the postings: what each found and what was new."""
    raw = postings(spark, sf_dir)
    after, one = run_search(raw.filter("ingest_seq % 4 < 3"), ACCOUNTING, TODAY, 1)
    _, two = run_search(raw.filter("ingest_seq % 4 > 0"), ACCOUNTING, TODAY, 2, after)
    return one.unionByName(two)
