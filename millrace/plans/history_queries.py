"""Queries over what happens after a run: events stand for runs, status changes and checks of postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import cluster as C
from millrace.operators import gates as G
from millrace.operators import history as H
from millrace.operators import state as S
from millrace.plans import oracle as O
from millrace.plans.postings import normalised, postings
from millrace.plans.searches import ACCOUNTING, TODAY

# An event's type as a status; one of them is none.
STATUS = "CASE event_type WHEN 'click' THEN 'seen' WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'saved' WHEN 'error' THEN 'rejected' ELSE 'lost' END"
STATE = "CASE WHEN value < 20 THEN 'gone' WHEN value < 60 THEN 'live' ELSE 'inconclusive' END"
RUN_STATUS = "CASE WHEN value < 20 THEN 'blocked' WHEN value < 40 THEN 'partial' WHEN value < 60 THEN 'skipped' ELSE 'ok' END"

MORE = G.Rules(
    "more", titles=["accountant", "program manager"], responsibilities=["close", "react components"], title_match="hard", workplace_types=["remote", "onsite"], locations=["Dallas", "California"],
    company_excludes=["employer 5"], required_skills=["excel", "react"], required_credentials=["CPA", "PMP"], deal_breakers=["wellness stipend"], shift_exclude=["night shift"], policy=G.STRICT,
)


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _statuses(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("identity"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), F.col("props").alias("note"))
    return H.apply_status_events(e.limit(0), e)


def status_events(spark, sf_dir):
    """Current statuses, with how many events were kept and turned away for the job."""
    history, current, rejected = _statuses(spark, sf_dir)
    n = history.groupBy("identity").agg(F.count("*").alias("n_kept"))
    bad = rejected.groupBy("identity").agg(F.count("*").alias("n_rejected"))
    out = current.join(n, "identity").join(bad, "identity", "left")
    return out.select("identity", "status", "note", "changed", "n_kept", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))


def _checks(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("user_id").alias("identity"), F.expr(STATE).alias("state"), (F.col("event_id") + 1_000_000_000).alias("seq"))


def verification_writes(spark, sf_dir):
    current = _statuses(spark, sf_dir)[1]
    checks = _checks(spark, sf_dir)
    # each job has a twin that was never marked, so that its check may be the first to give it a status
    checks = checks.unionByName(checks.withColumn("identity", -1 - F.col("identity")))
    jobs = checks.select("identity").distinct().withColumn("verification", F.lit("unverified")).withColumn("verified_at", F.lit(None).cast("long"))
    jobs, current = H.write_verification(jobs, current, checks)
    return jobs.join(current.select("identity", "status", "changed"), "identity", "left")


def verification_counts(spark, sf_dir):
    return H.verification_summary(_checks(spark, sf_dir))


def provenance_links(spark, sf_dir):
    jobs = normalised(postings(spark, sf_dir))
    p = C.provenance(jobs, C.clusters(jobs))
    return p.select("cluster", F.size("links").alias("n_links"), F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["authority"].cast("string"), x["link"], x["source"])), "\n").alias("links"))


def explanations(spark, sf_dir):
    """Verdicts written as JSON and read back: gates by outcome and points by signal."""
    judged = G.evaluate(normalised(postings(spark, sf_dir)), ACCOUNTING, TODAY)
    told = judged.select("ingest_seq", H.explained(H.explanation()).alias("x"))
    failed = F.filter("x.gates", lambda g: g["outcome"] == "fail")
    return told.select("ingest_seq", F.size("x.gates").alias("n_gates"), F.array_join(F.transform(failed, lambda g: g["gate"]), ",").alias("failed"), F.size("x.signals").alias("n_signals"))


def gates_more(spark, sf_dir):
    """A strict search with places, employers, skills, credentials, and relevance as a demand."""
    judged = G.evaluate(normalised(postings(spark, sf_dir)), MORE, TODAY)
    g = G.gate_rows(judged, "decision")
    return g.groupBy("decision", "g.gate", "g.outcome", "g.evidence", "g.detail").agg(F.count("*").alias("n"))


def flat_round_trip(spark, sf_dir):
    p = postings(spark, sf_dir).select(
        "ingest_seq", "location_raw", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("region"), F.col("country_hint").alias("country"),
        "salary_min", F.lit(None).cast("double").alias("salary_max"), F.lit(None).cast("string").alias("salary_currency"), "salary_period",
    )
    return H.flat_job(H.nested_job(p)).select("ingest_seq", "location_raw", "country", "salary_min", "salary_currency", "salary_period")


def _runs(spark, sf_dir):
    e = _events(spark, sf_dir)
    started = e.select(F.col("event_id").alias("run"), F.col("event_type").alias("search"), F.col("event_id").alias("started_at"))
    runs = H.start_runs(started.limit(0), started)
    ended = e.filter("value < 150").select(
        F.col("event_id").alias("run"), (F.col("event_id") + 1).alias("finished_at"), F.lit("completed").alias("status"), F.floor("value").alias("found"),
        F.lit(1).alias("matched"), F.lit(2).alias("rejected"), F.lit(0).alias("new_count"),
    )
    return H.finish_runs(runs, ended)


def searches_listed(spark, sf_dir):
    e = _events(spark, sf_dir)
    names = e.select(F.col("event_type").alias("name")).distinct().unionByName(e.select(F.concat(F.lit("never "), "event_type").alias("name")).distinct())
    saved = H.save_spec(names.withColumn("spec", F.lit(1)), names.filter("name LIKE 'never%'").withColumn("spec", F.lit(2)))
    return H.searches_with_runs(saved, _runs(spark, sf_dir))


def latest_runs(spark, sf_dir):
    return H.latest(_runs(spark, sf_dir), ["search"], "started_at").select("search", "run", "status", "finished_at", "found")


def coverage_rollup(spark, sf_dir):
    reports = _events(spark, sf_dir).select((F.col("event_id") % 40).alias("run"), F.concat_ws("-", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("source"), F.expr(RUN_STATUS).alias("status"))
    return H.coverage_rollup(reports)


def results_of_search(spark, sf_dir):
    """What a search lists: latest matches with their jobs and statuses, the best hundred."""
    from millrace.plans.state_queries import _verdicts

    v = _verdicts(spark, sf_dir).withColumn("is_new", F.lit(True))
    jobs = v.select("identity").distinct().select("identity", F.concat(F.lit("job "), F.col("identity").cast("string")).alias("title"), F.col("identity").alias("last_seen"))
    found = S.results(v, jobs, _statuses(spark, sf_dir)[1], "click", decision="match", statuses=["new", "seen", "applied"], min_score=30.0, limit=100)
    return found.select("identity", "title", "run_seq", "score", "status")


QUERIES = {
    "status_events": status_events,
    "verification_writes": verification_writes,
    "verification_counts": verification_counts,
    "provenance_links": provenance_links,
    "explanations": explanations,
    "gates_more": gates_more,
    "flat_round_trip": flat_round_trip,
    "searches_listed": searches_listed,
    "latest_runs": latest_runs,
    "coverage_rollup": coverage_rollup,
    "results_of_search": results_of_search,
}

_S = f"s AS (SELECT user_id AS identity, event_id AS seq, {STATUS} AS status, props AS note FROM events)"
_CURRENT = f"{_S}, cur AS (SELECT identity, arg_max(status, seq) AS status, arg_max(note, seq) AS note, max(seq) AS changed FROM s WHERE status <> 'lost' GROUP BY identity)"


def _links() -> str:
    from millrace.plans.state_queries import _CLUSTERS

    return f"""{_CLUSTERS}, m AS (SELECT jobs.*, cluster, {O.canonical("url")} AS canonical FROM jobs JOIN cl USING (ingest_seq)),
      one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cluster, canonical ORDER BY ingest_seq) = 1)
      SELECT cluster, CAST(count(*) AS INTEGER) AS n_links, string_agg(CAST(authority AS VARCHAR) || ' ' || url || ' ' || source, chr(10) ORDER BY authority DESC, canonical) AS links FROM one GROUP BY cluster"""


def _explained() -> str:
    gates, signals = O.gate_rows(ACCOUNTING), O.signal_rows(ACCOUNTING)
    failed = ", ".join(f"CASE WHEN ({o}) = 'fail' THEN {O.q(g)} END" for g, o, *_ in gates)
    n = " + ".join(f"CASE WHEN {c} AND CAST({p} AS DOUBLE) <> 0 THEN 1 ELSE 0 END" for p, c in signals)
    return f"""{O.verdicts(ACCOUNTING)} SELECT ingest_seq, {len(gates)} AS n_gates, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed,
      CASE WHEN decision = 'match' THEN {n} ELSE 0 END AS n_signals FROM verdicts"""


def _more() -> str:
    rows = O.gate_rows(MORE)
    bad = " OR ".join(f"({o}) = 'fail'" if g in ("required_skills", "required_credentials") else f"({o}) <> 'pass'" for g, o, *_ in rows)
    parts = " UNION ALL ".join(f"SELECT decision, {O.q(g)} AS gate, {o} AS outcome, {e} AS evidence, coalesce({d}, '') AS detail FROM d" for g, o, e, d in rows)
    return f"WITH {O.JOBS}, d AS (SELECT *, CASE WHEN {bad} THEN 'rejected' ELSE 'match' END AS decision FROM jobs), g AS ({parts}) SELECT decision, gate, outcome, evidence, detail, count(*) AS n FROM g GROUP BY ALL"


ORACLE_SQL = {
    "status_events": f"WITH {_CURRENT}, n AS (SELECT identity, count(*) FILTER (WHERE status <> 'lost') AS n_kept, count(*) FILTER (WHERE status = 'lost') AS n_rejected FROM s GROUP BY identity) SELECT cur.*, n_kept, n_rejected FROM cur JOIN n ON cur.identity = n.identity",
    "verification_writes": f"""WITH {_CURRENT}, k AS (SELECT user_id AS identity, {STATE} AS state, event_id FROM events),
      c AS (SELECT identity, arg_max(state, event_id) FILTER (WHERE state <> 'inconclusive') AS state, max(event_id + 1000000000) FILTER (WHERE state <> 'inconclusive') AS seq FROM (FROM k UNION ALL SELECT -1 - identity, state, event_id FROM k) GROUP BY 1),
      b AS (SELECT c.identity, state, seq, cur.status, changed, state = 'gone' AND coalesce(cur.status NOT IN ('applied', 'saved'), TRUE) AS closes FROM c LEFT JOIN cur ON c.identity = cur.identity)
      SELECT identity, coalesce(state, 'unverified') AS verification, seq AS verified_at, CASE WHEN closes THEN 'closed' ELSE status END AS status, CASE WHEN closes THEN seq ELSE changed END AS changed FROM b""",
    "verification_counts": f"SELECT count(*) AS checked, count(*) FILTER (WHERE {STATE} = 'live') AS live, count(*) FILTER (WHERE {STATE} = 'gone') AS gone, count(*) FILTER (WHERE {STATE} = 'inconclusive') AS inconclusive FROM events",
    "explanations": _explained(),
    "gates_more": _more(),
    "flat_round_trip": f"SELECT ingest_seq, location_raw, country_hint AS country, salary_min, CASE WHEN salary_min IS NOT NULL THEN 'USD' END AS salary_currency, CASE WHEN salary_min IS NOT NULL THEN coalesce(salary_period, 'year') END AS salary_period FROM ({O.POSTINGS_SQL})",
    "searches_listed": "SELECT event_type AS name, count(*) AS runs, max(event_id) AS last_run FROM events GROUP BY 1 UNION ALL SELECT DISTINCT 'never ' || event_type, 0, NULL FROM events",
    "latest_runs": "SELECT event_type AS search, event_id AS run, CASE WHEN value < 150 THEN 'completed' ELSE 'running' END AS status, CASE WHEN value < 150 THEN event_id + 1 END AS finished_at, CASE WHEN value < 150 THEN CAST(floor(value) AS BIGINT) END AS found FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1",
    "coverage_rollup": f"""WITH r AS (SELECT event_id % 40 AS run, event_type || '-' || user_id || '-' || event_id AS source, {RUN_STATUS} AS status FROM events)
      SELECT run, count(*) AS sources, count(*) FILTER (WHERE status = 'ok') AS fully_searched, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE status IN ('ok', 'partial')), '') AS searched,
        coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE status IN ('blocked', 'partial')), '') AS degraded FROM r GROUP BY run""",
    "results_of_search": f"""WITH {_CURRENT}, l AS (SELECT user_id AS identity, event_id AS run_seq, value AS score FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
      SELECT l.identity, 'job ' || l.identity AS title, run_seq, score, coalesce(status, 'new') AS status FROM l LEFT JOIN cur ON l.identity = cur.identity
      WHERE score >= 30 AND coalesce(status, 'new') IN ('new', 'seen', 'applied') ORDER BY score DESC, l.identity DESC LIMIT 100""",
    "provenance_links": _links(),
}
