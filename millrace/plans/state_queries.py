"""Queries over state, registry and duplicates: events stand for runs and outcomes, customers for boards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions.pay import pay
from millrace.operators import cluster as C
from millrace.operators import registry as R
from millrace.operators import state as S
from millrace.operators.store import Store
from millrace.operators.tables import cut, over_distinct, shared_dir
from millrace.plans import oracle as O
from millrace.plans.postings import identified, normalised, postings
from millrace.streaming.health import streaming_board_health

THIRD = "CASE WHEN dayofmonth(ts) <= 10 THEN 1 WHEN dayofmonth(ts) <= 20 THEN 2 ELSE 3 END"
KIND = "CASE event_type WHEN 'error' THEN 'gone' WHEN 'signup' THEN 'unavailable' ELSE 'ok' END"


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _verdicts(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("search"),
        F.col("user_id").alias("identity"),
        F.col("event_id").alias("run_seq"),
        F.expr(THIRD).alias("run"),
        F.col("value").alias("score"),
        F.when(F.col("value") >= 20, "match").otherwise("rejected").alias("decision"),
    )


def latest_verdict(spark, sf_dir):
    return S.latest_verdicts(_verdicts(spark, sf_dir)).select("search", "identity", "run_seq", "decision", "score")


def new_vs_seen(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    out = S.with_is_new(v.filter("run = 3"), v.filter("run < 3"))
    return out.groupBy("search", "decision", "is_new").agg(F.count("*").alias("n"), F.count_distinct("identity").alias("n_jobs"))


def first_last_seen(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("identity"), F.col("event_type").alias("source"), F.col("event_id").alias("seen"))
    return S.first_last_seen(e, ["identity", "source"])


def status_current(spark, sf_dir):
    e = _events(spark, sf_dir)
    return S.current_status(e.select(F.col("user_id").alias("identity"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


def _outcomes(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(F.col("user_id").alias("board"), F.col("event_id").alias("seq"), F.col("event_id").alias("ts"), F.expr(KIND).alias("kind"))


def board_health(spark, sf_dir):
    return S.board_health(_outcomes(spark, sf_dir))


def coverage_report(spark, sf_dir):
    kind = F.expr("CASE WHEN value < 10 THEN 'blocked' WHEN value < 12 THEN 'unavailable' ELSE 'ok' END")
    source = F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string"))
    e = _events(spark, sf_dir).select(source.alias("source"), kind.alias("kind"), F.floor("value").cast("long").alias("found"))
    return R.coverage(e)


def _registry(spark, sf_dir):
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "nation", "region")}
    r = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
    r = r.join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return r.select(
        F.col("n_name").alias("ats"),
        F.col("c_custkey").alias("token"),
        F.col("c_name").alias("company"),
        (F.col("r_name") == "AMERICA").cast("int").alias("us_signal"),
        (F.col("c_custkey") % 7).cast("int").alias("failures"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 101).alias("last_success"),
    )


def registry_counts(spark, sf_dir):
    return R.registry_counts(_registry(spark, sf_dir))


def budget_allocation(spark, sf_dir):
    return R.allocate(R.registry_counts(_registry(spark, sf_dir)), 400)


def registry_targets(spark, sf_dir):
    boards = _registry(spark, sf_dir)
    return R.targets(boards, R.allocate(R.registry_counts(boards), 400)).select("ats", "token", "company", "place")


def registry_upsert(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")

    def batch(rows, shift):
        return rows.select(
            F.col("c_mktsegment").alias("ats"),
            (F.col("c_custkey") % 200).alias("token"),
            F.col("c_name").alias("company"),
            F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("d"), F.col("c_custkey").cast("string"))).alias("domain"),
            F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).otherwise("").alias("board_url"),
            F.when(F.col("c_custkey") % 5 == 0, "note").otherwise("").alias("notes"),
            (F.col("c_acctbal") > 9000).cast("int").alias("us_signal"),
            (F.col("c_custkey") + shift).alias("seq"),
        )

    half = F.col("c_custkey") % 2 == 0
    return R.upsert_registry(batch(c.filter(half), 0), batch(c.filter(~half), 10_000_000))


def _run_of_jobs(spark, sf_dir, which):
    """Orders of the first run (0) or the second (1); together they are all orders.

    A third of the identities is only in the first, a third only in the second, the rest in both.
    """
    identity = (F.col("o_orderkey") / 4).cast("long")
    run = F.when(identity % 3 < 2, identity % 3).otherwise(F.col("o_orderkey") % 2)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(run == which)
    return o.select(
        identity.alias("identity"),
        (1 + F.col("o_custkey") % 3).cast("int").alias("authority"),
        F.col("o_orderpriority").alias("description"),
        F.when(F.col("o_custkey") % 4 == 0, "unknown").otherwise("remote").alias("workplace"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("salary_min"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("posted_at"),
        F.col("o_orderkey").alias("seq"),
    )


def _one_each(jobs):
    row = F.struct("authority", "description", "workplace", "salary_min", "posted_at")
    return jobs.groupBy("identity").agg(F.max_by(row, "seq").alias("j")).select("identity", "j.*")


def job_upsert(spark, sf_dir):
    stored = _one_each(_run_of_jobs(spark, sf_dir, 0)).withColumn("first_seen", F.lit(1)).withColumn("last_seen", F.lit(1))
    incoming = _one_each(_run_of_jobs(spark, sf_dir, 1))
    return S.upsert_jobs(stored, incoming, F.lit(2), ["description", "workplace", "salary_min", "posted_at"])


def store_upsert(spark, sf_dir):
    """The same two runs through a versioned store: the second reads and rewrites the buckets that it touches."""
    store = Store(spark, f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}")
    fields = ["description", "workplace", "salary_min", "posted_at"]
    for run in (0, 1):
        incoming, before = cut(_one_each(_run_of_jobs(spark, sf_dir, run)), "incoming"), store.latest()
        touched = store.touched(incoming)
        stored = store.read(before, "jobs", touched) if before else None
        if stored is None:
            stored = incoming.limit(0).withColumn("first_seen", F.lit(1)).withColumn("last_seen", F.lit(1))
        store.commit(run, {"jobs": S.upsert_jobs(stored, incoming, F.lit(run + 1), fields)}, {}, touched, before)
    return store.read(store.latest(), "jobs")


def cluster_postings(spark, sf_dir):
    return C.clusters(identified(postings(spark, sf_dir)))


def resolve_jobs(spark, sf_dir):
    out = C.resolve(normalised(postings(spark, sf_dir)))
    return out.withColumn("sources", F.array_join("sources", ","))


def within_source_dedup(spark, sf_dir):
    kept = C.first_of_source(postings(spark, sf_dir))
    return kept.groupBy("source").agg(F.count("*").alias("n_postings"), F.sum("ingest_seq").alias("seq_sum"))


def salary_extract(spark, sf_dir):
    p = over_distinct(postings(spark, sf_dir).select("ingest_seq", "description"), ["description"], lambda t: t.withColumn("p", pay(F.col("description"))), "pay")
    return p.select("ingest_seq", "p.minimum", "p.maximum", "p.currency", "p.period", N.annualized(F.col("p.minimum"), F.col("p.period")).alias("yearly"))


def relative_dates(spark, sf_dir):
    unit = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Day' WHEN 1 THEN 'Week' WHEN 2 THEN 'Month' ELSE 'Year' END")
    said = F.concat(F.lit("Posted "), (1 + F.col("o_orderkey") % 30).cast("string"), F.lit("+ "), unit, F.lit("s Ago"))
    said = F.when(F.col("o_orderkey") % 11 == 0, "Posted Today").when(F.col("o_orderkey") % 11 == 1, "Posted Yesterday").when(F.col("o_orderkey") % 11 == 2, "soon").otherwise(said)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", said.alias("said"))
    return o.select("o_orderkey", N.relative_date(F.col("said"), F.lit("1998-01-01").cast("date")).cast("string").alias("posted"))


QUERIES = {
    "latest_verdict": latest_verdict,
    "new_vs_seen": new_vs_seen,
    "first_last_seen": first_last_seen,
    "status_current": status_current,
    "board_health": board_health,
    "coverage_report": coverage_report,
    "registry_counts": registry_counts,
    "budget_allocation": budget_allocation,
    "registry_targets": registry_targets,
    "registry_upsert": registry_upsert,
    "job_upsert": job_upsert,
    "store_upsert": store_upsert,
    "cluster_postings": cluster_postings,
    "resolve_jobs": resolve_jobs,
    "within_source_dedup": within_source_dedup,
    "salary_extract": salary_extract,
    "relative_dates": relative_dates,
    "streaming_board_health": streaming_board_health,
}

_VERDICTS = f"""SELECT event_type AS search, user_id AS identity, event_id AS run_seq, {THIRD} AS run, value AS score,
  CASE WHEN value >= 20 THEN 'match' ELSE 'rejected' END AS decision FROM events"""
_HEALTH = f"""WITH o AS (SELECT user_id AS board, event_id AS seq, {KIND} AS kind FROM events),
k AS (SELECT *, max(CASE WHEN kind = 'ok' THEN seq END) OVER (PARTITION BY board) AS last_ok FROM o),
h AS (SELECT board, count(*) FILTER (WHERE kind = 'gone' AND seq > coalesce(last_ok, -1)) AS consecutive_failures,
  max(CASE WHEN kind = 'ok' THEN seq END) AS last_success, arg_max(kind, seq) AS last_outcome FROM k GROUP BY board)"""
_REGISTRY = """SELECT n_name AS ats, c_custkey AS token, c_name AS company, CAST(r_name = 'AMERICA' AS INTEGER) AS us_signal, c_custkey % 7 AS failures,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 101 END AS last_success
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_ALLOCATION = f"""r AS ({_REGISTRY}), c AS (SELECT ats, count(*) AS n_boards FROM r WHERE failures < 5 GROUP BY ats),
s AS (SELECT *, sum(n_boards) OVER () AS total FROM c),
f AS (SELECT *, (n_boards * 400) // total AS base, (n_boards * 400) % total AS rest FROM s),
a AS (SELECT ats, n_boards, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, ats) <= 400 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocation FROM f)"""


def _run_sql(which: int) -> str:
    return f"""SELECT identity, j.authority, j.description, j.workplace, j.salary_min, j.posted_at FROM (
      SELECT o_orderkey // 4 AS identity, arg_max({{'authority': CAST(1 + o_custkey % 3 AS INTEGER), 'description': o_orderpriority,
        'workplace': CASE WHEN o_custkey % 4 = 0 THEN 'unknown' ELSE 'remote' END, 'salary_min': CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END,
        'posted_at': CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END}}, o_orderkey) AS j
      FROM orders WHERE CASE WHEN (o_orderkey // 4) % 3 < 2 THEN (o_orderkey // 4) % 3 ELSE o_orderkey % 2 END = {which} GROUP BY 1)"""


_CLUSTERS = f"""WITH RECURSIVE {O.JOBS},
sig AS (
  SELECT ingest_seq, 'id:' || identity AS signal FROM jobs
  UNION SELECT ingest_seq, 'url:' || {O.canonical("url")} FROM jobs
  UNION SELECT ingest_seq, 'ext:' || source || ':' || external_id FROM jobs),
pair AS (SELECT DISTINCT signal, min(ingest_seq) OVER (PARTITION BY signal) AS least, ingest_seq FROM sig),
edge AS (SELECT DISTINCT least AS a, ingest_seq AS b FROM pair WHERE least <> ingest_seq UNION SELECT DISTINCT ingest_seq, least FROM pair WHERE least <> ingest_seq),
reach(node, seen) AS (SELECT ingest_seq, ingest_seq FROM jobs UNION SELECT e.b, r.seen FROM reach r JOIN edge e ON e.a = r.node),
cl AS (SELECT node AS ingest_seq, min(seen) AS cluster FROM reach GROUP BY node)"""


ORACLE_SQL = {
    "latest_verdict": f"SELECT search, identity, run_seq, decision, score FROM ({_VERDICTS}) QUALIFY row_number() OVER (PARTITION BY search, identity ORDER BY run_seq DESC) = 1",
    "new_vs_seen": f"""WITH v AS ({_VERDICTS}), m AS (SELECT *, NOT EXISTS (SELECT 1 FROM v b WHERE b.search = a.search AND b.identity = a.identity AND b.run < 3 AND b.decision = 'match') AS is_new FROM v a WHERE run = 3)
      SELECT search, decision, is_new, count(*) AS n, count(DISTINCT identity) AS n_jobs FROM m GROUP BY ALL""",
    "first_last_seen": "SELECT user_id AS identity, event_type AS source, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS times FROM events GROUP BY 1, 2",
    "status_current": """WITH e AS (SELECT user_id AS identity, event_id AS seq, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events),
      c AS (SELECT *, count(*) FILTER (WHERE status IS DISTINCT FROM previous) OVER (PARTITION BY identity ORDER BY seq) AS changes FROM e)
      SELECT identity, status, previous, changes FROM c QUALIFY row_number() OVER (PARTITION BY identity ORDER BY seq DESC) = 1""",
    "board_health": f"{_HEALTH} SELECT board, consecutive_failures, last_success, last_outcome, consecutive_failures >= 5 AS evicted FROM h",
    "streaming_board_health": f"{_HEALTH} SELECT board, consecutive_failures, last_outcome, consecutive_failures >= 5 AS evicted FROM h",
    "coverage_report": """WITH e AS (SELECT event_type || ':' || CAST(user_id % 7 AS VARCHAR) AS source, CASE WHEN value < 10 THEN 'blocked' WHEN value < 12 THEN 'unavailable' ELSE 'ok' END AS kind, CAST(floor(value) AS BIGINT) AS found FROM events),
      c AS (SELECT source, count(*) AS boards, count(*) FILTER (WHERE kind = 'ok') AS ok_boards, count(*) FILTER (WHERE kind = 'blocked') AS blocked_boards, CAST(sum(found) AS BIGINT) AS found FROM e GROUP BY source)
      SELECT *, CASE WHEN ok_boards = 0 AND blocked_boards > 0 THEN 'blocked' WHEN ok_boards > 0 AND ok_boards < boards THEN 'partial' WHEN ok_boards = 0 THEN 'unavailable' ELSE 'ok' END AS status FROM c""",
    "registry_counts": f"SELECT ats, count(*) AS n_boards FROM ({_REGISTRY}) WHERE failures < 5 GROUP BY ats",
    "budget_allocation": f"WITH {_ALLOCATION} SELECT ats, n_boards, allocation FROM a",
    "registry_targets": f"""WITH {_ALLOCATION}, t AS (SELECT ats, token, company, CAST(row_number() OVER (PARTITION BY ats ORDER BY us_signal DESC, failures, last_success DESC NULLS LAST, company, token) AS INTEGER) AS place FROM r WHERE failures < 5)
      SELECT t.ats, token, company, place FROM t JOIN a ON t.ats = a.ats WHERE place <= allocation""",
    "budget_left": f"WITH {_ALLOCATION} SELECT ats, n_boards, allocation, greatest(0, n_boards - allocation) AS not_reached FROM a",
    "registry_upsert": """WITH b AS (SELECT c_mktsegment AS ats, c_custkey % 200 AS token, c_name AS company, CASE WHEN c_custkey % 4 = 0 THEN 'd' || CAST(c_custkey AS VARCHAR) END AS domain,
        CASE WHEN c_custkey % 3 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR) END AS board_url, CASE WHEN c_custkey % 5 = 0 THEN 'note' END AS notes,
        CAST(c_acctbal > 9000 AS INTEGER) AS us_signal, c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10000000 END AS seq, c_custkey % 2 = 0 AS old FROM customer)
      SELECT ats, token, arg_max(company, seq) AS company, arg_min(domain, seq) FILTER (WHERE domain IS NOT NULL) AS domain, arg_max(board_url, seq) FILTER (WHERE board_url IS NOT NULL) AS board_url,
        arg_max(notes, seq) FILTER (WHERE notes IS NOT NULL) AS notes, max(us_signal) AS us_signal, NOT bool_or(old) AS is_new FROM b GROUP BY ats, token""",
    "job_upsert": f"""WITH s AS ({_run_sql(0)}), i AS ({_run_sql(1)}),
      b AS (SELECT s.*, i.identity AS i_identity, i.authority AS i_authority, i.description AS i_description, i.workplace AS i_workplace, i.salary_min AS i_salary_min, i.posted_at AS i_posted_at FROM s FULL JOIN i ON s.identity = i.identity),
      r AS (SELECT *, identity IS NULL OR (i_identity IS NOT NULL AND (i_authority > authority OR (i_authority = authority AND length(i_description) >= length(description)
        AND (workplace = 'unknown' OR i_workplace <> 'unknown') AND (salary_min IS NULL OR i_salary_min IS NOT NULL) AND (posted_at IS NULL OR i_posted_at IS NOT NULL)))) AS swap FROM b)
      SELECT coalesce(identity, i_identity) AS identity, {", ".join(f"CASE WHEN swap THEN i_{c} ELSE {c} END AS {c}" for c in ("authority", "description", "workplace", "salary_min", "posted_at"))},
        CASE WHEN identity IS NULL THEN 2 ELSE 1 END AS first_seen, CASE WHEN i_identity IS NULL THEN 1 ELSE 2 END AS last_seen FROM r""",
    "cluster_postings": f"{_CLUSTERS} SELECT ingest_seq, cluster FROM cl",
    "resolve_jobs": f"""{_CLUSTERS}, m AS (SELECT jobs.*, cluster, {O.canonical("url")} AS canonical FROM jobs JOIN cl USING (ingest_seq)),
      k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY authority DESC, description <> '' DESC, length(description) DESC, ingest_seq) AS nth FROM m),
      g AS (SELECT cluster, count(*) AS n_postings, count(DISTINCT canonical) AS n_urls, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, arg_min(description, ingest_seq) FILTER (WHERE description <> '') AS borrowed FROM m GROUP BY cluster)
      SELECT g.cluster, k.ingest_seq AS canonical_seq, k.identity, k.title, k.url, CAST(k.authority AS INTEGER) AS authority, coalesce(nullif(k.description, ''), borrowed, '') AS description, n_postings, n_urls, sources
      FROM g JOIN k ON g.cluster = k.cluster AND nth = 1""",
    "within_source_dedup": f"""WITH p AS ({O.POSTINGS_SQL}), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, coalesce(nullif(external_id, ''), url) ORDER BY ingest_seq) = 1)
      SELECT source, count(*) AS n_postings, CAST(sum(ingest_seq) AS BIGINT) AS seq_sum FROM f GROUP BY source""",
    "salary_extract": f"""WITH p AS ({O.POSTINGS_SQL}), m AS (SELECT ingest_seq, regexp_replace(description, '\\b401\\s*k\\b', ' ', 'gi') AS t FROM p),
      x AS (SELECT ingest_seq, t, regexp_extract(t, '\\$([\\d,.]*\\d)(k?)\\s*(?:-|to)\\s*\\$([\\d,.]*\\d)(k?)', ['low', 'lk', 'high', 'hk']) AS g FROM m),
      y AS (SELECT ingest_seq, t, TRY_CAST(replace(g.low, ',', '') AS DOUBLE) * CASE WHEN g.lk = 'k' THEN 1000 ELSE 1 END AS minimum, TRY_CAST(replace(g.high, ',', '') AS DOUBLE) * CASE WHEN g.hk = 'k' THEN 1000 ELSE 1 END AS maximum FROM x)
      SELECT ingest_seq, minimum, maximum, CASE WHEN minimum IS NOT NULL THEN 'USD' END AS currency, CASE WHEN minimum IS NOT NULL THEN CASE WHEN t LIKE '%per hour%' THEN 'hour' ELSE 'year' END END AS period,
        minimum * CASE WHEN t LIKE '%per hour%' THEN 2080 ELSE 1 END AS yearly FROM y""",
    "relative_dates": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 11 = 0 THEN DATE '1998-01-01' WHEN o_orderkey % 11 = 1 THEN DATE '1997-12-31' WHEN o_orderkey % 11 = 2 THEN NULL
      ELSE DATE '1998-01-01' - CAST((1 + o_orderkey % 30) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 30 ELSE 365 END AS INTEGER) END AS VARCHAR) AS posted FROM orders""",
}
ORACLE_SQL["store_upsert"] = ORACLE_SQL["job_upsert"]
