"""Queries over boards, places and page texts that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions import vocab as V
from millrace.functions.text import html_to_text
from millrace.operators import registry as R
from millrace.operators.boards_in_urls import board_ref, boards_from_urls, boards_in_pages
from millrace.plans import oracle as O
from millrace.plans.postings import postings
from millrace.sources import boards, tolerant


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# URLs of all platforms with the customer's number, each with the board that it names: (url, ats, token)
_URLS = [
    ("'https://boards.greenhouse.io/acme' || n || '/jobs/4'", "'greenhouse'", "'acme' || n"),
    ("'https://acme' || n || '.greenhouse.io/'", "'greenhouse'", "'acme' || n"),
    ("'https://boards.greenhouse.io/embed/'", "NULL", "NULL"),
    ("'jobs.lever.co/Acme' || n", "'lever'", "'acme' || n"),
    ("'https://jobs.ashbyhq.com/acme' || n || '?utm=1'", "'ashby'", "'acme' || n"),
    ("'https://careers.smartrecruiters.com/AcMe' || n || '/x'", "'smartrecruiters'", "'AcMe' || n"),
    ("'https://apply.workable.com/acme' || n || '/j/9'", "'workable'", "'acme' || n"),
    ("'https://acme' || n || '.wd3.myworkdayjobs.com/en-US/Careers_' || n || '/job/1'", "'workday'", "'acme' || n || ':3:Careers_' || n"),
    ("'https://acme' || n || '.recruitee.com/o/dev'", "'recruitee'", "'acme' || n"),
    ("'https://acme' || n || '.bamboohr.com'", "'bamboohr'", "'acme' || n"),
    ("'https://acme' || n || '.breezy.hr/p/1'", "'breezy'", "'acme' || n"),
    ("'http://acme' || n || '.applytojob.com/apply'", "'jazzhr'", "'acme' || n"),
    ("'https://acme' || n || '.teamtailor.com'", "'teamtailor'", "'acme' || n"),
    ("'https://acme' || n || '.jobs.personio.de/job/2'", "'personio'", "'acme' || n"),
    ("'https://evilgreenhouse.io/acme' || n", "NULL", "NULL"),
    ("'https://www.acme' || n || '.com/careers'", "NULL", "NULL"),
]


def _cases(which: int, by: str = "c_custkey") -> str:
    return f"CASE {by} % {len(_URLS)} " + " ".join(f"WHEN {k} THEN {u[which]}" for k, u in enumerate(_URLS)) + " END"


def _urls(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").withColumn("n", F.col("c_custkey").cast("string"))
    return c.select("c_custkey", "c_name", "n", F.expr(_cases(0)).alias("url"))


def board_refs(spark, sf_dir):
    return _urls(spark, sf_dir).select("c_custkey", board_ref(F.col("url")).alias("r")).select("c_custkey", "r.ats", "r.token")


def registry_from_urls(spark, sf_dir):
    u = _urls(spark, sf_dir).select("url", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("company"), F.col("c_custkey").alias("seq"))
    incoming = boards_from_urls(u)
    return R.upsert_registry(incoming.limit(0), incoming).select("ats", "token", "company", "board_url")


# What an employer's own page holds: a link, a script with a bare URL, an embedded board.
_MARKUP = """CASE page_id % 4 WHEN 0 THEN '<a href="https://jobs.lever.co/emp' || page_id || '/x">jobs</a>' WHEN 1 THEN '<script>load("https://emp' || page_id || '.bamboohr.com/list")</script>'
  WHEN 2 THEN '<iframe src="https://boards.greenhouse.io/embed/job_board?b=1&for=Emp' || page_id || '"></iframe><a href=''/careers''>' ELSE '<form action="https://apply.workable.com/emp' || page_id || '/">' END"""


def boards_in_html(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.expr(_MARKUP.replace("''/careers''", "\\'/careers\\'"))).alias("html"))
    return boards_in_pages(pages, "page_id", "html")


_NAMES = ["united states", *V.NON_US_COUNTRIES]


def country_pairs(spark, sf_dir):
    """Places that name two countries: the first of the table counts, wherever it stands."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    one, two = (F.element_at(names, F.expr(f"CAST({k} % {len(_NAMES)} + 1 AS INT)")) for k in ("c_custkey", "(c_custkey DIV 7 * 3)"))
    place = F.concat(F.initcap(one), F.when(F.col("c_custkey") % 2 == 0, " or ").otherwise(", "), two)
    return _read(spark, sf_dir, "customer").select("c_custkey", N.country_of(place).alias("country"))


_ENTITIES = [("&eacute;", "é"), ("&#8211;", "–"), ("&#x20AC;", "€"), ("&copy;", "©"), ("&amp;eacute;", "é"), ("&nosuch;", "&nosuch;"), ("&alpha;&omega;", "αω"), ("&quot;x&quot;", '"x"')]


def entities(spark, sf_dir):
    """Page titles with character references of all kinds as text."""
    ref = F.element_at(F.array(*[F.lit(e) for e, _ in _ENTITIES]), (F.col("page_id") % len(_ENTITIES) + 1).cast("int"))
    pages = _read(spark, sf_dir, "pages").select("page_id", html_to_text(F.concat(F.lit("<p>caf"), ref, F.lit(" "), "url", F.lit("</p>"))).alias("text"))
    return pages.select("page_id", "text")


def registry_seed(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    rows = c.select(
        F.col("c_name").alias("company"), F.lower("c_mktsegment").alias("ats"), (F.col("c_custkey") % 300).cast("string").alias("token"),
        F.lit(None).cast("string").alias("domain"), F.lit("").alias("board_url"), (F.col("c_custkey") % 3 == 0).cast("int").alias("us_signal"),
        F.create_map(F.lit("site"), F.col("c_nationkey").cast("string")).alias("extra"), F.col("c_custkey").alias("seq"),
    )
    stored = rows.filter("seq % 5 = 0").withColumn("notes", F.lit(None).cast("string")).drop("extra")
    _, report = R.seed(stored.select("ats", "token", "company", "domain", "board_url", "notes", "us_signal", "seq"), rows, only_us=True)
    return report


def registry_build(spark, sf_dir):
    u = _urls(spark, sf_dir)
    second = F.concat(F.lit("https://jobs.lever.co/shared"), (F.col("c_custkey") % 7).cast("string"))
    country = F.when(F.col("c_custkey") % 9 == 0, F.array(F.lit(" USA "))).otherwise(F.array(F.lit("France")))
    records = u.select(F.col("c_name").alias("name"), F.lit("https://www.acme.com/x").alias("website"), country.alias("countries"), F.array("url", second).alias("ats_links"), F.col("c_custkey").alias("seq"))
    return R.build(records).select("ats", "token", "company", "domain", "us_signal")


def _boards(spark, sf_dir):
    """A registry of the postings' employers, whose board is the employer's number on each platform."""
    p = postings(spark, sf_dir).select("source", F.regexp_extract("employer_domain", r"(\d+)", 1).alias("token"))
    p = p.distinct().filter("CAST(token AS INT) % 3 > 0")
    return p.select(F.col("source").alias("ats"), "token", F.concat(F.lit("Registered "), "token").alias("company"), F.concat(F.lit("reg"), "token", F.lit(".com")).alias("domain"))


def postings_with_registry(spark, sf_dir):
    p = postings(spark, sf_dir).withColumn("board", F.regexp_extract("employer_domain", r"(\d+)", 1))
    out = R.with_registry(p, _boards(spark, sf_dir), "board")
    return out.groupBy("source", "company", "employer_domain").agg(F.count("*").alias("n"))


def budget_left(spark, sf_dir):
    from millrace.plans.state_queries import _registry

    boards = _registry(spark, sf_dir)
    return R.not_reached(boards, R.allocate(R.registry_counts(boards), 400)).select("ats", "n_boards", "allocation", "not_reached")


def fetch_outcomes(spark, sf_dir):
    """Kinds of failures and verification states of a fetch log."""
    o = _read(spark, sf_dir, "orders")
    status = F.expr("CASE o_orderkey % 9 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 403 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN NULL WHEN 7 THEN 204 ELSE 401 END")
    asked = F.concat(F.lit("https://www.Jobs.example.com/job/"), F.col("o_custkey").cast("string"))
    got = F.when(F.col("o_custkey") % 2 == 0, F.concat(asked, F.lit("/?from=x"))).otherwise(F.lit("https://jobs.example.com/"))
    f = o.select(R.failure_kind(status, F.col("o_custkey") % 4 > 0).alias("kind"), R.verification(status, asked, got).alias("state"))
    return f.groupBy("kind", "state").agg(F.count("*").alias("n"))


# Payloads of boards, one for each customer, with wrong items among good ones; the same text runs in Spark and DuckDB.
ITEM = """CONCAT('{"id":', CAST(o_orderkey AS STRING), ',"title":"Job ', o_orderpriority, '","absolute_url":"https://x.example/', CAST(o_orderkey AS STRING),
  '","location":', CASE WHEN o_orderkey % 13 = 0 THEN '4' ELSE CONCAT('{"name":"', o_orderpriority, '"}') END,
  ',"departments":', CASE WHEN o_orderkey % 11 = 0 THEN '"none"' ELSE CONCAT('[{"id":1,"name":"', o_orderstatus, '"}]') END,
  ',"first_published":"', CASE WHEN o_orderkey % 17 = 0 THEN 'some day' ELSE CONCAT(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:00:00Z') END, '"}')"""


def _items(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    boards_of = orders.groupBy(F.col("o_custkey").cast("string").alias("board")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.expr(ITEM).alias("t")))).alias("i"))
    text = F.concat(F.lit('{"jobs":['), F.array_join(F.transform("i", lambda x: x["t"]), ","), F.lit("]}"))
    return tolerant.read_items(boards_of.select("board", text.alias("payload")), "greenhouse")


def tolerant_payloads(spark, sf_dir):
    """Postings of payloads in which some items are wrong."""
    read = boards.greenhouse(_items(spark, sf_dir)[0])
    return read.select("external_id", "company", "title", "url", "location_raw", "department", "posted_at")


def payload_quarantine(spark, sf_dir):
    """Which items of those payloads are wrong, and where."""
    return _items(spark, sf_dir)[1].select("board", "path", "problem")


QUERIES = {
    "tolerant_payloads": tolerant_payloads,
    "payload_quarantine": payload_quarantine,
    "board_refs": board_refs,
    "registry_from_urls": registry_from_urls,
    "boards_in_html": boards_in_html,
    "country_pairs": country_pairs,
    "entities": entities,
    "registry_seed": registry_seed,
    "registry_build": registry_build,
    "postings_with_registry": postings_with_registry,
    "budget_left": budget_left,
    "fetch_outcomes": fetch_outcomes,
}

_TOLD = f"SELECT c_custkey, c_name, {_cases(0)} AS url, {_cases(1)} AS ats, {_cases(2)} AS token FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS n FROM customer)"
_TABLE = ", ".join(f"({k}, {O.q(p)}, {O.q(code)})" for k, (p, code) in enumerate([("united states", "US"), *V.NON_US_COUNTRIES.items()]))
_EMP = "substr(employer_domain, 9, length(employer_domain) - 12)"
ORACLE_SQL = {
    "board_refs": f"SELECT c_custkey, ats, token FROM ({_TOLD})",
    "registry_from_urls": f"SELECT ats, token, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE token END AS company, url AS board_url FROM ({_TOLD}) WHERE token IS NOT NULL",
    "boards_in_html": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'lever' WHEN 1 THEN 'bamboohr' WHEN 2 THEN 'greenhouse' ELSE 'workable' END AS ats, 'emp' || page_id AS token FROM pages",
    "country_pairs": f"""WITH t(o, p, code) AS (VALUES {_TABLE}) SELECT c_custkey, arg_min(code, o) AS country FROM customer JOIN t ON o IN (c_custkey % {len(_NAMES)}, c_custkey // 7 * 3 % {len(_NAMES)}) GROUP BY c_custkey""",
    "entities": "SELECT page_id, 'caf' || CASE page_id % " + str(len(_ENTITIES)) + " " + " ".join(f"WHEN {k} THEN {O.q(v)}" for k, (_, v) in enumerate(_ENTITIES)) + " END || ' ' || url AS text FROM pages",
    "registry_seed": """WITH r AS (SELECT lower(c_mktsegment) AS ats, c_custkey % 300 AS token, c_custkey % 5 = 0 AS stored, c_custkey % 3 = 0 AS us FROM customer), s AS (SELECT DISTINCT ats, token FROM r WHERE stored),
      u AS (SELECT r.ats, r.token, s.ats IS NULL AS fresh FROM r LEFT JOIN s ON r.ats = s.ats AND r.token = s.token WHERE us)
      SELECT ats, count(*) AS total, count(DISTINCT token) FILTER (WHERE fresh) AS added, count(*) - count(DISTINCT token) FILTER (WHERE fresh) AS existing FROM u GROUP BY ats""",
    "registry_build": f"""WITH l AS (SELECT c_custkey, c_name, ats, token, 0 AS nth FROM ({_TOLD}) UNION ALL SELECT c_custkey, c_name, 'lever', 'shared' || (c_custkey % 7), 1 FROM customer)
      SELECT ats, token, arg_min(c_name, c_custkey * 2 + nth) AS company, 'acme.com' AS domain, CAST(bool_or(c_custkey % 9 = 0) AS INTEGER) AS us_signal FROM l
      WHERE ats IN ('greenhouse', 'lever', 'ashby', 'workday', 'smartrecruiters', 'workable') GROUP BY ats, token""",
    "postings_with_registry": f"""WITH p AS ({O.POSTINGS_SQL}), e AS (SELECT *, {_EMP} AS e FROM p)
      SELECT source, CASE WHEN CAST(e AS INTEGER) % 3 > 0 THEN 'Registered ' || e ELSE company END AS company, CASE WHEN CAST(e AS INTEGER) % 3 > 0 THEN 'reg' || e || '.com' ELSE employer_domain END AS employer_domain, count(*) AS n FROM e GROUP BY ALL""",
    "fetch_outcomes": """WITH f AS (SELECT o_orderkey % 9 AS s, o_custkey % 4 > 0 AS parsed, o_custkey % 2 = 0 AS same FROM orders)
      SELECT CASE WHEN s IN (3, 4, 8) THEN 'blocked' WHEN s IN (1, 2) THEN 'gone' WHEN s IN (5, 6) THEN 'unavailable' WHEN NOT parsed THEN 'parse_error' ELSE 'ok' END AS kind,
        CASE WHEN s IN (1, 2) THEN 'gone' WHEN s IN (0, 7) AND same THEN 'live' ELSE 'inconclusive' END AS state, count(*) AS n FROM f GROUP BY ALL""",
}
_WRONG = "o_orderkey % 13 = 0 OR o_orderkey % 11 = 0"
ORACLE_SQL["tolerant_payloads"] = f"""SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CAST(o_custkey AS VARCHAR) AS company, 'Job ' || o_orderpriority AS title, 'https://x.example/' || o_orderkey AS url,
  o_orderpriority AS location_raw, o_orderstatus AS department, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS posted_at FROM orders WHERE NOT ({_WRONG})"""
ORACLE_SQL["payload_quarantine"] = f"""SELECT CAST(o_custkey AS VARCHAR) AS board, '$.jobs[' || pos || CASE WHEN o_orderkey % 13 = 0 THEN '].location' ELSE '].departments' END AS path,
  CASE WHEN o_orderkey % 13 = 0 THEN 'not an object' ELSE 'not a list' END AS problem
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE {_WRONG}"""
