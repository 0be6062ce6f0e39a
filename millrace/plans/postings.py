"""Postings: the view that the queries read, and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions.pay import pay
from millrace.functions.text import collapse_whitespace
from millrace.functions.urls import url_authority
from millrace.operators.gates import searchable_text
from millrace.operators.tables import cut, over_distinct, spread

# The same text runs in Spark and DuckDB; it projects postings out of ``orders``.
POSTINGS_SQL = """
SELECT o_orderkey AS ingest_seq,
 CASE o_orderkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workday' ELSE 'usajobs' END AS source,
 CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 5 THEN 5 ELSE 0 END AS STRING) AS external_id,
 CONCAT(CASE o_custkey % 6 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Staff ' WHEN 3 THEN 'Senior Director of ' ELSE '' END,
  CASE o_custkey % 8 WHEN 0 THEN 'Accountant' WHEN 1 THEN 'Project Manager' WHEN 2 THEN 'Frontend Engineer' WHEN 3 THEN 'Accounts Payable Specialist' WHEN 4 THEN 'Program Manager' WHEN 5 THEN 'Web Developer' WHEN 6 THEN 'Internal Auditor' ELSE 'Cash Management Analyst' END,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' - Dallas, TX' WHEN 2 THEN ' | Remote' ELSE ' (Req 1234)' END) AS title,
 CONCAT('Employer ', CAST(o_custkey % 97 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' LLC' ELSE ' Group' END) AS company,
 CONCAT('employer', CAST(o_custkey % 97 AS STRING), '.com') AS employer_domain,
 CONCAT(CASE o_orderkey % 3 WHEN 0 THEN 'https://boards.greenhouse.io' WHEN 1 THEN 'https://WWW.Jobs.lever.co' ELSE CONCAT('https://careers.employer', CAST(o_custkey % 97 AS STRING), '.com') END,
  '/jobs/', CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 6 THEN 6 ELSE 0 END AS STRING),
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '?utm_source=feed&b=2&a=1' WHEN 2 THEN '/' ELSE '#top' END) AS url,
 CASE o_orderkey % 10 WHEN 0 THEN 'Remote - US' WHEN 1 THEN 'Dallas, TX' WHEN 2 THEN 'Dallas, Texas' WHEN 3 THEN 'Dallas-Fort Worth, TX' WHEN 4 THEN 'Toronto, Canada' WHEN 5 THEN 'Remote' WHEN 6 THEN '' WHEN 7 THEN 'Atlanta, Georgia' WHEN 8 THEN 'EMEA' ELSE 'San Francisco, CA' END AS location_raw,
 CASE WHEN o_orderkey % 7 = 0 THEN 'US' END AS country_hint,
 CASE o_custkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS workplace_hint,
 CASE o_custkey % 5 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Contractor' WHEN 2 THEN 'FullTime' ELSE CAST(NULL AS STRING) END AS employment_type,
 CASE o_orderkey % 12
  WHEN 0 THEN 'Own accounts payable. CPA a plus.'
  WHEN 1 THEN 'Lead the close. Active CPA license required.'
  WHEN 2 THEN CONCAT('Requirements:', CHR(10), '- Bachelor degree', CHR(10), '- CPA')
  WHEN 3 THEN CONCAT('Preferred Qualifications:', CHR(10), '- CPA', CHR(10), '- audits')
  WHEN 4 THEN 'No CPA required. Salary: $80,000-$95,000 per year. 401k match.'
  WHEN 5 THEN 'Pay range $22.00 - $28.00 per hour. CPA preferred; CPA required for promotion.'
  WHEN 6 THEN CONCAT('- Excel required', CHR(10), '- CPA a plus', CHR(10), '- MBA preferred')
  WHEN 7 THEN 'Our team includes a CPA. No visa sponsorship. Hybrid, 3 days in office.'
  WHEN 8 THEN 'Fully remote React components. Visa sponsorship available.'
  WHEN 9 THEN 'Enjoy a $50 monthly wellness stipend. Licensed CPAs required to apply.'
  WHEN 10 THEN 'Security clearance not required. PMP preferred. Compensation: $90k to $110k'
  ELSE '' END AS description,
 CASE o_orderkey % 3 WHEN 0 THEN CAST(FLOOR(o_totalprice / 4) AS DOUBLE) WHEN 1 THEN CAST(20 + o_custkey % 40 AS DOUBLE) END AS salary_min,
 CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'hour' END AS salary_period,
 CAST(o_orderdate AS DATE) AS posted_at
FROM orders
"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(POSTINGS_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)


def _placed(t: DataFrame) -> DataFrame:
    t = t.withColumn("_place", collapse_whitespace(F.coalesce("location_raw", F.lit(""))))
    t = t.withColumn("_region", N.state_of(F.col("_place"))).withColumn("_own", N.country_of(F.col("_place")))
    t = t.withColumn("_loc", N.location(F.col("_place"), F.col("country_hint"), F.col("_region"), F.col("_own")))
    return t.withColumn("_bucket", N.bucket_of(F.col("_loc"))).drop("_place", "_region", "_own")


def _headed(t: DataFrame) -> DataFrame:
    headline = F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("location_raw", F.lit("")))
    return t.withColumns(
        {
            "_title": collapse_whitespace(F.col("title")),
            "_title_key": N.title_key(F.col("title")),
            "_head_country": N.country_of(F.concat_ws("\n", "title", "location_raw")),
            "_head_workplace": F.nullif(N.workplace_in(headline), F.lit("unknown")),
        }
    )


def _named(t: DataFrame) -> DataFrame:
    return t.withColumn("_company", collapse_whitespace(F.col("company"))).withColumn("_company_key", N.company_key(F.col("company")))


def _described(t: DataFrame) -> DataFrame:
    return t.withColumn("_text_workplace", N.workplace_in(F.col("description"))).withColumn("_pay", pay(F.col("description")))


def placed(raw: DataFrame) -> DataFrame:
    """Raw postings with ``_loc``, ``_bucket`` and the keys of title and company.

    Places, headlines and employers repeat from posting to posting, so that each different one is worked
    out once.
    """
    raw = over_distinct(spread(raw, "ingest_seq"), ["location_raw", "country_hint"], _placed, "places")
    raw = over_distinct(raw, ["title", "location_raw"], _headed, "headlines")
    return over_distinct(raw, ["company"], _named, "companies")


def _identity() -> Column:
    return F.substring(F.sha1(F.concat_ws("|", "_company_key", "_title_key", "_bucket").cast("binary")), 1, 16)


def identified(raw: DataFrame) -> DataFrame:
    """Raw postings with their identity only, for what asks neither for texts nor for pay."""
    return placed(raw).withColumn("identity", _identity())


def normalised(raw: DataFrame) -> DataFrame:
    """Raw postings in one shape: location, workplace, employment type, authority, identity, pay, text.

    The workplace comes from the source, else from title and location, else from the description; the
    country never from the description. Pay that the source does not state is read from the description.
    Descriptions that are posted again and again are read once. The result is a written table.
    """
    title, text, loc = F.col("title"), F.col("description"), F.col("_loc")
    for name, kind in (("salary_max", "double"), ("salary_currency", "string"), ("apply_url", "string"), ("employer_domain", "string")):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    raw = over_distinct(placed(raw), ["description"], _described, "descriptions")
    stated = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()

    def money(name, part):
        return F.when(stated, F.col(name)).otherwise(F.col("_pay")[part]).alias(name)

    job = raw.select(
        "ingest_seq",
        "source",
        "external_id",
        "url",
        "apply_url",
        "employer_domain",
        "location_raw",
        "country_hint",
        "posted_at",
        money("salary_min", "minimum"),
        money("salary_max", "maximum"),
        money("salary_currency", "currency"),
        money("salary_period", "period"),
        "description",
        F.col("_title").alias("title"),
        F.col("_company").alias("company"),
        F.struct(loc["raw"].alias("raw"), loc["city"].alias("city"), loc["region"].alias("region"), F.coalesce(loc["country"], "_head_country").alias("country")).alias("location"),
        F.coalesce(F.nullif("workplace_hint", F.lit("unknown")), "_head_workplace", "_text_workplace", F.lit("unknown")).alias("workplace"),
        F.coalesce("employment_type", N.employment_type(F.concat_ws("\n", title, text))).alias("employment_type"),
        url_authority(F.col("url"), F.col("employer_domain")).alias("authority"),
        _identity().alias("identity"),
    )
    job = job.withColumn("searchable", searchable_text(F.col("title"), F.col("company"), F.col("description"), F.col("location_raw")))
    return cut(job, "normalised")
