"""The board registry: import, upsert, ordering, budget split and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.boards_in_urls import with_refs
from millrace.operators.state import MAX_FAILURES

TRUTHY = ["1", "true", "yes", "y"]
BLOCKED_CODES, GONE_CODES = [401, 403, 429], [404, 410]


def failure_kind(http_status: Column, parsed: Column) -> Column:
    """ok, blocked, gone, unavailable or parse_error for a fetched page."""
    return (
        F.when(http_status.isin(BLOCKED_CODES), "blocked")
        .when(http_status.isin(GONE_CODES), "gone")
        .when(http_status.isNull() | (http_status >= 400), "unavailable")
        .when(~parsed, "parse_error")
        .otherwise("ok")
    )


def verification(http_status: Column, asked: Column, got: Column) -> Column:
    """gone, live or inconclusive; a page that moved to another host or path proves nothing."""
    path = r"^https?://(?:www\.)?([^?#]*?)/*(?:[?#].*)?$"
    moved = F.regexp_extract(F.lower(asked), path, 1) != F.regexp_extract(F.lower(got), path, 1)
    fine = http_status.between(200, 299)
    return F.when(http_status.isin(GONE_CODES), "gone").when(fine & moved, "inconclusive").when(fine, "live").otherwise("inconclusive")


def upsert_registry(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each (ats, token), with is_new for what ``stored`` lacks.

    Both have (ats, token, company, domain, board_url, notes, us_signal, seq). The last company wins,
    the first known domain stays, board_url and notes give way to later ones that are not empty, and
    the US signal is the largest.
    """
    rows = stored.withColumn("_old", F.lit(True)).unionByName(incoming.withColumn("_old", F.lit(False)))

    def last_filled(c):
        return F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq"))).alias(c)

    return rows.groupBy("ats", "token").agg(
        F.max_by("company", "seq").alias("company"),
        F.min_by(F.col("domain"), F.when(F.col("domain").isNotNull(), F.col("seq"))).alias("domain"),
        last_filled("board_url"),
        last_filled("notes"),
        F.max("us_signal").alias("us_signal"),
        (~F.bool_or("_old")).alias("is_new"),
    )


def registry_order() -> list[Column]:
    return [F.desc("us_signal"), F.asc("failures"), F.col("last_success").desc_nulls_last(), F.asc("company"), F.asc("token")]


def registry_counts(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("failures") < MAX_FAILURES).groupBy("ats").agg(F.count("*").alias("n_boards"))


def allocate(counts: DataFrame, budget: int) -> DataFrame:
    """Split a budget over platforms in proportion to their boards, largest remainders first.

    ``counts``: (ats, n_boards), a row for each platform. Ties go by name; no boards, no budget.
    """
    whole = Window.partitionBy()
    c = counts.withColumn("total", F.sum("n_boards").over(whole))
    share = F.when(F.col("total") > 0, F.col("n_boards") * F.lit(budget)).otherwise(0)
    c = c.withColumn("floor", F.floor(share / F.greatest("total", F.lit(1)))).withColumn("rest", share % F.greatest("total", F.lit(1)))
    left = F.when(F.col("total") > 0, F.lit(budget) - F.sum("floor").over(whole)).otherwise(0)
    c = c.withColumn("left", left).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rest"), "ats")))
    return c.select("ats", "n_boards", (F.col("floor") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("allocation"))


def targets(registry: DataFrame, allocation: DataFrame) -> DataFrame:
    """The first boards of each platform in registry order, as many as it was given.

    Platforms are few and may each hold many boards, so that boards are first cut to the whole budget
    within a hash part of the platform.
    """
    usable = registry.filter(F.col("failures") < MAX_FAILURES)
    usable = usable.join(F.broadcast(allocation.select("ats", "allocation")), "ats")  # a row for each platform
    part = usable.withColumn("_part", F.pmod(F.xxhash64("token"), F.lit(16)))
    near = Window.partitionBy("ats", "_part").orderBy(*registry_order())
    part = part.withColumn("_place", F.row_number().over(near)).filter(F.col("_place") <= F.col("allocation"))
    order = Window.partitionBy("ats").orderBy(*registry_order())
    out = part.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("allocation"))
    return out.drop("_part", "_place")


def coverage(outcomes: DataFrame) -> DataFrame:
    """(source, boards, ok_boards, found, status) from (source, kind, found) outcomes.

    Status by precedence: blocked, partial, unavailable, ok.
    """
    c = outcomes.groupBy("source").agg(
        F.count("*").alias("boards"),
        F.count_if(F.col("kind") == "ok").alias("ok_boards"),
        F.count_if(F.col("kind").isin("blocked", "rate_limited", "host_blocked")).alias("blocked_boards"),
        F.sum("found").cast("long").alias("found"),
    )
    status = (
        F.when((F.col("ok_boards") == 0) & (F.col("blocked_boards") > 0), "blocked")
        .when((F.col("ok_boards") > 0) & (F.col("ok_boards") < F.col("boards")), "partial")
        .when(F.col("ok_boards") == 0, "unavailable")
        .otherwise("ok")
    )
    return c.withColumn("status", status)


def readiness(coverage_rows: DataFrame, counts: DataFrame, min_sources=3, min_boards=500) -> DataFrame:
    """One row: working sources, routable boards, and whether both suffice."""
    working = coverage_rows.filter(F.col("status").isin("ok", "partial"))
    boards = counts.join(working.select(F.col("source").alias("ats")), "ats").agg(F.coalesce(F.sum("n_boards"), F.lit(0)).alias("routable_boards"))
    out = working.agg(F.count("*").alias("working_sources")).crossJoin(boards)  # two single rows
    return out.withColumn("ready", (F.col("working_sources") >= min_sources) & (F.col("routable_boards") >= min_boards))


def import_rows(raw: DataFrame, number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a registry CSV whose headers go by several names.

    ``number`` names a column with the row's number in its file, which rejected rows keep. A row needs a company and either a platform with a token or a URL that names them.
    """
    names = {c.strip().lower(): c for c in raw.columns}

    def pick(*aliases):
        found = [F.nullif(F.trim(F.col(f"`{names[a]}`")), F.lit("")) for a in aliases if a in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    rows = raw.select(
        pick("company", "name").alias("company"),
        pick("url", "board_url", "careers_url").alias("board_url"),
        F.lower(pick("ats")).alias("ats"),
        pick("token").alias("token"),
        F.coalesce(F.lower(pick("us")).isin(TRUTHY), F.lit(False)).alias("us_signal"),
        (F.col(number) if number else F.lit(None)).cast("long").alias("row_number"),
    )
    rows = with_refs(rows, "board_url").withColumnRenamed("ref", "_ref").withColumn("ats", F.coalesce("ats", "_ref.ats")).withColumn("token", F.coalesce("token", "_ref.token")).drop("_ref")
    fine = F.col("ats").isNotNull() & F.col("token").isNotNull()
    return rows.filter(fine).withColumn("company", F.coalesce("company", "token")), rows.filter(~fine)


def seed(stored: DataFrame, companies: DataFrame, only_us: bool = False) -> tuple[DataFrame, DataFrame]:
    """(registry, report) after a seed of (company, ats, token, domain, board_url, us_signal, extra, seq).

    ``extra`` is a map that goes into the notes as JSON. The report has a row for each platform: total,
    added, existing. Seeding once more adds nothing.
    """
    rows = companies.filter("us_signal = 1") if only_us else companies
    rows = rows.withColumn("notes", F.when(F.size("extra") > 0, F.to_json("extra"))).drop("extra")
    after = upsert_registry(stored, rows.select(*stored.columns))
    seen = stored.select("ats", "token").distinct().withColumn("_old", F.lit(True))
    told = rows.select("ats", "token").join(seen, ["ats", "token"], "left")
    first = F.row_number().over(Window.partitionBy("ats", "token").orderBy(F.lit(1)))
    told = told.withColumn("_added", F.col("_old").isNull() & (first == 1))
    report = told.groupBy("ats").agg(F.count("*").alias("total"), F.count_if("_added").alias("added"), F.count_if(~F.col("_added")).alias("existing"))
    return after, report


def usable(report: DataFrame, shipped: list[str]) -> DataFrame:
    """One row: boards of a seed, and those of platforms that have a reader."""
    return report.agg(F.sum("total").alias("seeded"), F.sum(F.when(F.col("ats").isin(shipped), F.col("total")).otherwise(0)).alias("usable"))


SUPPORTED = ["greenhouse", "lever", "ashby", "workday", "smartrecruiters", "workable"]
US_NAMES = ["united states", "usa", "us", "united states of america"]  # fixed values


def build(records: DataFrame) -> DataFrame:
    """A registry from a list of companies (name, website, countries, ats_links, seq).

    Every link that names a board of a supported platform is a row; the first record of a board wins, but
    any record's sign of the US counts. In order of platform and company.
    """
    us = F.exists("countries", lambda c: F.lower(F.trim(c)).isin(US_NAMES))
    r = records.filter(F.trim("name") != "").withColumn("us", F.coalesce(us, F.lit(False)))
    r = r.select(F.trim("name").alias("company"), "website", "us", "seq", F.posexplode("ats_links").alias("nth", "link"))
    r = with_refs(r, "link").filter(F.col("ref.ats").isin(SUPPORTED))
    site = F.regexp_extract(F.lower("website"), r"^(?:.*//)?(?:www\.)?([^/]*)", 1)
    first = F.struct("company", F.nullif(site, F.lit("")).alias("domain"), F.col("link").alias("board_url"))
    out = r.groupBy("ref.ats", "ref.token").agg(F.min_by(first, F.struct("seq", "nth")).alias("f"), F.bool_or("us").alias("us_signal"))
    return out.select("ats", "token", "f.*", F.col("us_signal").cast("int").alias("us_signal")).orderBy("ats", F.lower("company"), "token")


def routed(registry: DataFrame) -> DataFrame:
    """Boards with ``tenant`` and ``extra``: notes as a map, over which what the token says wins."""
    parts = F.split("token", ":")
    triple = (F.col("ats") == "workday") & (F.size(parts) == 3)
    notes = F.coalesce(F.from_json("notes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.when(triple, F.create_map(F.lit("wd"), F.get(parts, F.lit(1)), F.lit("site"), F.get(parts, F.lit(2)))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(notes, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return registry.withColumn("tenant", F.when(triple, F.get(parts, F.lit(0))).otherwise(F.col("token"))).withColumn("extra", F.map_concat(kept, own))


def not_reached(registry: DataFrame, allocation: DataFrame) -> DataFrame:
    """(ats, n_boards, allocation, not_reached): what the budget leaves out on each platform."""
    counts = registry_counts(registry).join(allocation.select("ats", "allocation"), "ats", "left").withColumn("allocation", F.coalesce("allocation", F.lit(0)))
    return counts.withColumn("not_reached", F.greatest(F.lit(0), F.col("n_boards") - F.col("allocation")))


def with_registry(raw: DataFrame, registry: DataFrame, board: str = "company") -> DataFrame:
    """Raw postings with the employer's name and domain from the registry, by platform and board.

    ``board`` is the column that holds a board's token. Postings of unknown boards keep what they have; one
    row for each board is taken from the registry. The join is left to Spark, which broadcasts a small registry.
    """
    r = registry.groupBy("ats", "token").agg(F.max(F.struct("company", "domain")).alias("r"))
    out = raw.join(r, (raw["source"] == r["ats"]) & (raw[board] == r["token"]), "left")
    domain = F.col("r.domain") if "employer_domain" not in raw.columns else F.coalesce("r.domain", "employer_domain")
    return out.withColumn("company", F.coalesce("r.company", raw["company"])).withColumn("employer_domain", domain).drop("r", "ats", "token")
