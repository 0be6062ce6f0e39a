"""Which board a URL names, and which boards a page refers to."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import PARTS, host_of

# Path parts and host labels that are no board's name.
RESERVED = ["api", "v1", "v2", "v3", "accounts", "jobs", "job", "j", "embed", "search", "careers", "en-us", "en", "widget", "board", "boards", "www", "static", "assets"]
GREENHOUSE_LABELS = ["boards", "job-boards", "api", "boards-api", "my"]
ASHBY_LABELS = ["jobs", "api"]
# Platforms whose boards are named by the first part of the path, and by the host's label.
BY_PATH = {"lever.co": "lever", "smartrecruiters.com": "smartrecruiters", "workable.com": "workable"}
BY_LABEL = {"recruitee.com": "recruitee", "bamboohr.com": "bamboohr", "breezy.hr": "breezy", "applytojob.com": "jazzhr", "teamtailor.com": "teamtailor"}
PERSONIO = [".jobs.personio.de", ".jobs.personio.com"]
VENDORS = ["greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "workable.com", "recruitee.com", "bamboohr.com", "breezy.hr", "applytojob.com", "teamtailor.com"]
ATTRIBUTE = r"""(?i)(?:href|src|data-src|action)\s*=\s*["']([^"']+)["']"""
BARE = r"""(?i)https?://[\w.-]*(?:""" + "|".join(v.replace(".", r"\.") for v in VENDORS) + r""")[^\s"'<>]*"""
EMBEDDED = r"""(?i)boards\.greenhouse\.io/embed/job_board[^"']*?for=([\w-]+)"""


def _at(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))


def board_ref(url: Column) -> Column:
    """struct<ats, token> that a URL names, with nulls where it names none.

    Hosts match on whole labels; a URL may lack its scheme. A Workday board is tenant, instance and site in
    one token; SmartRecruiters names keep their case, all others are lower case.
    """
    url = F.trim(url)
    url = F.when(url == "", None).when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return _once(url, lambda u: _once(_pieces(u), lambda p: _once(_choice(p), lambda r: F.struct(F.when(r["token"].isNotNull(), r["ats"]).alias("ats"), r["token"].alias("token")))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is read: as a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(url: Column) -> Column:
    parts = F.filter(F.split(F.regexp_extract(url, PARTS, 3), "/"), lambda p: F.trim(p) != "")
    return F.struct(F.regexp_replace(host_of(url), r"^www\.", "").alias("host"), parts.alias("parts"))


def _choice(pieces: Column) -> Column:
    """struct<ats, token> by the platform's rules, the platform also where no token is named."""
    host, parts = pieces["host"], pieces["parts"]
    raw = F.coalesce(F.trim(F.get(parts, F.lit(0))), F.lit(""))
    named = F.nullif(F.lower(raw), F.lit(""))
    named = F.when(~named.isin(RESERVED), named)
    label = F.regexp_extract(host, r"^([^.]+)\.", 1)

    usable = F.filter(parts, lambda p: ~p.rlike("^[a-z]{2}-[A-Z]{2}$"))
    site = F.coalesce(F.get(F.filter(usable, lambda p: ~F.lower(p).isin(RESERVED)), F.lit(0)), F.get(usable, F.lit(0)))
    tenant = r"^([\w-]+)\.wd(\d+)\.myworkdayjobs\.com$"
    triple = F.when(site.isNotNull(), F.concat_ws(":", F.regexp_extract(host, tenant, 1), F.regexp_extract(host, tenant, 2), site))

    rules: list[tuple[Column, str, Column]] = [
        (host.rlike(tenant), "workday", triple),
        (_at(host, "greenhouse.io"), "greenhouse", F.coalesce(named, F.when(~label.isin(GREENHOUSE_LABELS), label))),
        (_at(host, "ashbyhq.com"), "ashby", F.coalesce(named, F.when(~label.isin(ASHBY_LABELS), label))),
    ]
    for domain, ats in BY_PATH.items():
        rules.append((_at(host, domain), ats, F.when(named.isNotNull(), raw) if ats == "smartrecruiters" else named))
    for domain, ats in BY_LABEL.items():
        own = F.substring(host, 1, F.length(host) - len(domain) - 1)
        rules.append((F.endswith(host, F.lit("." + domain)), ats, F.when((own != "") & ~own.contains("."), own)))
    rules.append((reduce(lambda x, y: x | y, [F.endswith(host, F.lit(p)) for p in PERSONIO]), "personio", label))

    none = F.lit(None).cast("string")
    found = F.struct(none.alias("ats"), none.alias("token"))
    for here, name, own in reversed(rules):
        found = F.when(here, F.struct(F.lit(name).alias("ats"), own.alias("token"))).otherwise(found)
    return found


def with_refs(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``ref``, what ``board_ref`` says of a column.

    It comes out of an array of one, so that a filter on it stays above: pushed below, it would read every URL again.
    """
    return df.withColumn("ref", F.explode_outer(F.array(board_ref(F.col(url)))))


def boards_in_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ats, token): each board that a page refers to, once.

    Boards are looked for in the attributes that hold links, in bare URLs of the platforms, and in the
    embedding form that names the board in its query.
    """
    embedded = F.transform(F.regexp_extract_all(html, F.lit(EMBEDDED), F.lit(1)), lambda t: F.struct(F.lit("greenhouse").alias("ats"), F.lower(t).alias("token")))
    links = F.array_union(F.regexp_extract_all(html, F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all(html, F.lit(BARE), F.lit(0)))
    named = pages.select(key, F.explode_outer(links).alias("link"))
    named = with_refs(named, "link").select(key, "ref")
    return named.unionByName(pages.select(key, F.explode(embedded).alias("ref"))).filter("ref.token IS NOT NULL").select(key, "ref.*").distinct()


def boards_from_urls(urls: DataFrame) -> DataFrame:
    """(ats, token, company, board_url, domain, us_signal, notes, seq) rows for the registry from (url, company, seq).

    The company is the token where none is given; URLs that name no board give no row.
    """
    r = with_refs(urls, "url").filter("ref.token IS NOT NULL")
    none = F.lit(None).cast("string")
    return r.select("ref.ats", "ref.token", F.coalesce("company", "ref.token").alias("company"), F.col("url").alias("board_url"), none.alias("domain"), F.lit(0).alias("us_signal"), none.alias("notes"), "seq")
