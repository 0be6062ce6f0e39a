"""Readers of landed board payloads: nested JSON in, raw postings out.

Each reader is a function of a DataFrame of payloads with an explicit schema; wrong items and broken
files give no row and end nothing. All give the columns of ``RAW``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.normalize import relative_date
from millrace.functions.pay import pay
from millrace.functions.text import html_to_text
from millrace.operators.sequence import numbered

RAW = ["source", "external_id", "title", "company", "url", "description", "location_raw", "country_hint", "workplace_hint", "employment_type", "department", "salary_min", "salary_max", "salary_currency", "salary_period", "posted_at", "apply_url", "extra"]

_DEPARTMENT = "array<struct<id:bigint,name:string>>"
SCHEMAS = {
    "greenhouse": f"jobs array<struct<id:bigint,title:string,updated_at:string,first_published:string,requisition_id:string,location:struct<name:string>,absolute_url:string,content:string,departments:{_DEPARTMENT},offices:array<struct<id:bigint,name:string,location:string>>>>, _corrupt_record string",
    "lever": "id string, text string, categories struct<location:string,team:string,commitment:string,department:string>, country string, workplaceType string, salaryRange struct<currency:string,interval:string,min:double,max:double>, hostedUrl string, applyUrl string, descriptionPlain string, description string, createdAt bigint, _corrupt_record string",
    "ashby": "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<string>,isRemote:boolean,workplaceType:string,department:string,departmentName:string,team:string,teamName:string,employmentType:string,compensationTierSummary:string,publishedAt:string,jobUrl:string,applyUrl:string,descriptionPlain:string,descriptionHtml:string,isListed:boolean>>, _corrupt_record string",
    "workday_list": "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>, _corrupt_record string",
    "workday_detail": "jobPostingInfo struct<title:string,jobDescription:string,location:string,postedOn:string,timeType:string,jobReqId:string,remoteType:string,country:struct<alpha2Code:string>,externalUrl:string>, _corrupt_record string",
    "usajobs": "SearchResult struct<SearchResultItems:array<struct<MatchedObjectId:string,MatchedObjectDescriptor:struct<PositionID:string,PositionTitle:string,PositionURI:string,ApplyURI:array<string>,OrganizationName:string,DepartmentName:string,PositionLocation:array<struct<LocationName:string,CountryCode:string>>,PositionSchedule:array<struct<Name:string>>,PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string,RateIntervalCode:string>>,PublicationStartDate:string,UserArea:struct<Details:struct<JobSummary:string,MajorDuties:string,Requirements:string,Qualifications:string,TeleworkEligible:string,RemoteIndicator:string>>>>>>, _corrupt_record string",
}
# What boards call pay periods and workplaces.
LEVER_PERIODS = {"per-year-salary": "year", "per-month-salary": "month", "per-week-salary": "week", "per-day-wage": "day", "per-hour-wage": "hour"}
WORKPLACES = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite"}
FEDERAL_PERIODS = {"PA": "year", "PH": "hour", "PD": "day", "PM": "month", "BW": "week"}


def landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Payload files of one kind; what cannot be read stands in ``_corrupt_record``.

    The company and the board's token are taken from a file name ``token.json`` and may be joined to
    a registry later.
    """
    rows = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("board", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def quarantined(payloads: DataFrame) -> DataFrame:
    return payloads.filter(F.col("_corrupt_record").isNotNull()).select("board", "_corrupt_record")


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(value))


def _offset_date(stamp: Column) -> Column:
    """The date as written, which a cast to a timestamp could move to the next day."""
    return F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd")


def _raw(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"posted_at": "date", "salary_min": "double", "salary_max": "double", "extra": "map<string,string>"}
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RAW])


def greenhouse(payloads: DataFrame) -> DataFrame:
    """Location from the job, else from its offices; html that was escaped twice becomes text."""
    j = payloads.select("board", F.explode("jobs").alias("j")).filter("j.id IS NOT NULL")
    offices = F.array_join(F.transform("j.offices", lambda o: F.coalesce(o["location"], o["name"])), ", ")
    return _raw(
        j,
        source=F.lit("greenhouse"),
        external_id=F.col("j.id"),
        title=F.col("j.title"),
        company=F.col("board"),
        url=F.col("j.absolute_url"),
        description=html_to_text(F.col("j.content")),
        location_raw=F.coalesce(F.nullif("j.location.name", F.lit("")), offices),
        department=F.get(F.transform("j.departments", lambda d: d["name"]), F.lit(0)),
        posted_at=F.coalesce(_offset_date(F.col("j.first_published")), _offset_date(F.col("j.updated_at"))),
        extra=F.create_map(F.lit("requisition_id"), F.col("j.requisition_id")),
    )


def lever(payloads: DataFrame) -> DataFrame:
    """A root array; milliseconds become a UTC date; only two-letter countries count."""
    country = F.upper("country")
    return _raw(
        payloads.filter("id IS NOT NULL"),
        source=F.lit("lever"),
        external_id=F.col("id"),
        title=F.col("text"),
        company=F.col("board"),
        url=F.col("hostedUrl"),
        apply_url=F.coalesce("applyUrl", "hostedUrl"),
        description=F.coalesce("descriptionPlain", html_to_text(F.col("description"))),
        location_raw=F.col("categories.location"),
        country_hint=F.when(F.length(country) == 2, country),
        workplace_hint=F.coalesce(_lookup(F.col("workplaceType"), WORKPLACES), F.lit("unknown")),
        employment_type=F.col("categories.commitment"),
        department=F.coalesce("categories.team", "categories.department"),
        salary_min=F.col("salaryRange.min"),
        salary_max=F.col("salaryRange.max"),
        salary_currency=F.col("salaryRange.currency"),
        salary_period=_lookup(F.col("salaryRange.interval"), LEVER_PERIODS),
        posted_at=F.to_date(F.timestamp_millis("createdAt")),
    )


def ashby(payloads: DataFrame) -> DataFrame:
    """Unlisted postings go; pay is read from its summary; secondary locations may be text or objects."""
    j = payloads.select("board", F.explode("jobs").alias("j")).filter("j.id IS NOT NULL AND coalesce(j.isListed, true)")
    named = F.transform("j.secondaryLocations", lambda x: F.coalesce(F.get_json_object(x, "$.location"), x))
    places = F.array_join(F.concat(F.array("j.location"), F.coalesce(named, F.array().cast("array<string>"))), ", ")
    kind = _lookup(F.replace(F.col("j.workplaceType"), F.lit(" "), F.lit("")), WORKPLACES)
    p = pay(F.concat(F.lit("pay "), F.col("j.compensationTierSummary")))
    return _raw(
        j,
        source=F.lit("ashby"),
        external_id=F.col("j.id"),
        title=F.col("j.title"),
        company=F.col("board"),
        url=F.col("j.jobUrl"),
        apply_url=F.col("j.applyUrl"),
        description=F.coalesce("j.descriptionPlain", html_to_text(F.col("j.descriptionHtml"))),
        location_raw=places,
        workplace_hint=F.coalesce(kind, F.when(F.col("j.isRemote"), "remote"), F.lit("unknown")),
        employment_type=F.col("j.employmentType"),
        department=F.coalesce("j.department", "j.departmentName", "j.team", "j.teamName"),
        salary_min=p["minimum"],
        salary_max=p["maximum"],
        salary_currency=p["currency"],
        salary_period=p["period"],
        posted_at=_offset_date(F.col("j.publishedAt")),
    )


def workday(lists: DataFrame, details: DataFrame, today: Column) -> DataFrame:
    """The list with what details add, joined on the tail of the path; ``details`` has ``path_tail``.

    A board is tenant, instance and site (``tenant:wd:site``), which also name the posting and its page; a
    posting that several pages of the list hold is taken once.
    """
    j = lists.select("board", F.explode("jobPostings").alias("j")).filter("j.externalPath IS NOT NULL")
    j = j.groupBy("board", F.col("j.externalPath").alias("path")).agg(F.min_by("j", F.to_json("j")).alias("j"))
    j = j.withColumn("path_tail", F.element_at(F.split("path", "/"), -1))
    parts = F.split("board", ":")
    tenant, wd, site = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("5")), F.coalesce(F.get(parts, F.lit(2)), F.lit("External"))
    slash = F.when(F.col("path").startswith("/"), "").otherwise("/")
    page = F.concat(F.lit("https://"), tenant, F.lit(".wd"), wd, F.lit(".myworkdayjobs.com/en-US/"), site, slash, F.col("path"))
    d = details.select(F.col("board").alias("d_board"), F.col("path_tail").alias("d_tail"), F.col("jobPostingInfo").alias("d"))
    both = j.join(d, (F.col("board") == F.col("d_board")) & (F.col("path_tail") == F.col("d_tail")), "left")
    return _raw(
        both,
        source=F.lit("workday"),
        external_id=F.concat_ws(":", tenant, wd, site, F.coalesce("d.jobReqId", "path_tail")),
        title=F.coalesce("d.title", "j.title"),
        company=tenant,
        url=page,
        apply_url=F.coalesce("d.externalUrl", page),
        description=html_to_text(F.col("d.jobDescription")),
        location_raw=F.coalesce("d.location", "j.locationsText"),
        country_hint=F.col("d.country.alpha2Code"),
        workplace_hint=F.coalesce(_lookup(F.col("d.remoteType"), WORKPLACES), F.lit("unknown")),
        employment_type=F.col("d.timeType"),
        posted_at=relative_date(F.coalesce("d.postedOn", "j.postedOn"), today),
    )


def usajobs(payloads: DataFrame) -> DataFrame:
    """Nested descriptors; telework is hybrid, an explicit no is onsite; pay of zero is none."""
    i = payloads.select(F.explode("SearchResult.SearchResultItems").alias("i")).select("i.MatchedObjectId", F.col("i.MatchedObjectDescriptor").alias("d"))
    i = i.filter("d.PositionTitle IS NOT NULL")
    details = F.col("d.UserArea.Details")
    text = F.concat_ws("\n\n", *[F.nullif(details[c], F.lit("")) for c in ("JobSummary", "MajorDuties", "Requirements", "Qualifications")])
    remote, telework = F.lower(details["RemoteIndicator"]), F.lower(details["TeleworkEligible"])
    yes, no = ["true", "yes", "y"], ["false", "no", "n"]
    workplace = F.when(remote.isin(yes), "remote").when(telework.isin(yes), "hybrid").when(remote.isin(no) & telework.isin(no), "onsite").otherwise("unknown")
    money = F.get("d.PositionRemuneration", F.lit(0))

    def amount(c):
        return F.nullif(money[c].try_cast("double"), F.lit(0.0))

    rate = F.try_element_at(F.create_map(*[F.lit(x) for kv in FEDERAL_PERIODS.items() for x in kv]), money["RateIntervalCode"])
    return _raw(
        i,
        source=F.lit("usajobs"),
        external_id=F.coalesce("d.PositionID", "MatchedObjectId"),
        title=F.col("d.PositionTitle"),
        company=F.coalesce("d.OrganizationName", "d.DepartmentName"),
        url=F.col("d.PositionURI"),
        apply_url=F.coalesce(F.get("d.ApplyURI", F.lit(0)), "d.PositionURI"),
        description=html_to_text(text),
        location_raw=F.array_join(F.transform("d.PositionLocation", lambda x: x["LocationName"]), "; "),
        country_hint=F.lit("US"),
        workplace_hint=workplace,
        employment_type=F.get(F.transform("d.PositionSchedule", lambda x: x["Name"]), F.lit(0)),
        department=F.col("d.DepartmentName"),
        salary_min=amount("MinimumRange"),
        salary_max=amount("MaximumRange"),
        salary_currency=F.when(amount("MinimumRange").isNotNull(), "USD"),
        salary_period=rate,
        posted_at=_offset_date(F.col("d.PublicationStartDate")),
    )


def union(*sources: DataFrame) -> DataFrame:
    """All sources' postings with ``ingest_seq``, the order in which ties are broken.

    Numbers follow the sources' order, then source, id and URL, then all other fields: they are the same for
    every partitioning and rerun. Rows alike in all fields get neighbouring numbers.
    """
    out = None
    for k, own in enumerate(sources):
        own = own.withColumn("_of", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    rest = F.xxhash64(F.to_json(F.struct(*[c for c in out.columns if c != "_of"])))
    return numbered(out, ["_of", "source", "external_id", "url", rest], "ingest_seq").drop("_of")
