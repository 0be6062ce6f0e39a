"""Gates, verdicts, clusters, requirement readings, state, registry, readers and streaming."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster, gates, registry, requirement, state
from millrace.plans.postings import normalised
from millrace.sources import boards, sinks

TODAY = date(2026, 9, 14)
RAW = "ingest_seq long, source string, external_id string, title string, company string, employer_domain string, url string, location_raw string, country_hint string, workplace_hint string, employment_type string, description string, salary_min double, salary_period string, posted_at date"


def posting(seq, title, **own):
    row = {
        "ingest_seq": seq, "source": "lever", "external_id": str(seq), "title": title, "company": "Acme", "employer_domain": "acme.com", "url": f"https://jobs.lever.co/acme/{seq}",
        "location_raw": "Dallas, TX", "country_hint": None, "workplace_hint": "unknown", "employment_type": None, "description": "Own accounts payable.", "salary_min": None, "salary_period": None, "posted_at": date(2026, 9, 10),
    } | own
    return tuple(row.values())


def judged(spark, rows, rules):
    return {r["ingest_seq"]: r for r in gates.evaluate(normalised(spark.createDataFrame(rows, RAW)), rules, TODAY).collect()}


def test_one_corpus_and_a_search(spark):
    rules = gates.Rules(
        titles=["accountant"], seniority_excludes=["senior"], title_excludes=["staff"], excluded_content=["auditing"],
        workplace_types=["remote", "hybrid"], salary_min=50000, max_age_days=30,
    )
    rows = [
        posting(1, "Accountant", workplace_hint="remote", salary_min=60000.0, salary_period="year"),
        posting(2, "Senior Accountant", workplace_hint="remote"),
        posting(3, "Staff Accountant", workplace_hint="remote"),
        posting(4, "Accountant", workplace_hint="remote", description="Lead the annual audit."),
        posting(5, "Accountant", location_raw="Toronto, Canada", workplace_hint="remote"),
        posting(6, "Accountant", location_raw="Remote"),
        posting(7, "Accountant", salary_min=20.0, salary_period="hour", workplace_hint="hybrid"),
        posting(8, "Accountant", posted_at=date(2026, 1, 1), workplace_hint="remote"),
        posting(9, "Accountant", posted_at=None, description=None, location_raw="", workplace_hint="unknown"),
    ]
    out = judged(spark, rows, rules)
    failed = {k: sorted(g["gate"] for g in r["gates"] if g["outcome"] == "fail") for k, r in out.items()}
    assert failed == {1: [], 2: ["seniority_excludes"], 3: ["title_excludes"], 4: ["excluded_content"], 5: ["country"], 6: [], 7: ["salary_floor"], 8: ["freshness"], 9: []}
    assert {k for k, r in out.items() if r["decision"] == "match"} == {1, 6, 9}
    for r in out.values():
        assert r["score"] == pytest.approx(round(sum(s["points"] for s in r["signals"]), 2))
        assert len(r["gates"]) == 7
    assert out[6]["is_uncertain"] and out[9]["is_uncertain"]
    strict = judged(spark, rows, gates.Rules(**{**rules.__dict__, "policy": "strict"}))
    assert strict[6]["decision"] == "rejected"


def test_sponsorship_and_explanations(spark):
    rules = gates.Rules(titles=["engineer"], countries=[], needs_sponsorship=True)
    rows = [
        posting(1, "Engineer", description="Visa sponsorship available."),
        posting(2, "Engineer", description="No visa sponsorship. We sponsor clubs."),
        posting(3, "Engineer", description="Says nothing."),
    ]
    df = gates.evaluate(normalised(spark.createDataFrame(rows, RAW)), rules, TODAY)
    got = {r["ingest_seq"]: r for r in df.select("ingest_seq", "decision", gates.explain_lines().alias("lines"), gates.why().alias("why"), F.col("gates")[0]["outcome"].alias("o")).collect()}
    assert [got[k]["o"] for k in (1, 2, 3)] == ["pass", "fail", "unverifiable"]
    assert got[2]["lines"][0] == "Rejected because:" and got[2]["why"] == "sponsorship: no visa sponsorship"
    assert "Could not be confirmed:" in got[3]["lines"] and got[1]["lines"][0].startswith("Matched, score")


REQUIRED = ["Active CPA license required.", "Must have a CPA", "CPA is a must", "Requirements:\n- CPA", "Licensed CPAs required to apply.", "CPA preferred; CPA required for promotion."]
PREFERRED = ["CPA preferred", "CPA a plus", "No CPA required.", "CPA not required", "Preferred Qualifications:\n- CPA", "Nice to have: CPA", "Active CPA license preferred", "- Excel required\n- CPA a plus"]


def test_requirement_readings(spark):
    want = dict.fromkeys(REQUIRED, "required") | dict.fromkeys(PREFERRED, "preferred") | {"Our team includes a CPA.": "unstated", "": "absent", "nothing": "absent"}
    rows = [(k, t) for k, t in enumerate(want)] + [(99, None)]
    out = requirement.requirement_context(spark.createDataFrame(rows, "id long, t string"), "id", "t", "CPA")
    got = {r["id"]: r["context"] for r in out.collect()}
    assert got == {k: c for k, c in enumerate(want.values())} | {99: "absent"}


def test_requirement_gate(spark):
    rules = gates.Rules(titles=["accountant"], countries=[], requirements={"CPA": "required"})
    texts = ["Active CPA license required.", "CPA a plus", "Our team includes a CPA.", "Excel"]
    out = judged(spark, [posting(k, "Accountant", description=t) for k, t in enumerate(texts)], rules)
    assert [out[k]["gates"][0]["outcome"] for k in range(4)] == ["fail", "pass", "unverifiable", "pass"]
    first = out[0]["gates"][0]
    assert out[0]["decision"] == "rejected" and first["evidence"] == "CPA"
    assert first["detail"] == "stated as required via 'required': Accountant Acme Active CPA license required. Dallas, TX"
    assert [out[k]["gates"][0]["evidence"] for k in (1, 2, 3)] == ["CPA", "", ""]


def test_clusters_do_not_depend_on_order(spark):
    url = "https://jobs.lever.co/acme/1"
    rows = [
        posting(1, "Accountant", url=url, external_id="a"),
        posting(2, "Bookkeeper", url=url + "?utm_source=x", external_id="b", description=""),
        posting(3, "Clerk", external_id="b"),
        posting(4, "Analyst", external_id="", url="https://x.example/4"),
        posting(5, "Auditor", external_id="", url=""),
        posting(6, "Buyer", external_id="", url=""),
        posting(7, "Accountant", source="ashby", external_id="z", url="https://careers.acme.com/7"),
    ]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 1}
    for own in (rows, rows[::-1]):
        df = normalised(spark.createDataFrame(own, RAW))
        assert dict(cluster.clusters(df).collect()) == want
    kept = {r["cluster"]: r for r in cluster.resolve(normalised(spark.createDataFrame(rows, RAW))).collect()}
    assert kept[1]["canonical_seq"] == 7 and kept[1]["n_postings"] == 4 and kept[1]["sources"] == ["ashby", "lever"]


def test_health_batch(spark):
    rows = [(1, k, k, kind) for k, kind in enumerate(["gone", "ok", "gone", "blocked", "parse_error"])] + [(2, k, k, "gone") for k in range(5)]
    got = {r["board"]: r for r in state.board_health(spark.createDataFrame(rows, "board long, seq long, ts long, kind string")).collect()}
    assert got[1]["consecutive_failures"] == 2 and not got[1]["evicted"] and got[1]["last_success"] == 1
    assert got[2]["evicted"] and got[2]["last_success"] is None


def test_sparse_record_does_not_erase(spark):
    schema = "identity long, authority int, description string, workplace string, salary_min double, posted_at date"
    old = spark.createDataFrame([(1, 2, "long text", "remote", 5.0, TODAY), (2, 2, "t", "unknown", None, None)], schema)
    old = old.withColumn("first_seen", F.lit(1)).withColumn("last_seen", F.lit(1))
    new = spark.createDataFrame([(1, 2, "short", "unknown", None, None), (2, 2, "text", "remote", 1.0, TODAY), (3, 1, "n", "remote", None, None)], schema)
    out = {r["identity"]: r for r in state.upsert_jobs(old, new, F.lit(2), ["description", "workplace", "salary_min", "posted_at"]).collect()}
    assert (out[1]["description"], out[1]["first_seen"], out[1]["last_seen"]) == ("long text", 1, 2)
    assert out[2]["description"] == "text" and out[3]["first_seen"] == 2


def test_new_only_after_an_earlier_match(spark):
    schema = "search string, identity long, decision string"
    before = spark.createDataFrame([("s", 1, "match"), ("s", 2, "rejected")], schema)
    now = spark.createDataFrame([("s", 1, "match"), ("s", 2, "match"), ("s", 3, "rejected")], schema)
    assert {r["identity"]: r["is_new"] for r in state.with_is_new(now, before).collect()} == {1: False, 2: True, 3: True}


def test_budget_split(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "ats string, n_boards long")
    assert {r["ats"]: r["allocation"] for r in registry.allocate(counts, 10).collect()} == {"a": 4, "b": 4, "c": 2}
    none = counts.withColumn("n_boards", F.lit(0).cast("long"))
    assert {r["allocation"] for r in registry.allocate(none, 10).collect()} == {0}


def test_registry_import(spark):
    raw = spark.createDataFrame([("Acme", "https://boards.greenhouse.io/acme", "yes"), ("Bad", "https://example.com", ""), ("", "https://foo.breezy.hr/", None)], "` Company` string, Careers_URL string, US string")
    good, bad = registry.import_rows(raw)
    assert {(r["company"], r["ats"], r["token"], r["us_signal"]) for r in good.collect()} == {("Acme", "greenhouse", "acme", True), ("foo", "breezy", "foo", False)}
    assert [r["company"] for r in bad.collect()] == ["Bad"]


def test_fetch_outcomes(spark):
    rows = [(200, True, "ok"), (403, True, "blocked"), (410, True, "gone"), (500, True, "unavailable"), (200, False, "parse_error"), (None, True, "unavailable")]
    df = spark.createDataFrame(rows, "s int, p boolean, want string")
    assert all(r[0] == r[1] for r in df.select(registry.failure_kind(F.col("s"), F.col("p")), "want").collect())
    pages = [(404, "https://a.b/1", "https://a.b/1", "gone"), (200, "https://a.b/1", "https://www.a.b/1/", "live"), (200, "https://a.b/1", "https://a.b/", "inconclusive"), (503, "https://a.b/1", "https://a.b/1", "inconclusive")]
    df = spark.createDataFrame(pages, "s int, a string, g string, want string")
    assert all(r[0] == r[1] for r in df.select(registry.verification(F.col("s"), F.col("a"), F.col("g")), "want").collect())


def land(tmp_path, kind, **files):
    folder = tmp_path / kind
    folder.mkdir()
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


def test_readers(spark, tmp_path):
    g = {"jobs": [{"id": 7, "title": "Accountant", "first_published": "2026-09-10T23:00:00-04:00", "requisition_id": "R1", "location": {"name": ""}, "offices": [{"name": "HQ", "location": "Dallas, TX"}], "absolute_url": "u", "content": "&lt;p&gt;CPA a plus&lt;/p&gt;", "departments": [{"id": 1, "name": "Finance"}]}, None]}
    out = boards.greenhouse(boards.landed(spark, land(tmp_path, "greenhouse", acme=g, broken="{nope"), "greenhouse")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["company"], r["location_raw"], r["description"], r["posted_at"], r["department"], r["extra"]) == ("acme", "Dallas, TX", "CPA a plus", date(2026, 9, 10), "Finance", {"requisition_id": "R1"})

    lever = [{"id": "x", "text": "Engineer", "categories": {"location": "Remote", "team": "Web"}, "country": "us", "workplaceType": "remote", "salaryRange": {"currency": "USD", "interval": "per-hour-wage", "min": 20, "max": 30}, "hostedUrl": "h", "createdAt": 1789000000000}]
    r = boards.lever(boards.landed(spark, land(tmp_path, "lever", acme=lever), "lever")).first()
    assert (r["country_hint"], r["salary_period"], r["apply_url"], r["workplace_hint"], r["posted_at"]) == ("US", "hour", "h", "remote", date(2026, 9, 10))

    a = {"jobs": [{"id": "1", "title": "A", "location": "NY", "secondaryLocations": [{"location": "SF"}, "LA"], "isRemote": True, "compensationTierSummary": "$80K - $100K", "publishedAt": "2026-09-01", "isListed": None}, {"id": "2", "title": "B", "isListed": False}]}
    out = boards.ashby(boards.landed(spark, land(tmp_path, "ashby", acme=a), "ashby")).collect()
    assert [(r["external_id"], r["location_raw"], r["salary_min"], r["salary_max"], r["workplace_hint"]) for r in out] == [("1", "NY, SF, LA", 80000.0, 100000.0, "remote")]

    w = {"jobPostings": [{"title": "T", "externalPath": "/job/T_R1", "locationsText": "2 Locations", "postedOn": "Posted 5 Days Ago"}, {"title": "U", "externalPath": "/job/U_R2", "postedOn": "Posted Today"}]}
    d = {"jobPostingInfo": {"title": "T full", "jobDescription": "<p>x</p>", "location": "Dallas", "jobReqId": "R1", "country": {"alpha2Code": "US"}}}
    details = boards.landed(spark, land(tmp_path, "workday_detail", T_R1=d), "workday_detail").withColumn("path_tail", F.col("board")).withColumn("board", F.lit("acme"))
    out = boards.workday(boards.landed(spark, land(tmp_path, "workday_list", acme=w), "workday_list"), details, F.lit(TODAY)).orderBy("title").collect()
    assert [(r["title"], r["location_raw"], r["posted_at"], r["country_hint"]) for r in out] == [("T full", "Dallas", date(2026, 9, 9), "US"), ("U", None, TODAY, None)]

    item = {"MatchedObjectId": "m", "MatchedObjectDescriptor": {"PositionID": "P", "PositionTitle": "Clerk", "PositionURI": "u", "OrganizationName": "Dept", "PositionLocation": [{"LocationName": "A"}, {"LocationName": "B"}], "PositionRemuneration": [{"MinimumRange": "0", "MaximumRange": "9.5", "RateIntervalCode": "BW"}], "PublicationStartDate": "2026-09-02T00:00", "UserArea": {"Details": {"JobSummary": "s", "TeleworkEligible": "True", "RemoteIndicator": "False"}}}}
    u = {"SearchResult": {"SearchResultItems": [item]}}
    r = boards.usajobs(boards.landed(spark, land(tmp_path, "usajobs", p1=u), "usajobs")).first()
    assert (r["location_raw"], r["workplace_hint"], r["salary_min"], r["salary_max"], r["salary_period"]) == ("A; B", "hybrid", None, 9.5, "week")


def test_sinks(spark, tmp_path):
    rules = gates.Rules(titles=["accountant"], countries=[])
    df = gates.evaluate(normalised(spark.createDataFrame([posting(1, "Accountant")], RAW)), rules, TODAY)
    for name, write in sinks.FORMATS.items():
        write(df, str(tmp_path / name))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["why"].startswith("title matches")
    assert spark.read.json(str(tmp_path / "json")).first()["score"] == df.first()["score"]
    assert spark.read.text(str(tmp_path / "markdown"), wholetext=True).first()[0].startswith("## Accountant - Acme")
