"""Payloads with wrong items: all others are read, and the quarantine says where they are wrong."""

import json

from pyspark.sql import functions as F

from millrace.sources import boards, tolerant


def texts(spark, **payloads):
    return spark.createDataFrame([(b, p if p is None or isinstance(p, str) else json.dumps(p)) for b, p in payloads.items()], "board string, payload string")


def test_wrong_items_cost_themselves_only(spark):
    jobs = [
        {"id": 1, "title": "A", "location": {"name": "Dallas"}, "departments": [{"id": 1, "name": "D"}], "first_published": "2026-01-02T00:00:00Z", "other": [1]},
        {"id": 2, "title": "B", "departments": "a list?"},
        {"id": 3, "title": "C", "location": 7},
        {"id": 4, "title": "D", "first_published": "yesterday", "location": None},
        "not even an object", None,
        {"id": "five", "title": "E"},
        {"id": 6, "title": 66},
        {"id": 7, "title": "G", "departments": [{"id": "x"}]},
    ]
    rows = texts(spark, acme={"jobs": jobs}, broken="{nope", odd={"jobs": 5}, none={"jobs": None}, bare={}, gone=None)
    good, bad = tolerant.read_items(rows, "greenhouse")
    read = {r.external_id: r for r in boards.greenhouse(good).collect()}
    assert set(read) == {"1", "4", "6", "7"} and read["7"].department is None
    assert read["1"].location_raw == "Dallas" and read["1"].department == "D" and str(read["1"].posted_at) == "2026-01-02"
    assert read["4"].posted_at is None and read["6"].title == "66" and read["1"].company == "acme"
    found = {(r.board, r.path, r.problem) for r in bad.collect()}
    assert found == {
        ("acme", "$.jobs[1].departments", "not a list"), ("acme", "$.jobs[2].location", "not an object"), ("acme", "$.jobs[4]", "not an object"), ("acme", "$.jobs[5]", "not an object"),
        ("acme", "$.jobs[6].id", "not a bigint"), ("broken", "$", "not JSON"), ("odd", "$.jobs", "not a list"),
    }
    assert json.loads(bad.filter(F.col("path") == "$.jobs[2].location").first()["item"]) == jobs[2]


def test_other_kinds_of_payloads(spark):
    lever = [{"id": "a", "text": "T", "salaryRange": {"min": 1, "max": 2.5}}, {"id": "b", "categories": "x"}]
    good, bad = tolerant.read_items(texts(spark, acme=lever), "lever")
    r = boards.lever(good).collect()
    assert [(x.external_id, x.salary_min, x.salary_max) for x in r] == [("a", 1.0, 2.5)] and bad.first()["path"] == "$[1].categories"
    federal = {"SearchResult": {"SearchResultItems": [{"MatchedObjectId": 9, "MatchedObjectDescriptor": {"PositionTitle": "P"}}, {"MatchedObjectDescriptor": 3}]}}
    good, bad = tolerant.read_items(texts(spark, p1=federal), "usajobs")
    assert [x.title for x in boards.usajobs(good).collect()] == ["P"] and bad.first()["path"] == "$.SearchResult.SearchResultItems[1].MatchedObjectDescriptor"
    ashby = {"jobs": [{"id": "z", "title": "Z", "isListed": True}, {"id": "y", "isRemote": "maybe"}]}
    good, bad = tolerant.read_items(texts(spark, acme=ashby), "ashby")
    assert [x.title for x in boards.ashby(good).collect()] == ["Z"] and bad.first()["path"] == "$.jobs[1].isRemote"


def test_files_as_texts(spark, tmp_path):
    (tmp_path / "acme.json").write_text('{"jobs": []}\n')
    (tmp_path / "beta.json").write_text("{")
    rows = {r.board: r.payload for r in tolerant.landed_texts(spark, str(tmp_path)).collect()}
    assert rows == {"acme": '{"jobs": []}', "beta": "{"}


def test_numbers_of_a_union_do_not_depend_on_partitioning(spark):
    schema = "source string, external_id string, url string, title string, extra map<string,string>"
    one = spark.createDataFrame([("a", str(k % 50), f"u{k}", None, {"k": str(k)}) for k in range(200)], schema)
    two = spark.createDataFrame([("b", None, None, "t", None), ("a", "1", "u1", "other", {})], schema)
    want = None
    for n in (1, 50):
        got = {(r.source, r.url, r.title): r.ingest_seq for r in boards.union(one.repartition(n), two.repartition(n)).collect()}
        assert sorted(got.values()) == list(range(202)) and got[("b", None, "t")] in (200, 201)
        want = want or got
        assert got == want
