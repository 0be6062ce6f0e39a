"""Plans and operators whose work must not grow faster than their input."""

import pytest

from millrace.operators.cluster import provenance
from millrace.plans import board_queries, history_queries, queries

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [queries.gates_long, queries.gate_summary, history_queries.gates_more])
def test_gates_are_worked_out_once(spark, query):
    filters = [line for line in optimized(query(spark, SF)).splitlines() if "Filter" in line]
    assert not any("RLIKE" in line or "size(array(" in line for line in filters)


@pytest.mark.parametrize("query", [queries.verdicts, queries.gates_long, history_queries.explanations])
def test_titles_and_texts_are_read_once_for_each_different_one(spark, query):
    plan = optimized(query(spark, SF))
    assert "staff(?:" not in plan and "audit(?:" not in plan  # only the ledger of matches reads postings by themselves


@pytest.mark.parametrize("query", [board_queries.registry_from_urls, board_queries.registry_build])
def test_urls_are_read_once(spark, query):
    plan = optimized(query(spark, SF))
    assert plan.count("regexp_extract(") < 20
    assert not any("regexp" in line for line in plan.splitlines() if "Filter" in line)


def test_links_are_read_once(spark):
    rows = [(1, "s", "x", "https://a.example/1?b=2", 2), (2, "s", "y", "", 1)]
    found = spark.createDataFrame([(1, 1), (2, 1)], "ingest_seq long, cluster long")
    links = provenance(spark.createDataFrame(rows, "ingest_seq long, source string, external_id string, url string, authority int"), found)
    assert not any("regexp" in line for line in optimized(links).splitlines() if "Filter" in line)
    assert [r["link"] for r in links.first()["links"]] == ["https://a.example/1?b=2"]
