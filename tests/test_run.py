"""Two runs of a search over its state."""

from datetime import date

import pytest

from millrace.operators import gates, state
from millrace.plans import run
from tests.test_operators import RAW, TODAY, posting


def test_two_runs(spark):
    rules = gates.Rules("s", titles=["accountant"], title_excludes=["senior"])
    rows = [posting(1, "Accountant"), posting(2, "Accountant", source="ashby", external_id="z"), posting(3, "Senior Accountant")]
    after, one = run.run_search(spark.createDataFrame(rows, RAW), rules, TODAY, 1)
    s = one.first()
    assert (s["found"], s["matched"], s["rejected"], s["new_matches"]) == (2, 1, 1, 1)
    more = [posting(1, "Accountant"), posting(9, "Accountant", company="Other")]
    after, two = run.run_search(spark.createDataFrame(more, RAW), rules, date(2026, 9, 15), 2, after)
    s = two.first()
    assert (s["found"], s["matched"], s["new_matches"]) == (2, 2, 1)
    assert after.jobs.count() == 3 and after.status.count() == 3
    found = state.results(after.matches, after.jobs, after.status, "s", decision="match").collect()
    assert len(found) == 2 and {r["status"] for r in found} == {"new"}
    assert {str(r["first_seen"]) for r in found} == {"2026-09-14", "2026-09-15"}
    assert state.results(after.matches, after.jobs, after.status, "s", only_new=True, decision="match").count() == 1


def test_rules_are_cleaned():
    r = run.cleaned(gates.Rules(titles=["Cash  Management", "cash management", " "], countries=["us"]))
    assert r.titles == ["Cash Management"] and r.countries == ["US"]
    with pytest.raises(ValueError):
        run.cleaned(gates.Rules(countries=["CA"]))
    assert run.discovery_terms(gates.Rules(titles=["A", "b"], keywords=["a", "c"], title_excludes=["x"])) == ["A", "b", "c"]
    assert run.since_date(TODAY, gates.Rules(max_age_days=4)) == date(2026, 9, 10)
