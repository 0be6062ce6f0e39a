"""Tables of searches judge as single searches do."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import pattern
from millrace.operators import gates, searches
from millrace.plans.postings import normalised
from millrace.plans.rule_queries import SEARCHES
from tests.test_operators import RAW, TODAY, posting

TEXTS = [
    "Own accounts payable. CPA a plus.", "Active CPA license required. C++ and .NET audits", "Annual auditing; co-op program (401(k))", "", "No visa sponsorship. PMP preferred.",
    "Visa sponsorship available. Auditors audited", "Fully remote React components", "cash\nmanagement/treasury", "Security clearance required", "ünïcode Straße CPAs",
]
PHRASES = ["accounts payable", "CPA", "c++", ".net", "auditing", "audit", "co-op", "401(k)", "cash management", "react component", "Straße", "auditor", "++", "a", "visa", "treasury", "plus"]
PLACES = ["Dallas, TX", "Toronto, Canada", "Remote", "", "San Francisco, CA"]


def some_postings(spark):
    rng = random.Random(1)
    titles = ["Senior Accountant", "Staff Auditor", "Web Developer", "Audit Intern", "Project Manager II"]
    rows = [
        posting(k, rng.choice(titles), description=rng.choice(TEXTS), location_raw=rng.choice(PLACES), company=rng.choice(["Acme", "Beta Co-op", "Gamma C++ Group"]))
        for k in range(60)
    ]
    return normalised(spark.createDataFrame(rows, RAW)).cache()


def some_searches(n):
    rng = random.Random(2)
    some = lambda xs, most=3: rng.sample(xs, rng.randint(0, most))
    return [
        gates.Rules(
            f"s{k}", titles=some(PHRASES), title_excludes=some(["auditor", "staff", "audit", "senior"], 2), excluded_content=some(PHRASES), required_keywords=some(PHRASES),
            company_excludes=some(["acme", "c++", "co-op"], 1), seniority_excludes=some(["senior", "staff", "intern"], 2), workplace_types=some(["remote", "hybrid", "onsite"]),
            countries=some(["US", "CA"], 1), locations=some(["Dallas", "TX", "San Francisco"], 2), employment_types=some(["full_time", "contract"], 1), salary_min=rng.choice([None, 50000, 90000.0]),
            max_age_days=rng.choice([None, 3, 400]), needs_sponsorship=rng.random() < 0.3, requirements={"CPA": rng.choice(["required", "mentioned", "preferred_or_required"])} if k == 0 else {},
            title_match=rng.choice(["rank", "hard"]), policy=rng.choice(["flag", "strict"]),
        )
        for k in range(n)
    ]


def test_a_table_of_searches_judges_as_evaluate_all(spark):
    jobs = some_postings(spark)
    rules = [*SEARCHES, *some_searches(2)]
    want = {(r.ingest_seq, r.search): r.decision for r in gates.evaluate_all(jobs, rules, TODAY).collect()}
    got = searches.judge_all(jobs, searches.searches_table(spark, rules), TODAY).collect()
    assert len(got) == len(want) and {(r.ingest_seq, r.search): r.decision for r in got} == want


def test_a_thousand_searches_keep_the_plan_small(spark):
    jobs = some_postings(spark)
    table = searches.searches_table(spark, some_searches(1000))
    judged = searches.judge_all(jobs, table, TODAY)
    plan = judged._jdf.queryExecution().toString()
    assert "accounts" not in plan and len(plan) < 200_000
    assert judged.count() == 60_000
    few = judged.filter(F.col("search").isin("s3", "s999")).collect()
    want = gates.evaluate_all(jobs, [r for r in some_searches(1000) if r.name in ("s3", "s999")], TODAY).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, want))


def test_first_words_propose_every_match(spark):
    import re

    for phrase in PHRASES:
        for text in TEXTS:
            for inflect in (True, False):
                found = re.search(pattern(phrase, inflect).removeprefix("(?iU)"), text, re.IGNORECASE)
                words = set(re.findall(r"\w+", text.lower()))
                if found and re.search(r"\w", phrase):
                    assert words & set(searches.first_words(phrase, inflect)), (phrase, text)


def test_null_lists_are_empty_and_terms_are_bounded(spark):
    jobs = some_postings(spark)
    table = spark.createDataFrame([("open",)], "name string").select(*[F.col("name") if c.startswith("name ") else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in searches.SCHEMA.split(", ")])
    assert {r.decision for r in searches.judge_all(jobs, table, TODAY).collect()} == {"match"}
    many = searches.searches_table(spark, [gates.Rules(f"r{k}", requirements={f"t{k}": "required"}) for k in range(51)])
    with pytest.raises(ValueError):
        searches.judge_all(jobs, many, TODAY)


def test_counts_are_those_of_all_pairs(spark):
    jobs = some_postings(spark)
    rules = [*some_searches(200), *[gates.Rules(f"f{k}", salary_min=float(k) * 9000, salary_period="year", policy="strict" if k % 3 else "flag") for k in range(12)]]
    table = searches.searches_table(spark, rules)
    judged = searches.judge_all(jobs, table, TODAY).groupBy("search", "decision").agg(F.count("*").alias("n"), F.min("ingest_seq").alias("first"))
    counted = searches.count_all(jobs, table, TODAY)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Join Cross" not in plan  # kinds met profiles before
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, judged.collect()))
