"""Clusters against a plain union of what shares a signal, and what their steps may carry."""

import random

from millrace.operators import cluster
from millrace.plans import run
from millrace.plans.postings import identified, normalised, postings
from millrace.plans.searches import ACCOUNTING, TODAY

SF = "/root/testdata/sf0.001"
SCHEMA = "ingest_seq long, identity string, url string, source string, external_id string"


def plain_clusters(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for seq, identity, url, source, external_id in rows:
        for signal in (("id", identity), ("url", url or None), ("ext", external_id and (source, external_id) or None)):
            if signal[1] is not None:
                a, b = root(first.setdefault(signal, seq)), root(seq)
                parent[max(a, b)] = min(a, b)
    return {seq: root(seq) for seq in parent}


def test_clusters_are_those_of_a_plain_union(spark):
    draw = random.Random(5)
    for n, kinds in ((60, 40), (200, 90), (120, 500)):
        rows = []
        for seq in draw.sample(range(1000), n):
            url = draw.choice(["", None, *[f"https://x.example/{draw.randrange(kinds)}"] * 4])
            identity, external_id = f"i{draw.randrange(kinds)}", draw.choice(["", None, str(draw.randrange(kinds))])
            rows.append((seq, draw.choice([None, identity, identity, identity]), url, draw.choice("st"), external_id))
        assert dict(cluster.clusters(spark.createDataFrame(rows, SCHEMA)).collect()) == plain_clusters(rows)


def test_postings_of_one_identity_draw_no_links(spark, monkeypatch):
    drawn = []
    real = cluster.components
    monkeypatch.setattr(cluster, "components", lambda links: drawn.append(links.count()) or real(links))
    rows = [(k, f"i{k % 3}", f"https://x.example/{min(k, 296)}", "s", str(k)) for k in range(300)]
    found = dict(cluster.clusters(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == plain_clusters(rows) and set(found.values()) == {0}
    assert drawn[0] <= 6  # by the URL that four share, and by its first and last node


def test_identities_are_those_of_normalised_postings(spark):
    raw = postings(spark, SF)
    one, other = (dict(f(raw).select("ingest_seq", "identity").collect()) for f in (identified, normalised))
    assert one == other and len(one) == 1500


def _aggregates(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate" in line]


def test_texts_stay_out_of_the_aggregation_of_clusters(spark):
    lines = _aggregates(cluster.resolve(normalised(postings(spark, SF))))
    assert lines and not any("description" in line or "title" in line for line in lines)


def test_borrowed_descriptions(spark):
    schema = SCHEMA + ", title string, authority int, description string"
    rows = [(1, "a", "", "s", "", "A", 2, None), (2, "a", "", "s", "", "A", 1, "second"), (3, "a", "", "t", "", "A", 1, "a third"), (4, "b", "", "s", "", "B", 1, ""), (5, "c", "", "s", "", "C", 1, "c")]
    got = {r["cluster"]: r for r in cluster.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r["canonical_seq"], r["description"], r["n_postings"], r["n_urls"]) for k, r in got.items()} == {1: (1, "second", 3, 1), 4: (4, "", 1, 1), 5: (5, "c", 1, 1)}
    assert got[1]["sources"] == ["s", "t"]


def test_a_run_resolves_its_postings_once(spark):
    plan = run.judged_jobs(postings(spark, SF), ACCOUNTING, TODAY)._jdf.queryExecution().optimizedPlan().toString()
    assert "canonical_seq" not in plan  # the jobs are written before they are judged
