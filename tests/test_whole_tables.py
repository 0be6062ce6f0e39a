"""Registered queries against plain counts over every row of their tables."""

import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from millrace.plans import queries, state_queries
from millrace.plans.postings import normalised

from .test_operators import RAW, posting

SF = "/root/testdata/sf0.001"


def test_phrases_are_counted_in_every_language(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang", "source"]).to_pylist()
    docs += [
        {"text": "The idiot and the théâtre, and THE end", "lang": None, "source": "none"},
        {"text": "élan and the Licence, license", "lang": "fr", "source": "french only"},
        {"text": "thé", "lang": "fr", "source": "french only"},
    ]
    pq.write_table(pa.Table.from_pylist(docs), tmp_path / "documents.parquet")
    want = Counter({(d["source"], w): 0 for d in docs for w in queries.WORDS})
    for d in docs:
        for w in queries.WORDS:
            want[d["source"], w] += len(re.findall(rf"\b{w}\b", d["text"], re.IGNORECASE))
    got = {(r["source"], r["phrase"]): r["n_hits"] for r in queries.phrase_counts(spark, str(tmp_path)).collect()}
    assert got == dict(want)
    assert got["none", "the"] == 3 and got["french only", "the"] == 1


def test_every_order_enters_a_run_of_jobs(spark):
    orders = sorted(pq.read_table(f"{SF}/orders.parquet").to_pylist(), key=lambda o: o["o_orderkey"])
    runs = [state_queries._run_of_jobs(spark, SF, k).collect() for k in (0, 1)]
    assert sorted(r["seq"] for run in runs for r in run) == [o["o_orderkey"] for o in orders]
    stored, incoming = {}, {}
    for o in orders:  # the last order of an identity in a run stays
        key, identity = o["o_orderkey"], o["o_orderkey"] // 4
        job = {
            "identity": identity,
            "authority": 1 + o["o_custkey"] % 3,
            "description": o["o_orderpriority"],
            "workplace": "unknown" if o["o_custkey"] % 4 == 0 else "remote",
            "salary_min": o["o_totalprice"] if key % 5 else None,
            "posted_at": o["o_orderdate"] if key % 7 else None,
        }
        (incoming if identity % 3 == 1 or (identity % 3 == 2 and key % 2) else stored)[identity] = job
    assert stored.keys() - incoming.keys() and incoming.keys() - stored.keys() and stored.keys() & incoming.keys()
    want = {}
    for identity in stored.keys() | incoming.keys():
        s, i = stored.get(identity), incoming.get(identity)
        swap = s is None
        if s and i:
            same = s["workplace"] == "unknown" or i["workplace"] != "unknown"
            same = same and len(i["description"]) >= len(s["description"])
            same = same and not any(s[c] is not None and i[c] is None for c in ("salary_min", "posted_at"))
            swap = i["authority"] > s["authority"] or (i["authority"] == s["authority"] and same)
        want[identity] = (i if swap else s) | {"first_seen": 1 if s else 2, "last_seen": 2 if i else 1}
    got = {r["identity"]: r.asDict() for r in state_queries.job_upsert(spark, SF).collect()}
    days = lambda x: str(x)[:10]
    for rows in (want, got):
        for r in rows.values():
            r["posted_at"] = days(r["posted_at"])
    assert got == want


def test_descriptions_are_read_to_their_end(spark, monkeypatch):
    filler = "Own the ledger and close the books. " * 300
    rows = [posting(1, "Clerk", location_raw="", description=filler + "The pay range is $70,000 - $90,000 per year. This is a fully remote role. It is a part-time job.")]
    raw = spark.createDataFrame(rows, RAW)
    job = normalised(raw).first()
    assert (job["workplace"], job["employment_type"]) == ("remote", "part_time")
    monkeypatch.setattr(state_queries, "postings", lambda spark, sf_dir: raw)
    found = state_queries.salary_extract(spark, SF).first()
    assert (found["minimum"], found["maximum"], found["currency"], found["period"]) == (70000, 90000, "USD", "year")
