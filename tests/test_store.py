"""Versioned state: buckets, replays, and streams that are stopped between batches and go on."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import gates, store
from millrace.plans import run
from tests.test_operators import RAW, TODAY, posting

RULES = gates.Rules("s", titles=["accountant"], title_excludes=["senior"])


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", key="k", buckets=16)
    assert s.latest() is None
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    s.commit(0, {"t": first}, {"log": first.limit(3)}, s.touched(first))
    assert s.read(s.latest(), "t").count() == 1000
    few = spark.createDataFrame([(7, "b"), (2000, "b")], "k long, v string")
    touched = s.touched(few)
    old = s.read(s.latest(), "t", touched)
    assert old.count() < 300
    plan = old._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_batch" in plan
    merged = old.join(few, "k", "left_anti").unionByName(few)
    s.commit(1, {"t": merged}, {"log": few}, touched)
    written = [d for d in os.listdir(tmp_path / "s/t/_batch=1") if d.startswith("_bucket=")]
    assert len(written) == len(touched) <= 2
    after = {r.k: r.v for r in s.read(s.latest(), "t").collect()}
    assert len(after) == 1001 and after[7] == after[2000] == "b" and after[8] == "a"
    assert s.read(s.latest(), "log").count() == 5
    # another session sees the same version
    assert store.Store(spark.newSession(), f"file://{tmp_path}/s", key="k", buckets=16).latest() == s.latest()


def test_what_was_written_without_a_manifest_does_not_count(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", key="k", buckets=4)
    rows = spark.range(10).select(F.col("id").alias("k"))
    s.commit(0, {"t": rows}, {"log": rows}, s.touched(rows))
    s._write("t", 1, spark.range(10, 40).select(F.col("id").alias("k")))
    s._write("log", 1, rows)
    assert s.read(s.latest(), "t").count() == 10 and s.read(s.latest(), "log").count() == 10
    more = spark.range(100, 105).select(F.col("id").alias("k"))
    touched = s.touched(more)
    s.commit(1, {"t": s.read(s.latest(), "t", touched).unionByName(more)}, {"log": more}, touched)
    assert s.read(s.latest(), "t").count() == 15 and s.read(s.latest(), "log").count() == 15


def landed(spark, tmp_path):
    """Three batches of postings, as files in order."""
    batches = [
        [posting(1, "Accountant"), posting(2, "Senior Accountant", company="Beta")],
        [posting(1, "Accountant"), posting(3, "Accountant", company="Gamma")],
        [posting(4, "Staff Accountant", company="Delta"), posting(2, "Accountant", company="Beta")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        name = next(f for f in os.listdir(tmp_path / f"in{k}") if f.endswith(".parquet"))
        os.makedirs(tmp_path / "landed", exist_ok=True)
        os.rename(tmp_path / f"in{k}" / name, tmp_path / "landed" / f"{k}.parquet")
        os.utime(tmp_path / "landed" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = spark.read.parquet(str(tmp_path / "landed")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))


def content(state):
    return (
        rows_of(state.jobs, "identity", "title", "first_seen", "last_seen"),
        rows_of(state.matches, "identity", "run_seq", "decision", "is_new"),
        rows_of(state.status, "identity", "status"),
        rows_of(state.job_sources, "identity", "url"),
    )


def plainly_found(raw, rules, today, run_seq):
    """A stand-in for the judging of postings, which other tests cover."""
    return raw.select(
        F.concat_ws("|", "company", "title").alias("identity"), F.lit(1).alias("authority"), "title", "company", "url", "description", F.lit("remote").alias("workplace"),
        F.lit(None).cast("double").alias("salary_min"), F.lit(None).cast("date").alias("posted_at"), F.lit(rules.name).alias("search"), F.lit(run_seq).alias("run_seq"),
        F.when(F.col("title").contains("Senior"), "rejected").otherwise("match").alias("decision"), F.lit(1.0).alias("score"),
    )


@pytest.mark.parametrize("after_commit", [False, True])
def test_a_stream_that_is_stopped_goes_on_where_it_was(spark, tmp_path, monkeypatch, after_commit):
    monkeypatch.setattr(run, "found_in", plainly_found)
    source = landed(spark, tmp_path)
    whole = content(run.stream_runs(spark, source, RULES, TODAY, f"file://{tmp_path}/whole"))
    assert len(whole[1]) == 6 and sum(is_new and d == "match" for *_, d, is_new in whole[1]) == 4

    seal = store.Store._seal

    def killed(self, version):
        if after_commit or version.batch != 1:
            seal(self, version)
        if version.batch == 1:
            raise RuntimeError("killed")

    root = f"file://{tmp_path}/stopped"
    monkeypatch.setattr(store.Store, "_seal", killed)
    with pytest.raises(Exception, match="killed"):
        run.stream_runs(spark, source, RULES, TODAY, root)
    monkeypatch.setattr(store.Store, "_seal", seal)
    assert content(run.stream_runs(spark, source, RULES, TODAY, root)) == whole
    # nothing is left to do, and a batch that comes again changes nothing
    s = store.Store(spark, f"{root}/state")
    before = s.latest()
    again = run.run_on_store(s, spark.read.parquet(str(tmp_path / "landed/0.parquet")), RULES, TODAY, 0)
    assert again == before == s.latest() and content(run.stored_state(s, again)) == whole
