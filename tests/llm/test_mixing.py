"""Targets, words taken and positions against a direct computation."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def water_fill(sizes: dict, weights: dict, share=1.5, passes=2) -> dict:
    """Targets by repeated resharing, source by source."""
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > passes * sizes[s]}
        if not full:
            target |= {s: left * weights[s] / total for s in open_}
            break
        target |= {s: passes * sizes[s] for s in full}
        left -= sum(passes * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 600, "b": 30, "c": 40, "d": 50},
        {"a": 10, "b": 1000, "c": 10},
        {"a": 100, "b": 100, "c": 100, None: 100},
        {"a": 0, "b": 7},
        {"a": 60, "b": 50, "c": 40, "d": 30, "e": 20, "f": 10, "g": 400},
    ],
)
@pytest.mark.parametrize("per_span, per_stretch", [(1000, 1000), (2, 3)])
def test_targets_are_met(spark, monkeypatch, sizes, per_span, per_stretch):
    monkeypatch.setattr(mixing, "ROWS_PER_SPAN", per_span)
    monkeypatch.setattr(mixing, "SPANS_PER_STRETCH", per_stretch)
    rows = []
    for s, size in sizes.items():
        k = 0
        while size > 0:
            n = min(size, 3 + 7 * k % 11)
            rows.append((len(rows), " ".join(["w"] * n), s))
            size, k = size - n, k + 1
        if not k:
            rows.append((len(rows), "", s))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    by_id = {r[0]: r for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out.itertuples():
        s = by_id[r.doc_id][2]
        assert r.size == len(by_id[r.doc_id][1].split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_training_rows_hold_what_is_taken(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 9)), "ab"[i % 3 == 0]) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("position", F.lit("clash"))
    mixed = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.training_rows(docs)
    assert out.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == mixed
    assert {r["position"] for r in out.select("position").distinct().collect()} == {"clash"}


def test_nulls_and_repeats_and_nothing(spark):
    rows = [(1, None, None), (1, None, None), (None, "a b", "x"), (2, "", "x")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(out) == 4 and out["taken"].sum() == 3
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_positions_invert_the_schedule(spark):
    for slope in (-0.5, 0.0, 0.5):
        t = spark.range(101).select((F.col("id") / 100).alias("t"))
        due = (1 - slope) * F.col("t") + slope * F.col("t") ** 2
        worst = t.select(F.max(F.abs(mixing.position(due, F.lit(slope)) - F.col("t")))).first()[0]
        assert worst < 1e-9
