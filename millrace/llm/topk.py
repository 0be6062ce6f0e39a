"""Exact top-k search by inner product over norm-bucketed vectors.

Candidates are grouped by length, in steps of a factor; a bucket is stored as blocks of packed rows.
Queries meet the longest buckets' blocks first: the k-th best score found there is a lower bound for
each query. Divided by the query's length and a bucket's greatest length it becomes the local cosine
threshold of that bucket. A threshold above 1 drops the bucket, one that is high prunes by the few
largest coordinates of the query (coordinate pruning), a lower one prunes by the vectors' lengths
(length pruning). What is left is verified by integer products. No bound is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
SCALE = 256
STEP = 1.1  # greatest over least length in a bucket
BLOCK_ROWS = 2048  # candidates in a block
QUERY_ROWS = 512  # queries in a block
FIRST_BLOCKS = 1  # blocks that set the first bound
COORDINATE_FROM = 0.5  # local cosine threshold from which coordinates prune
FOCUS = 8  # coordinates looked at


LONG = (-(2**63), 2**63 - 1)


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("x")
        offsets = lists.offsets.to_numpy()
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        # components from 2^44 on have no fraction below 1/256
        with np.errstate(over="ignore"):
            w = np.where(np.abs(x) >= 2.0**44, x, np.floor(x * SCALE) / SCALE)
        row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        top = np.zeros(b.num_rows)
        np.maximum.at(top, row, np.abs(w))
        squares = np.bincount(row, (w / np.where(top > 0, top, 1)[row]) ** 2, b.num_rows)
        with np.errstate(over="ignore"):
            norm = np.minimum(top * np.sqrt(squares), 1.7e308)
        listed = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(w))
        yield pa.record_batch({"vec_id": b.column("vec_id"), "w": listed, "norm": norm})


def scaled_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, w: floor(256 * x) / 256 of each component, norm of w); rows that take no part are left out.

    As doubles these are exact however large the components are.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.filter(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return kept.mapInArrow(_scaled, "vec_id long, w array<double>, norm double")


def _blocks(vectors: DataFrame, rows: int, seed: int) -> DataFrame:
    """Pack vectors of one bucket into blocks: (block, bucket, top: greatest norm, ids, data).

    Buckets may hold all rows, so each is dealt into parts by a hash of the id before rows meet.
    """
    # no length is the bucket below that of the least double
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / np.log(STEP))).otherwise(-10_000)
    keyed = vectors.withColumn("bucket", bucket.cast("long")).withColumn("dim", F.size("w"))
    sizes = keyed.groupBy("bucket", "dim").agg(F.count("*").alias("n"))
    parts = sizes.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / rows)).cast("long")).drop("n")
    part = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("parts"))
    dealt = keyed.join(parts, ["bucket", "dim"]).withColumn("part", part)

    def packed(t: pa.Table) -> pa.Table:
        norms = t.column("norm").to_numpy()
        order = np.lexsort((t.column("vec_id").to_numpy(), -norms))
        dim = t.column("dim")[0].as_py()
        flat = t.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
        return pa.table(
            {
                "bucket": pa.array([t.column("bucket")[0].as_py()], pa.int64()),
                "dim": pa.array([dim], pa.int32()),
                "part": pa.array([t.column("part")[0].as_py()], pa.int64()),
                "top": pa.array([norms.max()], pa.float64()),
                "ids": pa.array([t.column("vec_id").to_numpy()[order]], pa.list_(pa.int64())),
                "data": pa.array([flat[order].astype("<f8").tobytes()], pa.binary()),
            }
        )

    schema = "bucket long, dim int, part long, top double, ids array<long>, data binary"
    return dealt.groupBy("bucket", "dim", "part").applyInArrow(packed, schema)


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, dim)


def _whole(w: np.ndarray) -> np.ndarray:
    """The integers of scaled vectors, as Python's own, which have no bound."""
    flat = [int(x) * SCALE if abs(x) >= 2.0**53 else int(x * SCALE) for x in w.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(w.shape)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of scaled vectors; those beyond a long become the nearest long.

    In floating point where no partial sum can lose a digit, in 64-bit integers where none can overflow.
    """
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * SCALE**2 * q.shape[-1]
    if most < 2**53:
        return ((q * SCALE) @ (c * SCALE).T).astype(np.int64)
    if most < 2**62:
        return (q * SCALE).astype(np.int64) @ (c * SCALE).astype(np.int64).T
    exact = _whole(q) @ _whole(c).T
    return np.array([min(max(x, LONG[0]), LONG[1]) for x in exact.ravel()], np.int64).reshape(exact.shape)


def _norms(w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((w**2).sum(1))  # infinite for huge vectors, which only prunes less


def best_of_block(q_ids, q, bound, c_ids, c, k: int = K) -> list[tuple[int, int, int]]:
    """(query, vector, score) of up to k best vectors of a block for each query, not below its bound.

    ``bound`` is the score that k other vectors reach already (the least integer if there are none).
    """
    out = []
    if not len(c) or not len(q):
        return out
    q_norm, c_norm = _norms(q), _norms(c)
    top = c_norm.max()
    least_score = bound / float(SCALE) ** 2  # in the units of the scaled vectors
    with np.errstate(divide="ignore", invalid="ignore"):
        # one part in 10^9 is given away so that rounding cannot prune a tie
        local = np.where(q_norm * top > 0, least_score / (q_norm * top), np.where(bound > 0, np.inf, -np.inf)) - 1e-9
    alive = np.flatnonzero(local <= 1)
    near = (local[alive] >= COORDINATE_FROM) & np.isfinite(q_norm[alive] * top)
    by_coordinate, by_length = alive[near], alive[~near]
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in by_coordinate:
        focus = np.argsort(-np.abs(q[i]), kind="stable")[:FOCUS]
        part = c[:, focus]
        rest_q = np.sqrt(max(q_norm[i] ** 2 - (q[i, focus] ** 2).sum(), 0))
        rest_c = np.sqrt(np.maximum(c_norm**2 - (part**2).sum(1), 0))
        most = part @ q[i, focus] + rest_q * rest_c
        kept = np.flatnonzero(most * (1 + 1e-9) + 1e-6 * abs(least_score[i]) >= least_score[i])
        rows.append((i, kept, _products(q[i : i + 1], c[kept])[0]))
    if len(by_length):
        # rows are in order of falling length: a query reads as far as its bound allows
        with np.errstate(over="ignore"):
            least = np.where(q_norm[by_length] > 0, least_score[by_length] / np.maximum(q_norm[by_length], 1e-300), -np.inf)
        reach = np.searchsorted(-c_norm, -(least - 1e-6 * np.abs(least)), side="right")
        reach[bound[by_length] <= 0] = len(c)
        far = int(reach.max())
        scores = _products(q[by_length], c[:far])
        rows += [(i, np.arange(r), scores[j, :r]) for j, (i, r) in enumerate(zip(by_length, reach, strict=True))]
    for i, at, scores in rows:
        keep = (scores >= bound[i]) & (c_ids[at] != q_ids[i])
        at, scores = at[keep], scores[keep]
        order = np.lexsort((c_ids[at], ~scores))[:k]  # the complement falls as a score rises, for the least long too
        out += [(int(q_ids[i]), int(c_ids[a]), int(s)) for a, s in zip(at[order], scores[order], strict=True)]
    return out


def _pairs(dealt: DataFrame, by: Column, repeated: DataFrame) -> DataFrame:
    """Every pair of two tables' blocks of one dim, made where it is searched.

    The blocks of ``dealt`` are dealt by ``by`` into as many shares as there are shuffle partitions, and
    those of ``repeated`` go to each share, so that no task meets all pairs of a dim and no pair is moved.
    """
    shares = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    left = dealt.withColumn("share", F.pmod(by, F.lit(shares)).cast("int")).repartition(shares, "dim", "share")
    right = repeated.withColumn("share", every).repartition(shares, "dim", "share")
    # blocks whose greatest length no query can need meet nowhere: only numbers are compared, no vectors
    needs = F.col("least") <= F.col("top") * (1 + 1e-9)
    return left.join(right, (left["dim"] == right["dim"]) & (left["share"] == right["share"]) & needs).drop("share", right["dim"])


def _search(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                found = best_of_block(np.asarray(r.q_ids), _matrix(r.q_data, len(r.q_ids), r.dim), np.asarray(r.bounds), np.asarray(r.ids), _matrix(r.data, len(r.ids), r.dim), k)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return pairs.mapInPandas(run, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to smaller ids.

    Both inputs are tables of (vec_id, embedding). Vectors that are null or hold null or non-finite
    components take no part, nor do rows with a null id. All others do, however large: products are exact,
    and one that a long cannot hold counts as the nearest long. A query's own id is no candidate, nor are
    vectors of another length. Repeated rows with one id count as often as they come. Zero and empty vectors
    score 0. With fewer than k candidates all are returned. Empty tables give an empty result.

    Each block of queries is compared with each block of candidates (a stated query set against all
    rows), so that work is the product of both sizes less what the bounds prune, memory is one pair of
    blocks, and nothing grows on the driver.
    """
    c_blocks = cut(_blocks(scaled_vectors(candidates), BLOCK_ROWS, 1), "topk-candidates")
    order = Window.partitionBy("dim").orderBy(F.desc("top"), "bucket", "part")
    c_blocks = c_blocks.join(
        c_blocks.select("dim", "bucket", "part", F.row_number().over(order).alias("place")), ["dim", "bucket", "part"]
    )
    q_blocks = cut(_blocks(scaled_vectors(queries), QUERY_ROWS, 2), "topk-queries")
    no_bound = np.iinfo(np.int64).min
    q = q_blocks.select(
        "dim",
        F.col("bucket").alias("q_bucket"),
        F.col("part").alias("q_part"),
        F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"),
        F.transform("ids", lambda _: F.lit(no_bound)).alias("bounds"),
        F.lit(float("-inf")).alias("least"),
    )
    first = _pairs(q, F.xxhash64("q_bucket", "q_part"), c_blocks.filter(F.col("place") <= FIRST_BLOCKS))
    found = cut(_top(_search(first, k), k), "topk-first")
    bounds = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))

    def with_bounds(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("query_id").to_pylist(), right.column("bound").to_pylist(), strict=True))
        bounds, least = [], []
        for dim, ids, data in zip(*(left.column(c).to_pylist() for c in ("dim", "q_ids", "q_data")), strict=True):
            own = np.array([known.get(i, no_bound) for i in ids], np.int64)
            norm = _norms(_matrix(data, len(ids), dim))
            # the length that a vector needs to reach a query's bound; without one, or with 0, any will do
            with np.errstate(over="ignore"):
                needed = np.where((own > 0) & (norm > 0), own / float(SCALE) ** 2 / np.maximum(norm, 1e-300), np.where(own > 0, np.inf, -np.inf))
            bounds.append(own)
            least.append(float(needed.min()))
        columns = {c: left.column(c) for c in left.column_names} | {"bounds": pa.array(bounds, pa.list_(pa.int64())), "least": pa.array(least, pa.float64())}
        return pa.table(columns)

    # the bounds travel to the block that holds the query
    home = q_blocks.select("bucket", "part", F.explode("ids").alias("query_id"))
    placed = bounds.join(home, "query_id").select(F.col("bucket").alias("q_bucket"), F.col("part").alias("q_part"), "query_id", "bound")
    schema = "dim int, q_bucket long, q_part long, q_ids array<long>, q_data binary, bounds array<long>, least double"
    q = q.groupBy("q_bucket", "q_part").cogroup(placed.groupBy("q_bucket", "q_part")).applyInArrow(with_bounds, schema)
    q = cut(q, "topk-bounded")
    more = _search(_pairs(c_blocks.filter(F.col("place") > FIRST_BLOCKS), F.col("place"), q), k)
    out = _top(found.drop("rank").unionByName(more), k)
    return out.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The contract's five best of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


OP6_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         coalesce(list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda s, x: s + x), 0) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
l AS (
  SELECT query_id, vec_id, CAST(least(greatest(score, {LONG[0]}::HUGEINT), {LONG[1]}::HUGEINT) AS BIGINT) AS score FROM p),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM l)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
