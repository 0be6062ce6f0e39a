"""Vector compression to one byte for each of four parts, in exact integers.

Each part of every vector is a point; the points of a part position are sorted along a Hilbert curve and
cut into flat blocks, which store their box (least and greatest component), their sum and their points.
A round of the codebook's training, and the final coding, reads blocks: the distances from a block's box
to the codebook's entries leave a shortlist of the entries that can be nearest to any of its points. One
entry left takes the whole block by its stored sum; else a small integer kernel compares the block's
points with the shortlist. Boxes only leave out entries that are farther than another for every point,
so that codes are those of a full comparison.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, fresh_path, give_back

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 128
KEY_DIMS = 16  # components of a part that the Hilbert key looks at
SMALL = 2.0**20  # components below this stay 64-bit integers, whose sums fit for any task; others are Python's
LONG_MAX = 2**63 - 1


def integers(raw: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of every component, exactly: 64-bit integers, or Python's where a component is huge."""
    if not raw.size or np.abs(raw).max() < SMALL:
        return np.floor(raw.astype(np.float64) * SCALE).astype(np.int64)
    flat = [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in raw.astype(np.float64).ravel().tolist()]
    return np.array(flat, dtype=object).reshape(raw.shape)


def as_array(rows: list[list[int]]) -> np.ndarray:
    """Codebook entries as 64-bit integers where all are small."""
    small = all(abs(x) < SMALL * SCALE for row in rows for x in row)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), -1 if rows else 0)


def _largest(v: np.ndarray) -> int:
    return int(np.abs(v).max()) if v.size else 0


def _exact(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the fastest kind in which no sum of squared differences loses a digit."""
    most = v.shape[-1] * (_largest(v) + _largest(w)) ** 2
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    return v.astype(kind), w.astype(kind)


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the place of its nearest entry (the first of equals) and their squared distance."""
    a, b = _exact(v, entries)
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries, in order, that can be nearest to a point of the box."""
    box, e = _exact(np.stack([low, high]), entries)
    below, above = box[0] - e, e - box[1]
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(abs(below), abs(above))
    near, far = (gap * gap).sum(1), (reach * reach).sum(1)
    return np.flatnonzero((near <= far.min()).astype(bool))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (n, m; ``bits`` bits each, 64 together at most) on a Hilbert curve.

    Skilling's transform: undo the excess work of each bit plane, then Gray-code and interleave the bits.
    """
    x = cells.astype(np.uint64).copy()
    zero = np.uint64(0)
    for plane in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << plane), np.uint64((1 << plane) - 1)
        for i in range(x.shape[1]):
            turned = (x[:, i] & q) != zero
            swap = np.where(turned, zero, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(turned, p, zero)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, x.shape[1]):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] & np.uint64(1 << plane)) != zero, np.uint64((1 << plane) - 1), zero)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.uint64)
    for plane in range(bits - 1, -1, -1):
        for i in range(x.shape[1]):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(plane)) & np.uint64(1))
    return key


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix; shorter lists are read as if zeros followed."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (ends == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), flat.dtype)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest value of each component in a task."""
    low = high = np.zeros(0)
    for b in batches:
        lists = b.column("x")
        width = max(len(low), int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
        m = _matrix(lists, width).astype(np.float64)
        none = np.full(width - len(low), np.inf)
        low = np.minimum(np.append(low, none), m.min(0, initial=np.inf))
        high = np.maximum(np.append(high, -none), m.max(0, initial=-np.inf))
    yield pa.record_batch({"component": pa.array(range(len(low)), pa.int32()), "low": low, "high": high})


def _split(width: int, lows: np.ndarray, highs: np.ndarray):
    """A function from vectors to their four points with their keys on the curve."""
    d = width // PARTS
    looked = np.unique(np.linspace(0, d - 1, min(d, KEY_DIMS)).astype(int))
    bits = min(16, 64 // len(looked))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("x"), width)
            for k in range(PARTS):
                part = np.ascontiguousarray(m[:, k * d : (k + 1) * d])
                own = np.arange(k * d, (k + 1) * d)[looked]
                with np.errstate(all="ignore"):
                    share = (part[:, looked].astype(np.float64) - lows[own]) / (highs[own] - lows[own])
                cells = np.clip(np.nan_to_num(share) * 2**bits, 0, 2**bits - 1)
                key = hilbert_keys(cells, bits) ^ np.uint64(1 << 63)  # unsigned order as signed
                rows, first = b.num_rows, k == 0
                yield pa.record_batch(
                    {
                        "part": np.full(rows, k, np.int32),
                        "key": key.view(np.int64),
                        "row": b.column("row"),
                        "vec_id": b.column("vec_id") if first else pa.nulls(rows, b.schema.field("vec_id").type),
                        "label": b.column("label") if first else pa.nulls(rows, b.schema.field("label").type),
                        "point": pa.array([x.tobytes() for x in part], pa.binary()),
                    }
                )

    return split


def _in_blocks(d: int, kind: str):
    """A function from sorted points to blocks: consecutive points of one part position."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("part").to_numpy()
            starts = np.flatnonzero(np.diff(parts, prepend=-1))
            cuts = [a + k for a, z in zip(starts, [*starts[1:], len(parts)], strict=True) for k in range(0, z - a, BLOCK_ROWS)]
            rows = []
            for a, z in zip(cuts, [*cuts[1:], len(parts)], strict=True):
                t = b.slice(a, z - a)
                data = b"".join(t.column("point").to_pylist())
                raw = np.frombuffer(data, kind).reshape(z - a, d)
                sums = ",".join(str(int(x)) for x in integers(raw).sum(0))
                low, high = raw.min(0).tobytes(), raw.max(0).tobytes()
                rows.append((int(parts[a]), z - a, low, high, sums, data, *(t.column(c).to_pylist() for c in ("row", "vec_id", "label"))))
            of = dict(zip(("part", "n", "low", "high", "sums", "data", "rows", "vec_ids", "labels"), zip(*rows, strict=True), strict=True))
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            types += [pa.list_(b.schema.field(c).type) for c in ("vec_id", "label")]
            yield pa.record_batch({c: pa.array(v, t) for (c, v), t in zip(of.items(), types, strict=True)})

    return block


def _judged(b: pa.RecordBatch, kind: str, books: list[np.ndarray]):
    """(place in the batch, part, shortlist, function that reads the points) of each block."""
    d = books[0].shape[1]
    for i, part in enumerate(b.column("part").to_pylist()):
        box = np.stack([np.frombuffer(b.column(c)[i].as_py(), kind) for c in ("low", "high")])
        low, high = integers(box)
        found = shortlist(low, high, books[part])

        def points(i=i) -> np.ndarray:
            return integers(np.frombuffer(b.column("data")[i].as_py(), kind).reshape(-1, d))

        yield i, part, found, points


def _sums(kind: str, books: list[np.ndarray]):
    """A function from blocks to the points' counts and sums by entry, one row for each entry that a task met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in books]
        totals = [np.zeros(e.shape, object) for e in books]
        for b in batches:
            for i, part, found, points in _judged(b, kind, books):
                if len(found) == 1:
                    counts[part][found[0]] += b.column("n")[i].as_py()
                    totals[part][found[0]] += np.array([int(x) for x in b.column("sums")[i].as_py().split(",")], object)
                    continue
                v = points()
                at = found[nearest(v, books[part][found])[0]]
                order = np.argsort(at, kind="stable")
                new = np.flatnonzero(np.diff(at[order], prepend=-1))
                chosen = at[order][new]
                counts[part][chosen] += np.diff(np.append(new, len(at)))
                totals[part][chosen] += np.add.reduceat(v[order], new, axis=0).astype(object)
        rows = [(p, int(e), int(counts[p][e]), ",".join(map(str, totals[p][e]))) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = (pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.record_batch({c: pa.array(v, t) for c, v, t in zip(("part", "entry", "n", "total"), columns, types, strict=True)})

    return add


def _mean(t: pa.Table) -> pa.Table:
    """The floored mean of an entry's points from the tasks' sums."""
    n = sum(t.column("n").to_pylist())
    total = [sum(x) for x in zip(*([int(x) for x in s.split(",")] for s in t.column("total").to_pylist()), strict=True)]
    return pa.table({"part": t.column("part").slice(0, 1), "entry": t.column("entry").slice(0, 1), "mean": [",".join(str(x // n) for x in total)]})


def _codes(kind: str, books: list[np.ndarray]):
    """A function from blocks to every point's entry and squared distance (null beyond a long)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part, found, points in _judged(b, kind, books):
                at, error = nearest(points(), books[part][found])
                entries, errors = found[at], [int(x) for x in error]
                rows = b.column("rows")[i].values
                yield pa.record_batch(
                    {
                        "row": rows,
                        "part": np.full(len(at), part, np.int32),
                        "entry": entries.astype(np.int32),
                        "error": pa.array([x if x <= LONG_MAX else None for x in errors], pa.int64()),
                        "vec_id": b.column("vec_ids")[i].values,
                        "label": b.column("labels")[i].values,
                    }
                )
            give_back(None)

    return code


def first_codebooks(kept: DataFrame, width: int) -> list[np.ndarray]:
    """The four parts of the vectors with the smallest ids (nulls last, equal ids by their components)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()  # 256 rows
    d = width // PARTS
    whole = [(list(r.x) + [0.0] * width)[:width] for r in rows]
    return [as_array(integers(np.array([v[k * d : (k + 1) * d] for v in whole])).tolist()) for k in range(PARTS)]


def compress(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part.

    Vectors that are null or hold null or non-finite components take no part. Components become
    floor(1024 * x), vectors are cut into four equal parts, and codebooks of up to 256 entries (fewer
    vectors: fewer entries) are trained from the vectors of the smallest ids in ``rounds`` rounds, with
    floored means; an entry without points stays. Vectors shorter than the longest one are read as if
    zeros followed, likewise lengths that four does not divide; empty vectors are zeros. Repeated rows
    and ids are rows of their own; null ids come last among the first entries and keep null. Integers are
    exact however large; an error, or a label's sum of errors, beyond a long is null. Null labels are one
    label. An empty table gives an empty result.

    The codebooks (4 x 256 entries, 256 KB at 64 components) are all that the driver holds and sends.
    """
    spark = rows.sparkSession
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    used = rows.filter(x.isNotNull() & ~bad).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    # a number for each row that holds for all later steps once it is written
    path = fresh_path(spark, "vectors")
    used.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    types = dict(kept.dtypes)
    kind = "<f4" if types["x"] == "array<float>" else "<f8"
    if types["x"] not in ("array<float>", "array<double>"):
        kept = kept.withColumn("x", F.col("x").cast("array<double>"))
    spans = kept.select("x").mapInArrow(_spans, "component int, low double, high double")
    spans = spans.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("component").collect()
    width = max(PARTS, -(-len(spans) // PARTS) * PARTS)
    padded = [0.0] * (width - len(spans))
    lows, highs = (np.array([r[c] for r in spans] + padded) for c in ("low", "high"))
    books = first_codebooks(kept, width)
    named = f"vec_id {types['vec_id']}, label {types['label']}"
    points = kept.mapInArrow(_split(width, lows, highs), f"part int, key long, row long, {named}, point binary")
    # the row's number splits groups of equal points
    points = points.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    of_block = "part int, n int, low binary, high binary, sums string, data binary, rows array<long>"
    of_block += f", vec_ids array<{types['vec_id']}>, labels array<{types['label']}>"
    blocks = cut(points.mapInArrow(_in_blocks(width // PARTS, kind), of_block), "vector-blocks")
    delete(spark, path)
    if len(books[0]):
        for _ in range(rounds):
            read = blocks.select("part", "n", "low", "high", "sums", "data")
            sums = read.mapInArrow(_sums(kind, books), "part int, entry int, n long, total string")
            means = sums.groupBy("part", "entry").applyInArrow(_mean, "part int, entry int, mean string").collect()  # 1,024 rows at most
            entries = [e.tolist() for e in books]
            for r in means:
                entries[r.part][r.entry] = [int(v) for v in r.mean.split(",")]
            books = [as_array(e) for e in entries]
    coded = blocks.mapInArrow(_codes(kind, books), f"row long, part int, entry int, error long, {named}")
    digits = [F.lpad(F.hex(F.max(F.when(F.col("part") == k, F.col("entry")))), 2, "0") for k in range(PARTS)]
    whole = coded.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"),
        F.max("label").alias("label"),
        F.lower(F.concat(*digits)).alias("code"),
        F.when(F.count("error") == PARTS, F.try_sum("error")).alias("error"),
    )
    whole = cut(whole.drop("row"), "vector-codes")
    sums = whole.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    text = ",".join(str(int(v)) for e in books for row in e for v in row)
    out = whole.join(sums, F.col("label").eqNullSafe(F.col("of")))
    digest = F.lit(hashlib.sha256(text.encode()).hexdigest())
    return out.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The contract's code and errors of every vector of ``embeddings``; ``compress`` says how odd rows are read."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _op13_sql(rounds: int = ROUNDS) -> str:
    """The same by comparing every point with every entry."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
          list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // {PARTS} AS d
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, k, v[k * d + 1 : (k + 1) * d] AS x FROM v, range({PARTS}) t(k))",
        f"b0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS c FROM p WHERE r <= {ENTRIES})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, p.k, min(struct_pack(
              d := CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := e)) AS best
              FROM p JOIN b{n} b ON p.k = b.k GROUP BY r, p.k)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS MATERIALIZED (SELECT k, e, list(s ORDER BY i) AS c FROM (
                  SELECT a.k AS k, a.best.e AS e, i, CAST(floor(CAST(sum(x[i + 1]) AS DOUBLE) / count(*)) AS BIGINT) AS s
                  FROM a{n} a JOIN p ON a.r = p.r AND a.k = p.k, range((SELECT max(d) FROM v)) t(i) GROUP BY a.k, a.best.e, i) GROUP BY k, e)"""
            )
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.k = m.k AND b.e = m.e)")
    steps.append(
        f"""o AS (SELECT v.r, vec_id, label, string_agg(lpad(lower(to_hex(a.best.e)), 2, '0'), '' ORDER BY a.k) AS code, CAST(sum(a.best.d) AS BIGINT) AS error
          FROM a{rounds} a JOIN v ON a.r = v.r GROUP BY v.r, vec_id, label)"""
    )
    return f"""WITH {", ".join(steps)}
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM b{rounds}) AS codebooks_sha256 FROM o"""


OP13_SQL = _op13_sql()
