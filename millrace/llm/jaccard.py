"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets link when 100 * intersection >= 75 * union. A set of n shingles then shares at least one of its
first n - ceil(0.75 n) + 1 shingles with every partner, under any one order of all shingles. One order
here is by rising frequency; the others are by distance from fixed numbers. A pair is a candidate only if
the prefixes meet under all of the orders, and only candidates are verified, exactly.

Only components are asked for, which keeps groups of copies from making all their pairs: texts that are
equal count as one; then every set is compared with the first document that shares its smallest shingle
under each of some orders; what these verified links join is one class, and the prefix filter looks for
candidates between different classes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components

from .common import cut, give_back, release
from .exchange import PACKET, Chunks, Sums, ask, exchange, replies_of, stage
from .words import mixed, words_of

WORDS = 5
PERCENT = 75
# a shingle's place in such an order is its hash, with the bits of the number flipped
ORDERS = tuple(int(x) for x in (0x1B873593CC9E2D51, 0x5851F42D4C957F2D, -0x61C8864680B583EB, -0x2545F4914F6CDD1D, 0x3C6EF372FE94F82B))
PREFIX_ORDERS = ORDERS[:2]  # used by the filter, besides the frequency


def needed(n: np.ndarray) -> np.ndarray:
    """The least intersection of a set of n shingles with any partner."""
    return -(-n * PERCENT // 100)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): the sorted different shingle hashes of text k are keys[bounds[k]:bounds[k + 1]]."""
    w = words_of(texts, lower=True, accents=False)
    h, n = w.hashes(), len(w.starts)
    counts = np.bincount(w.text_of, minlength=w.n_texts)
    firsts = np.cumsum(counts) - counts
    keys, owner = [], []
    if n >= WORDS:
        key = h[: n - WORDS + 1].copy()
        for k in range(1, WORDS):
            key = mixed(key ^ (h[k : n - WORDS + 1 + k] * np.uint64(2 * k + 1)), k)
        inside = w.text_of[: n - WORDS + 1] == w.text_of[WORDS - 1 :]
        keys.append(key[inside]), owner.append(w.text_of[: n - WORDS + 1][inside])
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    key = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        more = counts[short] > k
        key[more] = mixed(key[more] ^ h[firsts[short[more]] + k], 20 + k)
    keys.append(key), owner.append(short)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(w.n_texts + 1))


SETS = "doc_id long, row_key long, n long, kept array<long>, prefix array<struct<token:long,after:long>>, limits array<long>, leads array<long>"
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64())]
    + [("kept", pa.list_(pa.int64())), ("prefix", pa.list_(pa.struct([("token", pa.int64()), ("after", pa.int64())])))]
    + [(c, pa.list_(pa.int64())) for c in ("limits", "leads")]
)


def find_sets(chunks: Chunks, copies: DataFrame) -> DataFrame:
    """Every row's set size; for rows that may have partners also what the join needs.

    ``kept`` are the shingles that other sets have too (no other can be in an intersection). Rows of
    ``copies`` (chunk, row_key) repeat an earlier text and get their size only.
    """
    levels, mask = chunks.levels, chunks.key_mask

    def ask_counts(t: pa.Table) -> pa.Table:
        keys, _ = shingle_sets(t.column("text").to_pylist())
        kinds, counts = np.unique(keys & mask, return_counts=True)
        return give_back(ask(Sums(), t.column("chunk")[0].as_py(), (kinds, counts[:, None]), levels))

    texts = chunks.table("doc_id", "row_key", "text")
    counts = exchange(texts.groupBy("chunk").applyInArrow(ask_counts, PACKET), Sums(), levels, "shingle-counts")
    release(chunks.spark)
    kind = F.struct(F.lit(-1).cast("long").alias("bucket"), "chunk", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data"), "row_key")
    skipped = copies.select(kind.alias("r")).select("r.*")
    told = counts.withColumn("row_key", F.lit(None).cast("long")).unionByName(skipped)

    def apply(t: pa.Table, r: pa.Table) -> pa.Table:
        skip = set(r.column("row_key").to_pylist())
        r = r.filter(pa.array(r.column("bucket").to_numpy() >= 0))
        keys, bounds = shingle_sets(t.column("text").to_pylist())
        kinds, place, own = np.unique(keys & mask, return_inverse=True, return_counts=True)
        many = Sums().heard((kinds, own[:, None]), replies_of(r), 0, levels[0])[place, 0]
        signed = keys.view(np.int64)
        rows = []
        for k, (doc_id, row_key) in enumerate(zip(t.column("doc_id").to_pylist(), t.column("row_key").to_pylist(), strict=True)):
            own, count = signed[bounds[k] : bounds[k + 1]], many[bounds[k] : bounds[k + 1]]
            n = len(own)
            least = int(needed(np.int64(n)))
            shared = count > 1
            if not n or doc_id is None or row_key in skip or int(shared.sum()) < least:
                rows.append((doc_id, row_key, n, None, None, None, None))
                continue
            size = n - least + 1
            by_count = np.lexsort((own, count))[:size]
            flipped = [own ^ np.int64(o) for o in ORDERS]
            limits = [int(np.partition(f, size - 1)[size - 1]) for f in flipped[: len(PREFIX_ORDERS)]]
            leads = [int(f.min() ^ np.int64(o)) for f, o in zip(flipped, ORDERS, strict=True)]
            # each with the number of the set's shingles that come after it in this order
            prefix = [{"token": int(own[i]), "after": n - 1 - at} for at, i in enumerate(by_count) if count[i] > 1]
            rows.append((doc_id, row_key, n, own[shared], prefix, limits, leads))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return give_back(pa.table({f.name: pa.array(c, f.type) for f, c in zip(_SETS, columns, strict=True)}, schema=_SETS))

    out = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, SETS)
    return cut(out, "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, filters: bool) -> DataFrame:
    """The pairs (a, b) that link; with ``filters`` only after their prefixes meet under all orders.

    A document with many pairs is a hot key of these joins, which adaptive execution splits.
    """
    columns = ("n", "kept", "limits")
    a, b = (sets.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b")
    if filters:
        for k, order in enumerate(PREFIX_ORDERS):

            def prefix(x, k=k, order=order):
                return F.filter(f"kept_{x}", lambda s: s.bitwiseXOR(F.lit(order)) <= F.element_at(f"limits_{x}", k + 1))

            both = both.filter(F.arrays_overlap(prefix("a"), prefix("b")))
    shared = F.size(F.array_intersect("kept_a", "kept_b"))
    return both.filter(100 * shared >= PERCENT * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Texts without words have 0 shingles, null texts too; they and rows with a null id link with nothing
    (their component is their own id). Rows that repeat an id are one document with the links of each.
    Equal texts are linked. An empty table gives an empty result. Other columns are ignored.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", digest)
    chunks = stage(rows.withColumn("row_key", F.xxhash64("doc_id", "digest")))
    ids = chunks.table("doc_id", "digest", "row_key")
    groups = ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).filter(F.col("many") > 1)
    copies = ids.join(groups, "digest").filter(F.col("doc_id") != F.col("first"))
    copies = cut(copies.select("chunk", "doc_id", "row_key", "first"), "copies")
    sets = find_sets(chunks, copies)
    chunks.drop()
    some = sets.filter(F.col("kept").isNotNull())

    # every set against the first document with the same smallest shingle, under each order
    leads = some.select("doc_id", F.posexplode("leads").alias("order", "lead"))
    heads = leads.groupBy("order", "lead").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"))
    heads = heads.filter(F.col("a") != F.col("last")).drop("last")
    pairs = leads.join(heads, ["order", "lead"]).filter(F.col("doc_id") != F.col("a"))
    stars = cut(verified(pairs.select("a", F.col("doc_id").alias("b")).distinct(), some, False), "stars")
    classes = components(stars)

    # prefixes under the order of frequency, where they join different classes
    known = some.join(classes, some["doc_id"] == classes["node"], "left")
    known = known.withColumn("class", F.coalesce("component", "doc_id"))
    prefixes = cut(known.select("doc_id", "class", "n", F.explode("prefix").alias("at")).select("doc_id", "class", "n", "at.*"), "prefixes")
    mixed_tokens = prefixes.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed_tokens = mixed_tokens.filter(F.col("low") != F.col("high")).select("token")
    x = prefixes.join(mixed_tokens, "token").select(
        "token", F.col("doc_id").alias("a"), F.col("class").alias("class_a"), F.col("n").alias("n_a"), F.col("after").alias("after_a")
    )
    y = x.toDF("token", "b", "class_b", "n_b", "after_b")
    # where the first shared shingle leaves too few behind it, the pair cannot link
    enough = (100 + PERCENT) * (1 + F.least("after_a", "after_b")) >= PERCENT * (F.col("n_a") + F.col("n_b"))
    close = (F.col("class_a") < F.col("class_b")) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & enough
    candidates = x.join(y, "token").filter(close).select("a", "b").distinct()
    links = verified(candidates, some, True).unionByName(stars)

    joined = components(links)
    out = sets.select("doc_id", "row_key", "n")
    firsts = copies.select(F.col("row_key").alias("copy_key"), "first").distinct()
    out = out.join(firsts, out["row_key"] == firsts["copy_key"], "left")
    # a copy of a text has the class of the text's first document; without words it links with nothing
    out = out.withColumn("home", F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(joined, (out["home"] == joined["node"]) & (out["n"] > 0), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "home").alias("component_id"))
    return cut(out, "jaccard")


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
