"""Resampling, personal data and vector codes against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import pii, resample, vector_codes
from millrace.llm.words import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, source string"


# --- resampling -------------------------------------------------------------------------------------


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % resample.BUCKETS


def resampled(docs, target):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in map(bucket, own)]
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 25 // 100])}
    return sorted((repr((*r[:4], drawn.get(id(r)))) for r in rows))


def test_resampling_equals_the_plain_version_on_odd_rows(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gÄmma", "日本語", "x1", "42", "o'neill", "long" * 30]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    line = "the same line again and again"
    texts += [None, "", "\n\n", " . \n!", "w" * 5000, "\n".join([line] * 40), "a\r\nb\x00c\x0bd", "A-B\n\n\nc", *[line] * 30]
    docs = list(enumerate(texts)) + [(3, texts[4]), (3, texts[3]), (None, texts[7]), (None, None)]
    target = [texts[k] for k in range(0, 60, 3)] + [None, ""]
    frame = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, rank string, weight long, n_words long")
    got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(repr(tuple(r)) for r in got) == resampled(docs, target)
    assert got[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b " * 30, "s")], DOCS)
    assert resample.resample(empty, some).count() == 0
    assert resample.resample(some, empty).count() == 1


# --- vector codes -----------------------------------------------------------------------------------


def coded(rows, rounds=4):
    kept = [(i, [math.floor(float(x) * 1024) if abs(x) < 2**50 else int(x) * 1024 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    d = width // 4
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    parts = [[tuple(v[k * d : k * d + d]) for _, v, _ in kept] for k in range(4)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[tuple(v[k * d : k * d + d]) for _, v, _ in first] for k in range(4)]

    def assign(k):
        return [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(books[k])) for p in parts[k]]

    for _ in range(rounds):
        for k in range(4):
            of = {}
            for p, (_, j) in zip(parts[k], assign(k), strict=True):
                of.setdefault(j, []).append(p)
            books[k] = [tuple(sum(x) // len(of[j]) for x in zip(*of[j], strict=True)) if j in of else e for j, e in enumerate(books[k])]
    best = [assign(k) for k in range(4)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{best[k][n][1]:02x}" for k in range(4)), sum(best[k][n][0] for k in range(4)), lab) for n, (i, _, lab) in enumerate(kept)]
    sums = Counter()
    for _, _, e, lab in out:
        sums[lab] += e
    longs = lambda x: x if x < 2**63 else None
    return sorted(repr((i, c, longs(e), longs(sums[lab]), digest)) for i, c, e, lab in out)


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def compressed(spark, rows, kind="array<float>"):
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS.replace("array<float>", kind))
    return sorted(repr(tuple(r)) for r in vector_codes.compress(frame).collect())


def test_codes_equal_a_full_comparison_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 20] + rng.normal(size=12) * 0.1], int(i % 3)) for i in range(500)]
    rows += [(600 + i, rows[7][1], None) for i in range(300)]  # copies
    rows += [(900 + i, [0.0] * 12, 1) for i in range(40)] + [(5, rows[9][1], 1), (None, rows[11][1], 2), (None, rows[12][1], None)]
    rows += [(2000, None, 1), (2001, [None] * 12, 1), (2002, [float("nan")] * 12, 1), (2003, [1.0, float("inf")] * 6, 2)]
    assert compressed(spark, rows) == coded(rows)


def test_codes_of_lengths_that_four_does_not_divide_and_of_huge_components(spark):
    rows = [(i, [float(i % 7), 0.5, -0.25 * i, 2.0, 1.0][: 3 + i % 3], 0) for i in range(40)] + [(50, [], 1), (51, [3e4, -7e3], None)]
    assert compressed(spark, rows) == coded(rows)
    huge = rows + [(60, [1e18, -3e30, 1.0], 0), (61, [1e300, 2.0], 4)]
    assert compressed(spark, huge, "array<double>") == coded(huge)


def test_codes_of_no_vectors(spark):
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 2)]) == []


def test_hilbert_neighbours_differ_in_one_cell():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = vector_codes.hilbert_keys(side, 3)
    walk = side[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_a_shortlist_holds_every_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(50):
        points, entries = rng.integers(-50, 50, (30, 4)), rng.integers(-60, 60, (40, 4))
        found = vector_codes.shortlist(points.min(0), points.max(0), entries)
        at, _ = vector_codes.nearest(points, entries)
        assert set(at) <= set(found)


# --- personal data ----------------------------------------------------------------------------------


def luhn(digits):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, text or "", re.ASCII) if ok(m[0])]


def spans_of(spark, texts):
    rows = spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], "doc_id long, text string, source string, kind string")
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    assert len(got) == len(texts)
    return [([tuple(s) for s in got[i].base], [tuple(s) for s in got[i].spans]) for i in range(len(texts))]


def test_base_spans_equal_the_patterns_on_random_and_odd_texts(spark):
    rng = random.Random(11)
    pieces = ["a@b.c", "_d@e.f", "..x@y-z.co.uk", "@", "+1 (213) 555-0246", "+49 30 1234567", " 188.54.39.104", ".5.6.7.8", "4571890862374175", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "\n", "é", "😀", "-", "1", "00", "256.1.1.1", "+", ".", "(", "0001.002.3.4", "378282246310005", "x"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(1500)]
    texts += [None, "", "9" * 3000, "a" * 3000 + "@", "a@b.c " * 3000, "1.2.3.4 " * 3000, "+1 234 567 8901 " * 2000, "(" * 5000, "1 " * 9000]
    for text, (base, spans) in zip(texts, spans_of(spark, texts), strict=True):
        assert base == base_spans(text), text[:80]
        assert set(base) <= set(spans)


def test_very_long_runs_end(spark):
    texts = ["7" * 2_000_000, "a." * 1_000_000, "1-" * 1_000_000, "+1" + "(" * 1_000_000]
    assert spans_of(spark, texts) == [([], [])] * len(texts)  # the plain patterns would take hours


def test_looser_spans_are_added_where_they_look_like_confirmed_ones(spark):
    rng = random.Random(2)
    texts = [f"please call tel {'+' * (i % 40 > 0)}1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} today" for i in range(1200)]
    texts += [f"about {rng.randint(1900, 2030)} and {rng.randint(1, 99)} things" for _ in range(300)]
    found = spans_of(spark, texts)
    assert all(base == base_spans(t) for t, (base, _) in zip(texts, found, strict=True))
    added = [i for i, (base, spans) in enumerate(found) if len(spans) > len(base)]
    assert added and all(i < 1200 and i % 40 == 0 for i in added)
    again = spans_of(spark, texts)
    assert again == found


def test_empty_tables_repeated_rows_and_null_ids(spark):
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, "x 1.2.3.4"), (None, None), (2, "")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, [tuple(s) for s in r.base])) for r in got) == sorted(repr((i, base_spans(t))) for i, t in rows)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- the contracts' columns -------------------------------------------------------------------------


CONTRACTS = {
    "op11_resample": (resample.op11_resample, "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"),
    "op12_pii": (pii.op12_pii, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    "op13_vector_codes": (vector_codes.op13_vector_codes, "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_types_of_the_contract(spark, name, tmp_path):
    rows = [(i, f"line {i}\nmail a{i}@b.org " * 8, [0.5, i / 7, -1.0, 0.25], i % 2) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, embedding array<float>, label int")
    for table, columns in {"documents": ["doc_id", "text"], "benchmark": ["doc_id as item_id", "text"], "embeddings": ["doc_id as vec_id", "embedding", "label"]}.items():
        frame.selectExpr(*columns).write.parquet(f"{tmp_path}/{table}.parquet")
    op, want = CONTRACTS[name]
    got = op(spark, str(tmp_path))
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == want
    assert got.count() == 30
    if name == "op12_pii":
        row = got.filter(F.col("doc_id") == 3).first()
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base_spans(rows[3][1]))
        assert row.n_email == 8 and row.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.spans == said


def test_very_long_words_are_hashed_in_one_pass():
    words = words_of(["x" * 5_000_000, "y" * 600 + " " + "y" * 600 + " " + "y" * 599 + "z", "a" * 512 + " " + "a" * 513])
    h = words.hashes()
    assert len(h) == 6 and h[1] == h[2] != h[3] and len(set(h.tolist())) == 5
