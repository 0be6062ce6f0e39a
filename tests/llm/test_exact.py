"""Operators with exact answers against plain computations on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import exchange, fingerprint, jaccard, lm_score, packing, substrings, topk
from millrace.operators.components import components

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def corpus(seed=0, n=120):
    """Texts of few words with copies, near copies, shared passages, nulls and one long text."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}é" if k % 7 == 0 else f"word{k}" for k in range(400)]
    make = lambda k: " ".join(rng.choice(words, k))
    passage, base = make(30), make(80).split()
    rows = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            near = list(base)
            near[int(rng.integers(80))] = "edited"
            rows.append((i, " ".join(near)))
        elif kind == 1:
            rows.append((i, make(10) + "\n" + passage + "\n" + make(20)))
        elif kind == 2 and i > 8:
            rows.append((i, rows[int(rng.integers(len(rows)))][1]))
        elif kind == 3:
            rows.append((i, ["", None, "a b", "a b", "\t\n", "x" * 60][i // 8 % 6]))
        else:
            rows.append((i, make(int(rng.integers(3, 120)))))
    rows.append((n, make(20_000)))
    return rows


@pytest.fixture(params=["one bucket", "many", "relays"])
def dealt(request, monkeypatch):
    """How documents are dealt: in one chunk and bucket, in many of both, and over several levels of relays."""
    if request.param != "one bucket":
        monkeypatch.setattr(exchange, "CHUNK_BYTES", 12_000)
        monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    if request.param == "relays":
        monkeypatch.setattr(exchange, "STEP", 2)
        monkeypatch.setattr(exchange, "GROUP", 3)
    return request.param


@pytest.mark.parametrize("hot, mask", [(substrings.HOT, None), (6, None), (substrings.HOT, 0)])
def test_repeats_are_removed(spark, dealt, hot, mask, monkeypatch):
    """Also where strings of a few documents count as hot, and where all sampled strings have one hash."""
    if (hot, mask) != (substrings.HOT, None) and dealt == "one bucket":
        pytest.skip("the same as in many buckets")
    if mask is not None:
        plain_stage = substrings.stage
        monkeypatch.setattr(substrings, "stage", lambda docs: replace(plain_stage(docs), key_mask=np.uint64(mask)))
    rows = corpus()
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_spans", F.lit("clash")).withColumn("extra", F.lit(3))
    out = {r["doc_id"]: r for r in substrings.remove_repeats(docs, hot=hot).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(r"1+", "".join("01"[int(g)] for g in gone)))
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), gone.sum(), spans)
        assert r["kept_sha256"] == hashlib.sha256(left).hexdigest() and r["extra"] == 3
        assert r["text"] == (None if t is None else left.decode("utf-8", "replace"))
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_keep_each_other(spark):
    t = "abcdefghij" * 8
    rows = [(1, t), (1, t), (None, t), (2, t)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), text_out=False).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (1, 80), (1, 80), (2, 80)]


def test_the_cover_meets_every_difference():
    p = substrings.PERIOD
    assert {(a - b) % p for a in substrings.COVER for b in substrings.COVER} == set(range(p))


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]) and top(a) != top(b):
            label[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_classes(spark, seed, dealt):
    if seed and dealt != "many":
        pytest.skip("one way of dealing is enough for a second corpus")
    rows = corpus(seed)
    # texts around the threshold: the first edits of one text, one word at a time
    rng = np.random.default_rng(seed)
    chain = [f"c{k}" for k in range(60)]
    for k in range(25):
        chain[int(rng.integers(60))] = f"e{k}"
        rows.append((1000 + k, " ".join(chain)))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("class", F.lit("clash"))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    assert out == brute_classes(rows)


def test_jaccard_odd_rows(spark):
    t = "one two three four five six seven"
    rows = [(4, t), (4, t), (None, t), (7, t.upper()), (8, None), (9, None)]
    out = jaccard.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in out) == [(-1, 3), (4, 3), (4, 3), (7, 3), (8, 0), (9, 0)]
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"]} == {4: 4, 7: 4, 8: 8, 9: 9}
    assert jaccard.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40) if i != 20] + [(50, 50), (40, 39)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_losses_of_both_models(spark, dealt):
    rows = corpus(2, 60)
    wanted = {i for i, _ in rows if i % 3 == 0}
    words = {i: WORD.findall((t or "").translate(LOWER)) for i, t in rows}
    uni, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in words.items():
        for k in (0, 1) if i in wanted else (0,):
            uni[k].update(w), pairs[k].update(zip([None, *w], w))
    out = lm_score.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in wanted], "doc_id long"))
    seen = 0
    for r in out.collect():
        w = words[r["doc_id"]]
        seen += 1
        if not w:
            assert r["score"] is None and r["n_words"] == 0
            continue
        for k, name in ((1, "target_loss"), (0, "background_loss")):
            loss = 0
            for a, b in zip([None, *w], w):
                known = uni[k][a]
                share = 0.7 if known else 0
                loss -= math.log2(share * pairs[k][a, b] / max(known, 1) + (1 - share) * (uni[k][b] + 0.5) / (sum(uni[k].values()) + 0.5 * len(uni[0])))
            assert r[name] == pytest.approx(loss / len(w))
    assert seen == len(rows)
    assert lm_score.score(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long")).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(300, 8)) * rng.choice([0.1, 1, 1, 5], size=(300, 1))
    v[10:40] = v[10]  # ties
    rows = [(i, [float(np.float32(x)) for x in row], "clash") for i, row in enumerate(v)]
    rows += [(300, None, ""), (301, [None] + [1.0] * 7, ""), (302, [float("nan")] * 8, ""), (303, [float("inf")] * 8, ""), (304, [0.0] * 8, ""), (None, [1.0] * 8, "")]
    rows += [(305, [], ""), (320, [], ""), (310, [1.0, 2.0], ""), (311, [3.0, -1.0], "")]
    huge = [[1e15] * 8, [1e7, 1.0] * 4, [1e7, 0.0] * 4, [-1e30] * 8, [1e19, -1e19] * 4, [3e38] * 8]
    rows += [(330 + 5 * k, [float(np.float32(x)) for x in v], "") for k, v in enumerate(huge)]
    return rows


def test_search_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v, _ in rows if i is not None and i not in (300, 301, 302, 303)}
    out = topk.search(table.filter(F.col("vec_id") % 10 == 0), table)
    found = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in good if i % 10 == 0}
    for q, got in found.items():
        products = ((sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        scores = sorted((-min(max(x, -(2**63)), 2**63 - 1), i) for x, i in products)[:5]
        assert got == [(i, -s) for s, i in scores]
    assert topk.search(table.limit(0), table.limit(0)).count() == 0
    few = table.filter(F.col("vec_id") < 3)
    assert topk.search(few, few).count() == 6
    again = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [0.0, 3.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = topk.search(again.filter("vec_id = 0"), again).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 6 * 65536), (0, 2, 1, 65536), (0, 3, 1, 65536)]


def test_pairs_of_one_dim_are_made_in_many_tasks(spark):
    dealt = spark.createDataFrame([(8, k, 1.0) for k in range(40)], "dim int, place long, top double")
    repeated = spark.createDataFrame([(8, k, -1.0) for k in range(6)] + [(8, 9, 2.0)], "dim int, q long, least double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        pairs = topk._pairs(dealt, F.col("place"), repeated).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r["place"], r["q"]) for r in pairs) == [(a, b) for a in range(40) for b in range(6)]
    tasks = Counter(r["task"] for r in pairs)
    assert len(tasks) > 4 and max(tasks.values()) < len(pairs) / 2


def test_pieces_and_places(spark):
    path = packing.default_tokenizer()
    rows = [*corpus(3, 60), (500, "it's 12!! don't _a_ É'sch <|endoftext|> x"), (500, "ＡＢＣ ﬁ İ ²½ ñ"), (None, "The the"), (501, "a\x1cb ć")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("clash"))
    out = packing.pack(docs, path).toPandas()
    whole = packing.tokenizer_of(path).whole
    want = Counter()
    total = 0
    for i, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[i if i is not None else -1, k // 2048, k, len(own), zlib.crc32(own.tobytes())] += 1
    got = Counter((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == want
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all()
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
    assert out["sequence_id"].nunique() <= -(-total // 2048) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
def test_plans_place_every_piece_once(counts):
    used = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, per, offset in packing.best_fit(counts, 40):
        for k in range(n):
            ranks[length].append(rank + k)
            used[first + k // per].append((offset + (k % per) * length, length))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    total = sum(s * n for s, n in counts.items())
    assert len(used) <= 2 * total / 40 + 1


def test_fingerprints_and_edits(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 4000)
    rows = corpus(4, 90)
    docs = spark.createDataFrame(rows[::-1], SCHEMA).withColumn("bucket", F.lit("clash"))
    bucketed = fingerprint.next_in_order(docs, 4000)[0]
    assert bucketed.select("bucket").distinct().count() > 5
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    texts = [t or "" for _, t in rows]
    by_text = {}
    for k, (i, _) in enumerate(rows):
        edited = fingerprint.edited_text(texts[k], texts[(k + 1) % len(rows)])
        r = out[i]
        assert r["n_chars"] == len(texts[k]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(texts[k], r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (edited == texts[k])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    long = [out[i] for i, t in rows if t and len(t) > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.35
    assert fingerprint.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = fingerprint.fingerprint_documents(spark.createDataFrame([(None, "abcd")], SCHEMA)).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and lone["near_next"] == 1


@pytest.mark.parametrize("run_bytes, most", [(1, 20_000), (3000, 3), (1 << 22, 1)])
def test_streamed_order_against_sorting(spark, monkeypatch, run_bytes, most):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(fingerprint, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(fingerprint, "MOST_BUCKETS", most)
    rows = [(i // 3 if i % 2 else i, t) for i, t in corpus(9, 60)] + [(None, "null id"), (None, None), (7, "same id"), (7, "id same")] * 5
    out = fingerprint.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    texts = [t or "" for _, t in rows]
    edited = [fingerprint.edited_text(t, f) for t, f in zip(texts, texts[1:] + texts[:1], strict=True)]
    want = sorted((str(i), hashlib.sha256(e.encode()).hexdigest()) for (i, _), e in zip(rows, edited, strict=True))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in out) == want


def test_fingerprints_are_sums():
    a, b, c = (fingerprint.fingerprints([t])[0] for t in (b"one two\nthree", b"three\none two", b"three"))
    assert (a == b).all() and (a != c).any()
    assert (fingerprint.insert(c, b"one two") == a).all() and (fingerprint.delete(a, b"one two") == c).all()


def test_every_byte_of_a_long_word_counts(monkeypatch):
    rng = np.random.default_rng(7)
    one, two = ("".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000))) for _ in range(2))
    like = lambda a, b: fingerprint.likeness(*(fingerprint.fingerprints([t.encode()]) for t in (a, b)))[0]
    assert 0.3 < like(one, one[:1500] + two[:1500]) < 0.7  # its first bytes alone: 1
    assert like(one[:6] + two, one) < 0.3  # 1
    assert like("x" + one, one) > 0.95  # about 0
    plain = fingerprint.fingerprints([one.encode(), b"a b", ("=" * 400).encode(), two.encode()])
    monkeypatch.setattr(fingerprint, "BLOCK", 37)
    assert (fingerprint.fingerprints([one.encode(), b"a b", ("=" * 400).encode(), two.encode()]) == plain).all()
    for length in (*range(17, 60), 400):  # whatever byte changes, some gram does
        word = bytes(rng.integers(33, 127, length, np.uint8))
        for k in range(length):
            other = word[:k] + b"~" + word[k + 1 :] if word[k] != 126 else word[:k] + b"!" + word[k + 1 :]
            x, y = fingerprint.fingerprints([word, other])[:, fingerprint.EQUAL :]
            assert (x != y).any(), (length, k)
    x, y = fingerprint.fingerprints([b"one " + one.encode() + b"\ntwo", b"two\none " + one.encode()])
    assert (x == y).all()


def test_counts_of_a_very_long_text():
    a, b = (fingerprint.fingerprints([t]) for t in (b"one\n" * 40_000, b"one\n" * 20_000))
    assert fingerprint.likeness(a, b)[0] > 0.99
    x, y = fingerprint.fingerprints([b"one\n" * 2**16, b""])[:, : fingerprint.EQUAL]
    assert (x != y).any()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**40)), unique_by=lambda x: x[0], max_size=50))
def test_packed_keys_come_back(items):
    keys = np.array(sorted(k for k, _ in items), np.uint64)
    counts = np.array([[n for _, n in sorted(items)], range(len(items))], np.int64).T
    codec = exchange.Sums(2)
    for used, step in ((0, 0), (0, 3), (0, 8)):
        got = [(k + (np.uint64(sub << (64 - step)) if step else np.uint64(0)), c) for sub, n, data in codec.split((keys, counts), used, step) for k, c in [codec.read(data, n)]]
        assert [int(k) for ks, _ in got for k in ks] == [int(k) for k in keys]
        assert [list(x) for _, c in got for x in c] == counts.tolist()