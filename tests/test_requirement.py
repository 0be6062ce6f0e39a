"""Requirement readings against a plain version, on many mentions and on odd texts."""

import random
import re
import time

from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.functions.text import pattern
from millrace.operators import requirement as R
from millrace.operators.spans import span_table

TERM = "CPA"


def places(text, phrase, inflect=False):
    core = pattern(phrase, inflect).removeprefix("(?iU)")
    return [m.span() for m in re.finditer(core, text, re.IGNORECASE)]


def plain(text):
    """(context, marker) by going over mentions, clauses and markers one after the other."""
    best = None
    for a, b in places(text or "", TERM, True):
        breaks = [m.span() for m in re.finditer(R.BREAK.removeprefix("(?U)"), text)]
        left = max((e for _, e in breaks if e <= a), default=0)
        right = min((s for s, _ in breaks if s >= b), default=len(text))
        clause = text[left:right]
        own = places(clause, TERM, True)[0]
        no = [m.span() for p in V.NEGATION_PATTERNS for m in re.finditer(p, clause, re.IGNORECASE)]

        def far(span, own=own):
            return max(0, own[0] - span[1], span[0] - own[1])

        must = [(far(s), p) for p in V.REQUIRED_MARKERS for s in places(clause, p) if not any(x <= s[0] and s[1] <= y for x, y in no)]
        may = [(far(s), p) for p in V.PREFERRED_MARKERS for s in places(clause, p)] + [(far(s), "not required") for s in no]
        m, y = min(must, default=None), min(may, default=None)
        if m and (not y or m[0] < y[0]):
            read = ("required", m[1])
        elif y and (not m or y[0] < m[0]):
            read = ("preferred", y[1])
        elif m:
            read = ("ambiguous", None)
        else:
            window, found = text[max(0, a - R.HEADING_REACH) : a], []
            for said, headings in (("required", V.REQUIREMENT_HEADINGS), ("preferred", V.PREFERENCE_HEADINGS)):
                for h in headings:
                    line = r"(?:^|\n)[\s\-*#>]{0,4}" + re.escape(h) + r"\s*[:\-–—]?\s*(?:\n|$)"
                    found += [(x.start() + len(h), len(h), said) for x in re.finditer(line, window, re.IGNORECASE)]
            said = max(found)[2] if found else "unstated"
            read = (said, {"required": R.DEMANDING_SECTION, "preferred": R.PREFERRING_SECTION}.get(said))
        rank = (["required", "ambiguous", "preferred", "unstated"].index(read[0]), a, b)
        best = min(best or (rank, read), (rank, read))
    if best is None:
        return ("absent", None, None)
    _, a, b = best[0]
    x, y = max(0, a - 70), min(len(text), b + 70)
    quoted = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text[x:y]))).strip().replace("\n", " ")
    return (*best[1], "..." * (x > 0) + quoted + "..." * (y < len(text)))


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: (r.context, r.marker, r.evidence) for r in R.requirement_context(rows, "id", "t", TERM).collect()}
    assert len(got) == len(texts)
    return [got[k] for k in range(len(texts))]


def test_readings_equal_the_plain_version_on_random_texts(spark):
    rng = random.Random(4)
    words = [*V.REQUIRED_MARKERS, *V.PREFERRED_MARKERS, "no", "not required", "without a", "CPA", "CPAs", "cpa", "license", "active", "and", "The", "CPA", "é", "😀"]
    heads = [*V.REQUIREMENT_HEADINGS, *V.PREFERENCE_HEADINGS]
    ends = [" ", " ", " ", ". ", "; ", "\n", "\n\n", "\n- ", ", ", "!\n"]
    texts = []
    for _ in range(600):
        parts = []
        for _ in range(rng.randint(1, 25)):
            if rng.random() < 0.12:
                parts.append(rng.choice(["\n", "\n- ", "\n\n", " "]) + rng.choice(heads).title() + rng.choice([":\n", ":\n- ", "\n", ": ", " - ", " of ours "]))
            else:
                parts.append(rng.choice(words) + rng.choice(ends))
        texts.append("".join(parts))
    for text, got in zip(texts, read(spark, texts), strict=True):
        assert got == plain(text), text


def test_overlapping_markers_and_other_spellings(spark):
    texts = ["ideal candidate: CPA", "A PLUS, CPA", "CPA nice-to-have", "CPA  a\tplus", "You must have a CPA", "CPA. Required", "Requirements: CPA", "requirements\n" + "x " * 700 + "CPA", "requirements\n" + "x " * 800 + "CPA"]
    got = read(spark, texts)
    assert [g[:2] for g in got] == [plain(t)[:2] for t in texts]
    assert got[0][:2] == ("preferred", "candidate") and got[7][0] == "required" and got[8][0] == "unstated"


def test_ten_thousand_mentions_in_one_text(spark):
    line = "We want a CPA here\n"
    texts = [line * 10_000 + "CPA required", line * 10_000, "CPA " * 10_000, "x " * 200_000 + "CPA a plus"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4).cache()
    rows.count()
    read(spark, ["CPA"])
    began = time.time()
    got = {r.id: (r.context, r.marker) for r in R.requirement_context(rows, "id", "t", TERM).collect()}
    assert time.time() - began < 20
    assert got == {0: ("required", "required"), 1: ("unstated", None), 2: ("unstated", None), 3: ("preferred", "a plus")}


def test_span_table_positions_equal_finditer(spark):
    texts = ["é CPA, cpa", "", "😀a a", None, "aaa", "CPA"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = span_table(rows, "id", "t", [("term", "(?i)cpa"), ("letter", "a")]).select("id", "kind", "start", "end", "hit").collect()
    want = [(k, kind, *m.span(), m[0]) for k, t in enumerate(texts) for kind, p in (("term", "(?i)cpa"), ("letter", "a")) for m in re.finditer(p, t or "")]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_markers_fall_into_groups_without_overlaps():
    for phrases in (V.REQUIRED_MARKERS, V.PREFERRED_MARKERS):
        groups = R.layers(phrases)
        assert sum(map(len, groups)) == len({R._tokens(p) for p in phrases}) and len(groups) <= 4
        assert not any({"plus", "a plus"} <= set(g) or {"candidate", "ideal candidate"} <= set(g) for g in groups)


def test_details_say_why(spark):
    texts = ["Active CPA license required.", "CPA a plus", "Our team includes a CPA.", "CPA preferred required", "Excel"]
    rows = R.requirement_context(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", TERM)
    detail = R.requirement_detail(F.col("context"), F.col("marker"), F.col("evidence"), TERM)
    said = {r.id: (r.d, r.e) for r in rows.select("id", detail.alias("d"), R.requirement_evidence(F.col("context"), TERM).alias("e")).collect()}
    assert said[0] == ("stated as required via 'required': Active CPA license required.", TERM)
    assert said[1] == ("mentioned but only preferred ('a plus')", TERM)
    assert said[2] == ("'CPA' mentioned without saying if it is required: Our team includes a CPA.", None)
    assert said[3][0].startswith("mentioned but only preferred") and said[4] == ("'CPA' not mentioned", None)


def test_spans_of_texts_that_hold_the_mark(spark):
    texts = ["a￿cpa￿", "￿", "cpa", "no", "￿cpa cpa￿a", "cpaCPA \U0001f600cpa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = span_table(rows, "id", "t", [("term", "(?i)cpa")]).select("id", "start", "end", "hit").collect()
    want = {(k, m.start(), m.end(), m[0]) for k, t in enumerate(texts) for m in re.finditer("(?i)cpa", t)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_spans_are_not_shuffled(spark):
    values = spark.createDataFrame([("1", "CPA required")], "_digest string, _text string")
    plan = R._read(values, "CPA")._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles, made = ([k for k, line in enumerate(plan) if word in line] for word in ("Exchange ", "Generate explode"))
    assert len(shuffles) == 1 and shuffles[0] > made[0]  # texts are dealt, below what makes spans of them
