"""Queries over rule sets: requirement readings, explanations, many searches at once, links in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.operators import gates as G
from millrace.operators.requirement import requirement_context, requirement_outcome
from millrace.operators.searches import SCHEMA as SEARCH_SCHEMA
from millrace.operators.searches import count_all
from millrace.plans import oracle as O
from millrace.plans.searches import ACCOUNTING, TODAY
from millrace.plans.postings import normalised, postings

LINK = r"""(?i)(?:href|src|data-src|action)\s*=\s*["']([^"'>\s]+)"""


def requirement(spark, sf_dir):
    read = requirement_context(postings(spark, sf_dir), "ingest_seq", "description", "CPA")
    return read.select("ingest_seq", "context", requirement_outcome(F.col("context")).alias("outcome"))


# words of the documents that stand for a qualification, its markers and headings, so that texts of prose can be read for them
STAND_INS = [
    (" the ", " CPA "), (" de ", " CPA "), (" der ", " CPAs "), (" and ", " required "), (" la ", " must have "), (" und ", " a plus "),
    (" of ", " ideally "), (" to ", " preferred "), (" in ", " mandatory "), (chr(10) + "Th", chr(10) + "Requirements:" + chr(10) + "Th"), (chr(10) + "En", chr(10) + "- Nice to have" + chr(10) + "En"),
]


def requirement_in_documents(spark, sf_dir):
    """How whole documents treat a qualification, with the text that says so."""
    text = F.col("text")
    for old, new in STAND_INS:
        text = F.replace(text, F.lit(old), F.lit(new))
    # out of an array of one, so that a filter on the text does not work it out again
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode_outer(F.array(text)).alias("text"))
    return requirement_context(docs, "doc_id", "text", "CPA")


def link_extract(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    return links.groupBy("link").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


def many_specs(spark, sf_dir, rules=None):
    """Every posting against several searches, with every field of each."""
    judged = G.evaluate_all(normalised(postings(spark, sf_dir)), rules or SEARCHES, TODAY)
    return judged.groupBy("search", "decision").agg(F.count("*").alias("n"))


SEARCHES = [
    G.Rules("accounting", titles=["accountant", "accounts payable"], title_excludes=["staff", "director"], workplace_types=["remote"], required_keywords=["CPA", "close"]),
    G.Rules("frontend", titles=["frontend engineer", "web developer"], title_excludes=["senior"], workplace_types=["remote", "hybrid"], salary_min=40000, employment_types=["full_time"]),
    G.Rules("projects", titles=["project manager"], seniority_excludes=["entry"], workplace_types=["hybrid", "onsite"], countries=[], excluded_content=["visa"], deal_breakers=["wellness stipend"], max_age_days=700),
]


# A search for every supplier; the same text runs in Spark and DuckDB.
SUPPLIER_SEARCHES = """
SELECT CONCAT('supplier ', CAST(s_suppkey AS STRING)) AS name, 'rank' AS title_match, CASE WHEN s_suppkey % 7 = 0 THEN 'strict' ELSE 'flag' END AS policy,
 s_suppkey % 11 = 0 AS needs_sponsorship, CASE WHEN s_acctbal > 0 THEN CAST(FLOOR(s_acctbal) * 8 AS DOUBLE) END AS salary_min, 'year' AS salary_period,
 CASE s_suppkey % 4 WHEN 0 THEN {array}'staff'{end} WHEN 1 THEN {array}'directors', 'junior'{end} WHEN 2 THEN {array}'auditing'{end} END AS title_excludes,
 CASE s_suppkey % 5 WHEN 0 THEN {array}'CPA'{end} WHEN 1 THEN {array}'accounts payable', 'audits'{end} WHEN 2 THEN {array}'react component'{end} WHEN 3 THEN {array}'close'{end} END AS required_keywords,
 CASE s_suppkey % 6 WHEN 0 THEN {array}'stipends'{end} WHEN 1 THEN {array}'visa sponsorship', 'hourly'{end} END AS barred,
 CASE s_nationkey % 3 WHEN 0 THEN {array}'remote'{end} WHEN 1 THEN {array}'hybrid', 'onsite'{end} END AS workplace_types,
 CASE WHEN s_nationkey % 2 = 0 THEN {array}'US'{end} END AS countries,
 CASE WHEN s_nationkey % 5 = 0 THEN {array}'Dallas', 'Atlanta'{end} END AS locations
FROM supplier
"""
_TITLE, _TEXT, _PLACE = ["staff", "directors", "junior", "auditing"], ["CPA", "accounts payable", "audits", "react component", "close", "stipends", "visa sponsorship", "hourly"], ["Dallas", "Atlanta"]


def saved_searches(spark, sf_dir):
    """A table of searches, one for each supplier, over all postings: how many each takes and turns away."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    told = spark.sql(SUPPLIER_SEARCHES.replace("{array}", "array(").replace("{end}", ")").replace("FROM supplier", "FROM {supplier}"), supplier=suppliers)
    given = [c.split() for c in SEARCH_SCHEMA.split(", ")]
    table = told.select(*[(F.col(c) if c in told.columns else F.lit(None)).cast(kind).alias(c) for c, kind in given])
    return count_all(normalised(postings(spark, sf_dir)), table, TODAY).withColumnRenamed("first", "first_posting")


def export_why(spark, sf_dir):
    """The one-line reason of every verdict, as exports have it."""
    judged = G.evaluate(normalised(postings(spark, sf_dir)), ACCOUNTING, TODAY)
    return judged.select("ingest_seq", "decision", G.why().alias("why"))


QUERIES = {"export_why": export_why, "requirement_context": requirement, "requirement_in_documents": requirement_in_documents, "link_extract": link_extract, "many_specs": many_specs, "saved_searches": saved_searches}

def _saved_sql() -> str:
    def found(column, phrases, inflect):
        return "list_filter([" + ", ".join(f"CASE WHEN {O.has(column, [p], inflect)} THEN {O.q(p)} END" for p in phrases) + "], lambda x: x IS NOT NULL)"

    where = "concat_ws(' ', location_raw, city, region)"
    strict = "s.policy = 'strict'"
    return f"""WITH {O.JOBS},
      f AS MATERIALIZED (SELECT *, {found("title", _TITLE, True)} AS ft, {found("searchable", _TEXT, True)} AS fx, {found(where, _PLACE, False)} AS fp, trim({where}) = '' AS nowhere,
        {O.has("searchable", V.SPONSORSHIP_REFUSALS)} AS no, {O.has("searchable", V.SPONSORSHIP_OFFERS)} AS yes FROM jobs),
      s AS ({SUPPLIER_SEARCHES.replace("{array}", "[").replace("{end}", "]")}),
      d AS (SELECT s.name AS search, ingest_seq, CASE WHEN coalesce(list_has_any(s.title_excludes, ft), FALSE) OR coalesce(list_has_any(s.barred, fx), FALSE)
          OR (s.required_keywords IS NOT NULL AND NOT list_has_any(s.required_keywords, fx))
          OR (s.workplace_types IS NOT NULL AND CASE WHEN workplace = 'unknown' THEN {strict} ELSE NOT list_contains(s.workplace_types, workplace) END)
          OR (s.countries IS NOT NULL AND CASE WHEN country IS NULL THEN {strict} ELSE NOT list_contains(s.countries, country) END)
          OR (s.locations IS NOT NULL AND NOT (workplace = 'remote' AND coalesce(list_contains(s.workplace_types, 'remote'), FALSE)) AND CASE WHEN nowhere THEN {strict} ELSE NOT list_has_any(s.locations, fp) END)
          OR (s.needs_sponsorship AND CASE WHEN no THEN TRUE WHEN yes THEN FALSE ELSE {strict} END)
          OR (coalesce(s.salary_min, 0) <> 0 AND CASE WHEN f.salary_min IS NULL THEN {strict} ELSE yearly < s.salary_min END)
        THEN 'rejected' ELSE 'match' END AS decision FROM f CROSS JOIN s)
      SELECT search, decision, count(*) AS n, min(ingest_seq) AS first_posting FROM d GROUP BY ALL"""


def _documents_sql() -> str:
    """Clause by clause: the first mention, then for each marker how far it stands before or after it."""
    text = "text"
    for old, new in STAND_INS:
        text = f"replace({text}, {O.q(old)}, {O.q(new)})"

    def spans(name, pattern, shift="0"):
        return f"""{name}s AS (SELECT id, unnest(string_split_regex(text, {O.q(pattern)})) AS piece, unnest(regexp_extract_all(text, {O.q(pattern)})) AS hit, generate_subscripts(string_split_regex(text, {O.q(pattern)}), 1) AS i FROM t),
          {name} AS (SELECT id, CAST(sum(length(piece) + coalesce(length(hit), 0)) OVER w - length(hit) + {shift} AS BIGINT) AS a, CAST(sum(length(piece) + length(hit)) OVER w AS BIGINT) AS z, i FROM {name}s WINDOW w AS (PARTITION BY id ORDER BY i) QUALIFY hit IS NOT NULL)"""

    def near(markers):
        far = []
        for m in markers:
            core = f"\\b{m.replace(' ', '[ ]+')}\\b".replace("\\\\", "\\")
            far.append(f"CASE WHEN regexp_matches(lead, {O.q('(?i)' + core)}) THEN {{'d': length(regexp_extract(lead, {O.q('(?is)^.*' + core + '(.*)$')}, 1)), 'm': {O.q(m)}}} END")
            far.append(f"CASE WHEN regexp_matches(tail, {O.q('(?i)' + core)}) THEN {{'d': length(regexp_extract(tail, {O.q('(?is)^(.*?)' + core)}, 1)), 'm': {O.q(m)}}} END")
        return f"list_min(list_filter([{', '.join(far)}], lambda x: x IS NOT NULL))"

    line = r"\n[ \-*#>]{0,4}(requirements|nice to have):?[ ]*\n"
    heading = f"lower(regexp_extract(substring(text, greatest(0, m.a - 1500) + 1, least(m.a, 1500)), {O.q('(?is)^.*' + line)}, 1))"
    return f"""WITH t AS MATERIALIZED (SELECT doc_id AS id, {text} AS text FROM documents),
      {spans("m", r"(?i)\bCPAs?\b")}, {spans("b", r"[.;!?]\s+|\n+", "CASE WHEN regexp_matches(hit, '^[.;!?]') THEN 1 ELSE 0 END")},
      c AS (SELECT m.id, m.a, m.z, (SELECT coalesce(max(b.z), 0) FROM b WHERE b.id = m.id AND b.z <= m.a) AS l, (SELECT min(b.a) FROM b WHERE b.id = m.id AND b.a >= m.z) AS r FROM m),
      k AS (SELECT c.*, min(a) OVER o AS fa, min(z) OVER o AS fz FROM c WINDOW o AS (PARTITION BY id, l)),
      n AS (SELECT k.*, text, substring(text, l + 1, fa - l) AS lead, substring(text, fz + 1, coalesce(r, length(text)) - fz) AS tail FROM k JOIN t ON k.id = t.id),
      x AS MATERIALIZED (SELECT m.*, {near(["required", "must have", "mandatory"])} AS y, {near(["a plus", "ideally", "preferred"])} AS p, {heading} AS h FROM n AS m),
      v AS (SELECT id, a, z, text, CASE WHEN y IS NOT NULL AND (p IS NULL OR y.d < p.d) THEN 1 WHEN p IS NOT NULL AND (y IS NULL OR p.d < y.d) THEN 3 WHEN y IS NOT NULL THEN 2 WHEN h = 'requirements' THEN 1 WHEN h = 'nice to have' THEN 3 ELSE 4 END AS o,
        CASE WHEN y IS NOT NULL AND (p IS NULL OR y.d < p.d) THEN y.m WHEN p IS NOT NULL AND (y IS NULL OR p.d < y.d) THEN p.m WHEN y IS NOT NULL THEN NULL WHEN h = 'requirements' THEN 'requirements section' WHEN h = 'nice to have' THEN 'preferred-qualifications section' END AS marker FROM x),
      f AS (SELECT *, {O.cut_out("text", "a", "z - a", 70)} AS evidence FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, a) = 1)
      SELECT d.doc_id, coalesce(['required', 'ambiguous', 'preferred', 'unstated'][o], 'absent') AS context, marker, evidence FROM documents d LEFT JOIN f ON d.doc_id = f.id"""


_NEGATED = "(?i)(?:" + "|".join(V.NEGATION_PATTERNS) + ")"
_SPECS = " UNION ALL ".join(
    f"""SELECT {O.q(r.name)} AS search, CASE WHEN {" OR ".join(f"({o}) = 'fail'" for _, o, *_ in O.gate_rows(r))} THEN 'rejected' ELSE 'match' END AS decision FROM jobs"""
    for r in SEARCHES
)
_NAMES = ["title matches a wanted title", "title matches a related title", "keywords present", "preferred workplace", "pay disclosed", "pay above floor", "recently posted", "authoritative employer posting", "unconfirmed requirements"]
_FAILED = ", ".join(f"CASE WHEN ({o}) = 'fail' THEN {O.q(g + ': ')} || {e} END" for g, o, e, _ in O.gate_rows(ACCOUNTING))
_SIGNALS = ", ".join(
    f"CASE WHEN {c} AND CAST({p} AS DOUBLE) <> 0 THEN {O.q(n + ' ')} || CASE WHEN {p} >= 0 THEN '+' ELSE '' END || CAST(CAST({p} AS DOUBLE) AS VARCHAR) END"
    for n, (p, c) in zip(_NAMES, O.signal_rows(ACCOUNTING), strict=True)
)
ORACLE_SQL = {
    "export_why": f"""{O.verdicts(ACCOUNTING)} SELECT ingest_seq, decision,
      array_to_string(list_filter(CASE WHEN decision = 'rejected' THEN [{_FAILED}] ELSE [{_SIGNALS}] END, lambda x: x IS NOT NULL), '; ') AS why FROM verdicts""",
    "requirement_context": f"""WITH p AS ({O.POSTINGS_SQL}),
      c AS (SELECT ingest_seq, description, unnest(string_split_regex(regexp_replace(description, '([.;!?])\\s+', '\\1' || chr(31), 'g'), '[' || chr(31) || '\\n]+')) AS clause FROM p),
      m AS (SELECT *, regexp_matches(clause, {O.q(_NEGATED)}) AS no, regexp_replace(clause, {O.q(_NEGATED)}, ' ', 'g') AS rest FROM c WHERE regexp_matches(clause, '(?i)\\bCPAs?\\b')),
      r AS (SELECT ingest_seq, CASE WHEN {O.has("rest", V.REQUIRED_MARKERS)} THEN 1 WHEN no OR {O.has("clause", V.PREFERRED_MARKERS)} THEN 3
        WHEN regexp_matches(description, '(?im)^requirements:$') THEN 1 WHEN regexp_matches(description, '(?im)^preferred qualifications:$') THEN 3 ELSE 4 END AS o FROM m),
      b AS (SELECT ingest_seq, min(o) AS o FROM r GROUP BY ingest_seq)
      SELECT p.ingest_seq, CASE o WHEN 1 THEN 'required' WHEN 3 THEN 'preferred' WHEN 4 THEN 'unstated' ELSE 'absent' END AS context,
        CASE o WHEN 1 THEN 'fail' WHEN 4 THEN 'unverifiable' ELSE 'pass' END AS outcome FROM p LEFT JOIN b ON p.ingest_seq = b.ingest_seq""",
    "requirement_in_documents": _documents_sql(),
    "saved_searches": _saved_sql(),
    "link_extract": f"SELECT link, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, {O.q(LINK)}, 1)) AS link FROM pages) GROUP BY link",
    "many_specs": f"WITH {O.JOBS}, j AS ({_SPECS}) SELECT search, decision, count(*) AS n FROM j GROUP BY search, decision",
}
