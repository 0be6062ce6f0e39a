"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions.text import content_hash, first_phrase, html_to_text, pattern
from millrace.functions.urls import canonical_url, url_authority
from millrace.operators import gates as G
from millrace.plans import oracle as O
from millrace.plans import board_queries, history_queries, rule_queries, state_queries
from millrace.plans.postings import normalised, placed, postings
from millrace.plans.searches import ACCOUNTING, TODAY

WORDS = ["license", "stupid", "idiot", "moron", "the", "and"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(postings(spark, sf_dir))


def canonical_url_dedup(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))
    return pages.groupBy("canonical").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


def html_text(spark, sf_dir):
    text = html_to_text(F.col("html"))
    pages = _table(spark, sf_dir, "pages").select("page_id", text.alias("text"))
    return pages.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def content_hash_dups(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    groups = docs.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return groups.filter("n_docs > 1")


def phrase_gate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    hit = first_phrase(F.col("text"), WORDS[:4], True)
    outcome = F.when(F.trim("text") == "", "unverifiable").when(hit.isNotNull(), "fail").otherwise("pass")
    return docs.select("doc_id", outcome.alias("outcome"), hit.alias("evidence"))


def phrase_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    counts = [F.sum(F.regexp_count("text", F.lit(pattern(w)))).cast("long").alias(w) for w in WORDS]
    wide = docs.groupBy("source").agg(*counts)
    return wide.unpivot(["source"], WORDS, "phrase", "n_hits")


def url_authority_tier(spark, sf_dir):
    tier = url_authority(F.col("url"), F.col("employer_domain"))
    return postings(spark, sf_dir).groupBy("source", tier.alias("authority")).agg(F.count("*").alias("n"))


def normalize_identity(spark, sf_dir):
    p = placed(postings(spark, sf_dir))
    p = p.select("ingest_seq", F.col("_company_key").alias("company_key"), F.col("_title_key").alias("title_key"), F.col("_bucket").alias("bucket"))
    key = F.concat_ws("|", "company_key", "title_key", "bucket")
    return p.withColumn("identity", F.substring(F.sha1(key.cast("binary")), 1, 16))


def normalized_fields(spark, sf_dir):
    return _jobs(spark, sf_dir).select(
        "ingest_seq",
        F.col("location.city").alias("city"),
        F.col("location.region").alias("region"),
        F.col("location.country").alias("country"),
        "workplace",
        N.highest_seniority(F.col("title")).alias("seniority"),
        N.employment_label(F.col("employment_type")).alias("employment"),
        "authority",
    )


def gates_long(spark, sf_dir):
    judged = G.evaluate(_jobs(spark, sf_dir), ACCOUNTING, TODAY)
    return G.gate_rows(judged, "ingest_seq").select("ingest_seq", "g.gate", "g.outcome", "g.evidence", "g.detail")


def verdicts(spark, sf_dir):
    judged = G.evaluate(_jobs(spark, sf_dir), ACCOUNTING, TODAY)
    return judged.select("ingest_seq", "decision", "score", "is_uncertain")


def top_matches(spark, sf_dir):
    """The flagship: the twenty best postings of a search."""
    judged = G.matches(_jobs(spark, sf_dir), ACCOUNTING, TODAY)
    best = judged.orderBy(F.desc("score"), F.desc("posted_at"), "ingest_seq").limit(20)
    return best.select("ingest_seq", "identity", "title", "company", "score", "is_uncertain")


def gate_summary(spark, sf_dir):
    judged = G.evaluate(_jobs(spark, sf_dir), ACCOUNTING, TODAY)
    g = G.gate_rows(judged).groupBy("g.gate", "g.outcome")
    return g.agg(F.count("*").alias("n"))


HIGHEST = "CASE " + " ".join(f"WHEN {O.seniority('title', k)} THEN {O.q(k)}" for k in reversed(list(G.V.SENIORITY))) + " END"


def _html_sql() -> str:
    def unescape(c):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
            c = f"replace({c}, {O.q(entity)}, {O.q(char)})"
        return c

    c = f"CASE WHEN regexp_matches(html, '&lt;|&amp;') THEN {unescape('html')} ELSE html END"
    steps = [(r"(?is)<!--.*?-->", "''")]
    steps += [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "''") for t in G.V.SKIPPED_TAGS]
    steps += [(r"(?i)<li\b[^>]*/>", "chr(10) || '- ' || chr(10)"), (rf"(?i)<(?:{'|'.join(G.V.BLOCK_TAGS)})\b[^>]*/>", "chr(10) || chr(10)")]
    steps += [(r"(?i)<li\b[^>]*>", "chr(10) || '- '"), (rf"(?i)</?(?:{'|'.join(G.V.BLOCK_TAGS)})\b[^>]*>", "chr(10)"), (r"</?[A-Za-z!][^>]*>", "''")]
    for pattern_, by in steps:
        c = f"regexp_replace({c}, {O.q(pattern_)}, {by}, 'g')"
    text = O.blank_lines(unescape(c))
    return f"SELECT page_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM (SELECT page_id, {text} AS text FROM pages)"


_HIT = O.first("text", WORDS[:4], True)
# RE2 knows ASCII word boundaries only: signs are doubled, so that neighbouring hits can each consume theirs
_DOUBLED = r"regexp_replace(text, '([^\p{L}\p{M}\p{N}\p{Pc}])', '\1\1', 'g')"
_EDGES = r"(?i)(?:^|[^\p{L}\p{M}\p{N}\p{Pc}])(?:%s)(?:$|[^\p{L}\p{M}\p{N}\p{Pc}])"
_COUNTS = "WITH d AS (SELECT source, " + _DOUBLED + " AS t FROM documents) " + " UNION ALL ".join(f"SELECT source, {O.q(w)} AS phrase, CAST(sum(len(regexp_extract_all(t, {O.q(_EDGES % w)}))) AS BIGINT) AS n_hits FROM d GROUP BY source" for w in WORDS)

QUERIES = {
    "top_matches": top_matches,
    "gates_long": gates_long,
    "gate_summary": gate_summary,
    "verdicts": verdicts,
    "normalize_company_title_identity": normalize_identity,
    "workplace_country_seniority_employment": normalized_fields,
    "url_authority_tier": url_authority_tier,
    "canonical_url_dedup": canonical_url_dedup,
    "html_to_text": html_text,
    "content_hash_dups": content_hash_dups,
    "phrase_gate": phrase_gate,
    "phrase_counts": phrase_counts,
}

ORACLE_SQL = {
    "top_matches": f"{O.verdicts(ACCOUNTING)} SELECT ingest_seq, identity, title, company, score, is_uncertain FROM verdicts WHERE decision = 'match' ORDER BY score DESC, posted_at DESC, ingest_seq LIMIT 20",
    "gates_long": O.gates_long(ACCOUNTING),
    "gate_summary": f"SELECT gate, outcome, count(*) AS n FROM ({O.gates_long(ACCOUNTING)}) GROUP BY gate, outcome",
    "verdicts": f"{O.verdicts(ACCOUNTING)} SELECT ingest_seq, decision, score, is_uncertain FROM verdicts",
    "normalize_company_title_identity": f"WITH {O.JOBS} SELECT ingest_seq, company_key, title_key, bucket, identity FROM jobs",
    "workplace_country_seniority_employment": f"WITH {O.JOBS} SELECT ingest_seq, city, region, country, workplace, {HIGHEST} AS seniority, {O.employment('employment')} AS employment, CAST(authority AS INTEGER) AS authority FROM jobs",
    "url_authority_tier": f"WITH {O.JOBS} SELECT source, CAST(authority AS INTEGER) AS authority, count(*) AS n FROM jobs GROUP BY source, authority",
    "canonical_url_dedup": f"SELECT canonical, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT page_id, {O.canonical('trim(url)')} AS canonical FROM pages) GROUP BY canonical",
    "html_to_text": _html_sql(),
    "content_hash_dups": """SELECT content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM (
        SELECT doc_id, substr(sha1(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')), 1, 16) AS content_hash FROM documents)
        GROUP BY content_hash HAVING count(*) > 1""",
    "phrase_gate": f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'unverifiable' WHEN {_HIT} IS NOT NULL THEN 'fail' ELSE 'pass' END AS outcome, {_HIT} AS evidence FROM documents",
    "phrase_counts": _COUNTS,
}

for _more in (state_queries, rule_queries, board_queries, history_queries):
    QUERIES |= _more.QUERIES
    ORACLE_SQL |= _more.ORACLE_SQL
