"""Whether a text demands, prefers or merely mentions a qualification.

Mentions, clause breaks, markers, negations and headings of a text are rows of a span table. Windows over
a text give each row its clause (the breaks before it) and the heading above it, windows over a clause
the nearest markers. Nothing is nested, so that a text with ten thousand mentions costs what its rows cost.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vocab as V
from millrace.functions.text import any_pattern, escaped, pattern, snippet
from millrace.operators.spans import gap_between, span_table
from millrace.operators.tables import dealt, over_distinct

REQUIRED, PREFERRED, AMBIGUOUS, UNSTATED, ABSENT = "required", "preferred", "ambiguous", "unstated", "absent"
BREAK = r"(?U)(?<=[.;!?])\s+|\n+"
HEADING_REACH, QUOTED = 1500, 70
ONE_LINE = r"[^\S\n]"  # blanks within a line: clauses end at line feeds
NOT_REQUIRED, DEMANDING_SECTION, PREFERRING_SECTION = "not required", "requirements section", "preferred-qualifications section"


def _tokens(phrase: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[\s\-/]+", phrase.lower()) if t)


def _may_overlap(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    if len(a) < len(b):
        a, b = b, a
    inside = any(a[k : k + len(b)] == b for k in range(len(a) - len(b) + 1))
    return inside or any(a[-k:] == b[:k] or b[-k:] == a[:k] for k in range(1, len(b)))


def layers(phrases: list[str]) -> list[list[str]]:
    """The phrases in groups within which no two can match overlapping text, so that one pattern finds all of a group.

    Of phrases that differ in blanks and dashes only, the first in order of their characters stays.
    """
    own = {}
    for p in sorted(phrases):
        own.setdefault(_tokens(p), p)
    out: list[list[str]] = []
    for t, p in own.items():
        group = next((g for g in out if not any(_may_overlap(t, _tokens(q)) for q in g)), None)
        out.append([p]) if group is None else group.append(p)
    return out


def _marker_name(hit: Column, phrases: list[str]) -> Column:
    """The phrase of the list that a hit is, whatever its case and blanks."""
    names = {}
    for p in sorted(phrases):
        names.setdefault(" ".join(_tokens(p)), p)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.regexp_replace(F.lower(hit), r"(?U)[\s\-/]+", " "))


def _heading(headings: list[str]) -> str:
    return r"[\s\-*#>]{0,4}(?:" + "|".join(escaped(h) for h in sorted(headings, key=lambda h: (-len(h), h))) + r")\s*[:\-–—]?\s*"


def _patterns(term: str) -> list[tuple[str, str]]:
    one_line = rf"[{ONE_LINE}\-/]+"
    marked = [("must", V.REQUIRED_MARKERS), ("may", V.PREFERRED_MARKERS)]
    found = [("mention", pattern(term, True)), ("break", BREAK)]
    found += [(kind, any_pattern(group, gap=one_line)) for kind, phrases in marked for group in layers(phrases)]
    found += [("negation", "(?iU)" + p.replace(r"[\w\s]", rf"(?:\w|{ONE_LINE})").replace(r"\s", ONE_LINE)) for p in V.NEGATION_PATTERNS]
    # a heading above stands alone on its line
    lines = [("demands", V.REQUIREMENT_HEADINGS), ("prefers", V.PREFERENCE_HEADINGS)]
    return found + [(kind, rf"(?iU)(?<![^\n]){_heading(h)[: -len(r'\s*[:\-–—]?\s*')]}(?=\s*[:\-–—]?\s*\n)") for kind, h in lines]


def _at_the_end(headings: list[str]) -> str:
    """A heading that the mention itself follows on its line."""
    return rf"(?iU)\n{_heading(headings)}$"


def requirement_context(docs: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """(key, context, marker, evidence): the strongest reading of a term over its mentions in a text.

    Every mention is read in its clause (up to sentence ends and line feeds), from the clause's first
    mention: the nearer of what demands and what prefers wins, equal distance is ambiguous; "no ...
    required" and the like prefer. Of markers equally near the first in order of their characters counts.
    Without a marker the nearest heading within 1,500 characters above decides; a heading begins a
    line. Over mentions, required beats ambiguous, preferred and unstated, then the first in the text.
    A mention that spans a break has both sides for its clause. Null and empty texts and those without
    the term are ``absent``, without marker and evidence. One row for each row of ``docs``; each
    different text is read once.
    """
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    read = over_distinct(rows, ["_text"], lambda values: _read(values, term), "requirement")
    best = F.col("_best")
    quoted = F.when(best.isNotNull(), snippet(F.col("_text"), best["at"], best["end"], QUOTED))
    return read.select(key, F.coalesce(best["context"], F.lit(ABSENT)).alias("context"), best["marker"].alias("marker"), quoted.alias("evidence"))


def _read(values: DataFrame, term: str) -> DataFrame:
    """(_digest, _best) for the different texts (_digest, _text) that hold the term."""
    # dealt by text before spans are looked for: texts are smaller than their spans, which then stay where they are
    texts = dealt(values.select("_digest", "_text").filter(F.col("_text").rlike(pattern(term, True))), "_digest")
    t = span_table(texts, "_digest", "_text", _patterns(term), {"mention"})
    kind, start, end = F.col("kind"), F.col("start"), F.col("end")
    whole = Window.partitionBy("_digest").orderBy("start", "end", "kind")
    before, upto = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, 0)
    mention = kind == "mention"
    # a break inside a mention parts nothing
    t = t.withColumn("_reach", F.max(F.when(mention, end)).over(before))
    parts = (kind == "break") & (F.coalesce(F.col("_reach"), F.lit(0)) <= start)
    t = t.withColumn("_clause", F.sum(parts.cast("int")).over(upto))
    heading = F.when(kind.isin("demands", "prefers"), F.struct(start.alias("start"), kind.alias("kind")))
    t = t.withColumn("_above", F.last(heading, True).over(before)).filter(kind != "break")

    clause = Window.partitionBy("_digest", "_clause")
    sofar = clause.orderBy("start", (kind != "negation").cast("int"), "end").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_own", F.min(F.when(mention, F.struct("start", "end"))).over(clause))
    t = t.withColumn("_no", F.max(F.when(kind == "negation", end)).over(sofar))  # how far negations that began so far reach
    d = gap_between(F.col("_own.start"), F.col("_own.end"), start, end)

    def nearest(when: Column, marker: Column) -> Column:
        return F.min(F.when(when, F.struct(d.alias("d"), marker.alias("marker")))).over(clause)

    negated = F.coalesce(F.col("_no"), F.lit(-1)) >= end
    t = t.withColumn("_must", nearest((kind == "must") & ~negated, _marker_name(F.col("hit"), V.REQUIRED_MARKERS)))
    said = F.when(kind == "negation", NOT_REQUIRED).otherwise(_marker_name(F.col("hit"), V.PREFERRED_MARKERS))
    t = t.withColumn("_may", nearest(kind.isin("may", "negation"), said)).filter(mention)

    m, y, above = F.col("_must"), F.col("_may"), F.col("_above")
    near = above["start"] >= start - HEADING_REACH
    section = (
        F.when(F.col("before").rlike(_at_the_end(V.REQUIREMENT_HEADINGS)), "demands")
        .when(F.col("before").rlike(_at_the_end(V.PREFERENCE_HEADINGS)), "prefers")
        .when(near, above["kind"])
    )
    t = t.withColumn("_section", F.when(m.isNull() & y.isNull(), section))
    section = F.col("_section")
    must = m.isNotNull() & (y.isNull() | (m["d"] < y["d"]))
    may = y.isNotNull() & (m.isNull() | (y["d"] < m["d"]))
    context = (
        F.when(must | (section == "demands"), REQUIRED)
        .when(may | (section == "prefers"), PREFERRED)
        .when(m.isNotNull(), AMBIGUOUS)
        .otherwise(UNSTATED)
    )
    marker = F.when(must, m["marker"]).when(may, y["marker"]).when(section == "demands", DEMANDING_SECTION).when(section == "prefers", PREFERRING_SECTION)
    order = F.array_position(F.array(*[F.lit(x) for x in (REQUIRED, AMBIGUOUS, PREFERRED, UNSTATED)]), context)
    read = F.struct(order.alias("o"), start.alias("at"), end.alias("end"), context.alias("context"), marker.alias("marker"))
    return t.groupBy("_digest").agg(F.min(read).alias("_best"))


def requirement_outcome(context: Column, when: str = "required") -> Column:
    """The gate on a reading: ``when`` is mentioned, required or preferred_or_required."""
    if when == "mentioned":
        return F.when(context == ABSENT, "pass").otherwise("fail")
    bad = [REQUIRED, PREFERRED] if when == "preferred_or_required" else [REQUIRED]
    return F.when(context.isin(bad), "fail").when(context.isin(AMBIGUOUS, UNSTATED), "unverifiable").otherwise("pass")


def requirement_evidence(context: Column, term: str, when: str = "required") -> Column:
    """What a gate quotes: the term, where it passes or fails upon a mention."""
    outcome = requirement_outcome(context, when)
    return F.when((context != ABSENT) & (outcome != "unverifiable"), F.lit(term))


def requirement_detail(context: Column, marker: Column, evidence: Column, term: str, when: str = "required") -> Column:
    """Why a gate decides as it does, with the text around the mention."""
    named = f"'{term}'"
    if when == "mentioned":
        return F.when(context == ABSENT, f"{named} not mentioned").otherwise(evidence)
    via = F.concat(F.lit("'"), F.coalesce(marker, F.lit("")), F.lit("'"))
    preferred = F.concat(F.lit("mentioned but only preferred ("), via, F.lit(")"))
    if when == "preferred_or_required":
        preferred = F.concat(F.lit("stated as preferred: "), evidence)
    return (
        F.when(context == ABSENT, f"{named} not mentioned")
        .when(context == REQUIRED, F.concat(F.lit("stated as required via "), via, F.lit(": "), evidence))
        .when(context == PREFERRED, preferred)
        .when(context == AMBIGUOUS, F.concat(F.lit(f"{named} mentioned with conflicting wording: "), evidence))
        .otherwise(F.concat(F.lit(f"{named} mentioned without saying if it is required: "), evidence))
    )
