"""Rule sets as columns: three-valued gates with evidence, verdicts and the ranking ledger.

A gate is a struct<gate, outcome, rule, evidence, detail, policy>; a posting's gates are an array of
them, all evaluated in one projection, so that every reason is shown and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions import vocab as V
from millrace.functions.text import first_match, first_phrase, phrases_found, snippet
from millrace.operators.requirement import requirement_context, requirement_detail, requirement_evidence, requirement_outcome
from millrace.operators.tables import cut, over_distinct, spread

PASS, FAIL, UNKNOWN = "pass", "fail", "unverifiable"
FLAG, STRICT = "flag", "strict"
CLEARANCES = ["security clearance", "TS/SCI", "top secret clearance"]  # fixed values


class Hits:
    """Expressions that a gate reads more than once, each worked out once as a column of its own.

    Those that look for phrases in ``source``, a column of the postings, are worked out once for each
    different text of that column.
    """

    def __init__(self, prefix: str):
        self.prefix, self.columns, self.by_source = prefix, {}, {}

    def __call__(self, expression: Column, source: str | None = None) -> Column:
        name = f"_{self.prefix}{len(self.columns) + sum(map(len, self.by_source.values()))}"
        (self.by_source.setdefault(source, {}) if source else self.columns)[name] = expression
        return F.col(name)

    def of(self, source: str) -> Callable[[Column], Column]:
        return lambda expression: self(expression, source)

    def added_to(self, postings: DataFrame) -> DataFrame:
        for source, columns in self.by_source.items():
            postings = over_distinct(postings, [source], lambda values, columns=columns: spread(values, "_digest").withColumns(columns), self.prefix)
        return postings.withColumns(self.columns) if self.columns else postings


def _inline(expression: Column) -> Column:
    return expression


def _of(keep, source: str):
    return keep.of(source) if isinstance(keep, Hits) else keep


@dataclass
class Rules:
    """One search. An empty field is no constraint."""

    name: str = "search"
    titles: list[str] = field(default_factory=list)
    related_titles: list[str] = field(default_factory=list)
    title_excludes: list[str] = field(default_factory=list)
    excluded_content: list[str] = field(default_factory=list)
    excluded_skills: list[str] = field(default_factory=list)
    responsibilities_exclude: list[str] = field(default_factory=list)
    deal_breakers: list[str] = field(default_factory=list)
    shift_exclude: list[str] = field(default_factory=list)
    exclude_security_clearance: bool = False
    required_keywords: list[str] = field(default_factory=list)
    required_skills: list[str] = field(default_factory=list)
    required_credentials: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    responsibilities: list[str] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    company_excludes: list[str] = field(default_factory=list)
    seniority_excludes: list[str] = field(default_factory=list)
    workplace_types: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=lambda: ["US"])
    locations: list[str] = field(default_factory=list)
    employment_types: list[str] = field(default_factory=list)
    salary_min: float | None = None
    salary_period: str = "year"
    max_age_days: int | None = None
    needs_sponsorship: bool = False
    requirements: dict[str, str] = field(default_factory=dict)  # term -> mentioned, required or preferred_or_required
    title_match: str = "rank"
    policy: str = FLAG
    weights: dict[str, float] = field(default_factory=lambda: dict(V.WEIGHTS))

    @property
    def barred(self) -> list[str]:
        """Everything that a posting's text must not mention."""
        return self.excluded_content + self.excluded_skills + self.responsibilities_exclude + self.deal_breakers + self.shift_exclude

    @property
    def barred_requirements(self) -> dict[str, str]:
        clearance = {term: "required" for term in CLEARANCES} if self.exclude_security_clearance else {}
        return clearance | self.requirements


QUOTED = 60  # characters on either side of a quoted match
NO_TEXT = "posting has no text to search"


def _gate(name: str, outcome: Column, rule: str, evidence: Column, policy: str = FLAG, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(name).alias("gate"),
        outcome.alias("outcome"),
        F.lit(rule).alias("rule"),
        F.when(outcome != UNKNOWN, F.coalesce(evidence, F.lit(""))).otherwise(F.lit("")).alias("evidence"),
        F.coalesce(none if detail is None else detail, F.lit("")).alias("detail"),
        F.lit(policy).alias("policy"),
    )


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def _quoted(text: Column, match: Column) -> Column:
    return F.when(match.isNotNull(), snippet(text, match["start"], match["end"], QUOTED))


def _in_quotes(c: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))


def title_excludes(title: Column, phrases: list[str], policy: str, keep=_inline) -> Column:
    """Fails on the first listed phrase in any form; the title is quoted."""
    hit = keep(first_phrase(title, phrases, True))
    detail = F.when(hit.isNotNull(), F.concat(F.lit("title is "), _in_quotes(title)))
    return _gate("title_excludes", F.when(hit.isNotNull(), FAIL).otherwise(PASS), f"must not mention: {', '.join(phrases)}", hit, policy, detail)


def company_excludes(company: Column, names: list[str], policy: str, keep=_inline) -> Column:
    hit = keep(first_phrase(company, names))
    return _gate("company_excludes", F.when(hit.isNotNull(), FAIL).otherwise(PASS), f"must not mention: {', '.join(names)}", hit, policy)


def phrase_excludes(name: str, text: Column, phrases: list[str], policy: str, keep=_inline) -> Column:
    """Fails on the first listed phrase that occurs in any form: the evidence is the text that matched, the detail what stands around it."""
    match = keep(first_match(text, phrases, True))
    outcome = F.when(_blank(text), UNKNOWN).when(match.isNotNull(), FAIL).otherwise(PASS)
    detail = F.when(_blank(text), NO_TEXT).otherwise(_quoted(text, match))
    return _gate(name, outcome, f"must not mention: {', '.join(phrases)}", match["hit"], policy, detail)


def title_includes(title: Column, phrases: list[str], policy: str = FLAG) -> Column:
    """Passes on any listed phrase as it is written, else quotes the title; no field of a search asks for this gate."""
    hit = first_phrase(title, phrases)
    outcome = F.when(hit.isNotNull(), PASS).otherwise(FAIL)
    detail = F.when(hit.isNull(), "no wanted phrase in title")
    return _gate("title_includes", outcome, f"title must mention one of: {', '.join(phrases)}", F.coalesce(hit, title), policy, detail)


def phrase_requires(name: str, text: Column, phrases: list[str], policy: str = FLAG, keep=_inline) -> Column:
    """Passes on any listed phrase in any form, with the text around it."""
    match = keep(first_match(text, phrases, True))
    outcome = F.when(_blank(text), UNKNOWN).when(match.isNotNull(), PASS).otherwise(FAIL)
    detail = F.when(_blank(text), NO_TEXT).when(match.isNull(), "none of the wanted phrases appear").otherwise(_quoted(text, match))
    return _gate(name, outcome, f"must mention one of: {', '.join(phrases)}", match["phrase"], policy, detail)


def membership(name: str, value: Column, allowed: list[str], unknown: Column, policy: str, why_unknown: Column, detail: Column | None = None) -> Column:
    outcome = F.when(unknown, UNKNOWN).when(value.isin(allowed), PASS).otherwise(FAIL)
    said = F.when(unknown, why_unknown)
    return _gate(name, outcome, f"must be one of: {', '.join(allowed)}", value, policy, said if detail is None else said.otherwise(detail))


def workplace_gate(workplace: Column, allowed: list[str], policy: str) -> Column:
    return membership("workplace", workplace, allowed, workplace == "unknown", policy, F.lit("posting does not state its workplace arrangement"))


def country_gate(place: Column, workplace: Column, allowed: list[str], policy: str) -> Column:
    hint = F.when(workplace == "remote", "remote posting with no country stated").otherwise("posting does not state a country")
    return membership("country", place["country"], allowed, place["country"].isNull(), policy, hint, N.location_display(place))


def seniority_excludes(title: Column, barred: list[str], policy: str, keep=_inline) -> Column:
    """Every level that a title names counts; the evidence is the term that names it."""
    named = keep(N.seniority_named(title))
    hits = F.filter(named, lambda x: x["level"].isin(barred))
    outcome = F.when(F.size(named) == 0, UNKNOWN).when(F.size(hits) > 0, FAIL).otherwise(PASS)
    shown = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))).otherwise(F.get(named, F.lit(0)))
    levels = F.when(F.size(hits) > 0, shown["level"]).otherwise(F.array_join(F.transform(named, lambda x: x["level"]), ", "))
    detail = F.when(F.size(named) == 0, F.concat(F.lit("title "), _in_quotes(title), F.lit(" states no seniority level")))
    detail = detail.otherwise(F.concat(F.lit("detected level "), _in_quotes(levels)))
    return _gate("seniority_excludes", outcome, f"must not be: {', '.join(barred)}", shown["term"], policy, detail)


def stated_pay(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """The pay as the posting states it."""
    unit = F.concat(F.lit(" "), F.coalesce(currency, F.lit("USD")), F.lit("/"), F.coalesce(period, F.lit("year")))
    both = F.concat(F.format_number(low, 0), F.lit("-"), F.format_number(high, 0), unit)
    return F.coalesce(both, F.concat(F.format_number(F.coalesce(low, high), 0), unit))


def salary_floor(low: Column, high: Column, currency: Column, period: Column, minimum: float, unit: str, policy: str) -> Column:
    """Both sides for a year; the posting's minimum counts, and its own wording is the evidence."""
    yearly, most = N.annualized(low, period), N.annualized(high, period)
    outcome = F.when(low.isNull(), UNKNOWN).when(yearly >= minimum * V.PERIODS_A_YEAR.get(unit, 1), PASS).otherwise(FAIL)
    only_high = F.concat(F.lit("posting states only an upper figure ("), F.format_number(most, 0), F.lit("/year); no guaranteed minimum to compare"))
    detail = F.when(low.isNull(), F.coalesce(only_high, F.lit("posting advertises no pay")))
    detail = detail.otherwise(F.concat(F.lit("minimum "), F.format_number(yearly, 0), F.lit("/year")))
    return _gate("salary_floor", outcome, f"pay of at least {minimum:g} a {unit}", stated_pay(low, high, currency, period), policy, detail)


def freshness(posted: Column, today: date, most: int, policy: str) -> Column:
    age = F.datediff(F.lit(today), posted)
    outcome = F.when(posted.isNull(), UNKNOWN).when(age <= most, PASS).otherwise(FAIL)
    return _gate("freshness", outcome, f"posted within {most} days", F.concat(age.cast("string"), F.lit("d old")), policy, F.when(posted.isNull(), "posting has no date"))


def location_gate(loc: Column, workplace: Column, places: list[str], remote_exempt: bool, policy: str, keep=_inline) -> Column:
    where = F.concat_ws(" ", loc["raw"], loc["city"], loc["region"])
    hit = keep(first_phrase(where, places))
    exempt = (workplace == "remote") if remote_exempt else F.lit(False)
    outcome = F.when(exempt, PASS).when(_blank(where), UNKNOWN).when(hit.isNotNull(), PASS).otherwise(FAIL)
    shown = N.location_display(loc)
    evidence = F.when(exempt, "remote").otherwise(F.coalesce(hit, shown))
    detail = F.when(exempt, "remote roles are not tied to a place").when(_blank(where), "posting does not state where the work is").when(hit.isNotNull(), shown)
    return _gate("location", outcome, f"must be in: {', '.join(places)}", evidence, policy, detail)


def employment_gate(value: Column, allowed: list[str], policy: str, keep=_inline) -> Column:
    label = keep(N.employment_label(value))
    said = F.coalesce(value, F.lit("")) != ""
    unknown = F.when(said, F.concat(F.lit("unrecognized employment type "), _in_quotes(value))).otherwise("posting does not state an employment type")
    return membership("employment_type", label, allowed, label.isNull(), policy, unknown, F.concat(F.lit("posting says "), _in_quotes(value)))


def sponsorship(text: Column, policy: str, keep=_inline) -> Column:
    """A refusal beats an offer; silence says nothing. What is said is quoted."""
    no, yes = keep(first_match(text, V.SPONSORSHIP_REFUSALS)), keep(first_match(text, V.SPONSORSHIP_OFFERS))
    outcome = F.when(no.isNotNull(), FAIL).when(yes.isNotNull(), PASS).otherwise(UNKNOWN)
    silent = F.when(_blank(text), NO_TEXT).otherwise("posting does not say whether it sponsors")
    detail = F.coalesce(_quoted(text, no), _quoted(text, yes), silent)
    return _gate("sponsorship", outcome, "employer must be willing to sponsor a visa", F.coalesce(no["phrase"], yes["phrase"]), policy, detail)


def requirement_gate(text: Column, context: Column, marker: Column, quoted: Column, term: str, when: str, policy: str) -> Column:
    """The gate on a reading of ``requirement_context``."""
    outcome = F.when(_blank(text), UNKNOWN).otherwise(requirement_outcome(context, when))
    detail = F.when(_blank(text), NO_TEXT).otherwise(requirement_detail(context, marker, quoted, term, when))
    return _gate(f"requirement:{term}", outcome, f"reject when {term} is {when.replace('_', ' ')}", requirement_evidence(context, term, when), policy, detail)


def searchable_text(title: Column, company: Column, description: Column, raw_location: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (title, company, description, raw_location)])


def compile_gates(r: Rules, today: date, keep=_inline, only: str = "all") -> list[Column]:
    """The gates of a search over normalised postings, in a fixed order.

    ``keep`` may give names to expressions that gates read more than once (see ``Hits``). ``only`` chooses
    the gates on short fields or those on the whole text, which cost most.
    """
    title, text, place = F.col("title"), F.col("searchable"), F.col("location")
    p, in_title, in_text = r.policy, _of(keep, "title"), _of(keep, "searchable")
    short: list[tuple[object, Callable[[], Column]]] = [
        (r.title_excludes, lambda: title_excludes(title, r.title_excludes, p, in_title)),
        (r.seniority_excludes, lambda: seniority_excludes(title, r.seniority_excludes, p, in_title)),
        (r.workplace_types, lambda: workplace_gate(F.col("workplace"), r.workplace_types, p)),
        (r.countries, lambda: country_gate(place, F.col("workplace"), r.countries, p)),
        (r.locations, lambda: location_gate(place, F.col("workplace"), r.locations, "remote" in r.workplace_types, p, keep)),
        (r.company_excludes, lambda: company_excludes(F.col("company"), r.company_excludes, p, keep)),
    ]
    whole = [
        (r.title_match == "hard" and (r.titles + r.related_titles + r.responsibilities), lambda: phrase_requires("relevance", text, r.titles + r.related_titles + r.responsibilities, p, in_text)),
        (r.required_keywords, lambda: phrase_requires("required_keywords", text, r.required_keywords, keep=in_text)),
        (r.required_skills, lambda: phrase_requires("required_skills", text, r.required_skills, keep=in_text)),
        (r.required_credentials, lambda: phrase_requires("required_credentials", text, r.required_credentials, keep=in_text)),
        (r.barred, lambda: phrase_excludes("excluded_content", text, r.barred, p, in_text)),
        (r.needs_sponsorship, lambda: sponsorship(text, p, in_text)),
    ]
    last = [
        (r.employment_types, lambda: employment_gate(F.col("employment_type"), r.employment_types, p, keep)),
        (r.salary_min, lambda: salary_floor(*[F.col(f"salary_{c}") for c in ("min", "max", "currency", "period")], r.salary_min, r.salary_period, p)),
        (r.max_age_days is not None, lambda: freshness(F.col("posted_at"), today, r.max_age_days, p)),
    ]
    makers = {"all": short + whole + last, "short": short + last, "whole": whole}[only]
    return [make() for wanted, make in makers if wanted]


def _signal(name: str, points: Column, evidence: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("name"), F.round(points, 2).alias("points"), F.coalesce(evidence, F.lit("")).alias("evidence")))


def ledger(r: Rules, today: date, keep=_inline) -> Column:
    """array<struct<name, points, evidence>> of what speaks for and against a posting."""
    w, title, text, place = r.weights, F.col("title"), F.col("searchable"), F.col("location")
    hit, related = keep(first_phrase(title, r.titles)), keep(first_phrase(title, r.related_titles))
    signals = [
        _signal("title matches a wanted title", F.lit(w["title_match"]), hit, hit.isNotNull()),
        _signal("title matches a related title", F.lit(w["related_title_match"]), related, hit.isNull() & related.isNotNull()),
    ]
    kinds = [
        ("keywords present", r.keywords, w["keyword_match"], 5),
        ("skills present", r.required_skills, w["required_skill_match"], 5),
        ("responsibilities present", r.responsibilities, w["responsibility_match"], 4),
        ("industry match", r.industries, w["industry_match"], 2),
    ]
    for name, phrases, weight, most in kinds:
        if phrases:
            found = keep(phrases_found(text, phrases, most))
            signals.append(_signal(name, F.size(found) * F.lit(weight), F.array_join(found, ", "), F.size(found) > 0))
    if r.companies:
        own = keep(first_phrase(F.col("company"), r.companies))
        signals.append(_signal("target employer", F.lit(w["target_company_match"]), own, own.isNotNull()))
    if r.workplace_types:
        signals.append(_signal("preferred workplace", F.lit(w["preferred_workplace"]), F.col("workplace"), F.col("workplace") == r.workplace_types[0]))
    if r.locations:
        there = keep(first_phrase(F.concat_ws(" ", N.location_display(place), place["raw"]), r.locations))
        signals.append(_signal("preferred location", F.lit(w["preferred_location"]), there, there.isNotNull()))
    low = F.col("salary_min")
    yearly = N.annualized(low, F.col("salary_period"))
    high, stated = F.col("salary_max"), low.isNotNull() | F.col("salary_max").isNotNull()
    signals.append(_signal("pay disclosed", F.lit(w["salary_disclosed"]), stated_pay(low, high, F.col("salary_currency"), F.col("salary_period")), stated))
    if r.salary_min:
        floor = r.salary_min * V.PERIODS_A_YEAR.get(r.salary_period, 1)
        signals.append(_signal("pay above floor", F.lit(w["salary_above_floor"]), F.concat(F.format_number(yearly, 0), F.lit("/year")), yearly >= floor))
    age = F.datediff(F.lit(today), F.col("posted_at"))
    fresh = F.lit(w["freshness"]) * (1 - age / 30)
    signals.append(_signal("recently posted", fresh, F.concat(age.cast("string"), F.lit("d old")), (age <= 30) & (F.round(fresh, 2) > 0)))
    signals.append(_signal("authoritative employer posting", F.lit(w["authority_bonus"]), F.lit("employer site"), F.col("authority") == 3))
    unsure = F.filter("gates", lambda g: g["outcome"] == UNKNOWN)
    names = F.array_join(F.transform(unsure, lambda g: g["gate"]), ", ")
    signals.append(_signal("unconfirmed requirements", F.least(F.size(unsure), F.lit(3)) * F.lit(w["uncertainty_penalty"]), names, F.size(unsure) > 0))
    return F.filter(F.array(*signals), lambda s: s.isNotNull())


def requirement_gates(postings: DataFrame, r: Rules, key: str) -> tuple[DataFrame, list[Column]]:
    """Postings with each barred requirement's reading joined on ``key``, and the gates on them."""
    gates = []
    for k, (term, when) in enumerate(r.barred_requirements.items()):
        names = [f"_{c}{k}" for c in ("context", "marker", "quoted")]
        postings = postings.join(requirement_context(postings, key, "searchable", term).toDF(key, *names), key)
        gates.append(requirement_gate(F.col("searchable"), *map(F.col, names), term, when, r.policy))
    return postings, gates


_GATES = "array<struct<gate:string,outcome:string,rule:string,evidence:string,detail:string,policy:string>>"
_SIGNALS = "array<struct<name:string,points:double,evidence:string>>"


def rejects(gates: Column) -> Column:
    """A failed gate rejects, under the strict policy an unverifiable one too."""
    return F.exists(gates, lambda g: (g["outcome"] == FAIL) | ((g["outcome"] == UNKNOWN) & (g["policy"] == STRICT)))


def _outcomes(gates: list[Column]) -> Column:
    """Gates without what they quote, where only the decision is wanted."""
    return F.array(*[F.struct(g["outcome"].alias("outcome"), g["policy"].alias("policy")) for g in gates])


def evaluate(postings: DataFrame, r: Rules, today: date, key: str = "ingest_seq") -> DataFrame:
    """Normalised postings with gates, decision, signals, score and is_uncertain.

    All gates are evaluated whatever the others say; what is rejected has no ledger and score 0.
    """
    given = postings.columns
    postings, required = requirement_gates(postings, r, key)
    hits, told = Hits("hit"), Hits("sign")
    gates = compile_gates(r, today, hits) + required
    out = hits.added_to(postings)
    out = out.withColumn("gates", F.array(*gates) if gates else F.array().cast(_GATES))
    out = out.withColumn("decision", F.when(rejects(F.col("gates")), "rejected").otherwise("match"))
    match = F.col("decision") == "match"
    signals = ledger(r, today, lambda e: told(F.when(match, e)))
    out = out.withColumns(told.columns) if told.columns else out
    out = out.withColumn("signals", F.when(match, signals).otherwise(F.array().cast(_SIGNALS)))
    out = out.withColumn("score", F.round(F.aggregate("signals", F.lit(0.0), lambda s, x: s + x["points"]), 2))
    out = out.withColumn("is_uncertain", match & F.exists("gates", lambda g: g["outcome"] == UNKNOWN))
    return out.select(*given, "gates", "decision", "signals", "score", "is_uncertain")


def gate_rows(judged: DataFrame, *columns: str) -> DataFrame:
    """A row for each gate of each judged posting, as ``g``.

    Before a plain explode Spark puts a filter on the size of the array, which it pushes below the gates, so
    that every gate is worked out again with all that it reads.
    """
    return judged.select(*columns, F.explode_outer("gates").alias("g")).filter(F.col("g").isNotNull())


def matches(postings: DataFrame, r: Rules, today: date, key: str = "ingest_seq") -> DataFrame:
    """The rows of ``evaluate`` that match.

    Gates on short fields turn postings away before any whole text is read. The rest is written, so that
    each later read of it does not judge again, and once more before the last filter: a filter above the gates
    would make Spark work them out twice.
    """
    hits = Hits("short")
    gates = compile_gates(r, today, hits, "short")
    if gates:
        given = postings.columns
        postings = cut(hits.added_to(postings).filter(~rejects(_outcomes(gates))).select(*given), "short")
    return cut(evaluate(postings, r, today, key), "judged").filter("decision = 'match'")


def evaluate_all(postings: DataFrame, searches: list[Rules], today: date, key: str = "ingest_seq") -> DataFrame:
    """(key, search, decision) for every posting and search: all searches in one scan of the postings.

    The searches are few and sit in the plan; their names should differ.
    """
    hits, verdicts = Hits("of"), []
    for k, r in enumerate(searches):
        required = []
        for n, (term, when) in enumerate(r.barred_requirements.items()):
            names = [f"_{c}{k}_{n}" for c in ("context", "marker", "quoted")]
            postings = postings.join(requirement_context(postings, key, "searchable", term).toDF(key, *names), key)
            required.append(requirement_gate(F.col("searchable"), *map(F.col, names), term, when, r.policy))
        gates = compile_gates(r, today, hits) + required
        decision = F.when(rejects(_outcomes(gates)), "rejected").otherwise("match") if gates else F.lit("match")
        verdicts.append(F.struct(F.lit(r.name).alias("search"), decision.alias("decision")))
    out = hits.added_to(postings)
    return out.select(key, F.explode(F.array(*verdicts)).alias("v")).select(key, "v.search", "v.decision")


def _said(g: Column) -> Column:
    shown = F.when(g["evidence"] != "", F.concat(F.lit(" ["), g["evidence"], F.lit("]"))).otherwise("")
    return F.concat(F.lit("  - "), g["gate"], F.lit(": "), g["rule"], shown)


def explain_lines() -> Column:
    """What speaks for a verdict, line by line."""
    failed = F.filter("gates", lambda g: g["outcome"] == FAIL)
    unsure = F.filter("gates", lambda g: g["outcome"] == UNKNOWN)
    passed = F.filter("gates", lambda g: (g["outcome"] == PASS) & (g["evidence"] != ""))
    none = F.array().cast("array<string>")

    def block(head: str, gates: Column) -> Column:
        return F.when(F.size(gates) > 0, F.concat(F.array(F.lit(head)), F.transform(gates, _said))).otherwise(none)

    points = F.transform("signals", lambda s: F.concat(F.lit("  "), _points(s["points"]), F.lit(" "), s["name"], F.lit(" ["), s["evidence"], F.lit("]")))
    matched = F.concat(
        F.array(F.concat(F.lit("Matched, score "), F.col("score").cast("string"), F.lit(":"))), points, block("Could not be confirmed:", unsure), block("Rules satisfied:", passed)
    )
    rejected = F.concat(F.array(F.lit("Rejected because:")), F.transform(failed, _said), block("Could not be confirmed:", unsure))
    return F.when(F.col("decision") == "match", matched).otherwise(rejected)


def _points(p: Column) -> Column:
    return F.concat(F.when(p >= 0, F.lit("+")).otherwise(""), p.cast("string"))


def why() -> Column:
    """One line for exports: the failed gates, else the signals with their points."""
    failed = F.transform(F.filter("gates", lambda g: g["outcome"] == FAIL), lambda g: F.concat(g["gate"], F.lit(": "), g["evidence"]))
    signals = F.transform("signals", lambda s: F.concat(s["name"], F.lit(" "), _points(s["points"])))
    return F.when(F.col("decision") == "rejected", F.array_join(failed, "; ")).otherwise(F.array_join(signals, "; "))
