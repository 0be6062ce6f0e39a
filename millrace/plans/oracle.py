"""DuckDB SQL for the queries: the same questions asked of the raw tables in plain SQL."""

from __future__ import annotations

from millrace.functions import normalize as N
from millrace.functions import vocab as V
from millrace.functions.text import phrase_core
from millrace.operators.gates import Rules
from millrace.plans.postings import POSTINGS_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, phrases: list[str], inflect: bool = False) -> str:
    pattern = "(?i)(?:" + "|".join(phrase_core(p, inflect) for p in phrases) + ")"
    return f"regexp_matches({column}, {q(pattern)})"


def first(column: str, phrases: list[str], inflect: bool = False) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, {q('(?i)' + phrase_core(p, inflect))}) THEN {q(p)}" for p in phrases)
    return f"CASE {cases} END"


def matched(column: str, phrases: list[str], inflect: bool = False) -> str:
    """The text that the first phrase of the list that occurs matches."""
    cores = [q("(?i)" + phrase_core(p, inflect)) for p in phrases]
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {c}) THEN regexp_extract({column}, {c}, 0)" for c in cores) + " END"


def around(column: str, phrases: list[str], inflect: bool = False, width: int = 60) -> str:
    """The text around that match, in one line, with dots where it is cut."""
    cores = [phrase_core(p, inflect) for p in phrases]
    lead = "CASE " + " ".join(f"WHEN regexp_matches({column}, {q('(?i)' + c)}) THEN length(regexp_extract({column}, {q('(?is)^(.*?)(?:' + c + ')')}, 1))" for c in cores) + " END"
    return cut_out(column, lead, f"length({matched(column, phrases, inflect)})", width)


def cut_out(column: str, lead: str, size: str, width: int) -> str:
    body = blank_lines(f"substring(s.t, greatest(0, s.a - {width}) + 1, least(length(s.t), s.a + s.n + {width}) - greatest(0, s.a - {width}))")
    return f"""list_transform([{{'t': {column}, 'a': {lead}, 'n': {size}}}], lambda s: CASE WHEN s.a > {width} THEN '...' ELSE '' END
      || replace({body}, chr(10), ' ') || CASE WHEN length(s.t) > s.a + s.n + {width} THEN '...' ELSE '' END)[1]"""


def in_order(column: str, codes: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {has(column, [p])} THEN {q(code)}" for p, code in codes.items())
    return f"CASE {cases} END"


def longest(column: str, codes: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {has(column, [p])} THEN {q(codes[p])}" for p in sorted(codes, key=lambda p: (-len(p), p)))
    return f"CASE {cases} END"


CODE = r"""regexp_extract({c}, '([A-Za-z .''-]+),\s*([A-Z]{{2}})\b', {g})"""
STATES = ", ".join(q(s) for s in sorted(V.US_STATES.values()))


def country(column: str) -> str:
    return f"""CASE WHEN {has(column, V.US_PHRASES)} THEN 'US' WHEN {CODE.format(c=column, g=2)} IN ({STATES}) THEN 'US'
      WHEN {has(column, list(V.US_STATES))} THEN 'US' ELSE coalesce({in_order(column, V.NON_US_COUNTRIES)}, {in_order(column, V.NON_US_REGIONS)}) END"""


def employment(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(column, t)} THEN {q(k)}" for k, t in V.EMPLOYMENT_TYPES.items()) + " END"


def workplace(column: str) -> str:
    kinds = (("hybrid", V.HYBRID_PHRASES), ("onsite", V.ONSITE_PHRASES), ("remote", V.REMOTE_PHRASES))
    return "CASE " + " ".join(f"WHEN {has(column, p)} THEN {q(k)}" for k, p in kinds) + " END"


def within(host: str, domain: str) -> str:
    return f"({host} = {domain} OR ends_with({host}, '.' || {domain}))"


PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def host(url: str) -> str:
    authority = f"regexp_extract({url}, {q(PARTS)}, 2)"
    return f"lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':\\d*$', ''))"


def canonical(url: str) -> str:
    """SQL for a canonical URL (no default port but those given: the test tables have none)."""
    tracking = ", ".join(q(t) for t in V.TRACKING_PARAMS)
    kept = f"list_filter(string_split(regexp_extract({url}, {q(PARTS)}, 4), '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND lower(string_split(p, '=')[1]) NOT IN ({tracking}))"
    query = f"array_to_string(list_sort({kept}), '&')"
    path = f"coalesce(nullif(regexp_replace(regexp_extract({url}, {q(PARTS)}, 3), '/+$', ''), ''), '/')"
    scheme = f"coalesce(nullif(lower(regexp_extract({url}, {q(PARTS)}, 1)), ''), 'https')"
    return f"{scheme} || '://' || regexp_replace({host(url)}, '^www\\.', '') || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


def blank_lines(c: str) -> str:
    """Collapsed white space."""
    for pattern, by in (("\\r\\n?", "chr(10)"), ("[ \\t\\x0B\\f]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        c = f"regexp_replace({c}, {q(pattern)}, {by}, 'g')"
    return f"regexp_replace({c}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"


COMPANY_WORDS = ", ".join(q(s) for s in V.COMPANY_SUFFIXES)


def company_key(c: str) -> str:
    plain = f"trim(regexp_replace(lower(trim({c})), '[^\\w\\s&]', ' ', 'g'))"
    words = f"array_to_string(list_filter(string_split_regex({plain}, '\\s+'), lambda w: w <> '' AND w NOT IN ({COMPANY_WORDS})), ' ')"
    return f"coalesce(nullif({words}, ''), {plain})"


def stated_pay(text: str) -> str:
    """Low, high and period of the first range in dollars of a text, for texts that state at most one."""
    ends = "regexp_extract({}, '\\$([\\d,.]*\\d)(k?)\\s*(?:-|to)\\s*\\$([\\d,.]*\\d)(k?)', ['low', 'lk', 'high', 'hk'])".format(f"regexp_replace({text}, '\\b401\\s*k\\b', ' ', 'gi')")
    amount = "TRY_CAST(replace({e}.{n}, ',', '') AS DOUBLE) * CASE WHEN {e}.{k} = 'k' THEN 1000 ELSE 1 END"
    low, high = amount.format(e=ends, n="low", k="lk"), amount.format(e=ends, n="high", k="hk")
    return f"{{'low': {low}, 'high': {high}, 'period': CASE WHEN {low} IS NOT NULL THEN CASE WHEN {text} LIKE '%per hour%' THEN 'hour' ELSE 'year' END END}}"


JOBS = f"""
posted AS ({POSTINGS_SQL}),
paid AS (SELECT *, {stated_pay("description")} AS said FROM posted),
raw AS (SELECT * EXCLUDE (said) REPLACE (coalesce(salary_min, said.low) AS salary_min, CASE WHEN salary_min IS NOT NULL THEN salary_period ELSE said.period END AS salary_period), CASE WHEN salary_min IS NULL THEN said.high END AS salary_max FROM paid),
place AS (
  SELECT *, {CODE.format(c="location_raw", g=2)} AS code, {CODE.format(c="location_raw", g=1)} AS code_city,
    {longest("location_raw", V.US_STATES)} AS named,
    CASE WHEN title LIKE '%(Req 1234)' THEN replace(title, '(Req 1234)', ' ') ELSE title END AS bare
  FROM raw),
region AS (
  SELECT *, CASE WHEN code IN ({STATES}) THEN code ELSE named END AS region, {country("location_raw")} AS place_country,
    {country("(title || chr(10) || location_raw)")} AS head_country
  FROM place),
city AS (
  SELECT *, CASE WHEN location_raw = '' THEN NULL WHEN code IN ({STATES}) THEN trim(code_city)
      WHEN named IS NOT NULL THEN nullif(trim(string_split(location_raw, ',')[1]), '')
      WHEN {has("string_split(location_raw, ',')[1]", ["remote"])} THEN NULL
      ELSE trim(string_split(location_raw, ',')[1]) END AS city,
    coalesce(nullif(upper(coalesce(country_hint, '')), ''), place_country, CASE WHEN region IS NOT NULL THEN 'US' END) AS own_country
  FROM region),
shaped AS (
  SELECT *, coalesce(own_country, head_country) AS country,
    coalesce(nullif(workplace_hint, 'unknown'), {workplace("(title || ' ' || location_raw)")}, {workplace("description")}, 'unknown') AS workplace,
    coalesce(employment_type, {employment("(title || chr(10) || description)")}) AS employment,
    CASE WHEN {within(host("url"), "employer_domain")} THEN 3 WHEN {" OR ".join(within(host("url"), q(h)) for h in V.ATS_HOSTS)} THEN 2 ELSE 1 END AS authority,
    concat_ws(chr(10), nullif(title, ''), nullif(company, ''), nullif(description, ''), nullif(location_raw, '')) AS searchable,
    {company_key("company")} AS company_key,
    trim(regexp_replace(regexp_replace(lower(bare), ' - dallas, tx$| \\| remote$', ''), '\\s+', ' ', 'g')) AS title_key,
    CASE WHEN city IS NOT NULL THEN trim(trim(regexp_replace(regexp_extract(lower(city), '^[^-/,]*'), '[^a-z ]', '', 'g')) || '|' || coalesce(region, own_country, ''), '|')
      WHEN region IS NOT NULL THEN lower(region) WHEN own_country IS NOT NULL THEN lower(own_country) ELSE 'unspecified' END AS bucket
  FROM city),
jobs AS (
  SELECT *, substr(sha1(concat_ws('|', company_key, title_key, bucket)), 1, 16) AS identity,
    CASE salary_period WHEN 'hour' THEN 2080 ELSE 1 END * salary_min AS yearly,
    date_diff('day', posted_at, DATE '1998-01-01') AS age
  FROM shaped)"""


def seniority(column: str, level: str) -> str:
    return has(column, N.seniority_terms()[level])


def whole(number: str) -> str:
    """A number without decimals, its thousands parted."""
    return f"format('{{:,}}', CAST(round({number}) AS BIGINT))"


def quoted(text: str) -> str:
    return f"chr(39) || {text} || chr(39)"


SHOWN = "coalesce(nullif(concat_ws(', ', city, region, country), ''), nullif(location_raw, ''), 'unspecified')"
UNIT = "' USD/' || coalesce(salary_period, 'year')"
PAY = f"CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN {whole('salary_min')} || '-' || {whole('salary_max')} || {UNIT} ELSE {whole('coalesce(salary_min, salary_max)')} || {UNIT} END"
NO_TEXT = "WHEN trim(searchable) = '' THEN 'posting has no text to search'"


def gate_rows(r: Rules) -> list[tuple[str, str, str, str]]:
    """(gate, outcome, evidence, detail) as SQL over ``jobs``, in the order of the gates."""
    rows = []
    if r.title_excludes:
        hit = first("title", r.title_excludes, True)
        rows.append(("title_excludes", f"CASE WHEN {hit} IS NOT NULL THEN 'fail' ELSE 'pass' END", hit, f"CASE WHEN {hit} IS NOT NULL THEN 'title is ' || {quoted('title')} END"))
    if r.seniority_excludes:
        named = "list_filter([" + ", ".join(f"{{'k': {q(k)}, 't': {matched('title', N.seniority_terms()[k])}}}" for k in V.SENIORITY) + "], lambda x: x.t IS NOT NULL)"
        barred = "[" + ", ".join(q(x) for x in r.seniority_excludes) + "]"
        hits = f"list_filter({named}, lambda x: list_contains({barred}, x.k))"
        outcome = f"CASE WHEN len({named}) = 0 THEN 'unverifiable' WHEN len({hits}) > 0 THEN 'fail' ELSE 'pass' END"
        every = f"array_to_string(list_transform({named}, lambda x: x.k), ', ')"
        detail = f"""CASE WHEN len({named}) = 0 THEN 'title ' || {quoted("title")} || ' states no seniority level'
          WHEN len({hits}) > 0 THEN 'detected level ' || {quoted(f"{hits}[1].k")} ELSE 'detected level ' || {quoted(every)} END"""
        rows.append(("seniority_excludes", outcome, f"CASE WHEN len({hits}) > 0 THEN {hits}[1].t ELSE {named}[1].t END", detail))
    where_is = f"CASE WHEN country IS NOT NULL THEN {SHOWN} WHEN workplace = 'remote' THEN 'remote posting with no country stated' ELSE 'posting does not state a country' END"
    for gate, column, allowed, unknown, detail in (
        ("workplace", "workplace", r.workplace_types, "workplace = 'unknown'", "CASE WHEN workplace = 'unknown' THEN 'posting does not state its workplace arrangement' END"),
        ("country", "country", r.countries, "country IS NULL", where_is),
    ):
        if allowed:
            among = ", ".join(q(x) for x in allowed)
            rows.append((gate, f"CASE WHEN {unknown} THEN 'unverifiable' WHEN {column} IN ({among}) THEN 'pass' ELSE 'fail' END", column, detail))
    if r.locations:
        where = "concat_ws(' ', location_raw, city, region)"
        hit = first(where, r.locations)
        exempt = "workplace = 'remote'" if "remote" in r.workplace_types else "FALSE"
        outcome = f"CASE WHEN {exempt} THEN 'pass' WHEN trim({where}) = '' THEN 'unverifiable' WHEN {hit} IS NOT NULL THEN 'pass' ELSE 'fail' END"
        detail = f"CASE WHEN {exempt} THEN 'remote roles are not tied to a place' WHEN trim({where}) = '' THEN 'posting does not state where the work is' WHEN {hit} IS NOT NULL THEN {SHOWN} END"
        rows.append(("location", outcome, f"CASE WHEN {exempt} THEN 'remote' ELSE coalesce({hit}, {SHOWN}) END", detail))
    if r.company_excludes:
        hit = first("company", r.company_excludes)
        rows.append(("company_excludes", f"CASE WHEN {hit} IS NOT NULL THEN 'fail' ELSE 'pass' END", hit, "NULL"))
    wanted = [("required_keywords", r.required_keywords), ("required_skills", r.required_skills), ("required_credentials", r.required_credentials)]
    if r.title_match == "hard":
        wanted.insert(0, ("relevance", r.titles + r.related_titles + r.responsibilities))
    for gate, phrases in wanted:
        if phrases:
            hit = first("searchable", phrases, True)
            detail = f"CASE {NO_TEXT} WHEN {hit} IS NULL THEN 'none of the wanted phrases appear' ELSE {around('searchable', phrases, True)} END"
            rows.append((gate, f"CASE WHEN {hit} IS NOT NULL THEN 'pass' ELSE 'fail' END", hit, detail))
    if r.barred:
        hit = matched("searchable", r.barred, True)
        detail = f"CASE {NO_TEXT} WHEN {hit} IS NOT NULL THEN {around('searchable', r.barred, True)} END"
        rows.append(("excluded_content", f"CASE WHEN {hit} IS NOT NULL THEN 'fail' ELSE 'pass' END", hit, detail))
    if r.needs_sponsorship:
        no, yes = first("searchable", V.SPONSORSHIP_REFUSALS), first("searchable", V.SPONSORSHIP_OFFERS)
        outcome = f"CASE WHEN {no} IS NOT NULL THEN 'fail' WHEN {yes} IS NOT NULL THEN 'pass' ELSE 'unverifiable' END"
        detail = f"""CASE {NO_TEXT} WHEN {no} IS NOT NULL THEN {around("searchable", V.SPONSORSHIP_REFUSALS)} WHEN {yes} IS NOT NULL THEN {around("searchable", V.SPONSORSHIP_OFFERS)}
          ELSE 'posting does not say whether it sponsors' END"""
        rows.append(("sponsorship", outcome, f"coalesce({no}, {yes})", detail))
    if r.employment_types:
        label = employment("employment")
        among = ", ".join(q(x) for x in r.employment_types)
        detail = f"""CASE WHEN {label} IS NOT NULL THEN 'posting says ' || {quoted("employment")} WHEN coalesce(employment, '') <> '' THEN 'unrecognized employment type ' || {quoted("employment")}
          ELSE 'posting does not state an employment type' END"""
        rows.append(("employment_type", f"CASE WHEN {label} IS NULL THEN 'unverifiable' WHEN {label} IN ({among}) THEN 'pass' ELSE 'fail' END", label, detail))
    if r.salary_min:
        outcome = f"CASE WHEN salary_min IS NULL THEN 'unverifiable' WHEN yearly >= {r.salary_min} THEN 'pass' ELSE 'fail' END"
        rows.append(("salary_floor", outcome, PAY, f"CASE WHEN salary_min IS NULL THEN 'posting advertises no pay' ELSE 'minimum ' || {whole('yearly')} || '/year' END"))
    if r.max_age_days is not None:
        outcome = f"CASE WHEN posted_at IS NULL THEN 'unverifiable' WHEN age <= {r.max_age_days} THEN 'pass' ELSE 'fail' END"
        rows.append(("freshness", outcome, "CAST(age AS VARCHAR) || 'd old'", "CASE WHEN posted_at IS NULL THEN 'posting has no date' END"))
    return [(g, o, f"CASE WHEN ({o}) = 'unverifiable' THEN '' ELSE coalesce({e}, '') END", d) for g, o, e, d in rows]


def gates_long(r: Rules) -> str:
    parts = " UNION ALL ".join(f"SELECT ingest_seq, {q(g)} AS gate, {o} AS outcome, {e} AS evidence, coalesce({d}, '') AS detail FROM jobs" for g, o, e, d in gate_rows(r))
    return f"WITH {JOBS}, gates AS ({parts}) SELECT ingest_seq, gate, outcome, evidence, detail FROM gates"


def signal_rows(r: Rules) -> list[tuple[str, str]]:
    """(points, condition) as SQL, to be summed over what is not rejected."""
    w = r.weights
    title, related = first("title", r.titles) if r.titles else "NULL", first("title", r.related_titles) if r.related_titles else "NULL"
    rows = [(str(w["title_match"]), f"{title} IS NOT NULL"), (str(w["related_title_match"]), f"{title} IS NULL AND {related} IS NOT NULL")]
    if r.keywords:
        n = " + ".join(f"CASE WHEN {has('searchable', [p])} THEN 1 ELSE 0 END" for p in r.keywords)
        rows.append((f"least({n}, 5) * {w['keyword_match']}", "TRUE"))
    if r.workplace_types:
        rows.append((str(w["preferred_workplace"]), f"workplace = {q(r.workplace_types[0])}"))
    rows.append((str(w["salary_disclosed"]), "salary_min IS NOT NULL"))
    if r.salary_min:
        rows.append((str(w["salary_above_floor"]), f"yearly >= {r.salary_min}"))
    fresh = f"round({w['freshness']}::DOUBLE * (1 - age / 30.0::DOUBLE), 2)"
    rows.append((fresh, f"age <= 30 AND {fresh} > 0"))
    rows.append((str(w["authority_bonus"]), "authority = 3"))
    rows.append((f"least(n_unsure, 3) * {w['uncertainty_penalty']}", "n_unsure > 0"))
    return rows


def verdicts(r: Rules) -> str:
    """CTEs up to ``verdicts``: jobs with decision, n_unsure and score."""
    gates = gate_rows(r)
    failed = " OR ".join(f"({o}) = 'fail'" for _, o, *_ in gates)
    unsure = " + ".join(f"CASE WHEN ({o}) = 'unverifiable' THEN 1 ELSE 0 END" for _, o, *_ in gates)
    points = " + ".join(f"CASE WHEN {c} THEN CAST({p} AS DOUBLE) ELSE 0 END" for p, c in signal_rows(r))
    return f"""WITH {JOBS},
judged AS (SELECT *, CASE WHEN {failed} THEN 'rejected' ELSE 'match' END AS decision, {unsure} AS n_unsure FROM jobs),
verdicts AS (SELECT *, CASE WHEN decision = 'match' THEN round({points}, 2) ELSE 0.0 END AS score,
  decision = 'match' AND n_unsure > 0 AS is_uncertain FROM judged)"""
