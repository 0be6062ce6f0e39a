"""Places, workplaces, seniority, employment types, dates and names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import any_pattern, collapse_whitespace, contains_any, first_match, first_phrase, pattern

CITY_STATE = r"([A-Za-z .'-]+),\s*([A-Z]{2})\b"


def _by_phrase(text: Column, codes: dict[str, str], longest: bool = False) -> Column:
    """The code of the first phrase of the table that occurs, else null; with ``longest`` of the longest one.

    Longer phrases come first in the pattern, so that no part of one is read instead of it; the phrase
    found is looked up in a constant map of places in the order, which keeps the expression small.
    """
    by_length = sorted(codes, key=lambda p: (-len(p), p))
    order = by_length if longest else list(codes)
    places = F.create_map(*[F.lit(x) for k, p in enumerate(order) for x in (p, k)])
    hits = F.regexp_extract_all(text, F.lit(any_pattern(by_length)), F.lit(0))
    plain = F.transform(hits, lambda h: F.regexp_replace(F.lower(h), r"[\s\-/]+", " "))
    best = F.array_min(F.transform(plain, lambda h: F.try_element_at(places, h)))
    return F.get(F.array(*[F.lit(codes[p]) for p in order]), best)


def state_of(raw: Column) -> Column:
    code = F.regexp_extract(raw, CITY_STATE, 2)
    return F.coalesce(F.when(code.isin(sorted(V.US_STATES.values())), code), _by_phrase(raw, V.US_STATES, True))


def country_of(text: Column) -> Column:
    """US phrases, then "City, ST", then state names, then other countries, then regions; else null.

    Of several countries the first of the table wins, wherever it stands in the text.
    """
    code = F.regexp_extract(text, CITY_STATE, 2)
    return F.coalesce(
        F.when(contains_any(text, V.US_PHRASES), F.lit("US")),
        F.when(code.isin(sorted(V.US_STATES.values())), F.lit("US")),
        F.when(contains_any(text, list(V.US_STATES)), F.lit("US")),
        _by_phrase(text, V.NON_US_COUNTRIES),
        _by_phrase(text, V.NON_US_REGIONS),
    )


def location(raw: Column, hint: Column | None = None, region: Column | None = None, country: Column | None = None) -> Column:
    """struct<raw, city, region, country>; "remote" is never a city, and a hint wins the country.

    ``region`` and ``country`` may be given as columns that hold state_of and country_of already.
    """
    raw = collapse_whitespace(F.coalesce(raw, F.lit("")))
    hint = F.nullif(F.upper(F.coalesce(hint if hint is not None else F.lit(None).cast("string"), F.lit(""))), F.lit(""))
    code = F.regexp_extract(raw, CITY_STATE, 2)
    is_code = code.isin(sorted(V.US_STATES.values()))
    region = state_of(raw) if region is None else region
    country = country_of(raw) if country is None else country
    not_city = any_pattern(["remote"])
    coded_city = F.when(is_code, F.trim(F.regexp_extract(raw, CITY_STATE, 1)))
    names = any_pattern(sorted(V.US_STATES, key=lambda p: (-len(p), p)))
    before_name = F.trim(F.lower(F.element_at(F.split(raw, names, 2), 1)), F.lit(" ,"))
    named_city = F.when(~is_code & region.isNotNull() & (before_name != "") & (F.length(before_name) < 60), F.initcap(before_name))
    head = F.trim(F.element_at(F.split(raw, ",", 2), 1))
    lone_city = F.when(region.isNull() & (head != "") & (F.length(head) < 60), head)
    city = F.coalesce(coded_city, named_city, lone_city)
    city = F.when(~city.rlike(not_city), city)
    country = F.coalesce(hint, country, F.when(region.isNotNull(), F.lit("US")))
    empty = raw == ""
    none = F.lit(None).cast("string")
    return F.struct(
        raw.alias("raw"),
        F.when(empty, none).otherwise(city).alias("city"),
        F.when(empty, none).otherwise(region).alias("region"),
        F.when(empty, hint).otherwise(country).alias("country"),
    )


def location_display(loc: Column) -> Column:
    shown = F.concat_ws(", ", loc["city"], loc["region"], loc["country"])
    return F.coalesce(F.nullif(shown, F.lit("")), F.nullif(loc["raw"], F.lit("")), F.lit("unspecified"))


def location_bucket(raw: Column, hint: Column | None = None) -> Column:
    return bucket_of(location(raw, hint))


def bucket_of(loc: Column) -> Column:
    """A coarse key of a place: city and region, else region, else country."""
    city = F.element_at(F.split(F.lower(loc["city"]), "[-/,]", 2), 1)
    city = F.trim(F.regexp_replace(city, "[^a-z ]", ""))
    keyed = F.trim(F.concat(city, F.lit("|"), F.coalesce(loc["region"], loc["country"], F.lit(""))), F.lit("|"))
    return F.coalesce(F.when(loc["city"].isNotNull(), keyed), F.lower(loc["region"]), F.lower(loc["country"]), F.lit("unspecified"))


def workplace_in(text: Column) -> Column:
    return (
        F.when(contains_any(text, V.HYBRID_PHRASES), "hybrid")
        .when(contains_any(text, V.ONSITE_PHRASES), "onsite")
        .when(contains_any(text, V.REMOTE_PHRASES), "remote")
        .otherwise("unknown")
    )


def workplace(hint: Column, *texts: Column) -> Column:
    """The source's own statement, else what the first telling text says."""
    known = [F.nullif(x, F.lit("unknown")) for x in (hint, *[workplace_in(t) for t in texts])]
    return F.coalesce(*known, F.lit("unknown"))


def seniority_terms() -> dict[str, list[str]]:
    return {k: [t for t in v if len(t) > 2 or t in V.SHORT_SENIORITY_TERMS] for k, v in V.SENIORITY.items()}


def seniority_levels(title: Column) -> Column:
    """Every level that a title names, from low to high."""
    named = [F.when(contains_any(title, terms), F.lit(level)) for level, terms in seniority_terms().items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def seniority_named(title: Column) -> Column:
    """array<struct<level, term>>: every level that a title names, from low to high, with what the first term of its list matched."""
    named = [F.struct(F.lit(level).alias("level"), first_match(title, terms)["hit"].alias("term")) for level, terms in seniority_terms().items()]
    return F.filter(F.array(*named), lambda x: x["term"].isNotNull())


def highest_seniority(title: Column) -> Column:
    levels = seniority_levels(title)
    return F.when(F.size(levels) > 0, F.element_at(levels, -1))


def employment_type(text: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(text, terms), F.lit(k)) for k, terms in V.EMPLOYMENT_TYPES.items()])


def employment_label(value: Column) -> Column:
    """A label as it is, or recognised in what a source wrote."""
    labels = list(V.EMPLOYMENT_TYPES)
    return F.when(value.isin(labels), value).otherwise(employment_type(value))


def company_key(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"(?U)[^\w\s&]", " ")
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: ~w.isin(V.COMPANY_SUFFIXES) & (w != ""))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.trim(plain))


SUFFIX = r"\s*[-–—|,]\s*(?:remote|hybrid|onsite|on-site|[a-z .']{2,30}(?:,\s*[a-z]{2}|,\s*[a-z .']{4,20})?)\s*$"


def title_key(title: Column) -> Column:
    """Lower case without brackets, requisition ids and one trailing place or arrangement."""
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[\(\[\{].*?[\)\]\}]", " ")
    text = F.regexp_replace(text, r"(?U)\b(?:req|requisition|job|id)[\s#:-]*\w*\d+\w*\b", " ")
    short = F.trim(F.regexp_replace(text, SUFFIX, ""))
    tail = F.trim(F.substring(text, F.length(short) + 1, F.length(text)), F.lit(" -–—|,"))
    is_place = (tail.rlike(r"\b[a-z]{2}\b\s*$") & tail.contains(",")) | tail.isin("remote", "hybrid", "onsite", "on-site")
    is_place = is_place | country_of(tail).isNotNull()
    text = F.when((short != "") & (short != F.trim(text)) & is_place, short).otherwise(text)
    return collapse_whitespace(F.regexp_replace(text, r"(?U)[^\w\s+#]", " "))


def identity(company: Column, title: Column, location_raw: Column, country: Column | None = None) -> Column:
    return identity_of(company, title, location_bucket(location_raw, country))


def identity_of(company: Column, title: Column, bucket: Column) -> Column:
    key = F.concat_ws("|", company_key(company), title_key(title), bucket)
    return F.substring(F.sha1(key.cast("binary")), 1, 16)


def relative_date(text: Column, today: Column) -> Column:
    """"Posted 5 days ago" as a date, counted from ``today``; else null."""
    low = F.lower(text)
    found = r"(\d+)\+?\s*(day|week|month|year)s?\s*ago"
    unit = F.regexp_extract(low, found, 2)
    days = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
    amount = F.regexp_extract(low, found, 1).try_cast("int")
    return (
        F.when(low.contains("today") | low.contains("just posted"), today)
        .when(low.contains("yesterday"), F.date_sub(today, 1))
        .when(days.isNotNull() & amount.isNotNull(), F.date_sub(today, amount * days))
    )


def annualized(amount: Column, period: Column) -> Column:
    factor = F.lit(1)
    for name, times in V.PERIODS_A_YEAR.items():
        factor = F.when(period == name, times).otherwise(factor)
    return amount * factor


def first_phrase_in(text: Column, phrases: list[str]) -> Column:
    return first_phrase(text, phrases)
