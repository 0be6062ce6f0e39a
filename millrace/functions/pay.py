"""Pay stated in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What says that a number nearby is pay, what looks like money and is none, and the
# words for periods, in the order in which they are tried.
CUES = r"(?i)(salary|salaries|compensation|pay\s*(?:range|rate|band)?|base\s+pay|base\s+salary|wage|hourly\s*(?:rate)?|annual(?:ized)?\s+(?:pay|salary|compensation)|per\s+(?:hour|year|annum|month|week)|/\s*(?:hr|hour|yr|year|mo|month)|starting\s+at|range\s+of|earn(?:s|ing)?\s+up\s+to|\bDOE\b)"
NOT_MONEY = r"\b(401\s*[kK]|403\s*[bB]|457\s*[bB]|529)\b"
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
RANGE = rf"(?i)([$€£])?\s*({NUMBER})\s*([km])?\s*(?:-|–|—|to|through|up\s+to)\s*([$€£])?\s*({NUMBER})\s*([km])?"
SINGLE = rf"(?i)([$€£])?\s*({NUMBER})\s*(k\b|m\b)?"
PERIODS = {
    "hour": ["per hour", "/hour", "/hr", "hourly", "an hour", "per hr"],
    "day": ["per day", "/day", "daily"],
    "week": ["per week", "/week", "weekly"],
    "month": ["per month", "/month", "monthly"],
    "year": ["per year", "/year", "annually", "per annum", "annual", "/yr"],
}
WINDOW = 120


def _scaled(number: Column, suffix: Column) -> Column:
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("double")
    return value * F.when(F.lower(suffix) == "k", 1000.0).when(F.lower(suffix) == "m", 1000000.0).otherwise(1.0)


def _period(window: Column) -> Column:
    low, out = F.lower(window), F.lit("year")
    for name, words in reversed(PERIODS.items()):
        said = F.lit(False)
        for w in words:
            said = said | low.contains(w)
        out = F.when(said, name).otherwise(out)
    return out


def _currency(sign: Column) -> Column:
    return F.when(sign == "€", "EUR").when(sign == "£", "GBP").otherwise("USD")


def _windows(text: Column, pattern: str) -> Column:
    """array<struct<hit, window>> of all matches with what stands near them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<hit:string,start:int>>").alias("found"))

    def step(acc, i):
        begin = acc["at"] + F.get(gaps, i)
        hit = F.get(hits, i)
        return F.struct((begin + F.length(hit)).alias("at"), F.concat(acc["found"], F.array(F.struct(hit.alias("hit"), begin.alias("start")))).alias("found"))

    places = F.sequence(F.lit(0), F.size(hits) - 1)
    found = F.aggregate(places, start, step, lambda acc: acc["found"])

    def near(x):
        a = F.greatest(F.lit(0), x["start"] - WINDOW)
        return F.struct(x["hit"].alias("hit"), F.substring(text, a + 1, x["start"] + F.length(x["hit"]) + WINDOW - a).alias("window"))

    return F.when(F.size(hits) > 0, F.transform(found, near)).otherwise(F.array().cast("array<struct<hit:string,window:string>>"))


def pay(text: Column) -> Column:
    """struct<minimum, maximum, currency, period>, null where no pay is stated.

    The first valid range with a currency or near a cue wins; else the first single figure near a cue
    that has a currency, a suffix or a comma. Equal ends leave the maximum null.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), NOT_MONEY, " ")

    def read_range(x):
        part = [F.regexp_extract(x["hit"], RANGE, k) for k in range(7)]
        low, high = _scaled(part[2], part[3]), _scaled(part[5], part[6])
        money = (part[1] != "") | (part[4] != "")
        fine = (money | x["window"].rlike(CUES)) & (high >= low) & (money | (part[3] != "") | part[2].contains(","))
        sign = F.coalesce(F.nullif(part[1], F.lit("")), part[4])
        return F.when(
            fine,
            F.struct(
                low.alias("minimum"), F.when(high != low, high).alias("maximum"), _currency(sign).alias("currency"), _period(x["window"]).alias("period")
            ),
        )

    def read_single(x):
        part = [F.regexp_extract(x["hit"], SINGLE, k) for k in range(4)]
        fine = ((part[1] != "") | (part[3] != "") | part[2].contains(",")) & x["window"].rlike(CUES)
        return F.when(
            fine,
            F.struct(
                _scaled(part[2], part[3]).alias("minimum"), F.lit(None).cast("double").alias("maximum"), _currency(part[1]).alias("currency"), _period(x["window"]).alias("period")
            ),
        )

    def first(found):
        return F.get(F.filter(found, lambda p: p.isNotNull()), F.lit(0))

    return F.coalesce(first(F.transform(_windows(plain, RANGE), read_range)), first(F.transform(_windows(plain, SINGLE), read_single)))
