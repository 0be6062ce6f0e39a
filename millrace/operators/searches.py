"""Many searches as a table: one scan of the postings for all of them, found by an inverted phrase index.

Phrases of all searches become rows keyed by their first word, in each form that it may take; the
different words of a text become rows; an equi-join proposes (text, phrase), and only proposed phrases
are looked for. Searches then judge the phrases found, array against array: the plan holds no pattern of
any search and keeps its size however many there are.
"""

from __future__ import annotations

import re
from dataclasses import asdict
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import normalize as N
from millrace.functions import vocab as V
from millrace.functions.text import ENDINGS, LONG_WORD, first_phrase, inflections, pattern
from millrace.operators.gates import STRICT, UNKNOWN, Rules
from millrace.operators.requirement import requirement_context, requirement_outcome
from millrace.operators.tables import cut, over_distinct, spread

BLOCK = 1000  # searches that are sent to every task at a time, a few MB at most
MOST_TERMS = 50  # different qualifications that all searches together may ask to be read
PHRASES = {  # the lists of a search, the text that they are looked for in, and whether in any form
    "titles": ("searchable", True), "related_titles": ("searchable", True), "responsibilities": ("searchable", True),
    "required_keywords": ("searchable", True), "required_skills": ("searchable", True), "required_credentials": ("searchable", True),
    "barred": ("searchable", True), "title_excludes": ("title", True), "company_excludes": ("company", False), "locations": ("place", False),
}
VALUES = ["seniority_excludes", "workplace_types", "countries", "employment_types"]
_FOUND = [f"found_{t}" for t in sorted({t for t, _ in PHRASES.values()})]
_STRINGS = "array<string>"
SCHEMA = ", ".join(
    ["name string", "title_match string", "policy string", "needs_sponsorship boolean", "salary_min double", "salary_period string", "max_age_days int", "requirements map<string,string>"]
    + [f"{c} {_STRINGS}" for c in (*PHRASES, *VALUES)]
)


def searches_table(spark: SparkSession, rules: list[Rules]) -> DataFrame:
    """Searches as rows of ``SCHEMA``; tables of searches may also come from elsewhere."""
    rows = []
    for r in rules:
        own = asdict(r) | {"barred": r.barred, "requirements": r.barred_requirements, "salary_min": None if r.salary_min is None else float(r.salary_min)}
        rows.append({c.split()[0]: own[c.split()[0]] for c in SCHEMA.split(", ")})
    return spark.createDataFrame(rows, SCHEMA)


def first_words(phrase: str, inflect: bool) -> list[str]:
    """What the first word of a text can be where the phrase begins, in lower case.

    A phrase without letters and digits has none and is never found.
    """
    words = phrase.split()
    runs = re.findall(r"\w+", words[0]) if words else []
    if not runs and words:
        return first_words(" ".join(words[1:]), inflect)
    if not runs:
        return []
    whole = inflect and len(words) == 1 and runs[0] == words[0]
    if not whole:
        return [runs[0].lower()]
    if len(words[0]) < LONG_WORD:
        return [words[0].lower(), words[0].lower() + "s"]
    stem = inflections(words[0]).removesuffix("(?:s|es|ed|ing)?").replace("\\", "")
    return [stem, *[stem + e for e in ENDINGS]]


def phrase_index(searches: DataFrame) -> DataFrame:
    """(target, word, phrase, pattern): the different phrases of all searches under each of their first words."""
    wanted = [
        searches.select(F.lit(target).alias("target"), F.lit(inflect).alias("inflect"), F.explode(F.array_distinct(field)).alias("phrase"))
        for field, (target, inflect) in PHRASES.items()
    ]
    every = wanted[0]
    for w in wanted[1:]:
        every = every.unionByName(w)

    @F.udf("struct<pattern:string,words:array<string>>", useArrow=True)
    def compiled(phrase, inflect):  # once for each different phrase of the searches, not for texts
        return pattern(phrase, inflect), first_words(phrase, inflect)

    out = every.distinct().filter(F.trim("phrase") != "").withColumn("c", compiled("phrase", "inflect"))
    return out.select("target", "phrase", "c.pattern", F.explode(F.array_distinct("c.words")).alias("word"))


def found_phrases(postings: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, found_<target>...): the phrases of the index that each posting's texts hold.

    Words and phrases meet by equality on (target, word). A word that every text has and many phrases
    begin with is split by Spark where its join partition grows; what a text is searched for is at most
    the index. Texts come by ``title``, ``company``, ``place`` and ``searchable``.
    """
    targets = sorted({t for t, _ in PHRASES.values()})
    words = [
        postings.select(F.col(key), F.lit(t).alias("target"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word")) for t in targets
    ]
    rows = words[0]
    for w in words[1:]:
        rows = rows.unionByName(w)
    proposed = rows.join(index, ["target", "word"]).groupBy(key)
    proposed = proposed.agg(*[F.collect_set(F.when(F.col("target") == t, F.struct("phrase", "pattern"))).alias(f"_maybe_{t}") for t in targets])
    both = postings.select(key, *targets).join(proposed, key, "left")

    def confirmed(t: str) -> Column:
        maybe = F.coalesce(F.col(f"_maybe_{t}"), F.array().cast("array<struct<phrase:string,pattern:string>>"))
        return F.transform(F.filter(maybe, lambda p: F.rlike(F.col(t), p["pattern"])), lambda p: p["phrase"]).alias(f"found_{t}")

    return both.select(key, *[confirmed(t) for t in targets])


def _decision(today: date, s: Column) -> Column:
    """Whether search ``s`` rejects the posting, over its columns and the phrases found."""
    strict = s["policy"] == STRICT
    blank = F.coalesce(F.trim("searchable"), F.lit("")) == ""
    place, none = F.col("location"), F.lit(False)

    def hits(*lists: Column, target: str) -> Column:
        every = lists[0] if len(lists) == 1 else F.concat(*lists)
        return F.arrays_overlap(every, F.col(f"found_{target}"))

    def judged(when: Column, unknown: Column, passes: Column, policy: Column = strict) -> Column:
        """True where a gate that a search asks for rejects."""
        return when & F.when(unknown, policy).otherwise(~F.coalesce(passes, none))

    def asked(name: str) -> Column:
        return F.size(s[name]) > 0

    remote = (F.col("workplace") == "remote") & F.array_contains(s["workplace_types"], "remote")
    floor = F.coalesce(s["salary_min"], F.lit(0.0))
    for period, times in V.PERIODS_A_YEAR.items():
        floor = F.when(s["salary_period"] == period, F.coalesce(s["salary_min"], F.lit(0.0)) * times).otherwise(floor)
    wanted = [s["titles"], s["related_titles"], s["responsibilities"]]
    rejects = [
        asked("title_excludes") & hits(s["title_excludes"], target="title"),
        judged(asked("seniority_excludes"), F.size("_levels") == 0, ~F.arrays_overlap(s["seniority_excludes"], F.col("_levels"))),
        judged(asked("workplace_types"), F.col("workplace") == "unknown", F.array_contains(s["workplace_types"], F.col("workplace"))),
        judged(asked("countries"), place["country"].isNull(), F.array_contains(s["countries"], F.coalesce(place["country"], F.lit("")))),
        judged(asked("locations") & ~remote, F.trim("place") == "", hits(s["locations"], target="place")),
        asked("company_excludes") & hits(s["company_excludes"], target="company"),
        judged((s["title_match"] == "hard") & (F.size(F.concat(*wanted)) > 0), blank, hits(*wanted, target="searchable")),
        *[judged(asked(c), blank, hits(s[c], target="searchable"), none) for c in ("required_keywords", "required_skills", "required_credentials")],
        judged(asked("barred"), blank, ~hits(s["barred"], target="searchable")),
        judged(s["needs_sponsorship"], ~F.col("_refuses") & ~F.col("_offers"), ~F.col("_refuses")),
        judged(asked("employment_types"), F.col("_employment").isNull(), F.array_contains(s["employment_types"], F.coalesce("_employment", F.lit("")))),
        judged(F.coalesce(s["salary_min"], F.lit(0.0)) != 0, F.col("salary_min").isNull(), F.col("_yearly") >= floor),
        judged(s["max_age_days"].isNotNull(), F.col("posted_at").isNull(), F.datediff(F.lit(today), F.col("posted_at")) <= s["max_age_days"]),
    ]

    def demanded(e: Column) -> Column:
        context = F.element_at(F.col("_contexts"), e["key"])
        by = F.when(e["value"] == "mentioned", requirement_outcome(context, "mentioned")).when(e["value"] == "preferred_or_required", requirement_outcome(context, "preferred_or_required"))
        outcome = F.when(blank, UNKNOWN).otherwise(by.otherwise(requirement_outcome(context)))
        return F.when(outcome == UNKNOWN, strict).otherwise(outcome == "fail")

    bad = F.exists(F.map_entries(s["requirements"]), demanded)
    for r in rejects:
        bad = bad | F.coalesce(r, none)
    return F.when(bad, "rejected").otherwise("match")


def _read(postings: DataFrame, searches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(postings with all that searches ask of them, searches without nulls); the postings' part is written.

    Postings with the same texts are read for phrases once.
    """
    terms = searches.select(F.explode(F.map_keys("requirements")).alias("t")).distinct().limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} different qualifications to read")
    empty = F.array().cast(_STRINGS)
    lists = {c: F.coalesce(c, empty).alias(c) for c in (*PHRASES, *VALUES)}
    plain = {
        "requirements": F.coalesce("requirements", F.create_map().cast("map<string,string>")),
        "needs_sponsorship": F.coalesce("needs_sponsorship", F.lit(False)),
        "policy": F.coalesce("policy", F.lit("flag")),
    }
    searches = searches.select(*[lists.get(c, plain.get(c, F.col(c)).alias(c)) for c in searches.columns])
    loc, index = F.col("location"), cut(phrase_index(searches), "phrases")
    asked = postings.withColumns(
        {
            "place": F.concat_ws(" ", loc["raw"], loc["city"], loc["region"]),
            "_employment": N.employment_label(F.col("employment_type")),
            "_yearly": N.annualized(F.col("salary_min"), F.col("salary_period")),
        }
    )

    def texts(values: DataFrame) -> DataFrame:
        values = cut(spread(values, "_digest"), "texts")
        told = {
            "_levels": N.seniority_levels(F.col("title")),
            "_refuses": F.coalesce(first_phrase(F.col("searchable"), V.SPONSORSHIP_REFUSALS).isNotNull(), F.lit(False)),
            "_offers": F.coalesce(first_phrase(F.col("searchable"), V.SPONSORSHIP_OFFERS).isNotNull(), F.lit(False)),
        }
        return values.withColumns(told).join(found_phrases(values, index, "_digest"), "_digest")

    asked = over_distinct(asked, sorted({t for t, _ in PHRASES.values()}), texts, "found")
    contexts = []
    for n, (term,) in enumerate(terms):
        read = requirement_context(postings, key, "searchable", term).select(key, F.col("context").alias(f"_context{n}"))
        asked = asked.join(read, key)
        contexts += [F.lit(term), F.col(f"_context{n}")]
    asked = asked.withColumn("_contexts", F.create_map(*contexts) if contexts else F.create_map().cast("map<string,string>"))
    needed = [key, "workplace", "location", "place", "salary_min", "posted_at", "searchable", "_levels", "_employment", "_yearly", "_refuses", "_offers", "_contexts"]
    return cut(asked.select(*needed, *_FOUND), "asked"), searches


def judge_all(postings: DataFrame, searches: DataFrame, today: date, key: str = "ingest_seq") -> DataFrame:
    """(key, search, decision) for every normalised posting and every search of a table of ``SCHEMA``.

    The decisions are those of ``gates.evaluate_all``; null lists are empty ones. Postings are read once
    and numbered by ``key``, which must tell them apart. All searches are asked of all postings, in
    blocks of ``BLOCK`` that go to every task (the searches are the stated queries of this operator).
    Where only counts are wanted, ``count_all`` has them without these pairs.
    """
    asked, searches = _read(postings, searches, key)
    return _judged(asked, searches, today, key, "name").select(key, F.col("name").alias("search"), "decision")


def _judged(asked: DataFrame, searches: DataFrame, today: date, key: str, name: str) -> DataFrame:
    verdicts = F.transform("_searches", lambda s: F.struct(s[name].alias(name), _decision(today, s).alias("decision")))
    return asked.crossJoin(F.broadcast(_blocks(searches, name))).select(key, F.explode(verdicts).alias("v")).select(key, f"v.{name}", "v.decision")


_ANY_PAY = 2**31 - 1  # the rank of postings whose pay no floor turns away


def count_all(postings: DataFrame, searches: DataFrame, today: date, key: str = "ingest_seq") -> DataFrame:
    """(search, decision, n, first): how many postings each search takes and turns away, and the smallest ``key`` of them.

    The same as counting ``judge_all``, exactly, without its pairs: searches that differ in name and floor only
    are one kind, postings that no search tells apart but by pay are one profile, and kinds judge profiles. Of the
    profiles that a kind takes, running sums over the pay, in ranks among the different floors, say how many
    reach each floor. The different floors and ages go to the tasks as arrays.
    """
    asked, searches = _read(postings, searches, key)
    floor = F.when(F.col("salary_min") != 0, N.annualized(F.col("salary_min"), F.col("salary_period")))
    searches = searches.withColumn("_floor", floor)
    floors = np.sort(np.array([r[0] for r in searches.select("_floor").distinct().filter("_floor IS NOT NULL").collect()], dtype="float64"))
    ages = np.array(sorted(r[0] for r in searches.select("max_age_days").distinct().filter("max_age_days IS NOT NULL").collect()), dtype="int64")

    @F.pandas_udf("int")
    def rank(yearly: pd.Series) -> pd.Series:  # how many floors a pay reaches
        return pd.Series(np.searchsorted(floors, yearly.to_numpy("float64"), "right").astype("int32"))

    @F.pandas_udf("int")
    def bound(age: pd.Series) -> pd.Series:  # how many limits an age is beyond
        return pd.Series(np.searchsorted(ages, age.to_numpy("float64"), "left").astype("int32"))

    judged_by = [c for c in searches.columns if c not in ("name", "salary_min", "salary_period", "_floor")]
    own = F.struct(*judged_by, F.col("_floor").isNotNull().alias("paid"))
    searches = searches.withColumn("_kind", F.md5(F.to_json(own, {"ignoreNullFields": "false"}))).withColumn("_rank", F.coalesce(rank("_floor"), F.lit(0)))
    searches = cut(searches.withColumn("_rank", F.when(F.col("_floor").isNull(), 0).otherwise(F.col("_rank"))), "searches")
    # a kind's floor is any pay, so that it decides on postings without pay only
    kinds = searches.dropDuplicates(["_kind"]).withColumn("salary_min", F.when(F.col("_floor").isNotNull(), 1.0)).withColumn("salary_period", F.lit("year")).drop("name", "_floor", "_rank")

    uses = ["seniority_excludes", "workplace_types", "countries", "employment_types"]
    flags = searches.agg(*[F.coalesce(F.bool_or(F.size(c) > 0), F.lit(False)).alias(c) for c in uses], F.coalesce(F.bool_or("needs_sponsorship"), F.lit(False)).alias("visa")).first()

    def if_asked(flag: str, c: Column, otherwise: Column) -> Column:
        return c if flags[flag] else otherwise

    none, no = F.lit(None).cast("string"), F.lit(False)
    blank = F.coalesce(F.trim("searchable"), F.lit("")) == ""
    limits = F.array(*[F.lit(int(a)) for a in ages]) if len(ages) else F.array().cast("array<int>")
    age = F.datediff(F.lit(today), F.col("posted_at"))
    known = F.get(limits, bound(age)) if len(ages) else F.lit(0)
    beyond = int(ages[-1]) + 1 if len(ages) else 0
    profile = {
        "workplace": if_asked("workplace_types", F.col("workplace"), none),
        "country": if_asked("countries", F.col("location.country"), none),
        "place": F.when(F.trim("place") != "", "some").otherwise(""),
        "searchable": F.when(~blank, "some").otherwise(""),
        "age": F.when(F.col("posted_at").isNotNull(), F.coalesce(known, F.lit(beyond))) if len(ages) else F.lit(0),
        "paid": F.col("salary_min").isNotNull(),
        "_levels": if_asked("seniority_excludes", F.col("_levels"), F.array().cast(_STRINGS)),
        "_employment": if_asked("employment_types", F.col("_employment"), none),
        "_refuses": if_asked("visa", F.col("_refuses"), no),
        "_offers": if_asked("visa", F.col("_offers"), no),
        "contexts": F.array_sort(F.map_entries("_contexts")),
        **{c: F.array_sort(c) for c in _FOUND},
    }
    pay = F.when(F.col("_yearly").isNull(), _ANY_PAY).otherwise(rank("_yearly"))
    rows = asked.select(key, pay.alias("pay"), F.struct(*[c.alias(n) for n, c in profile.items()]).alias("p"))
    rows = rows.withColumn("_profile", F.md5(F.to_json("p", {"ignoreNullFields": "false"})))
    counts = cut(rows.groupBy("_profile", "pay").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.first("p").alias("p")), "counts")
    profiles = counts.groupBy("_profile").agg(F.first("p").alias("p"), F.sum("n").alias("n"), F.min("first").alias("first"))
    told = profiles.select("_profile", "p.*").withColumns(
        {
            "location": F.struct("country"),
            "posted_at": F.date_sub(F.lit(today), F.col("age")),
            "salary_min": F.when(F.col("paid"), 2.0),
            "_yearly": F.when(F.col("paid"), 2.0),
            "_contexts": F.map_from_entries("contexts"),
        }
    )
    pairs = cut(_judged(spread(told, "_profile"), kinds, today, "_profile", "_kind"), "pairs")
    totals = profiles.select("_profile", "n", "first")
    refused = pairs.filter("decision = 'rejected'").join(totals, "_profile").groupBy("_kind").agg(F.sum("n").alias("_n_refused"), F.min("first").alias("_refused"))
    taken = pairs.filter("decision = 'match'").join(counts.select("_profile", "pay", "n", "first"), "_profile")
    taken = taken.groupBy("_kind", "pay").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    wanted = searches.select("_kind", F.col("_rank").alias("pay")).distinct()
    # at one rank postings come before the floor that they reach
    line = taken.withColumn("floor", F.lit(False)).unionByName(wanted.withColumn("floor", F.lit(True)), allowMissingColumns=True)
    above = Window.partitionBy("_kind").orderBy(F.desc("pay"), "floor").rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("_kind").orderBy("pay", F.desc("floor")).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"_n": F.sum("n").over(above), "_first": F.min("first").over(above), "_n_under": F.sum("n").over(below), "_under": F.min("first").over(below)})
    found = line.filter("floor").join(refused, "_kind", "left")
    zero = F.lit(0)
    match = F.struct(F.lit("match").alias("decision"), F.coalesce("_n", zero).alias("n"), F.col("_first").alias("first"))
    rejected = F.struct(
        F.lit("rejected").alias("decision"), (F.coalesce("_n_under", zero) + F.coalesce("_n_refused", zero)).alias("n"), F.least("_under", "_refused").alias("first")
    )
    found = found.select("_kind", F.col("pay").alias("_rank"), F.explode(F.array(match, rejected)).alias("v"))
    named = searches.select(F.col("name").alias("search"), "_kind", "_rank").join(found, ["_kind", "_rank"]).select("search", "v.*").filter("n > 0")
    return named.groupBy("search", "decision").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _blocks(searches: DataFrame, name: str = "name") -> DataFrame:
    """One row for each block of about ``BLOCK`` searches."""
    n = max(1, -(-searches.count() // BLOCK))
    return searches.groupBy(F.pmod(F.xxhash64(name), F.lit(n)).alias("_block")).agg(F.collect_list(F.struct(*searches.columns)).alias("_searches")).select("_searches")
