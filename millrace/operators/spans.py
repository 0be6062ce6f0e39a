"""Where patterns match in texts, as rows: a span table, for joins of what stands near to what.

Matches of all patterns leave a text in one projection, as gaps and lengths; rows and a running sum turn
them into positions. Work and memory are in proportion to text and matches, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 80
MARK = "\uffff"  # no character; texts that hold it are searched twice


def _hit(piece: Column, hit: Column, quoted: bool) -> Column:
    before = F.right(piece, F.lit(CONTEXT)) if quoted else F.lit("")
    return F.struct(F.length(piece).alias("gap"), before.alias("before"), hit.alias("hit"))


def occurrences(text: Column, patterns: list[tuple[str, str]], quoted: set[str] | None = None) -> Column:
    """array<struct<kind, pattern, hits: array<struct<gap, before, hit>>>> of the patterns that match, which must not be empty.

    ``gap`` counts code points since the match before, ``before`` is their end (at most ``CONTEXT`` of them),
    empty for kinds that are not ``quoted`` (None: all are).
    """

    def by_mark(regex: str, own: bool) -> Column:
        # one search: matches stand between marks, so that every second piece is one
        pieces = F.split(F.regexp_replace(text, F.lit(regex), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        # as a lambda over one array, so that pieces are cut once and not for each match
        return F.get(F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda k: _hit(F.get(p, k - 1), F.get(p, k), own))), F.lit(0))

    def by_two(regex: str, own: bool) -> Column:
        both = F.arrays_zip(F.split(text, regex, -1).alias("piece"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"))
        return F.transform(F.filter(both, lambda x: x["hit"].isNotNull()), lambda x: _hit(x["piece"], x["hit"], own))

    def of(n: int, kind: str, regex: str) -> Column:
        own = quoted is None or kind in quoted
        hits = F.when(text.contains(MARK), by_two(regex, own)).otherwise(by_mark(regex, own))
        return F.when(text.rlike(regex), F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("pattern"), hits.alias("hits")))

    return F.filter(F.array(*[of(n, kind, regex) for n, (kind, regex) in enumerate(patterns)]), lambda x: x.isNotNull())


def span_table(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]], quoted: set[str] | None = None) -> DataFrame:
    """(key, kind, start, end, hit, before): a row for every match, in code points, end exclusive.

    A kind may have several patterns. ``key`` tells the texts apart; rows stay where their text is, so that
    over texts dealt by ``key`` neither this nor windows over a text shuffle rows, which take more room
    than texts. Null texts have no rows. The table holds no texts.
    """
    found = texts.select(key, F.explode(occurrences(F.col(text), patterns, quoted)).alias("_f"))
    rows = found.select(key, "_f.kind", "_f.pattern", F.posexplode("_f.hits").alias("_place", "_h"))
    rows = rows.select(key, "kind", "pattern", "_place", "_h.*")
    so_far = Window.partitionBy(key, "pattern").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    # a text's first match stands at the beginning of a line if nothing stands before it
    before = F.when(F.col("_place") == 0, F.concat(F.lit("\n"), F.col("before"))).otherwise(F.col("before"))
    return rows.select(key, "kind", "start", "end", "hit", before.alias("before"))


def gap_between(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Code points between two spans; 0 where they meet or overlap."""
    return F.greatest(F.lit(0), other_start - end, start - other_end)
