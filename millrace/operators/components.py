"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.tables import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    In a round every node turns to the smallest of itself and its neighbours, and from there twice
    further; then the links are drawn between what their ends turned to, and those within one node go.
    Links, and with them the nodes of the next round, become fewer from round to round, along chains too,
    so that a long chain takes as many rounds as its logarithm. The written turns of all rounds, one
    after the other, lead a node to its component. Nulls and links of a node to itself name no node. A
    node with many links is a hot key of one aggregation with partial sums and of joins that adaptive
    execution splits; only whether links are left reaches the driver.
    """
    a, b = F.col("a"), F.col("b")
    known = links.select("a", "b").filter(a.isNotNull() & b.isNotNull() & (a != b))
    nodes = cut(known.select("a").unionByName(known.select(b.alias("a"))).distinct(), "nodes")
    left = cut(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    turns: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(b.alias("a"), a.alias("b")))
        turn = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "turns")
        for _ in range(2):
            turn = _through(turn, "to", turn)
        turn = cut(turn, "turns")
        turns.append(turn)
        moved = _through(_through(left, "a", turn), "b", turn).filter(a != b)
        left = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = nodes.select(F.col("a").alias("node"), F.col("a").alias("component"))
    for turn in turns:
        found = _through(found, "component", turn)
    return found


def _through(df: DataFrame, column: str, turn: DataFrame) -> DataFrame:
    """``df`` with a column's values replaced by what they turn to; those that do not turn stay."""
    t = turn.select(F.col("a").alias("_from"), F.col("to").alias("_to"))
    moved = df.join(t, df[column] == t["_from"], "left")
    return moved.select(*[F.coalesce("_to", column).alias(c) if c == column else c for c in df.columns])
