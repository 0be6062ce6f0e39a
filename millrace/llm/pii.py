"""Personal data: generated candidates, boosted trees over format and context, calibrated thresholds.

DataFrame functions only. Generators with high recall propose spans, which may overlap: the base patterns
of each kind, and looser ones (signs spelled out, blanks and other separators, numbers without a plus).
All hits of a text come out of one projection with a little context; rows and running sums turn them into
positions. Spans that a base pattern finds and its rule confirms always count. They also teach: a span's
features fall into few bins, Spark counts confirmed and other candidates for every combination of
bins, and trees are boosted over these counts. A kind's threshold is the lowest score at which confirmed
spans still make up a set share of held-out candidates; looser candidates above it are added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out

# The kinds in their order and the patterns that define them (possessive, guarded forms that
# match alike and in one pass over a text, whatever it holds).
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
HOST = "A-Za-z0-9-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # chains of 13 to 19 digits with single separators, from their first digit to their last
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Looser generators: signs spelled out or spaced, other separators, numbers without a plus.
LOOSE = {
    "email": rf"(?i)(?<![{LOCAL}])[{LOCAL}]++\x20?(?:@|[\[(]\x20?at\x20?[\])])\x20?[{HOST}]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[{HOST}]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:00)?[0-9]{1,3}[\x20./-]{1,2}(?=[0-9(]))?+\(?[0-9]{2,4}+\)?(?:[\x20./()-]{1,3}[0-9]{2,5}+){1,5}+(?![0-9])",
}
GENERATORS = [(kind, which, p) for which, patterns in (("base", BASE), ("loose", LOOSE)) for kind, p in patterns.items()]
CUES = {
    "email": r"mail|write|schreib|escrib|\bto\b|contact|kontakt|contacto",
    "ip": r"\bip\b|host|server|address|adresse|node|login|router",
    "card": r"card|karte|carte|tarjeta|visa|credit|master|amex|konto|account|paid|pay",
    "phone": r"phone|tel|call|fax|mobil|ruf|appel|llam|sms|number|nummer",
}
CONTEXT = 32  # characters before and after a span that are looked at

FEATURES = {"kind": 4, "digits": 21, "groups": 8, "before": 4, "after": 4, "cue": 3, "check": 2}  # and their bins
TREES, DEPTH, RATE, L2 = 24, 3, 0.3, 1.0
PRECISION, SUPPORT = 0.95, 30


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one doubled, its digits added."""

    def weighed(d, i):
        doubled = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), ""), weighed)
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def rule(kind: Column, hit: Column) -> Column:
    """What a kind asks of a span besides its pattern; of looser spans the same after their signs are undone."""
    n = F.length(_digits(hit))
    plain = F.regexp_replace(hit, r"[\x20\[\]()]", "")
    return (
        F.when(kind == "email", F.regexp_replace(F.lower(plain), "dot", ".").rlike(r"\.[a-z]{2,}$"))
        .when(kind == "ip", plain.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"))
        .when(kind == "card", n.between(*CARD_DIGITS) & luhn(_digits(hit)))
        .otherwise(n.between(*PHONE_DIGITS))
    )


def _hits(text: Column) -> Column:
    """array<struct<generator, hits: array<struct<gap, hit, before, after>>>> of a text, with the generators that hit.

    ``gap`` counts the code points between a hit and the one before. Pieces between hits are cut once and
    looked up by place, so that the work is in proportion to the text.
    """

    def of(k: int, regex: str) -> Column:
        pieces, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))

        def row(z: Column, i: Column) -> Column:
            piece = z["piece"]
            return F.struct(F.length(piece).alias("gap"), z["hit"].alias("hit"), F.right(piece, F.lit(CONTEXT)).alias("before"), F.left(z["next"], F.lit(CONTEXT)).alias("after"))

        zipped = F.arrays_zip(pieces.alias("piece"), found.alias("hit"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("next"))
        rows = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), row)
        return F.when(text.rlike(regex), F.struct(F.lit(k).alias("generator"), rows.alias("hits")))

    every = F.array(*[of(k, regex) for k, (_, _, regex) in enumerate(GENERATORS)])
    return F.filter(every, lambda g: g.isNotNull())


def _class(c: Column) -> Column:
    """0: nothing or a blank, 1: a letter or sign beyond ASCII, 2: a digit, 3: another sign."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^[A-Za-z\x{80}-\x{10FFFF}]"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): a number for every row of ``docs``, and the different spans proposed for each row.

    Candidates: row, fold (held out or not), kind, start, end (code points, end exclusive), ``base`` (found by
    the base pattern and confirmed), ``near`` (overlaps a confirmed span of the row) and the features of FEATURES.
    """
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _hits(F.coalesce("text", F.lit(""))).alias("found"))
    found = cut(found, "pii-hits")  # the rows' numbers hold from here on; texts are left behind
    hits = found.select("row", "doc_id", F.explode("found").alias("g")).select("row", "doc_id", "g.generator", F.posexplode("g.hits").alias("place", "h"))
    hits = hits.select("row", "doc_id", "generator", "place", "h.*").withColumn("size", F.length("hit"))
    so_far = Window.partitionBy("row", "generator").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    names = F.array(*[F.lit(kind) for kind, _, _ in GENERATORS])
    hits = hits.withColumn("kind", F.element_at(names, F.col("generator") + 1)).withColumn("check", rule(F.col("kind"), F.col("hit")))
    by_base = F.col("generator") < len(KINDS)
    # an e-mail address needs no more than its pattern
    hits = hits.withColumn("base", by_base & (F.col("check") | (F.col("kind") == "email")))
    cue, other = F.lit(False), F.lit(False)
    before = F.lower("before")
    for kind in KINDS:
        said = before.rlike(CUES[kind])
        cue, other = cue | ((F.col("kind") == kind) & said), other | ((F.col("kind") != kind) & said)
    # hits of one generator do not overlap, so that the context before a hit may be cut short by another hit
    spans = hits.groupBy("row", "doc_id", "kind", "start", "end").agg(
        F.max("base").alias("base"),
        F.max("check").cast("int").alias("check"),
        F.max(F.least(F.length(_digits(F.col("hit"))), F.lit(FEATURES["digits"] - 1))).alias("digits"),
        F.max(F.least(F.regexp_count("hit", F.lit("[0-9]+")), F.lit(FEATURES["groups"] - 1))).alias("groups"),
        F.max(_class(F.right(F.col("before"), F.lit(1)))).alias("before"),
        F.max(_class(F.left(F.col("after"), F.lit(1)))).alias("after"),
        F.max(F.when(cue, 1).when(other, 2).otherwise(0)).alias("cue"),
    )
    # overlapping spans of a row form a cluster: a new one begins where no span before reaches
    earlier = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("fresh", (F.col("start") >= F.coalesce(F.max("end").over(earlier), F.lit(0))).cast("int"))
    spans = spans.withColumn("cluster", F.sum("fresh").over(upto))
    cluster = Window.partitionBy("row", "cluster")
    spans = spans.withColumn("near", F.max("base").over(cluster)).withColumn("fold", held_out(F.col("doc_id")))
    spans = spans.withColumn("kind_no", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1)
    return found.select("row", "doc_id"), cut(spans.drop("fresh", "doc_id"), "pii-spans")


@dataclass
class Model:
    """Boosted trees as nested conditions, and each kind's threshold (infinite: nothing is added)."""

    start: float
    trees: list  # a leaf's value or (feature, last bin that goes left, left, right)
    thresholds: list[float]

    def score(self) -> Column:
        def read(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, last, left, right = tree
            return F.when(_feature(feature) <= last, read(left)).otherwise(read(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + read(tree)
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        def read(tree, at) -> np.ndarray:
            if isinstance(tree, float):
                return np.full(len(at), tree)
            feature, last, left, right = tree
            goes, out = x[at, list(FEATURES).index(feature)] <= last, np.empty(len(at))
            out[goes], out[~goes] = read(left, at[goes]), read(right, at[~goes])
            return out

        return self.start + sum((read(t, np.arange(len(x))) for t in self.trees), np.zeros(len(x)))


def _feature(name: str) -> Column:
    return F.col("kind_no" if name == "kind" else name)


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, list]:
    """Logistic boosting over cells of binned features with their counts of confirmed and other candidates."""
    n, total = yes + no, float(yes.sum() + no.sum())
    if not total or not yes.sum() or not no.sum():
        return (0.0 if not total else 4.0 if yes.sum() else -4.0), []
    start = float(np.log(yes.sum() / no.sum()))
    raw, trees, names = np.full(len(x), start), [], list(FEATURES)

    def grow(at: np.ndarray, depth: int, g: np.ndarray, h: np.ndarray):
        value = float(-RATE * g[at].sum() / (h[at].sum() + L2))
        if not depth:
            return value
        best = (1e-6, None)
        for f, bins in enumerate(FEATURES.values()):
            left = np.stack([np.bincount(x[at, f], w[at], bins).cumsum()[:-1] for w in (g, h)])
            right = np.stack([w[at].sum() for w in (g, h)])[:, None] - left
            whole = g[at].sum() ** 2 / (h[at].sum() + L2)
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - whole
            if gain.max() > best[0]:
                best = (float(gain.max()), (f, int(gain.argmax())))
        if best[1] is None:
            return value
        f, last = best[1]
        goes = x[at, f] <= last
        return (names[f], last, grow(at[goes], depth - 1, g, h), grow(at[~goes], depth - 1, g, h))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(np.arange(len(x)), DEPTH, p * n - yes, p * (1 - p) * n)
        trees.append(tree)
        raw = raw + Model(0.0, [tree], []).scores(x)
    return start, trees


def _threshold(score: np.ndarray, yes: np.ndarray, no: np.ndarray) -> float:
    """The lowest score at which confirmed spans are PRECISION of the candidates from there on, SUPPORT of them at least."""
    order = np.argsort(-score, kind="stable")
    s, y, n = score[order], yes[order].cumsum(), no[order].cumsum()
    last = np.append(s[1:] != s[:-1], True)  # equal scores are taken together
    good = last & (y >= SUPPORT) & (y >= PRECISION * (y + n))
    return float(s[np.flatnonzero(good)[-1]]) if good.any() else float("inf")


def train(spans: DataFrame) -> Model:
    """Trees and thresholds from all candidates.

    Spans that overlap a confirmed one without being it teach nothing. Documents of the fold that is not
    held out teach the trees, the others set thresholds. What reaches the driver is one row for each
    combination of bins that occurs: 4 x 21 x 8 x 4 x 4 x 3 x 2 = 64,512 at most.
    """
    usable = spans.filter(F.col("base") | ~F.col("near"))
    counts = {f"{fold}_{said}": F.count_if((F.col("fold") == (fold == "held")) & (F.col("base") == (said == "yes"))) for fold in ("own", "held") for said in ("yes", "no")}
    cells = usable.groupBy(*[_feature(f) for f in FEATURES]).agg(*[c.alias(k) for k, c in counts.items()]).collect()
    cells.sort(key=lambda r: tuple(r)[: len(FEATURES)])  # sums in one order, so that reruns agree
    x = np.array([tuple(r)[: len(FEATURES)] for r in cells], np.int64).reshape(-1, len(FEATURES))
    own_yes, own_no, held_yes, held_no = (np.array([r[k] for r in cells], float) for k in counts)
    start, trees = boost(x, own_yes, own_no)
    model = Model(start, trees, [])
    score = model.scores(x)
    for k in range(len(KINDS)):
        of = x[:, 0] == k
        model.thresholds.append(_threshold(score[of], held_yes[of], held_no[of]) if trees else float("inf"))
    return model


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): the confirmed and all spans of every row, arrays of (kind_no, start, end) in that order.

    A looser span is added where it overlaps no confirmed one, its score reaches its kind's threshold, and
    it is the best of the spans that it is chained to by overlaps (by score, then length, then kind and place).
    Null and empty texts have none. Repeated rows and ids are rows of their own, each with its spans.
    An empty table gives an empty result. Other columns are ignored. Positions are code points.
    """
    rows, spans = candidates(docs)
    model = train(spans)
    limits = F.create_map(*[F.lit(v) for pair in enumerate(model.thresholds) for v in pair])
    best = Window.partitionBy("row", "cluster").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "kind_no", "start")
    scored = spans.withColumn("score", model.score()).withColumn("place", F.row_number().over(best))
    added = ~F.col("near") & (F.col("place") == 1) & (F.col("score") >= limits[F.col("kind_no")])
    span = F.struct("kind_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    chosen = scored.filter(F.col("base") | added).groupBy("row")
    chosen = chosen.agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<kind_no:int,start:bigint,end:bigint>>")
    out = rows.join(chosen, "row", "left")
    return out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


def op12_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's counts, digest and spans of every document; ``find`` says how odd rows are read. Counts are of base spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
