"""Reading landed payloads item by item: a wrong item costs itself only and says where it is wrong.

A payload is parsed once as a variant; its list is unpacked into one variant for each item, and every field
of an item is read with its type by itself. An item of which a field has another kind of value goes to
the quarantine with the path of that field; all others go on to the readers of ``boards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.tables import cut
from millrace.sources.boards import SCHEMAS

# Where each kind of payload has its list of items: the fields on the way to it.
LISTS = {"greenhouse": ["jobs"], "ashby": ["jobs"], "workday_list": ["jobPostings"], "lever": [], "usajobs": ["SearchResult", "SearchResultItems"]}


def landed_texts(spark: SparkSession, path: str) -> DataFrame:
    """(board, payload): whole files, with the board's token from the name ``token.json``."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("board"), F.col("value").alias("payload"))


def _item_fields(kind: str) -> list[T.StructField]:
    inside = T.StructType.fromDDL(SCHEMAS[kind])
    for name in LISTS[kind]:
        inside = inside[name].dataType
        inside = inside.elementType if isinstance(inside, T.ArrayType) else inside
    return [f for f in inside.fields if f.name != "_corrupt_record"]


def _kind_of(kind: T.DataType) -> str:
    return "a list" if isinstance(kind, T.ArrayType) else "an object" if isinstance(kind, T.StructType) else f"a {kind.simpleString()}"


def _problem(path: Column, field: T.StructField) -> Column:
    """A struct<path, problem> if the item has a value for the field that is of another kind, else null."""
    raw = F.try_variant_get("item", f"$.{field.name}", "variant")
    typed = F.try_variant_get("item", f"$.{field.name}", field.dataType.simpleString())
    wrong = raw.isNotNull() & ~F.is_variant_null(raw) & typed.isNull()
    return F.when(wrong, F.struct(F.concat(path, F.lit(f".{field.name}")).alias("path"), F.lit(f"not {_kind_of(field.dataType)}").alias("problem")))


def read_items(payloads: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(payloads of one good item each, in the shape that the reader of ``kind`` takes; quarantine).

    ``payloads`` has board and payload (JSON text). The quarantine has board, path, problem and item (the
    JSON of the item, or of the payload). Payloads that are no JSON or have no list in its place are one
    row each; a missing or null list is an empty one. Absent and null fields are null, unknown fields are
    ignored; numbers are read as text where text is due. A value deeper inside a field that does not fit is
    null and costs no item. Null payloads have no row anywhere.
    """
    path = "$" + "".join(f".{name}" for name in LISTS[kind])
    parsed = payloads.filter(F.col("payload").isNotNull()).select("board", "payload", F.try_parse_json("payload").alias("v"))
    there = F.try_variant_get("v", path, "variant")
    parsed = parsed.withColumn("items", F.try_variant_get("v", path, "array<variant>"))
    lost = F.when(F.col("v").isNull(), F.struct(F.lit("$").alias("path"), F.lit("not JSON").alias("problem")))
    lost = lost.when(F.col("items").isNull() & there.isNotNull() & ~F.is_variant_null(there), F.struct(F.lit(path).alias("path"), F.lit("not a list").alias("problem")))
    items = parsed.select("board", F.posexplode("items").alias("at", "item"))
    at = F.concat(F.lit(f"{path}["), F.col("at").cast("string"), F.lit("]"))
    fields = _item_fields(kind)
    is_object = F.try_variant_get("item", "$", "map<string,variant>").isNotNull()
    first = F.coalesce(
        F.when(F.coalesce(~is_object, F.lit(True)), F.struct(at.alias("path"), F.lit("not an object").alias("problem"))),
        *[_problem(at, f) for f in fields],
    )
    typed = F.struct(*[F.try_variant_get("item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields])
    judged = cut(items.select("board", first.alias("first"), typed.alias("j"), F.to_json("item").alias("text")), "items")
    good = judged.filter(F.col("first").isNull())
    if kind == "lever":
        out = good.select("board", "j.*")
    else:
        shaped = F.array("j")
        for name in LISTS[kind][:0:-1]:
            shaped = F.struct(shaped.alias(name))
        out = good.select("board", shaped.alias(LISTS[kind][0]))
    bad = judged.filter(F.col("first").isNotNull()).select("board", "first.path", "first.problem", F.col("text").alias("item"))
    whole = parsed.select("board", lost.alias("lost"), F.col("payload").alias("item")).filter(F.col("lost").isNotNull())
    return out, bad.unionByName(whole.select("board", "lost.path", "lost.problem", "item"))
