"""Documents of unknown shape: JSON text as VARIANT, its leaves in long form, and what kinds of fields they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import to_double


def parse_documents(df: DataFrame, text: str, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """df with the VARIANT column doc, and the rows whose text isn't a JSON object (broken, another value, or with a repeated key)."""
    t = df.withColumn(doc, F.try_parse_json(text))
    ok = F.coalesce(_is("OBJECT", F.col(doc)), F.lit(False))
    return t.filter(ok), t.filter(~ok).drop(doc)


def _is(kind: str, v: Column) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _depth(v: Column) -> Column:
    """Levels of nesting that a document's type shows, or more (arrays count as levels, too)."""
    names = F.regexp_replace(F.schema_of_variant(v), "`[^`]*`", "")
    signs = F.split(F.regexp_replace(names, "[^<>]", ""), "")
    level = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, sign: Column) -> Column:
        now = s["now"] + F.when(sign == "<", 1).when(sign == ">", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(signs, level, step, lambda s: s["most"])


def document_schema(df: DataFrame, doc: str = "doc") -> DataFrame:
    """One row: schema, the union of all documents' types; what differs between documents is a VARIANT there."""
    return df.agg(F.schema_of_variant_agg(doc).alias("schema"))


def flatten_documents(
    df: DataFrame, doc: str = "doc", keep: Sequence[str] = (), groups: Sequence[str] | None = None, ignore: Sequence[str] = (), depth: int | None = None
) -> DataFrame:
    """P7 without a schema. One row per document and leaf: the kept columns, field (dotted path), kind ('num', 'cat', 'list', null for JSON's
    null), num_value (what the leaf is as a number, true being 1), cat_value (a text, number or truth value as text), list_value (items as
    text). Lists are leaves, objects are opened, empty ones have none. `groups` names the top-level keys to read, `ignore` the last keys
    of leaves to leave out. Without a depth, one aggregate over the documents finds how deep they go."""
    spark = df.sparkSession
    if depth is None:
        depth = df.agg(F.max(_depth(F.col(doc)))).first()[0] or 0
    t = df.select(*keep, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("_last"), F.col(doc).alias("_own"))
    for level in range(depth):
        own = F.col("_own").outer()
        t = t.lateralJoin(spark.tvf.variant_explode_outer(F.when(_is("OBJECT", own), own)).alias("_in"))
        opened = F.coalesce(_is("OBJECT", F.col("_own")), F.lit(False))
        t = t.filter(~opened | F.col("key").isNotNull())
        if level == 0 and groups is not None:
            t = t.filter(F.col("key").isin(*groups))
        t = t.select(
            *keep, F.when(opened, F.concat_ws(".", "field", "key")).otherwise(F.col("field")).alias("field"),
            F.when(opened, F.col("key")).otherwise(F.col("_last")).alias("_last"), F.when(opened, F.col("value")).otherwise(F.col("_own")).alias("_own"),
        )
    t = t.filter(F.col("field").isNotNull() & ~_is("OBJECT", F.col("_own")))
    if ignore:
        t = t.filter(~F.col("_last").isin(*ignore))
    own, shape = F.col("_own"), F.schema_of_variant("_own")
    is_list, known = shape.startswith("ARRAY"), shape != "VOID"
    is_num = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    text = F.try_variant_get(own, "$", "string")
    number = F.when(shape == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(to_double(text))
    return t.select(
        *keep, "field", F.when(is_list, "list").when(is_num, "num").when(known, "cat").alias("kind"), F.when(~is_list, number).alias("num_value"),
        F.when(~is_list & known, text).alias("cat_value"), F.when(is_list, F.try_variant_get(own, "$", "array<string>")).alias("list_value"),
    )


def document_kinds(flat: DataFrame, share: float = 0.95) -> DataFrame:
    """A22 on leaves from flatten_documents: field, kind, n (documents with the field), known (those where it isn't null). A field with any list
    is categorical_multilabel; one that is an object in other documents is mixed_skip; numeric_scalar if at least `share` of the known values
    are numbers, else categorical_scalar; all_missing without known values. A field need not be in all documents."""
    has = flat.groupBy("field").agg(
        F.count("*").alias("n"), F.count("kind").alias("known"), F.count("num_value").alias("numbers"), F.max(F.coalesce(F.col("kind") == "list", F.lit(False))).alias("lists")
    )
    # a path that goes on below a field says that the field is an object there; one row a field from here on
    parts = F.split("field", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    objects = has.select(F.explode(F.when(F.size(parts) > 1, above)).alias("field")).distinct().withColumn("object", F.lit(True))
    t = has.join(objects, "field", "left")
    kind = (
        F.when(F.col("lists"), "categorical_multilabel")
        .when(F.col("object"), "mixed_skip")
        .when(F.col("known") == 0, "all_missing")
        .when(F.col("numbers") >= share * F.col("known"), "numeric_scalar")
        .otherwise("categorical_scalar")
    )
    return t.select("field", kind.alias("kind"), "n", "known")


def document_numbers(flat: DataFrame, kinds: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, field, x) of the numeric fields, for the operators on long numbers. Documents without a field have no row."""
    return flat.join(kinds.filter("kind = 'numeric_scalar'").select("field"), "field", "left_semi").select(dataset, "field", F.col("num_value").alias("x"))


def document_counts(flat: DataFrame, kinds: DataFrame, totals: Mapping[str, int], dataset: str = "dataset") -> DataFrame:
    """A6 on leaves: (dataset, field, value, n) of the categorical fields; list values count once per document, an empty list as __EMPTY__, a
    null or a document without the field as __MISSING__. totals has the number of documents of each dataset."""
    t = flat.join(kinds.filter("kind like 'categorical%'").select("field"), "field", "left_semi")
    values = F.when(F.size("list_value") == 0, F.array(F.lit("__EMPTY__"))).when(F.col("kind") == "list", F.array_distinct("list_value")).otherwise(F.array("cat_value"))
    seen = t.filter("kind is not null").select(dataset, "field", F.explode(values).alias("value")).filter("value is not null")
    counts = seen.groupBy(dataset, "field", "value").agg(F.count("*").alias("n"))
    has = t.groupBy("field", dataset).agg(F.count("kind").alias("here"))  # a row for each field and dataset
    sizes = F.array(*[F.struct(F.lit(d).alias(dataset), F.lit(int(n)).cast("long").alias("total")) for d, n in totals.items()])
    every = has.select("field").distinct().select("field", F.inline(sizes))
    gone = every.join(has, ["field", dataset], "left").select(dataset, "field", F.lit("__MISSING__").alias("value"), (F.col("total") - F.coalesce("here", F.lit(0))).alias("n"))
    return counts.unionByName(gone.filter("n > 0"))
