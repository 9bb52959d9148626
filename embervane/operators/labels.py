"""Typed labels: normalisation of targets, catalogs, and lossless JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType

TARGET_TYPES = ("single_label", "multi_label", "regression")


def label_key(df: DataFrame, column: str, name: str = "label_key") -> DataFrame:
    """Adds the typed key of a label: 1, "1" and true are three classes, and so are 1 and 1.0.

    Variants keep the type of each value, other columns have one. The key is ``<type>:<value as JSON>``; null stays null.
    """
    kind = dict(df.dtypes)[column]
    c = f"`{column}`"
    if kind == "variant":
        # decimals of different scale are one type
        t = f"regexp_replace(lower(schema_of_variant({c})), '^decimal.*', 'decimal')"
        return df.withColumn(name, F.expr(f"if({c} is null or is_variant_null({c}), null, concat({t}, ':', to_json({c})))"))
    value = f"to_json({c})" if kind.startswith(("array", "struct", "map")) else f"cast({c} as string)"
    return df.withColumn(name, F.expr(f"if({c} is null, null, concat('{kind.split('<')[0]}', ':', {value}))"))


def catalog(df: DataFrame, column: str) -> DataFrame:
    """(position, label_key, label_type, display, n): the classes in the order of their keys."""
    from pyspark.sql import Window as W

    keyed = label_key(df, column).where("label_key is not null").groupBy("label_key").agg(F.count(F.lit(1)).alias("n"))
    rows = keyed.select("label_key", F.substring_index("label_key", ":", 1).alias("label_type"), F.regexp_replace(F.expr("substring(label_key, instr(label_key, ':') + 1)"), r'^"(.*)"$', "$1").alias("display"), "n")
    return rows.withColumn("position", F.row_number().over(W.orderBy("label_key")) - 1)  # as many rows as classes


def infer_target_type(df: DataFrame, target: str | list[str], declared: str | None = None) -> str:
    """single_label for scalars, multi_label for arrays of labels or several indicator columns; regression must be declared."""
    if declared is not None and declared not in TARGET_TYPES:
        raise ValueError(f"a target type is one of {TARGET_TYPES}, not {declared!r}")
    fields = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(target, list):
        numeric = all(isinstance(fields[c], (NumericType, BooleanType)) for c in target)
        if not numeric:
            raise ValueError("several target columns must hold numbers or booleans")
        return declared or "multi_label"
    kind = fields[target]
    if declared == "regression" and not isinstance(kind.elementType if isinstance(kind, ArrayType) else kind, NumericType):
        raise ValueError("a regression target must be numeric")
    return declared or ("multi_label" if isinstance(kind, ArrayType) else "single_label")


def normalize_targets(df: DataFrame, target: str | list[str], declared: str | None = None, names: list[str] | None = None) -> tuple[DataFrame, str]:
    """The rows with a column ``target`` in the form that metrics read, and the target type.

    single_label: the typed key. multi_label: a sorted array of distinct keys, from label arrays, from arrays of 0 and 1
    with ``names``, or from indicator columns. regression: an array of doubles. An indicator that is neither 0 nor 1, a null
    or non-finite number and a null label are errors where the row is read.
    """
    kind = infer_target_type(df, target, declared)
    fail = lambda what: F.raise_error(F.lit(what))
    if kind == "regression":
        values = F.array(*(F.col(c).cast("double") for c in (target if isinstance(target, list) else [target]))) if isinstance(target, list) or not dict(df.dtypes)[target].startswith("array") else F.col(target).cast("array<double>")
        good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.withColumn("target", F.when(good, values).otherwise(fail("a regression target is null or not finite").cast("array<double>"))), kind
    if kind == "single_label":
        keyed = label_key(df, target, "target")
        return keyed.withColumn("target", F.when(F.col("target").isNotNull(), F.col("target")).otherwise(fail("a label is null").cast("string"))), kind
    if isinstance(target, list):
        flags, names = F.array(*(F.col(c).cast("int") for c in target)), list(target)
    elif names is not None:
        flags = F.col(target).cast("array<int>")
    else:
        return df.withColumn("target", F.array_sort(F.array_distinct(F.filter(F.col(target).cast("array<string>"), lambda x: x.isNotNull())))), kind
    good = (F.size(flags) == len(names)) & F.forall(flags, lambda x: x.isin(0, 1))
    on = F.transform(F.filter(F.arrays_zip(flags.alias("f"), F.array(*(F.lit(n) for n in names)).alias("n")), lambda x: x["f"] == 1), lambda x: x["n"])
    return df.withColumn("target", F.when(F.coalesce(good, F.lit(False)), F.array_sort(on)).otherwise(fail("an indicator is neither 0 nor 1").cast("array<string>"))), kind


def to_json(df: DataFrame, column: str) -> DataFrame:
    """The column as JSON text that tells its type: {"type": ..., "value": ...}."""
    kind = df.schema[column].dataType.json()
    return df.withColumn(column, F.concat(F.lit('{"type":' + kind + ',"value":'), F.coalesce(F.get_json_object(F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"}), "$.v"), F.lit("null")) if not df.schema[column].dataType.simpleString() == "string" else F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("null")), F.lit("}")))


def from_json(df: DataFrame, column: str) -> DataFrame:
    """The column as it was before ``to_json``; the type is that of the first row, and rows of another type are null."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_json_string

    first = df.where(F.col(column).isNotNull()).select(column).first()
    if first is None:
        return df
    kind = _parse_datatype_json_string(json.dumps(json.loads(first[0])["type"]))
    return df.withColumn(column, F.from_json(column, StructType([StructField("value", kind)]))["value"])
