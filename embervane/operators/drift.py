"""Schemas that drift between files: one table over all time, and a report of every change.

The schemas of all files are inferred in parallel as tagged unions (each field keeps every JSON type it was
seen with), fused into one schema, and read back with one branch per conflicting type besides a canonical
column. Consecutive files of a stream are compared field by field; a field that went while another came is a
rename if both hold equal values in every row that the two files share.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from embervane.functions.json import bind, field, json_type, parsed, quoted, unwrapped
from embervane.session import Scratch, table

TYPES = ("boolean", "integer", "number", "string", "array", "object")


def parsed_rows(lines: DataFrame) -> DataFrame:
    """lines(line_id, stream_id, file_seq, line_no, record) to one row per object in ``rows`` of each record.

    ``rows`` may be a list, one object or either of them encoded as a string. Unreadable lines are skipped.
    Returns (line_id, stream_id, file_seq, line_no, row_no, evaluation_index, extractor, status, fields: map<string,variant>).
    """
    base = lines.selectExpr("line_id", "stream_id", "file_seq", "line_no", f"{unwrapped(parsed('record'))} as v").where("stream_id is not null and file_seq is not null")
    base = base.selectExpr("line_id", "stream_id", "file_seq", "line_no", f"try_cast(cast({field('v', 'evaluation_index')} as string) as bigint) as evaluation_index", "try_variant_get(v, '$.status', 'string') as status", f"{field('v', 'rows')} as r")
    rows = "coalesce(try_cast(r as array<variant>), if(try_cast(r as map<string,variant>) is null, null, array(r)))"
    base = base.selectExpr("line_id", "stream_id", "file_seq", "line_no", "evaluation_index", "status", f"posexplode({rows}) as (row_no, x)")
    base = base.selectExpr("* except (x)", f"try_cast({unwrapped('x')} as map<string,variant>) as fields").where("fields is not null")
    return base.selectExpr("line_id", "stream_id", "file_seq", "line_no", "row_no", "evaluation_index", "try_cast(fields['extractor'] as string) as extractor", "status", "fields")


def typed_cells(rows: DataFrame) -> DataFrame:
    """Each row with the type and a hash of the value of each of its fields, as ``cells``: what is left of the lines once
    they are parsed. Values are hashed as JSON (1 and 1.0 are equal), an absent key is like a null."""
    cell = f"struct(e.key, struct({json_type('e.value')} as type, xxhash64(coalesce(to_json(e.value), 'null')) as h))"
    return rows.selectExpr("stream_id", "file_seq", "evaluation_index", "extractor", f"map_from_entries(transform(map_entries(fields), e -> {cell})) as cells")


def file_schemas(cells: DataFrame) -> DataFrame:
    """The tagged union of each file: (stream_id, file_seq, field, types), types without null, sorted."""
    seen = cells.selectExpr("stream_id", "file_seq", "inline(transform(map_entries(cells), e -> struct(e.key as field, e.value.type as type)))")
    real = F.array_remove(F.collect_set("type"), "null")
    return seen.groupBy("stream_id", "file_seq", "field").agg(F.array_sort(real).alias("types"))


def fused_schema(schemas: DataFrame) -> DataFrame:
    """One row per field over all time: its types, the canonical type and where it was first and last seen.

    Canonical: the only type; number for integer and number; else string (JSON text for arrays and objects).
    """
    u = schemas.groupBy("field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.count(F.lit(1)).alias("n_files"), F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq"))
    canonical = F.when(F.size("types") == 0, "string").when(F.size("types") == 1, F.element_at("types", 1)).when(F.size(F.array_except("types", F.array(F.lit("integer"), F.lit("number")))) == 0, "number").otherwise("string")
    return u.withColumn("canonical", canonical)


def _file_pairs(schemas: DataFrame) -> DataFrame:
    """Consecutive files of each stream that have at least one readable field: (stream_id, file_seq, prev_seq)."""
    files = schemas.select("stream_id", "file_seq").distinct()
    return files.withColumn("prev_seq", F.lag("file_seq").over(W.partitionBy("stream_id").orderBy("file_seq"))).where("prev_seq is not null")


def _difference(schemas: DataFrame) -> DataFrame:
    """(stream_id, file_seq, prev_seq, field, kind) with kind removed, added or type."""
    pairs = _file_pairs(schemas)
    new = schemas.join(pairs, ["stream_id", "file_seq"]).select("stream_id", "file_seq", "prev_seq", "field", F.col("types").alias("new_types"))
    old = schemas.withColumnRenamed("file_seq", "prev_seq").join(pairs, ["stream_id", "prev_seq"]).select("stream_id", "file_seq", "prev_seq", "field", F.col("types").alias("old_types"))
    both = old.join(new, ["stream_id", "file_seq", "prev_seq", "field"], "full")
    kind = F.when(F.col("new_types").isNull(), "removed").when(F.col("old_types").isNull(), "added").when((F.size("old_types") > 0) & (F.size("new_types") > 0) & (F.col("old_types") != F.col("new_types")), "type")
    return both.withColumn("kind", kind).where("kind is not null").select("stream_id", "file_seq", "prev_seq", "field", "kind")


def renames(cells: DataFrame, difference: DataFrame) -> DataFrame:
    """(stream_id, file_seq, field, new_field) for fields that went and came with equal values.

    Hashes are compared over all rows that both files hold, matched by evaluation_index and extractor; without a
    shared row there is no rename. Where several fits exist, they are taken in the order of names, each field once.
    """
    side = lambda kind, seq: difference.where(F.col("kind") == kind).groupBy("stream_id", F.col("file_seq").alias("cur_seq"), F.col(seq).alias("file_seq")).agg(F.collect_set("field").alias("wanted"))
    gone, come = side("removed", "prev_seq"), side("added", "file_seq")
    both = gone.select("stream_id", "cur_seq").join(come.select("stream_id", "cur_seq"), ["stream_id", "cur_seq"], "left_semi")
    keyed = cells.where("extractor is not null and evaluation_index is not null")

    def values(files: DataFrame, name: str) -> DataFrame:
        files = files.join(both, ["stream_id", "cur_seq"], "left_semi")
        value = F.expr("transform(wanted, f -> struct(f as field, coalesce(cells[f].h, xxhash64('null')) as h))")
        return keyed.join(files, ["stream_id", "file_seq"]).select("stream_id", "cur_seq", "evaluation_index", "extractor", value.alias(name))

    pairs = values(gone, "old").join(values(come, "new"), ["stream_id", "cur_seq", "evaluation_index", "extractor"])
    pairs = pairs.select("stream_id", "cur_seq", F.explode("old").alias("o"), "new").select("stream_id", "cur_seq", "o", F.explode("new").alias("n"))
    fits = pairs.groupBy("stream_id", F.col("cur_seq").alias("file_seq"), F.col("o.field").alias("field"), F.col("n.field").alias("new_field")).agg(F.bool_and(F.col("o.h") == F.col("n.h")).alias("fit")).where("fit")
    fits = fits.groupBy("stream_id", "file_seq").agg(F.array_sort(F.collect_list(F.struct("field", "new_field"))).alias("fits"))  # a file's fields
    taken = "aggregate(fits, cast(array() as array<struct<field:string,new_field:string>>), (a, x) -> if(exists(a, y -> y.field = x.field or y.new_field = x.new_field), a, array_append(a, x)))"
    return fits.selectExpr("stream_id", "file_seq", f"inline({taken})")


def changes(rows: DataFrame) -> DataFrame:
    """(stream_id, file_seq, change_kind, field, new_field): every change against the next lower file of the stream.

    The lines are parsed once, and their cells written to the shared scratch folder; file schemas and their
    differences, far smaller, follow from these.
    """
    scratch = Scratch(rows.sparkSession)
    cells = scratch.put(typed_cells(rows), "cells")
    diff = scratch.put(_difference(scratch.put(file_schemas(cells), "schemas")), "difference")
    ren = scratch.put(renames(cells, diff), "renames")
    involved = ren.select("stream_id", "file_seq", F.explode(F.array(F.struct(F.col("field"), F.lit("removed").alias("kind")), F.struct(F.col("new_field").alias("field"), F.lit("added").alias("kind")))).alias("x")).select("stream_id", "file_seq", "x.*")
    rest = diff.join(involved, ["stream_id", "file_seq", "field", "kind"], "left_anti")
    return rest.select("stream_id", "file_seq", F.col("kind").alias("change_kind"), "field", F.lit("").alias("new_field")).unionByName(ren.select("stream_id", "file_seq", F.lit("renamed").alias("change_kind"), "field", "new_field"))


def column_names(fields: list[str], taken: tuple[str, ...] = ()) -> dict[str, str]:
    """Column name of each field; names that differ only in case or signs get a number, in order of name."""
    used, out = {t.lower() for t in taken}, {}
    for f in sorted(fields):
        base = re.sub(r"\W", "_", f) or "_"
        name, n = base, 1
        while name.lower() in used:
            n += 1
            name = f"{base}__{n}"
        used.add(name.lower())
        out[f] = name
    return out


def _read(value: str, kind: str) -> Column:
    """The value of a variant if it is of that JSON type, else null; integers are numbers too."""
    sql = {"boolean": "boolean", "integer": "bigint", "number": "double", "string": "string"}.get(kind)
    if kind == "any":
        body = lambda v: f"case {json_type(v)} when 'null' then null when 'array' then to_json({v}) when 'object' then to_json({v}) else cast({v} as string) end"
    else:
        wanted = "('number', 'integer')" if kind == "number" else f"('{kind}')"
        body = lambda v: f"if({json_type(v)} in {wanted}, {f'try_cast({v} as {sql})' if sql else f'to_json({v})'}, null)"
    return F.expr(bind(value, body))


def unified(rows: DataFrame, fused: list[tuple[str, list[str], str]]) -> DataFrame:
    """One wide table of all rows: a canonical column per field, and a branch ``<column>_as_<type>`` per type of
    a field with several. ``fused`` holds (field, types, canonical) of the fused schema; it is as large as the
    schema, not the data. Repeated deliveries of a line give one row; lines without an id are all kept.
    """
    keys = ["line_id", "stream_id", "file_seq", "line_no", "row_no", "evaluation_index", "status"]
    names = column_names([f for f, _, _ in fused], tuple(keys))
    cols = []
    for f, types, canonical in sorted(fused):
        v = f"fields[{quoted(f)}]"
        cols.append(_read(v, "any" if canonical == "string" and types != ["string"] else canonical).alias(names[f]))
        if len(types) > 1:
            cols += [_read(v, t).alias(f"{names[f]}_as_{t}") for t in types]
    own = rows.withColumn("__own", F.when(F.col("line_id").isNull(), F.monotonically_increasing_id()))
    return own.dropDuplicates(["line_id", "row_no", "__own"]).select(*keys, *cols)


def monitor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_rows(table(spark, sf_dir, "monitor_lines").select("line_id", "stream_id", "file_seq", "line_no", "record"))
