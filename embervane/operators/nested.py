"""Deeply nested semi-structured records into flat tables with parent-child links.

The schema of all payloads is inferred and merged first: every path with the types it has. Each array in it becomes a
level, a child table whose rows carry the surrogate key of their parent, their own surrogate key and their ordinal.
Naming rules tell what a level is called, which fields name its entries and where an object is a map of entries; an
array that no rule knows is a level named by its path. The levels are then exploded with variants. Lists, maps keyed by
name, single objects where a list is usual and levels encoded once more as strings are all read alike. The columns of
a child table come from the schema merged over all of its rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from embervane.functions.json import bind, field, json_type, parsed, quoted, unwrapped
from embervane.session import table


@dataclass(frozen=True)
class Child:
    """One array level: where it lies below its parent, and which fields name an entry.

    ``maps``: an object there that has none of ``names`` is a map of entries by name; otherwise it is one entry.
    """

    kind: str
    parent: str
    paths: tuple[tuple[str, ...], ...]
    names: tuple[str, ...] = ()
    maps: bool = True


#: Paths that one set of payloads may have; more mean that names stand as keys where no rule says so.
MAX_PATHS = 20_000
LEVELS = "payload string, path array<string>, type string"


def _unique(pairs: list) -> dict:
    if len(out := dict(pairs)) != len(pairs):
        raise ValueError("an object repeats a key")
    return out


def _number(text: str):
    raise ValueError(text)


def _paths(rules_of: dict[str, dict[tuple, Child]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct (payload, path, type) of a partition with a column for each payload. ``[]`` stands for the entries of an array, of a map of entries, or
    of a single object where a list is usual."""
    read = lambda t: json.loads(t, object_pairs_hook=_unique, parse_constant=_number)
    held: dict[str, set[tuple]] = {p: set() for p in rules_of}
    seen, rules = set(), {}
    plain = {bool: "boolean", int: "integer", float: "number", type(None): "null"}

    def walk(v, path: tuple) -> None:
        for _ in range(2):
            if isinstance(v, str):
                if not v.lstrip()[:1] in ("{", "[", '"'):  # nothing that holds entries
                    break
                try:
                    v = read(v)
                except (ValueError, RecursionError):
                    break
        rule = rules.get(path)
        if isinstance(v, list):
            seen.add((path, "array"))
            for x in v:
                walk(x, (*path, "[]"))
        elif isinstance(v, dict):
            if rule is not None and not path[-1:] == ("[]",):
                entries = list(v.values()) if rule.maps and not any(n in v for n in rule.names) else [v]
                seen.add((path, "array"))
                for x in entries:
                    walk(x, (*path, "[]"))
                return
            seen.add((path, "object"))
            for k, x in v.items():
                kind = plain.get(type(x))
                if kind:
                    seen.add(((*path, k), kind))
                else:
                    walk(x, (*path, k))
        else:
            seen.add((path, plain.get(type(v), "string" if isinstance(v, str) else "null")))
        if len(seen) > MAX_PATHS:
            raise ValueError(f"more than {MAX_PATHS} paths, such as {path}: a map needs a naming rule")

    for batch in batches:
        for payload in rules_of:
            seen, rules = held[payload], rules_of[payload]
            for text in batch[payload]:
                if text:
                    try:
                        v = read(text)
                    except (ValueError, RecursionError):
                        continue
                    walk(v, ())
    yield pd.DataFrame([(payload, list(p), t) for payload, own in held.items() for p, t in sorted(own)], columns=["payload", "path", "type"])


def _rule_paths(payload: str, rules: tuple[Child, ...]) -> dict[tuple, Child]:
    """Where the rules' levels lie below a payload: absolute path to rule."""
    out: dict[tuple, Child] = {}

    def below(kind: str, at: tuple, depth: int) -> None:
        for c in rules:
            if c.parent == kind and depth < 20:
                for p in c.paths:
                    out[(*at, *p)] = c
                    below(c.kind, (*at, *p, "[]"), depth + 1)

    below(payload, (), 0)
    return out


def inferred_schema(df: DataFrame, payloads: dict[str, str], rules: tuple[Child, ...]) -> DataFrame:
    """(payload, path, types): the schema merged over all payloads, alternatives kept. Damaged payloads add nothing."""
    at = {name: _rule_paths(name, rules) for name in payloads}
    out = df.select(*(F.col(c).alias(name) for name, c in payloads.items())).mapInPandas(lambda it: _paths(at, it), LEVELS)
    return out.groupBy("payload", "path").agg(F.array_sort(F.collect_set("type")).alias("types"))


def levels(schema: list[tuple[str, list[str]]], rules: tuple[Child, ...]) -> tuple[Child, ...]:
    """The rules and one more level for each array of the schema that no rule knows.

    schema: (payload, path) of every array. A new level hangs below the level that encloses it and is called after its
    path; an array right inside an array is the level ``<level>_entry``.
    """
    tree, taken, made = list(rules), {c.kind for c in rules}, {}
    for payload in sorted({p for p, _ in schema}):
        known: dict[tuple, str] = {p: c.kind for p, c in _rule_paths(payload, rules).items()}
        for path in sorted((tuple(p) for q, p in schema if q == payload), key=len):
            if path in known:
                continue
            marks = [i for i, x in enumerate(path) if x == "[]"]
            start = marks[-1] + 1 if marks else 0
            parent = known[path[: start - 1]] if marks else payload
            rest = path[start:]
            if (parent, rest) not in made:
                name = re.sub(r"\W", "_", "_".join([parent, *(rest or ("entry",))]))
                while name in taken:
                    name += "_"
                taken.add(name)
                made[parent, rest] = name
                tree.append(Child(name, parent, (rest,), (), maps=False))
            known[path] = made[parent, rest]
    return tuple(tree)


def _items(v: str, c: Child) -> str:
    """SQL for array<struct<ordinal, key, value>> of the entries held by a variant."""
    part = lambda f: bind(f, lambda y: f"if({json_type(y)} in ('object', 'array'), null, cast({y} as string))")
    name = lambda m: "coalesce(" + ", ".join([*(part(f"{m}[{quoted(n)}]") for n in c.names), "cast(null as string)"]) + ")"
    struct = lambda i, key, e: f"named_struct('ordinal', {i}, 'key', {key}, 'value', {e})"
    entry = lambda e, i: bind(unwrapped(e, 1), lambda y: struct(i, name(f"try_cast({y} as map<string,variant>)"), y))

    def held(u: str) -> str:
        listed = f"transform(try_cast({u} as array<variant>), (e_, i_) -> {entry('e_', 'i_')})"
        mapped = lambda m: f"transform(map_entries({m}), (m_, j_) -> {struct('j_', 'm_.key', unwrapped('m_.value', 1))})"
        one = lambda m: f"case when {m} is null then null when {name(m)} is not null then array({struct('0', name(m), u)}) else {mapped(m)} end" if c.maps else f"if({m} is null, null, array({struct('0', name(m), u)}))"
        return f"coalesce({listed}, {bind(f'try_cast({u} as map<string,variant>)', one)}, array())"

    return bind(v, held)


def _walk(v: str, kind: str, row: str, key: str, tree: tuple[Child, ...], depth: int) -> list[str]:
    """SQL arrays of the child structs below a value."""
    out = []
    for n, c in enumerate(t for t in tree if t.parent == kind):
        for p, path in enumerate(c.paths):
            x = f"x{depth}_{n}_{p}_"
            at = "/".join((c.kind, *path)) if len(c.paths) > 1 else c.kind
            me = f"concat({row}, '/{at}:', {x}.ordinal)"
            own = f"named_struct('kind', '{c.kind}', 'parent_row', {row}, 'row', {me}, 'ordinal', {x}.ordinal, 'parent_key', {key}, 'key', {x}.key, 'value', {x}.value)"
            below = _walk(f"{x}.value", c.kind, me, f"coalesce({x}.key, '')", tree, depth + 1)
            rows = f"concat(array({own}), {', '.join(below)})" if below else f"array({own})"
            out.append(f"flatten(transform({_items(field(v, *path) if path else v, c)}, {x} -> {rows}))")
    return out


def children(df: DataFrame, id_col: str, payloads: dict[str, str], tree: tuple[Child, ...]) -> DataFrame:
    """Every child row of every payload in one pass over the input.

    ``payloads`` maps a root kind of ``tree`` to its JSON column. Payloads that are null, blank or damaged
    have no children. Returns (id, kind, parent_row, row, ordinal, parent_key, key, value): ``row`` and
    ``parent_row`` are surrogate keys made of the record's id and the position at each level, so they are
    equal in repeated runs and for repeated deliveries; a hash of the payloads stands for a null id. ``key`` is
    null where an entry names itself nowhere.
    """
    roots = [f"{unwrapped(parsed(f'`{c}`'))} as `__{k}`" for k, c in payloads.items()]
    hashed = f"sha2(to_json(struct({', '.join(f'`{c}`' for c in payloads.values())})), 256)"
    base = df.selectExpr(f"`{id_col}`", f"coalesce(cast(`{id_col}` as string), concat('null-', {hashed})) as `__id`", *roots)
    arrays = [a for k in payloads for a in _walk(f"`__{k}`", k, f"concat(`__id`, '#{k}')", "''", tree, 0)]
    return base.select(id_col, F.inline(F.expr(f"concat({', '.join(arrays)})")))


def merged_schema(rows: DataFrame) -> DataFrame:
    """The schema merged over all values of each kind; conflicting types at a path become VARIANT."""
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.schema_of_variant_agg("value").alias("merged_schema"))


def child_table(rows: DataFrame, kind: str, id_col: str, schema: str) -> DataFrame:
    """The flat table of one kind: links, ordinal, key and one column per scalar field of the merged schema.

    Objects inside an entry are flattened with ``_``; arrays belong to their own child tables and are JSON here. An entry
    that is no object has its value in ``entry``. Names may hold any sign. Repeated deliveries of a record give one row.
    """
    cols, used = [], {id_col, "row", "parent_row", "ordinal", "key"}

    def column(name: str, sql: str) -> None:
        while name.lower() in used:
            name += "_field"
        used.add(name.lower())
        cols.append(F.expr(sql).alias(name))

    def add(prefix: str, at: str, struct: StructType) -> None:
        for f in struct.fields:
            col, value = f"{prefix}{f.name}".replace("@", "_at_").replace(".", "_").replace("`", "_"), f"try_cast({at} as map<string,variant>)[{quoted(f.name)}]"
            if isinstance(f.dataType, StructType):
                add(f"{col}_", value, f.dataType)
                continue
            t = f.dataType.simpleString()
            sql = {"bigint": "bigint", "boolean": "boolean", "string": "string"}.get(t, "double" if t.startswith("decimal") or t == "double" else "string")
            column(col, f"try_variant_get({value}, '$', '{sql}')")

    if schema.startswith("OBJECT<"):
        add("", "value", _parse_datatype_string(schema.replace("OBJECT<", "STRUCT<")))
    elif schema:
        column("entry", "try_variant_get(value, '$', 'string')")
    own = rows.where(F.col("kind") == kind)
    return own.select(id_col, "row", "parent_row", "ordinal", "key", *cols).dropDuplicates(["row"])


#: Naming rules of the score reports.
REPORT_RULES = (
    Child("probe", "report", (("metrics", "probes"),), ("name", "label")),
    Child("recipe", "probe", (("recipe",), ("recipes",)), ("recipe_id",), maps=False),
    Child("architecture", "report", (("metrics", "mlp_recommendation_evidence", "architectures"),), ("architecture",), maps=False),
    Child("recipe", "architecture", (("recipe",),), ("recipe_id",), maps=False),
    Child("class", "per_class", ((),), ("label", "name")),
    Child("confusion", "class", (("confusions",),), ("label", "name")),
    Child("worst_query", "diagnostics", (("worst_queries",),), ("query_id",), maps=False),
    Child("hit", "worst_query", (("hits",),), ("gallery_id",), maps=False),
)
REPORT_PAYLOADS = {"report": "report", "per_class": "per_class", "diagnostics": "diagnostics"}
KINDS = ("probe", "recipe", "class", "confusion", "worst_query", "hit")


def exploded(df: DataFrame, id_col: str, payloads: dict[str, str], rules: tuple[Child, ...]) -> tuple[DataFrame, tuple[Child, ...]]:
    """The child rows of every array level that the payloads have, and the levels; see ``children``."""
    arrays = inferred_schema(df, payloads, rules).where(F.array_contains("types", "array")).select("payload", "path").collect()  # as large as the schema
    tree = levels([(r["payload"], r["path"]) for r in arrays], rules)
    return children(df, id_col, payloads, tree), tree


def score_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "score_reports").select("report_id", "report", "per_class", "diagnostics")


def report_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(score_reports(spark, sf_dir), "report_id", REPORT_PAYLOADS, REPORT_RULES)[0]
