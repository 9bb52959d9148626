"""Reading of JSON text that may be damaged, encoded twice or shaped unevenly, as Spark variants."""

from __future__ import annotations

import itertools

_names = itertools.count()
_END = "end of the value"


def bind(value: str, body) -> str:
    """SQL that evaluates ``value`` once and hands its name to ``body``."""
    x = f"b{next(_names)}_"
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


def parsed(text: str) -> str:
    """SQL for the variant in a string expression; null where it is null, blank or damaged.

    Text after the value counts as damage at any length, as the value is read inside an object that must end after it;
    so does an object that repeats a key.
    """
    inside = f"try_cast(try_parse_json(concat('{{\"v\":', {text}, ',\"{_END}\":0}}')) as map<string,variant>)"
    return bind(inside, lambda m: f"if(size({m}) = 2 and {m}['{_END}'] is not null, {m}['v'], cast(null as variant))")


def is_string(v: str) -> str:
    """SQL that tells whether a variant holds a string, without looking into objects and arrays."""
    return f"(try_variant_get({v}, '$', 'binary') is not null)"


def unwrapped(v: str, times: int = 2) -> str:
    """SQL for a variant that, where it holds a string with a readable value, is that value; other strings stay."""
    for _ in range(times):
        v = bind(v, lambda x: f"if({is_string(x)}, coalesce({parsed(f'cast({x} as string)')}, {x}), {x})")
    return v


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def field(v: str, *path: str) -> str:
    """SQL for the unwrapped variant at a path of object keys."""
    for name in path:
        v = unwrapped(f"try_cast({v} as map<string,variant>)[{quoted(name)}]", 1)
    return v


def json_type(v: str) -> str:
    """SQL for the JSON type of a variant: boolean, integer, number, string, array, object or null."""
    big = lambda t: f"({t} like 'DECIMAL(%,0)' and cast(substring({t}, 9, length({t}) - 11) as int) > 18)"
    return bind(
        f"schema_of_variant({v})",
        lambda t: f"case when {t} is null or {t} = 'VOID' then 'null' when {t} = 'BOOLEAN' then 'boolean' when {t} = 'BIGINT' or {big(t)} then 'integer' when {t} = 'STRING' then 'string' "
        f"when {t} like 'ARRAY<%' then 'array' when {t} like 'OBJECT<%' then 'object' else 'number' end",
    )
