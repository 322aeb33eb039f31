"""JSON text functions. Paths are `$`, `.key` and `[n]`.

Extraction by one path stays in the JVM: text by get_json_object, JSON by the
variant functions, whose objects have their members in the order of their names.
Objects, arrays and keys are built-ins too. Several paths, containment and mutation of nested documents
have none and run as Arrow-batched pandas functions, which SQL text calls by name (`sql_functions`).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_arrow_text(doc: Column, key: str | int) -> Column:
    """doc ->> key: a member, an element or a `$` path, as text."""
    if isinstance(key, str) and key.startswith("$"):
        return F.get_json_object(doc, key)
    return F.get_json_object(doc, f"$[{key}]" if isinstance(key, int) else f"$['{key}']" if not re.fullmatch(r"\w+", key) else f"$.{key}")


def _member(doc: Column, path: str) -> Column:
    """The value at a path as JSON."""
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), path, "variant"))


@F.pandas_udf(T.StringType())
def _members(docs: pd.Series, paths: pd.Series) -> pd.Series:
    """The values at several paths, one a line, as a JSON array of those found."""

    def one(doc, several):
        doc = _parsed(doc)
        if doc is _MISSING or several is None:
            return None
        found = [x for p in several.split("\n") if (x := _walk(doc, _steps(p))) is not _MISSING]
        return _dumped(found) if found else None

    return pd.Series([one(d, p) for d, p in zip(docs, paths, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _at(docs: pd.Series, paths: pd.Series) -> pd.Series:
    """The value at a path that differs from row to row."""

    def one(doc, path):
        doc = _parsed(doc)
        found = _MISSING if doc is _MISSING or path is None else _walk(doc, _steps(path))
        return None if found is _MISSING else _dumped(found)

    return pd.Series([one(d, p) for d, p in zip(docs, paths, strict=True)], dtype=object)


def json_arrow(doc: Column, key: str | int) -> Column:
    """doc -> key: the member or element as JSON."""
    path = key if isinstance(key, str) and key.startswith("$") else f"$[{key}]" if isinstance(key, int) else f"$.{key}"
    return _member(doc, path)


def json_extract(doc: Column, *paths: str) -> Column:
    """One path: its value. Several: a JSON array of those found; NULL if none is."""
    return _member(doc, paths[0]) if len(paths) == 1 else _members(doc, F.lit("\n".join(paths)))


def json_unquote(x: Column) -> Column:
    """A JSON string without its quotes; other text stays."""
    return F.when(x.rlike(r'(?s)^".*"$'), F.coalesce(F.get_json_object(x, "$"), x)).otherwise(x)


def json_object(*pairs) -> Column:
    """A JSON object of alternating names and columns."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in zip(pairs[::2], pairs[1::2], strict=True))), {"ignoreNullFields": "false"})


def json_array(*items: Column) -> Column:
    """A JSON array; every item keeps its own type."""
    return F.concat(F.lit("["), F.concat_ws(",", *map(_encoded, items)), F.lit("]"))


def _encoded(value: Column) -> Column:
    """A value as JSON text; NULL is null."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


class _MISSING:
    """Stands for a value that isn't there; a class, so that it stays itself when functions are sent to executors."""


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return _MISSING


def _dumped(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _steps(path: str) -> list[str | int]:
    return [int(n) if n else quoted or key for key, quoted, n in re.findall(r'\.(\w+)|\."([^"]*)"|\[(\d+)\]', path or "")]


def _walk(value, steps):
    """The value that a path leads to, or _MISSING."""
    for step in steps:
        if isinstance(step, int):
            # a scalar counts as an array of itself only at [0]
            value = value[step] if isinstance(value, list) and step < len(value) else _MISSING
        else:
            value = value.get(step, _MISSING) if isinstance(value, dict) else _MISSING
        if value is _MISSING:
            break
    return value


def contains(doc, part) -> bool:
    """Objects contain their members' subsets, arrays hold every element wanted, scalars are equal."""
    if isinstance(doc, dict) and isinstance(part, dict):
        return all(k in doc and contains(doc[k], v) for k, v in part.items())
    if isinstance(doc, list):
        return all(any(contains(d, p) for d in doc) for p in (part if isinstance(part, list) else [part]))
    return type(doc) is type(part) and doc == part or isinstance(doc, (int, float)) and isinstance(part, (int, float)) and not isinstance(doc, bool) and not isinstance(part, bool) and doc == part


@F.pandas_udf(T.BooleanType())
def _contains(docs: pd.Series, parts: pd.Series) -> pd.Series:
    def one(doc, part):
        doc, part = _parsed(doc), _parsed(part)
        return None if doc is _MISSING or part is _MISSING else contains(doc, part)

    return pd.Series([one(d, p) for d, p in zip(docs, parts, strict=True)], dtype=object)


def json_contains(doc: Column, part: Column, path: str | None = None) -> Column:
    """doc @> part."""
    return _contains(doc if path is None else _member(doc, path), part)


def json_has_key(doc: Column, key: str) -> Column:
    """doc ? key: a member of an object, a string element of an array, or the string itself."""
    value = F.try_parse_json(doc)
    is_key = lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") == key)
    return F.when(value.isNotNull(), F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.exists(F.try_variant_get(value, "$", "array<variant>"), is_key), is_key(value)))


def _changer(change):
    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        def one(doc, path, value):
            doc = _parsed(doc)
            if doc is _MISSING:
                return None
            steps = _steps(path)
            around = _walk(doc, steps[:-1]) if steps else _MISSING
            if around is not _MISSING:
                change(around, steps[-1], None if value is None else json.loads(value))
            return _dumped(doc)

        return pd.Series([one(*x) for x in zip(docs, paths, values, strict=True)], dtype=object)

    return run


def _has(around, step) -> bool:
    return isinstance(around, dict) and step in around or isinstance(around, list) and isinstance(step, int) and step < len(around)


def _set(around, step, value):
    if isinstance(around, dict) and isinstance(step, str) or _has(around, step):
        around[step] = value
    elif isinstance(around, list) and isinstance(step, int):
        around.append(value)


def _replace(around, step, value):
    if _has(around, step):
        around[step] = value


def _remove(around, step, _):
    if _has(around, step):
        del around[step]


_setter, _replacer, _remover = _changer(_set), _changer(_replace), _changer(_remove)


def json_set(doc: Column, path: str, value: Column) -> Column:
    return _setter(doc, F.lit(path), _encoded(value))


def json_replace(doc: Column, path: str, value: Column) -> Column:
    return _replacer(doc, F.lit(path), _encoded(value))


def json_remove(doc: Column, path: str) -> Column:
    return _remover(doc, F.lit(path), F.lit("null"))


def sql_functions() -> dict:
    """The functions that SQL text calls by name: the same ones that the Columns above use."""
    return {"quern_json_get": _at, "quern_json_get_all": _members, "quern_json_contains": _contains, "quern_json_set": _setter, "quern_json_replace": _replacer, "quern_json_remove": _remover}
