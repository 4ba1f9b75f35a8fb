"""JSON in VARIANT columns: paths through objects, rendering as Python's str(), replacement."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(parts: list[str]) -> str:
    return "$" + "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in parts)


def at(value: Column, parts: list[str]) -> Column:
    """The value at a path of object keys (a JSON null is a value, a missing key is SQL null)."""
    return F.try_variant_get(value, path_of(parts), "variant")


def _loads(text: str):
    """The value of a JSON text (of a repeated key, the last), or the text itself where it is none."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return text


def _python_str(value: Column) -> Column:
    @F.pandas_udf("string")
    def as_str(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else str(_loads(v)))

    return as_str(value)


def refused(raw: Column) -> Column:
    """Whether a VARIANT can't hold what a text says: it isn't JSON, or an object in it repeats a key."""
    return raw.isNotNull() & F.try_parse_json(raw).isNull()


def simple(value: Column) -> Column:
    """Whether a JSON value is null, true, false, a text or a whole number: what reads the same in a VARIANT as in its text."""
    return F.schema_of_variant(value).isin("VOID", "BOOLEAN", "STRING", "BIGINT")


def rendered(value: Column, raw: Column | None = None) -> Column:
    """``str()`` of a JSON value. Only objects and arrays leave the JVM; and fractions, where ``raw``, the JSON text that the
    value was read from, is known: it tells 1.0 from 1, the order of keys, and which of two equal keys was the last."""
    kind = F.schema_of_variant(value)
    away = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    source = F.to_json(value)
    if raw is not None:
        away = away | (raw.isNotNull() & (~simple(value) | refused(raw)))
        source = F.coalesce(raw, source)
    return F.when(away, _python_str(F.when(away, source))).otherwise(rendered_simple(value))


def rendered_simple(value: Column) -> Column:
    """``str()`` of a JSON value that is ``simple``."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def walked(raw: Column, path: Column) -> Column:
    """struct(text, body, reason): what stands at a dotted path in a JSON text, as ``str()`` and as JSON, or why nothing does.
    For what a VARIANT can't tell."""

    @F.pandas_udf("text string, body string, reason string")
    def walk(raw: pd.Series, path: pd.Series) -> pd.DataFrame:
        rows = []
        for text, keys in zip(raw, path, strict=True):
            at, why = None if text is None else _loads(text), None
            if not at or not keys:
                why = "missing_data_or_key"
            for part in keys.split(".") if why is None else ():
                if not isinstance(at, dict) or part not in at:
                    why = f"key_not_found: {part}"
                    break
                at = at[part]
            rows.append((None, None, why) if why else (str(at), json.dumps(at), None))
        return pd.DataFrame(rows, columns=["text", "body", "reason"])

    return walk(raw, path)


def _set(data, parts: list[str], value, create: bool) -> tuple[object, bool, str | None]:
    """A copy of ``data`` with ``value`` at the path; or ``data``, and why not."""
    if not data or not parts:
        return data, False, "missing_data_or_key"
    whole = at = json.loads(json.dumps(data))
    for part in parts[:-1]:
        if not isinstance(at, dict):
            return data, False, f"invalid_path_type: {part}"
        if part not in at:
            if not create:
                return data, False, f"path_not_found: {part}"
            at[part] = {}
        at = at[part]
    if not isinstance(at, dict):
        return data, False, "target_not_dict"
    at[parts[-1]] = value
    return whole, True, None


def replaced(data: Column, path: Column, value: Column, create: Column) -> Column:
    """struct(result, success, reason): JSON text with the JSON ``value`` set at a dotted path. Untyped nested data has no
    built-in setter."""

    @F.pandas_udf("result string, success boolean, reason string")
    def put(data: pd.Series, path: pd.Series, value: pd.Series, create: pd.Series) -> pd.DataFrame:
        rows = []
        for d, p, v, c in zip(data, path, value, create, strict=True):
            out, done, why = _set(None if d is None else _loads(d), [x for x in (p or "").split(".") if x], None if v is None else _loads(v), bool(c))
            rows.append((None if d is None else json.dumps(out, separators=(",", ":"), ensure_ascii=False), done, why))
        return pd.DataFrame(rows, columns=["result", "success", "reason"])

    return put(data, path, value, create)
