"""JSON nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsons
from .base import Built, Call, NodeType, Value


def _variant(value: Value) -> Column:
    return value.col if value.kind == "json" else F.try_parse_json(value.text())


def _as_json(value: Value) -> Column:
    """JSON text of a value."""
    if value.kind == "json":
        return F.to_json(value.col) if value.raw is None else F.coalesce(value.raw, F.to_json(value.col))
    if value.kind == "text":
        return F.regexp_extract(F.to_json(F.array(value.col)), r"(?s)^\[(.*)\]$", 1)
    return value.col.cast("string")


def _found(success: Column, reason: Column | None = None, extracted: Column | None = None) -> Value:
    parts = [success.alias("success"), (F.lit(None).cast("string") if reason is None else reason).alias("reason")]
    return Value(F.struct(*parts, *([] if extracted is None else [F.when(success, extracted).alias("extracted")])), "other")


def _extract(call: Call) -> Built:
    """The value at a dotted path through objects; ``found`` is struct(success, reason, extracted). A ``key`` port that isn't empty
    replaces the path, so its paths are walked row by row only then. Where the JSON text is known, rows leave the JVM whose
    value is an object, an array or a fraction, or whose text a VARIANT refuses."""
    given = call.get("data")
    source = given.raw if given.kind == "json" else given.text()
    data, default = _variant(call.get("data")), F.lit(str(call.params.get("default_value", "")))
    raw, path = not call.params.get("stringify", True), str(call.params.get("key_path", ""))
    empty = data.isNull() | F.to_json(data).isin("null", "false", "0", "0.0", '""', "{}", "[]")

    def walk(parts: list[str]) -> tuple[Column, Column]:
        steps = [F.when(jsons.at(data, parts[: k + 1]).isNull(), f"key_not_found: {p}") for k, p in enumerate(parts)]
        return jsons.at(data, parts), F.coalesce(*steps, F.lit(None).cast("string"))

    if "key" in call.inputs:
        keys = call.inputs["key"].text()
        parts = F.split(F.coalesce(F.nullif(keys, F.lit("")), F.lit(path)), r"\.", -1)
        seen = F.aggregate(parts, F.struct(data.alias("v"), F.lit(None).cast("string").alias("reason")), lambda a, k: F.when(a["reason"].isNotNull(), a).otherwise(_step(a["v"], k)))
        value, reason = seen["v"], seen["reason"]
        whole = F.coalesce(F.nullif(keys, F.lit("")), F.lit(path))
        none = whole == ""
    else:
        value, reason = walk(path.split(".")) if path else (F.lit(None).cast("variant"), F.lit(None).cast("string"))
        whole, none = F.lit(path), F.lit(not path)
    reason = F.when(empty | none, "missing_data_or_key").otherwise(reason)
    if source is None:
        hit = reason.isNull()
        if raw:
            return Built({"value": Value(F.when(hit, value).otherwise(default.cast("variant")), "json"), "found": _found(hit, reason, value)})
        return Built({"value": Value(F.when(hit, jsons.rendered(value)).otherwise(default)), "found": _found(hit, reason, value)})
    odd = jsons.refused(source)
    away = odd | (source.isNotNull() & reason.isNull() & ~jsons.simple(value))
    told = jsons.walked(F.when(away, source), whole)
    reason = F.when(odd, told["reason"]).otherwise(reason)
    hit = reason.isNull()
    held = F.when(odd, F.coalesce(F.try_parse_json(told["body"]), told["body"].try_cast("double").cast("variant"))).otherwise(value)
    if raw:
        body = F.when(hit, F.when(away, told["body"]).otherwise(F.to_json(value))).otherwise(F.to_json(default.cast("variant")))
        result = F.when(hit, held).otherwise(default.cast("variant"))
        return Built({"value": Value(result, "json", raw=body), "found": _found(hit, reason, held)})
    result = F.when(hit, F.when(away, told["text"]).otherwise(jsons.rendered_simple(value))).otherwise(default)
    return Built({"value": Value(result), "found": _found(hit, reason, held)})


def _step(value: Column, key: Column) -> Column:
    """One step of a path that is known by row only, through the object's entries."""
    entries = F.from_json(F.to_json(value), "map<string,variant>")
    inner = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_element_at(entries, key))
    return F.struct(inner.alias("v"), F.when(inner.isNull(), F.concat(F.lit("key_not_found: "), key)).alias("reason"))


def _replace(call: Call) -> Built:
    """The data with a value set at a path; ``success`` is struct(success, reason). Data at which nothing could be set is
    returned as it was."""
    key = call.inputs["key"].text() if "key" in call.inputs else F.lit("")
    path = F.coalesce(F.nullif(key, F.lit("")), F.lit(str(call.params.get("key_path", ""))))
    data = call.get("data")
    text = data.text() if data.kind == "text" else _as_json(data) if data.kind == "json" else F.to_json(_variant(data))
    out = jsons.replaced(text, path, _as_json(call.get("value")), F.lit(bool(call.params.get("create_if_missing", True))))
    return Built({"result": Value(F.try_parse_json(out["result"]), "json", raw=out["result"]), "text": Value(out["result"]), "success": _found(out["success"], out["reason"])})


JSON = [
    NodeType("json_extract", "JSON", {"data": True, "key": False}, ("value", "found"), _extract, {"key_path": "", "default_value": "", "stringify": True}),
    NodeType("json_replace", "JSON", {"data": True, "key": False, "value": True}, ("result", "text", "success"), _replace, {"key_path": "", "create_if_missing": True}),
]
