"""Text nodes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from .base import Built, Call, NodeType, Value

_TRANSFORMS = {"uppercase": F.upper, "lowercase": F.lower, "title": texts.title, "strip": texts.strip, "reverse": F.reverse}


def _transform(call: Call) -> Built:
    """An unknown operation leaves the text as it is; an empty one stays empty."""
    text, error = call.get("text").plain_text("text_transform")
    operation = _TRANSFORMS.get(call.params.get("operation", "uppercase"), lambda t: t)
    return Built({"output": Value(operation(text))}, error)


#: Python's classes in Java's words, for use inside brackets; and what Java's engine reads differently or not at all.
_CLASSES = {"s": r"\s\x1c-\x1f", "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"}
_WORD = "[" + _CLASSES["w"] + "]"
_OTHER_MEANING = re.compile(r"\(\?P=|\(\?\(|\(\?[aLux]|\\[ZNuU]|\(\?[imsx-]*i[imsx-]*\)(?s:.*)[^\x00-\x7f]|(?s:.*)[^\x00-\x7f](?s:.*)\(\?[imsx-]*i")


def java_pattern(spark: SparkSession, pattern: str) -> str | None:
    """The pattern for Spark's regular expressions, with Python's meaning of classes, word borders and line ends (only a
    newline ends a line); null where that can't be said, and for sets in sets, whose signs mean something else in Java."""
    if _OTHER_MEANING.search(pattern):
        return None
    out, inside, k = [], False, 0
    while k < len(pattern):
        c, two = pattern[k], pattern[k : k + 2]
        k += 1
        if c == "\\":
            k += 1
            kind = two[1:]
            if kind.lower() in _CLASSES:
                if inside and kind.isupper():
                    return None
                out.append(_CLASSES[kind] if inside else f"[{'^' * kind.isupper()}{_CLASSES[kind.lower()]}]")
            elif kind in ("b", "B"):
                if inside:
                    return None
                border = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
                out.append(border if kind == "b" else f"(?!{border})")
            elif kind.isalpha() and kind not in "AafnrtvxX":
                return None
            else:
                out.append({"a": "\\x07", "v": "\\x0b"}.get(kind, two))
        elif inside:
            if c == "[" or two == "&&":
                return None
            inside = c != "]" or pattern[k - 2] == "[" or pattern[k - 3 : k - 1] == "[^"
            out.append("\\]" if inside and c == "]" else c)
        else:
            inside = c == "["
            out.append(c)
    java = "(?Ud)" + re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", "".join(out))
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # noqa: BLE001  the JVM's PatternSyntaxException
        return None
    return java


def _found_by_python(pattern: str) -> Column:
    @F.pandas_udf("matches string, filtered string")
    def found(texts: pd.Series) -> pd.DataFrame:
        compiled = re.compile(pattern)
        return pd.DataFrame([("\n".join(compiled.findall(t)), compiled.sub("", t)) for t in texts], columns=["matches", "filtered"])

    return found


def _hit(spark: SparkSession, text: Column, pattern: str) -> Column:
    java = java_pattern(spark, pattern)
    if java is not None:
        return text.rlike(java)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return texts.map(lambda t: None if t is None else compiled.search(t) is not None)

    return found(text)


def _filter(call: Call) -> Built:
    """What a pattern finds, a line each, and what is left without it. A pattern that isn't valid is taken literally; one
    with several groups fails, as its matches aren't text."""
    text, error = call.get("text").plain_text("text_filter")
    pattern = str(call.params.get("pattern", ""))
    if not pattern:
        return Built({"matches": Value(F.lit("")), "filtered": Value(text)}, error)
    try:
        compiled = re.compile(pattern) if call.params.get("use_regex", True) else None
    except re.error:
        compiled = None
    if compiled is None:
        hit = F.contains(text, F.lit(pattern))
        return Built({"matches": Value(F.when(hit, pattern).otherwise("")), "filtered": Value(F.replace(text, F.lit(pattern), F.lit("")))}, error)
    if compiled.groups > 1:
        return Built({"matches": Value(F.lit("")), "filtered": Value(text)}, F.coalesce(error or F.lit(None), F.when(_hit(call.spark, text, pattern), "sequence item 0: expected str instance, tuple found")))
    java = java_pattern(call.spark, pattern)
    if java is None:
        both = _found_by_python(pattern)(text)
        return Built({"matches": Value(both["matches"]), "filtered": Value(both["filtered"])}, error)
    matches = F.array_join(F.regexp_extract_all(text, F.lit(java), F.lit(compiled.groups)), "\n")
    return Built({"matches": Value(matches), "filtered": Value(F.regexp_replace(text, java, ""))}, error)


def _concat(call: Call) -> Built:
    """Joins the ports that aren't null or empty."""
    parts = [texts.present(call.inputs[p].text()) for p in ("text1", "text2", "text3") if p in call.inputs]
    return Built({"output": Value(F.concat_ws(str(call.params.get("separator", " ")), *parts))})


TEXT = [
    NodeType("text_transform", "Text", {"text": True}, ("output",), _transform, {"operation": "uppercase"}),
    NodeType("text_filter", "Text", {"text": True}, ("matches", "filtered"), _filter, {"pattern": "", "use_regex": True}),
    NodeType("text_concat", "Text", {"text1": True, "text2": False, "text3": False}, ("output",), _concat, {"separator": " "}),
]
