"""Example node types, as plugins would add them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as texts
from .base import Built, Call, NodeType, Value


def _processor(call: Call) -> Built:
    text, error = call.get("text").plain_text("example_processor")
    operation, prefix = call.params.get("operation", "word_count"), str(call.params.get("prefix", ""))
    words = texts.words(text)
    counted = {"word_count": ("Word count: ", texts.word_count(text)), "char_count": ("Character count: ", F.length(text))}
    if operation in counted:
        said, count = counted[operation]
        processed = F.concat(F.lit(prefix + said), count.cast("string"))
    elif operation == "reverse":
        processed, count = F.concat(F.lit(prefix), F.reverse(text)), F.length(text)
    elif operation == "shuffle":
        processed, count = F.concat(F.lit(prefix), F.array_join(F.shuffle(words, call.params.get("seed")), " ")), F.size(words)
    else:
        processed, count = F.concat(F.lit(prefix), text), F.lit(0)
    return Built({"processed": Value(processed), "count": Value(count, "number"), "count_string": Value(F.concat(F.lit(prefix), count.cast("string")))}, error)


def _auto_processor(call: Call) -> Built:
    text, error = call.get("input").plain_text("example_processor")
    kind = call.params.get("processing_type", "word_count")
    n = {"word_count": texts.word_count(text), "char_count": F.length(text), "reverse": F.length(text)}.get(kind, F.lit(0)).cast("string")
    processed = {"word_count": F.concat(F.lit("Words: "), n), "char_count": F.concat(F.lit("Characters: "), n), "reverse": F.reverse(text)}.get(kind, text)
    said = {"char_count": F.concat(n, F.lit(" characters")), "reverse": F.concat(F.lit("Reversed "), n, F.lit(" characters"))}.get(kind, F.concat(n, F.lit(" words")))
    return Built({"processed": Value(processed), "count_string": Value(said)}, error)


def _simple(call: Call) -> Built:
    text, error = call.get("text").plain_text("simple_text_processor")
    around = {"exclamation": ("", " !!!"), "brackets": ("[", "]"), "quotes": ('"', '"')}.get(call.params.get("operation", "exclamation"), ("", ""))
    return Built({"result": Value(F.concat(F.lit(around[0]), text, F.lit(around[1])))}, error)


#: The variant that automatic discovery would add: it loses to the other of its name.
AUTO_PROCESSOR = NodeType("example_processor", "Custom", {"input": False}, ("processed", "count_string"), _auto_processor, {"processing_type": "word_count"})

PLUGINS = [
    NodeType("example_processor", "Custom", {"text": True}, ("processed", "count", "count_string"), _processor, {"operation": "word_count", "prefix": ""}),
    NodeType("simple_text_processor", "Custom", {"text": True}, ("result",), _simple, {"operation": "exclamation"}),
]
