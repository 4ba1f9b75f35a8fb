"""Conversations as ARRAY<STRUCT<role, content>>: keys by content, prompts, rewinding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How prompts name the roles.
SPEAKERS = {"system": "System", "user": "Human", "assistant": "Assistant"}


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def canonical(messages: Column, ascii_only: bool = True) -> Column:
    """JSON of the messages with sorted keys and no spaces; a missing role or content is the empty text."""
    plain = F.to_json(F.transform(messages, lambda m: F.struct(F.coalesce(m["content"], F.lit("")).alias("content"), F.coalesce(m["role"], F.lit("")).alias("role"))))
    if not ascii_only:
        return plain

    def escaped(part: Column) -> Column:
        units = F.lower(F.hex(F.encode(part, "utf-16be")))
        both = F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise(""))
        return F.when(F.startswith(part, F.lit("\\u")), F.lower(part)).when(part.rlike(r"^[ -~]+$"), part).otherwise(both)

    parts = F.regexp_extract_all(plain, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\.|[ -\[\]-~]+|(?s:.))"), F.lit(1))
    return F.array_join(F.transform(parts, escaped), "")


def context_key(messages: Column, ascii_only: bool = True) -> Column:
    """The first 16 hex digits of the SHA-256 of the canonical JSON."""
    return F.substring(F.sha2(canonical(messages, ascii_only), 256), 1, 16)


def rewind(messages: Column, steps: Column) -> Column:
    """Without the last ``steps`` exchanges of two messages, if fewer than all would go."""
    return F.when(2 * steps < F.size(messages), F.slice(messages, F.lit(1), F.size(messages) - 2 * steps)).otherwise(messages)


def prompt(messages: Column, question: Column | None = None) -> Column:
    """A flat prompt that ends where the assistant is to speak; messages of other roles are left out."""
    names = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    known = F.filter(messages, lambda m: m["role"].isin(*SPEAKERS))
    said = F.transform(known, lambda m: F.concat(F.element_at(names, m["role"]), F.lit(": "), m["content"]))
    if question is not None:
        said = F.concat(said, F.array(F.concat(F.lit("Human: "), question)))
    return F.concat_ws("\n\n", said, F.lit("Assistant:"))


def last_system(messages: Column) -> Column:
    """Content of the last system message, or null."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    return F.when(F.size(system) > 0, F.element_at(system, -1)["content"])


def split_request(messages: Column, question: Column, default: str = "You are a helpful AI assistant.") -> Column:
    """JSON of the last system prompt (or a default) and of all other messages with the question after them."""
    others = F.filter(messages, lambda m: m["role"] != "system")
    system = F.coalesce(F.nullif(last_system(messages), F.lit("")), F.lit(default))
    return F.to_json(F.struct(system.alias("system"), F.concat(others, F.array(message(F.lit("user"), question))).alias("messages")))


def mock_reply(question: Column, turn: Column, model: str | Column = "mock") -> Column:
    if isinstance(model, Column):
        return F.concat(F.lit("[MOCK "), F.upper(model), F.lit("] Turn "), turn.cast("string"), F.lit(" response to: "), question)
    return F.format_string(f"[MOCK {model.upper().replace('%', '%%')}] Turn %d response to: %s", turn, question)
