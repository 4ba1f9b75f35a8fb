"""Token counts by section: each document is encoded once, as a whole; the tokens' character spans are then joined to
the sections' intervals, and a token that crosses a boundary is given away by an explicit rule."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, without

#: Rules for a token that crosses a boundary: whole to the section of its first or last byte, whole to the section that
#: has most of its bytes (the earlier of equals), or shared out by bytes.
RULES = ("first", "last", "majority", "shared")


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(text: str) -> list[int]:
    """Sections are lines; the newline belongs to the line that it ends."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def attributed(token_bytes: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ``token_bytes``: the tokens' lengths in order; ``bounds``: the sections' byte bounds,
    one more than sections. Tokens and sections are both intervals in order, so the join is a binary search."""
    n = len(bounds) - 1
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float)
    out = np.bincount(first[first == last], minlength=n).astype(float)
    for t in np.flatnonzero(first != last):
        over = np.arange(first[t], last[t] + 1)
        share = np.minimum(bounds[over + 1], ends[t]) - np.maximum(bounds[over], starts[t])
        if rule == "shared":
            out[over] += share / token_bytes[t]
        else:
            out[over[share.argmax()]] += 1
    return out


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", sections: Callable[[str], list[int]] = line_starts, rule: str = "first") -> DataFrame:
    """One row for each section of each document: the columns of ``docs`` but its text, and

    * ``section`` int from 0; ``start_char``, ``end_char`` long, the section's half-open span in the text;
    * ``n_tokens`` double: tokens that ``rule`` gives to it. Over a document they sum to its tokens.

    ``sections`` gives the sorted starts of a text's sections, the first at 0 (default: lines).

    Cases: a null or empty text has one empty section without tokens; so has any empty section but under "last" or
    "first", where a boundary's token goes to the section that holds its byte; whole texts of any length are encoded
    at once; repeated rows each get rows; an empty table gives none; columns named like the outputs are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    @F.pandas_udf("array<struct<section:int,start_char:long,end_char:long,n_tokens:double>>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding, lengths = _encoder(path, pattern)

        def one(t: str | None) -> list[dict]:
            t = t or ""
            starts = np.asarray([*sections(t), len(t)], np.int64)
            size = lengths[np.asarray(encoding.encode_ordinary(t), np.int64)] if t else np.empty(0, np.int64)
            if t.isascii():
                bounds = starts
            else:
                raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                bounds = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[starts]
            n = attributed(size, bounds, rule)
            return [{"section": i, "start_char": a, "end_char": b, "n_tokens": c} for i, (a, b, c) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), n.tolist(), strict=True))]

        for texts in batches:
            yield pd.Series([one(t) for t in texts])

    outs = ("section", "start_char", "end_char", "n_tokens")
    x = fresh(docs, "x")
    kept = [c for c in docs.columns if c.lower() not in {*outs, text.lower()}]
    made = bounded_batches(docs).select(*without(docs, *outs, text), F.explode(counted(F.col(text))).alias(x))
    return made.select(*without(made, x) if kept else [], *(F.col(x)[c].alias(c) for c in outs))
