"""Byte-level BPE with a rank queue made of a hierarchical bitmap.

A run of the queue takes many pre-tokens at once, laid end to end. It keeps one bucket of linked-list positions for each
merge rank that is present, and a bitmap in two levels of 256-bit words over all ranks. Find-first-set on the levels
gives the lowest rank; positions whose pair has changed since they were put into a bucket are stale and skipped. So n
bytes take O(n) list steps and as many constant-time queue steps, where repeated scanning of a long pre-token takes
O(n^2)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, without

#: Distinct pre-tokens of up to LONGEST_KEPT characters whose encoding a worker keeps: when the newer half is full, it
#: becomes the older one, from which pre-tokens that turn up again are taken over.
KEPT, LONGEST_KEPT = 250_000, 48

#: Pre-tokens that are looked at together, and bytes of new ones that go through the queue in one run.
TOGETHER, RUN = 400_000, 1 << 18

_BIT = [1 << k for k in range(256)]


class RankQueue:
    """Buckets of positions by merge rank; the lowest rank present comes first."""

    def __init__(self, n_ranks: int):
        self.leaf, self.top = [0] * ((n_ranks >> 8) + 1), 0
        self.bucket: dict[int, list[int]] = {}

    def open(self, rank: int, places: list[int]) -> None:
        """Adds a bucket for a rank that has none."""
        self.bucket[rank] = places
        self.leaf[rank >> 8] |= _BIT[rank & 255]
        self.top |= 1 << (rank >> 8)

    def put(self, rank: int, at: int) -> None:
        found = self.bucket.get(rank)
        if found is None:
            self.open(rank, [at])
        else:
            found.append(at)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank present and its positions, which leave the queue."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.leaf[a]
        rank = a << 8 | (word & -word).bit_length() - 1
        self.leaf[a] = word = word & (word - 1)
        if not word:
            self.top &= self.top - 1
        return rank, self.bucket.pop(rank)


class BytePairs:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.piece = {i: b for b, i in ranks.items()}
        self.n_ranks = max(ranks.values()) + 1
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        #: rank of what two neighbours merge to, by their ranks side by side
        self.merged = {ranks[b[:k]] << 32 | ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self.first = np.full((256, 256), -1, np.int64)
        for b, i in ranks.items():
            if len(b) == 2:
                self.first[b[0], b[1]] = i
        self.queue = RankQueue(self.n_ranks)  # empty again after each run
        self.kept: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of some pre-tokens (none is empty), by one run of the queue."""
        data = b"".join(pieces)
        n, raw = len(data), np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        pairs = np.full(n, -1, np.int64)
        pairs[:-1] = self.first[raw[:-1], raw[1:]]
        pairs[ends - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[ends[:-1]] = before[0] = -1
        part, pair = [self.of_byte[b] for b in data], pairs.tolist()
        after, before = after.tolist(), before.tolist()
        queue, merged = self.queue, self.merged.get
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        cut = np.flatnonzero(np.diff(pairs[at], prepend=-2)).tolist()
        places = at.tolist()
        for x, y in zip(cut, [*cut[1:], len(places)], strict=False):
            queue.open(pair[places[x]], places[x:y])
        bucket, put = queue.bucket, queue.put
        while (found := queue.pop()) is not None:
            rank, places = found
            places.sort()  # left to right
            for done, i in enumerate(places, 1):
                if pair[i] != rank:
                    continue  # stale: the pair here has changed
                j = after[i]
                part[i] = rank
                pair[j] = -1
                after[i] = k = after[j]
                least = rank
                if k >= 0:
                    before[k] = i
                    r = merged(rank << 32 | part[k])
                    if r is None:
                        pair[i] = -1
                    else:
                        pair[i] = r
                        if (there := bucket.get(r)) is not None:
                            there.append(i)
                        else:
                            put(r, i)
                        least = min(least, r)
                else:
                    pair[i] = -1
                p = before[i]
                if p >= 0:
                    r = merged(part[p] << 32 | rank)
                    if r is None:
                        pair[p] = -1
                    else:
                        pair[p] = r
                        if (there := bucket.get(r)) is not None:
                            there.append(p)
                        else:
                            put(r, p)
                        least = min(least, r)
                if least < rank:  # a lower rank has come up: it goes first, the rest of this bucket waits
                    for other in places[done:]:
                        put(rank, other)
                    break
        out, begin = [], 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            if (whole := self.ranks.get(piece)) is not None:
                out.append([whole])
            else:
                ids, i = [], begin
                while i >= 0:
                    ids.append(part[i])
                    i = after[i]
                out.append(ids)
            begin = end
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def _learn(self, tokens: list[str], into: dict[str, tuple[str, int, bytes]]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (size == 0 or size + len(raw[end]) <= RUN):
                size += len(raw[end])
                end += 1
            for token, ids in zip(tokens[at:end], self.merge(raw[at:end]), strict=True):
                into[token] = ",".join(map(str, ids)), len(ids), self.decode(ids)
            at = end

    def encode(self, text: str) -> list[int]:
        tokens = self.pattern.findall(text)
        return [i for ids in self.merge([t.encode("utf-8", "surrogatepass") for t in tokens]) for i in ids] if tokens else []

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: how many ids, SHA-256 of the decimal ids joined by commas, and of the bytes decoded from them."""
        ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
        for tokens, over in self._groups(texts):
            flat = {t for part in tokens for t in part}
            if len(self.kept) >= KEPT // 2:
                self.kept, self.older = {}, self.kept
            kept, older, new = self.kept, self.older, []
            for t in flat:
                if t not in kept:
                    if (found := older.get(t)) is not None:
                        kept[t] = found
                    else:
                        new.append(t)
            self._learn([t for t in new if len(t) <= LONGEST_KEPT], kept)
            long: dict[str, tuple[str, int, bytes]] = {}
            self._learn([t for t in new if len(t) > LONGEST_KEPT], long)
            known = kept | long if long else kept
            for k, part in enumerate(tokens):
                if part:
                    each = [known[t] for t in part]
                    text = ",".join([x[0] for x in each])
                    ids.update(("," + text if n else text).encode())
                    back.update(b"".join([x[2] for x in each]))
                    n += sum([x[1] for x in each])
                if k < len(tokens) - 1 or over:
                    yield n, ids.hexdigest(), back.hexdigest()
                    ids, back, n = hashlib.sha256(), hashlib.sha256(), 0

    def _groups(self, texts: list[str]) -> Iterator[tuple[list[list[str]], bool]]:
        """Pre-tokens of consecutive texts in groups of bounded size; whether the last text of the group is complete."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) <= TOGETHER:
                group.append(self.pattern.findall(text))
                size += len(group[-1])
                if size >= TOGETHER:
                    yield group, True
                    group, size = [], 0
                continue
            if group:
                yield group, True
                group, size = [], 0
            found = self.pattern.finditer(text)
            part = [m[0] for m in islice(found, TOGETHER)]
            while more := [m[0] for m in islice(found, TOGETHER)]:
                yield [part], False
                part = more
            yield [part], True
        if group:
            yield group, True


@cache
def byte_pairs(path: str, pattern: str) -> BytePairs:
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> of each whole text (null: no ids). An existing column ``ids`` is replaced."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        code = byte_pairs(path, pattern)
        return texts.map(lambda t: code.encode(t or ""))

    return bounded_batches(docs).select(*without(docs, "ids"), ids(F.col(text)).alias("ids"))


def bpe_decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` binary, the bytes of the ids (null ids: no bytes)."""

    @F.pandas_udf("binary")
    def decoded(each: pd.Series) -> pd.Series:
        code = byte_pairs(path, pattern)
        return each.map(lambda x: b"" if x is None else code.decode(x))

    return bounded_batches(encoded).select(*without(encoded, "decoded"), decoded(F.col(ids)).alias("decoded"))


def bpe_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` (lowercase hex) of each whole text.

    Each match of ``pattern`` is encoded separately by the ranks in the file ``path`` (which every executor has), and
    the digest of the decoded bytes is made from the ids. No special tokens.

    Cases: a null text counts as empty (no ids; digests of nothing); very long pre-tokens go through the rank queue
    and are not kept; repeated rows each get a row; an empty table gives none; columns named like outputs are replaced.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        code = byte_pairs(path, pattern)
        try:
            for texts in batches:
                yield pd.DataFrame(list(code.digests([t or "" for t in texts])), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:  # a worker that waits for its next task holds no store
            code.kept, code.older = {}, {}

    outs = ("n_tokens", "ids_sha256", "decoded_sha256")
    made = digests(F.col(text))
    name = fresh(docs, "digests")
    return bounded_batches(docs).withColumn(name, made).select(*without(docs, *outs), *(F.col(name)[c].alias(c) for c in outs))
