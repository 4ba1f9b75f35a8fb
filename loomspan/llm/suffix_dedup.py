"""Removal of 50-byte strings that a document with a smaller id holds too, by suffix sorting dealt out over a cluster.

A window of 50 bytes is named by its anchor: of the 24-byte grams in it, the one whose hash is least (the leftmost of
equals). Equal windows have equal anchors, so windows can be brought together by anchor, in buckets, and no two that are
equal are ever apart. Consecutive windows of one anchor form a context. A window has 13 bytes or more
beside its anchor on one side, so a context whose anchor with these, left or right, no other document has is done; one that
equals a context of a smaller document in its chunk, by its bytes, or elsewhere, by an 80-bit hash of all of them, goes
whole; what is left is sent as bytes to its bucket, where the windows are sorted as suffixes (``suffix_sort``: block by block,
with a difference cover) and runs of equal windows find their smallest document."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_sort

#: Bytes of a window, of an anchor gram, and grams of a window.
WINDOW = suffix_sort.DEPTH
GRAM = 24
GRAMS = WINDOW - GRAM + 1
BESIDE = (WINDOW - GRAM) // 2

#: Bytes of text that are handled together (a chunk, expected), and for which there is one bucket, at least; parts of a
#: bucket whose bytes are sorted apart. A chunk sends each bucket one row, so both grow with the root of all bytes where these
#: are many: a row then holds some CONTEXTS_SENT contexts, and rows grow in proportion to the bytes.
CHUNK, BUCKET, PARTS, CONTEXTS_SENT = 4 << 20, 4 << 20, 4, 16

#: An anchor with this many different contexts in one chunk is a common phrase: its windows are dealt out one by one.
COMMON = 64

#: Positions hashed at a time.
_STRETCH = 1 << 15

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_COMMON_MARK = np.uint64((1 << 48) - 1)
_LAST_ID = np.iinfo(np.int64).max  # of a null id: such a row is smaller than none


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M4
    x ^= x >> np.uint64(29)
    return x


def contexts(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The contexts of documents that lie one after another in ``text`` and end at ``ends``: first and last window start,
    hash of the anchor, hash of the context's bytes, short hashes of the bytes left and right of the anchor (0 where no
    window of the context has as many). Every window inside a document is in one context."""
    total, padded = len(text), text + bytes(256)
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, total - WINDOW + 1), _STRETCH):
        n = min(_STRETCH, total - WINDOW + 1 - at)  # windows that start in this stretch
        m = n + 2 * WINDOW  # grams that they and their contexts need
        raw = np.frombuffer(padded, np.uint8, min(m + GRAM + 8, len(padded) - at), at)
        x = np.lib.stride_tricks.as_strided(raw[: len(raw) - 7].view(), (len(raw) - 7, 8), (1, 1)).copy().view("<u8").ravel()
        m = min(m, len(x) - 16)
        h = _mixed(x[:m] * _M1 + x[8 : m + 8] * _M2 + x[16 : m + 16] * _M3)
        o = (h >> np.uint64(32)).astype(np.uint32)
        low = o[: n + GRAMS - 1]
        for step in (1, 2, 4, 8, 11):  # minima over 2, 4, 8, 16 and 27 grams
            low = np.minimum(low[:-step], low[step:])
        mine = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + WINDOW, "right") + 1] - at
        cut = np.zeros(n + 1, bool)
        cut[0] = True
        cut[1:n] = low[1:] != low[:-1]
        cut[mine[(mine > 0) & (mine < n)]] = True
        over = mine - WINDOW + 1
        cut[over[(over > 0) & (over < n)]] = True
        start = np.flatnonzero(cut[:n])
        stop = np.append(start[1:], n)
        fits = start + WINDOW <= mine[np.searchsorted(mine, start, "right")]
        start, stop = start[fits], stop[fits]
        near = np.lib.stride_tricks.sliding_window_view(o[: n + GRAMS - 1], GRAMS)
        anchor = start + near[start].argmin(axis=1)
        tie = stop - 1 > anchor  # another gram of equal hash follows
        rest = np.concatenate([np.arange(a, b) for a, b in zip(anchor[tie] + 1, stop[tie], strict=True)]) if tie.any() else np.empty(0, np.int64)
        if len(rest):
            stop = np.minimum(stop, anchor + 1)
            owner = rest + near[rest].argmin(axis=1)
            start, stop, anchor = np.concatenate([start, rest]), np.concatenate([stop, rest + 1]), np.concatenate([anchor, owner])
            order = np.argsort(start, kind="stable")
            start, stop, anchor = start[order], stop[order], anchor[order]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != stop[:-1])
        first = np.flatnonzero(new)
        s0, s1, p = start[first], stop[np.append(first[1:], len(start)) - 1] - 1, anchor[first]
        tail = s1 + WINDOW - GRAM
        c = h[s0] * _M1 + h[np.minimum(s0 + GRAM, tail)] * _M2 + h[np.minimum(s0 + 2 * GRAM, tail)] * _M3
        beside = []
        for fits, b in ((p - s0 >= BESIDE, np.maximum(p - BESIDE, 0)), (s1 + WINDOW - p - GRAM >= BESIDE, p + GRAM)):
            short = (_mixed(x[b] * _M1 + x[b + BESIDE - 8] * _M2) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
            beside.append(np.where(fits, short, np.uint16(0)))
        parts.append((s0 + at, s1 + at, h[p], _mixed(_mixed(c + (s1 - s0).astype(np.uint64)) + h[tail]), *beside))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint16, np.uint16))
    return tuple(np.concatenate([x[i] for x in parts]) for i in range(6))


class _Chunk:
    """The documents of one chunk, in order of id and text, with their contexts sorted by bucket, anchor, hash and id."""

    def __init__(self, rows: pd.DataFrame, n_buckets: int, sort: bool = True):
        rows = rows.sort_values(["id", "nameless", "text"], kind="stable")
        self.nameless = rows["nameless"].tolist()
        self.ids, texts = rows["id"].to_numpy(np.int64), rows["text"].tolist()
        self.text, self.ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not sort:
            return
        s0, s1, anchor, whole, left, right = contexts(self.text, self.ends)
        doc = np.searchsorted(self.ends, s0, "right")
        self.n_buckets = n_buckets
        anchor = _mixed(anchor * _M2)  # anchors are least hashes: mixed again, they are even
        bucket = ((anchor >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)
        anchor, whole = anchor & np.uint64((1 << 32) - 1), whole % _COMMON_MARK
        order = np.lexsort((doc, whole, anchor, bucket))  # doc is in order of id
        self.s0, self.s1, self.doc, self.bucket, self.anchor, self.whole, self.left, self.right = (x[order] for x in (s0, s1, doc, bucket, anchor, whole, left, right))
        n = len(order)
        same_anchor, same = np.zeros(n, bool), np.zeros(n, bool)
        same_anchor[1:] = (self.anchor[1:] == self.anchor[:-1]) & (self.bucket[1:] == self.bucket[:-1])
        same[1:] = same_anchor[1:] & (self.whole[1:] == self.whole[:-1]) & (self.s1[1:] - self.s0[1:] == self.s1[:-1] - self.s0[:-1])
        alike = np.flatnonzero(same)  # of one hash: the bytes decide
        same[alike] = _equal_bytes(self.text, self.s0[alike], self.s0[alike - 1], self.s1[alike] - self.s0[alike] + WINDOW)
        self.group = np.cumsum(~same) - 1  # equal contexts
        first = np.flatnonzero(~same)
        #: contexts of documents above the smallest that has them here go without asking anyone
        self.repeated = self.ids[self.doc] > self.ids[self.doc[first]][self.group] if n else np.empty(0, bool)
        kind = np.cumsum(~same_anchor) - 1
        per_anchor = np.bincount(kind[first]) if n else np.empty(0, np.int64)
        self.common = per_anchor[kind] >= COMMON if n else np.empty(0, bool)
        #: what is asked of the bucket: one row for each distinct context, or one for a common anchor
        head = np.where(self.common, ~same_anchor, ~same)
        self.asked = np.flatnonzero(head)
        self.answer_of = np.cumsum(head) - 1

    def asks(self) -> pd.DataFrame:
        a = self.asked
        b = self.bucket[a]
        whole = np.where(self.common[a], _COMMON_MARK, self.whole[a])
        bounds = np.searchsorted(b, np.arange(self.n_buckets + 1))
        rows = []
        for k in np.unique(b):
            part = slice(bounds[k], bounds[k + 1])
            docs, at = np.unique(self.doc[a[part]], return_inverse=True)
            rows.append((int(k), self.ids[docs].tobytes(), at.astype(np.uint16 if len(docs) < 65536 else np.uint32).tobytes(), self.anchor[a[part]].astype(np.uint32).tobytes(), whole[part].astype(np.uint32).tobytes(), (whole[part] >> np.uint64(32)).astype(np.uint16).tobytes(), self.left[a[part]].tobytes(), self.right[a[part]].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "ids", "doc", "a4", "w4", "w2", "left", "right"])


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """For a bucket: 0, no smaller document has it; 1, goes whole; 2, send the bytes; 3, send window by window."""
    size = [len(x) // 4 for x in rows["a4"]]
    anchor = np.frombuffer(b"".join(rows["a4"]), np.uint32)
    whole = np.frombuffer(b"".join(rows["w4"]), np.uint32).astype(np.uint64) | np.frombuffer(b"".join(rows["w2"]), np.uint16).astype(np.uint64) << np.uint64(32)
    doc = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint16 if len(d) < 4 * n else np.uint32)] for i, d, n in zip(rows["ids"], rows["doc"], size, strict=True)])
    order = np.lexsort((doc, whole, anchor))
    a, w, d = anchor[order], whole[order], doc[order]
    new_a, new_w = np.ones(len(a), bool), np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_w[1:] = new_a[1:] | (w[1:] != w[:-1])
    ga, gw = np.cumsum(new_a) - 1, np.cumsum(new_w) - 1
    at_a, at_w = np.flatnonzero(new_a), np.flatnonzero(new_w)
    common = np.logical_or.reduceat(w == _COMMON_MARK, at_a)
    varied = np.bincount(ga[at_w]) > 1
    answer = np.where(d > d[at_w][gw], 1, np.where(varied[ga], 2, 0))
    shared = np.zeros(len(a), bool)
    for side in ("left", "right"):
        key = a.astype(np.uint64) << np.uint64(16) | np.frombuffer(b"".join(rows[side]), np.uint16)[order]
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.append(True, key[by[1:]] != key[by[:-1]]))
        least, most = np.minimum.reduceat(d[by], start), np.maximum.reduceat(d[by], start)
        shared[by] |= np.repeat(least < most, np.diff(np.append(start, len(by)))) & (key[by] & np.uint64(0xFFFF) > 0)
    answer = np.where(common[ga], 3, np.where((answer == 2) & ~shared, 0, answer)).astype(np.uint8)
    out = np.empty(len(answer), np.uint8)
    out[order] = answer
    return pd.DataFrame([(c, b, zlib.compress(x.tobytes(), 1)) for c, b, x in zip(rows["chunk"], rows["bucket"], np.split(out, np.cumsum(size)[:-1]), strict=True)], columns=["chunk", "bucket", "answer"])


def pieces_of(total: int) -> tuple[int, int]:
    """Chunks and buckets for so many bytes."""
    even = int((total * GRAMS / 2 * CONTEXTS_SENT) ** 0.5)  # a context has some GRAMS / 2 windows of its own
    return max(1, -(-total // max(CHUNK, even))), max(1, -(-total // max(BUCKET, even)))


def _equal_bytes(text: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` on equal those from ``b`` on, for ``size`` bytes (8 at least)."""
    raw = np.frombuffer(text, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (max(0, len(raw) - 7), 8), (1, 1))
    at = lambda x: words[x].view("<u8").ravel()
    out = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        off = np.minimum(k, size - 8)
        out &= at(a + off) == at(b + off)
    return out


def _joined_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as sorted spans that don't touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


_WORK = "kind int, key long, chunk long, a binary, b binary, ids binary, raw binary"


def _work(chunk: _Chunk, number: int, answers: pd.DataFrame) -> pd.DataFrame:
    """Of a chunk that was answered: kind 0, spans that are known to go; kind 1, contexts to be sorted in their bucket."""
    if not len(chunk.s0):
        return pd.DataFrame(columns=[c.split()[0] for c in _WORK.split(", ")])
    answers = answers.sort_values("bucket", kind="stable")
    told = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in answers["answer"]])[chunk.answer_of]
    gone = (told == 1) | chunk.repeated
    spans_a, spans_b = [chunk.s0[gone]], [chunk.s1[gone] + WINDOW]
    send = ~gone & (told == 2)
    at, last, key = chunk.s0[send], chunk.s1[send], chunk.bucket[send] * PARTS + (chunk.anchor[send] % np.uint64(PARTS)).astype(np.int64)
    one = ~gone & (told == 3)
    if one.any():  # windows one by one, in buckets of their own hash; repeats within the chunk are settled here
        n = chunk.s1[one] - chunk.s0[one] + 1
        w = np.repeat(chunk.s0[one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.frombuffer(chunk.text + bytes(8), np.uint8)
        h = np.zeros(len(w), np.uint64)
        for k in (0, 8, 16, 24, 32, 40, 42):
            h = _mixed(h * _M1 + text[w[:, None] + np.arange(k, k + 8)].view("<u8").ravel())
        ids = chunk.ids[np.searchsorted(chunk.ends, w, "right")]
        order = np.lexsort((ids, h))
        w, h, ids = w[order], h[order], ids[order]
        new = np.ones(len(w), bool)
        new[1:] = (h[1:] != h[:-1]) | ~_equal_bytes(chunk.text, w[1:], w[:-1], np.full(max(0, len(w) - 1), WINDOW))
        repeat = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        spans_a, spans_b = [*spans_a, w[repeat]], [*spans_b, w[repeat] + WINDOW]
        at, last = np.concatenate([at, w[~repeat]]), np.concatenate([last, w[~repeat]])
        key = np.concatenate([key, ((h[~repeat] >> np.uint64(40)) * np.uint64(chunk.n_buckets * PARTS) >> np.uint64(24)).astype(np.int64)])
    a, b = _joined_spans(np.concatenate(spans_a), np.concatenate(spans_b))
    rows = [(0, number, number, a.tobytes(), b.tobytes(), b"", b"")] if len(a) else []
    order = np.argsort(key, kind="stable")
    at, last, key = at[order], last[order], key[order]
    ids = chunk.ids[np.searchsorted(chunk.ends, at, "right")]
    for k in np.unique(key):
        x = slice(*np.searchsorted(key, [k, k + 1]))
        raw = b"".join([chunk.text[p : q + WINDOW] for p, q in zip(at[x].tolist(), last[x].tolist(), strict=True)])
        rows.append((1, int(k), number, at[x].tobytes(), (last[x] - at[x]).astype(np.uint8).tobytes(), ids[x].tobytes(), raw))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _WORK.split(", ")])


def _sorted_out(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans to remove, from the contexts of one bucket; known spans pass through."""
    if rows["kind"].iloc[0] == 0:
        return rows[["chunk", "a", "b"]]
    size = [len(x) for x in rows["b"]]
    base = np.concatenate([np.frombuffer(x, np.int64) for x in rows["a"]])
    more = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["b"]]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
    words = suffix_sort.words_at(b"".join(rows["raw"]))
    place = np.cumsum(more + WINDOW) - (more + WINDOW)
    owner = np.repeat(np.arange(len(base)), more + 1)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    at = place[owner] + offset
    context_of = np.zeros(len(words), np.int32)
    context_of[at] = owner
    gone: list[np.ndarray] = []
    for s in suffix_sort.sorted_suffixes(words, at):
        first = suffix_sort.equal_runs(words, s)
        doc = ids[context_of[s]]
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(s))))
        gone.append(s[doc > least])
    s = np.concatenate(gone) if gone else np.empty(0, np.int64)
    c = context_of[s]
    start = base[c] + s - place[c]
    source = np.repeat(np.arange(len(size)), size)[c]
    out = []
    for k in np.unique(source):
        a, b = _joined_spans(start[source == k], start[source == k] + WINDOW)
        out.append((rows["chunk"].iloc[k], a.tobytes(), b.tobytes()))
    return pd.DataFrame(out, columns=["chunk", "a", "b"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: its id (``doc_id``), ``n_bytes`` long, ``spans`` array<struct<start:long,end:long>> of the
    bytes that go (maximal runs, in order), ``kept`` binary, the bytes that stay.

    A byte goes if a window of 50 bytes that covers it, inside this document, also starts in a document with a smaller
    id. Windows are judged on the texts as they came, as UTF-8.

    Cases: null and empty texts and texts under 50 bytes keep everything; rows of equal id take nothing from each
    other; a row with a null id counts as larger than all others; repeated rows each get a row; an empty table gives
    none. Texts are dealt into chunks by a hash of the id, so work is even however the table is laid out.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n_chunks, n_buckets = pieces_of(total)
    key = F.pmod(F.xxhash64(F.col(doc_id), F.substring(F.col(text), 1, 64)), F.lit(n_chunks))
    rows = docs.select(key.cast("long").alias("chunk"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST_ID)).alias("id"), F.col(doc_id).isNull().alias("nameless"), raw.alias("text"))

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        out = _Chunk(part, n_buckets).asks()
        out.insert(0, "chunk", part["chunk"].iloc[0])
        return out

    def work(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(answers):
            return pd.DataFrame(columns=[c.split()[0] for c in _WORK.split(", ")])
        return _work(_Chunk(part, n_buckets), int(part["chunk"].iloc[0]), answers)

    def finish(part: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(part, n_buckets, sort=False)
        a, b = _joined_spans(np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in spans["a"])]), np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in spans["b"])]))
        out, names, begin = [], [], 0
        cut = np.searchsorted(chunk.ends, a, "right")  # spans of different documents can touch: cut at the ends
        pieces: dict[int, list[tuple[int, int]]] = {}
        for d, x, y in zip(cut.tolist(), a.tolist(), b.tolist(), strict=True):
            while x < y:
                stop = min(y, int(chunk.ends[d]))
                if x < stop:
                    pieces.setdefault(d, []).append((x, stop))
                x, d = stop, d + 1
        for d, end in enumerate(chunk.ends.tolist()):
            mine = pieces.get(d, [])
            kept, at = [], begin
            for x, y in mine:
                kept.append(chunk.text[at:x])
                at = y
            kept.append(chunk.text[at:end])
            names.append(None if chunk.nameless[d] else int(chunk.ids[d]))
            out.append((end - begin, [{"start": x - begin, "end": y - begin} for x, y in mine], b"".join(kept)))
            begin = end
        made = pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])
        made.insert(0, "doc_id", pd.array(names, "Int64"))
        return made

    asked = rows.groupBy("chunk").applyInPandas(ask, "chunk long, bucket int, ids binary, doc binary, a4 binary, w4 binary, w2 binary, left binary, right binary")
    answered = asked.groupBy("bucket").applyInPandas(_answers, "chunk long, bucket int, answer binary")
    worked = rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(work, _WORK)
    spans = worked.groupBy("kind", "key").applyInPandas(_sorted_out, "chunk long, a binary, b binary")
    done = rows.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInPandas(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return done.withColumnRenamed("doc_id", doc_id)
