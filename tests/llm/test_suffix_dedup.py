import random
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import suffix_dedup, suffix_sort
from tests.llm.cases import TEXTS, frame, pairs, sentence


def brute(texts):
    least = {}
    for i, t in texts:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            least[w] = min(least.get(w, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < (float("inf") if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(raw), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.repeated_spans(df).collect())


def small_texts():
    rng = random.Random(8)
    common = sentence(21, 30)
    out = [(k, f"{sentence(30 + k, rng.randint(1, 30))} {common if k % 2 else ''} {sentence(90 + k % 7, 25)} é漢{'x' * rng.randint(0, 120)}") for k in range(60)]
    return out + [(60, "ab" * 200), (61, "ab" * 150), (62, "a" * 400), (63, "a" * 49), (64, "a" * 50), (64, "a" * 60)]


@pytest.mark.parametrize("common", [64, 3])
def test_spans(spark, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 3000)
    assert result(pairs(spark, small_texts())) == brute(small_texts())


def test_odd_rows(spark):
    texts = [x for x in TEXTS if not x[1] or len(x[1]) < 50_000]
    assert result(frame(spark, texts)) == brute(texts)


def test_a_very_long_text_and_the_largest_id(spark):
    long = sentence(61, 30_000)
    texts = [(2**63 - 1, long[1000:3000]), (5, long), (None, long[:500]), (6, "x" * 120_000), (7, "x" * 60), (8, long[50_000:50_200])]
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(pairs(spark, texts)).collect()}
    gone = {i: [(s.start, s.end) for s in r.spans] for i, r in got.items()}
    assert gone == {2**63 - 1: [(0, 2000)], 5: [], None: [(0, 500)], 6: [], 7: [(0, 60)], 8: [(0, 200)]}
    assert got[5].n_bytes == len(long) and bytes(got[6].kept) == b"x" * 120_000


def test_rows_sent_grow_in_proportion():
    for total in (0, 10**9, 10**12, 10**14):
        chunks, buckets = suffix_dedup.pieces_of(total)
        assert chunks * buckets <= max(1, total / 100) and total / chunks < 2 << 27
    assert suffix_dedup.pieces_of(10**9) == (239, 239)


def test_bytes_decide():
    text = b"abcdefghijklmnopqrstuvwxyz" * 2 + b"abcdefghijklmnoXqrstuvwxyz" + bytes(8)
    a, b = np.array([0, 0, 0, 5]), np.array([26, 52, 52, 57])
    assert suffix_dedup._equal_bytes(text, a, b, np.array([26, 15, 16, 10])).tolist() == [True, True, False, True]


def test_empty_table(spark):
    assert suffix_dedup.repeated_spans(pairs(spark, [])).count() == 0


def test_every_window_is_in_one_context_and_equal_windows_share_an_anchor(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STRETCH", 333)
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") if k % 3 == 0 else rng.choice(b"abcdefgh ") for _ in range(rng.choice([10, 49, 50, 51, 700]))) for k in range(20)] + [b"z" * 900]
    ends = np.cumsum([len(t) for t in texts])
    text = b"".join(texts)
    s0, s1, anchor, *_ = suffix_dedup.contexts(text, ends)
    windows = [w for a, b in zip(s0, s1) for w in range(a, b + 1)]
    inside = [e - len(t) + p for t, e in zip(texts, ends) for p in range(len(t) - 49)]
    assert sorted(windows) == sorted(inside)
    names = {}
    for a, b, h in zip(s0, s1, anchor):
        for w in range(a, b + 1):
            assert names.setdefault(text[w : w + 50], h) == h


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd", bytes(range(97, 123))])
def test_suffix_order(letters):
    rng = random.Random(7)
    for n in (50, 60, 300, 2000):
        text = bytes(rng.choice(letters) for _ in range(n))
        text += text[n // 3 :]
        words, at = suffix_sort.words_at(text), np.arange(len(text) - 49)
        for block in (10, 200, 10**6):
            got = np.concatenate(list(suffix_sort.sorted_suffixes(words, at, block)))
            leading = [text[i : i + 50] for i in got]
            assert sorted(got) == list(at) and leading == sorted(leading)
            assert suffix_sort.equal_runs(words, got).tolist() == [k for k in range(len(leading)) if not k or leading[k] != leading[k - 1]]


def test_the_cover_has_every_difference():
    cover = suffix_sort.COVER
    assert {(a - b) % suffix_sort.V for a in cover for b in cover} == set(range(suffix_sort.V))
