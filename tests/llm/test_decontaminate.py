import math
import re
from itertools import combinations

import pytest

from loomspan.llm import common, decontaminate
from tests.llm.cases import TEXTS, frame, pairs, sentence

ITEMS = [(1, " ".join(sentence(1, 120).split()[20:60])), (2, "too short to count here"), (3, None), (4, ""), (5, sentence(77, 30)), (None, sentence(78, 12)), (5, sentence(79, 9)), (7, sentence(80, 8))]


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(texts, items, window=13):
    out = set()
    for i, text in texts:
        x = tokens(text)
        for j, item in items:
            y = tokens(item)
            w = min(window, len(y))
            if w < 8:
                continue
            allowed = int(w * 0.2) if w >= 11 else 1
            if any(sum(a != b for a, b in zip(x[p : p + w], y[q : q + w])) <= allowed for p in range(len(x) - w + 1) for q in range(len(y) - w + 1)):
                out.add((i, j))
    return out


def benchmark(spark, items=None):
    return spark.createDataFrame(ITEMS if items is None else items, "item_id long, text string")


def result(df, items):
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items).collect()}


def planted():
    out = []
    for k, subs in enumerate([(), (3,), (3, 9), (1, 5), (0, 12), (2, 6), (2, 6, 10)]):
        words = tokens(ITEMS[4][1])[4:17]
        for s in subs:
            words[s] = "swapped"
        out.append((100 + k, sentence(500 + k, 30) + " " + ", ".join(words) + " " + sentence(600 + k, 30)))
    out.append((200, "ABC " + ITEMS[5][1].upper() + "!"))
    out.append((201, ITEMS[7][1]))
    out.append((202, " ".join(tokens(ITEMS[6][1])[:8])))
    return out


def test_planted_passages(spark):
    texts = [x for x in TEXTS if not x[1] or len(x[1]) < 5000] + planted()
    got = result(pairs(spark, texts), benchmark(spark))
    assert got == brute(texts, ITEMS)
    assert {(100, 5), (102, 5), (200, None), (201, 7)} <= got and (106, 5) not in got and (202, 5) not in got


def test_masks_hit_all_allowed_windows():
    for w in range(decontaminate.LEAST, 14):
        allowed = int(w * 0.2) if w >= 11 else 1
        for bad in combinations(range(w), allowed):
            assert any(all(o + k not in bad for k in mask) for mask in decontaminate.MASKS for o in range(w - mask[-1]))
        assert allowed == (math.floor(w * 0.2) if w >= 11 else 1)


def test_without_broadcasts(spark, monkeypatch):
    """Whatever the counts say, seeds, hits and items are joined by shuffles; with hot items and without."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    texts = planted() + [(None, planted()[0][1]), (None, None), (100, planted()[0][1])]
    assert result(pairs(spark, texts), benchmark(spark)) == brute(texts, ITEMS)
    monkeypatch.setattr(common, "HOT_SHARE", 0)
    assert result(pairs(spark, texts), benchmark(spark)) == brute(texts, ITEMS)


def test_clean_documents_stay(spark):
    kept = decontaminate.without_contaminated(frame(spark), benchmark(spark))
    gone = {i for i, _ in brute([x for x in TEXTS if not x[1] or len(x[1]) < 5000], ITEMS)}
    assert {0, 1, 2, None} <= gone
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in TEXTS if i not in gone)
    assert kept.columns == frame(spark).columns


def test_empty_tables(spark):
    assert decontaminate.contaminated(pairs(spark, []), benchmark(spark)).count() == 0
    assert decontaminate.contaminated(pairs(spark, TEXTS[:5]), benchmark(spark, [])).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contaminated(pairs(spark, []), benchmark(spark), window=20)
