from collections import Counter

import numpy as np
import pandas as pd

from loomspan.llm import common, ngram_join
from loomspan.llm.stars import components
from tests.llm.cases import CLASH_UPPER, TEXTS, frame, near, pairs, sentence


def grams(text, n=5):
    w = (text or "").lower().split()
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(texts, threshold=0.8):
    sets, parent, links = [grams(t) for _, t in texts], list(range(len(texts))), [0] * len(texts)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = {}
    for i, (name, _) in enumerate(texts):
        if name is not None:
            ids[find(i)] = min(name, ids.get(find(i), name))
    return Counter((name, ids.get(find(i)), links[i]) for i, (name, _) in enumerate(texts))


def result(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect())


def test_odd_rows(spark):
    assert result(frame(spark)) == brute(TEXTS)
    assert result(frame(spark, clash=CLASH_UPPER)) == brute(TEXTS)


def test_without_broadcasts_and_with_hot_keys(spark, monkeypatch):
    """Texts, components and buckets are joined by shuffles; first every key is hot, then none is."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    base = sentence(31, 60)
    texts = TEXTS[:12] + [(400 + k, base) for k in range(40)] + [(500 + k, near(base, k)) for k in range(30)] + [(600 + k, None) for k in range(40)]
    for share in (10**6, 0, 8):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert result(pairs(spark, texts)) == brute(texts)


def test_blocks_are_bounded_by_length(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CHARS", 3000)
    base = sentence(41, 150)
    texts = [(i, near(base, 3 * i)) for i in range(20)]
    assert result(pairs(spark, texts)) == brute(texts)


def test_one_of_each_keeps_all_columns(spark):
    df = frame(spark, clash=CLASH_UPPER)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    expected = Counter()
    for (i, c, _), times in brute(TEXTS).items():
        expected[i] += times * (c is None or i == c)
    assert Counter(r.doc_id for r in kept.collect()) == +expected


def test_a_large_group_is_done_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = sentence(9, 150)
    texts = [(i, near(base, 3 * i)) for i in range(40)] + [(100 + i, sentence(200 + i, 60)) for i in range(20)] + [(200, base), (201, base)]
    assert result(pairs(spark, texts)) == brute(texts)


def test_similarities_at_the_threshold(spark):
    base = sentence(11, 200)
    texts = [(i, " ".join(base.split()[: 200 - 4 * i])) for i in range(12)]
    assert result(pairs(spark, texts)) == brute(texts)


def test_exact_count_both_ways():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 250).astype(np.uint64)) for _ in range(60)]
    a, b = np.triu_indices(60, 1)
    slow = [len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert ngram_join.verified(sets, a, b, 0.5).tolist() == slow
    few = a[:2], b[:2]
    assert ngram_join.verified(sets, *few, 0.5).tolist() == slow[:2]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    kept = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 800).astype(np.uint64)
        a, b = both[:720], both[80:]  # similarity 640 / 800
        sigs = np.stack([ngram_join.signature(np.sort(a)), ngram_join.signature(np.sort(b))])
        words = sigs.view(np.uint32)[:, : ngram_join.BANDS]
        bands = np.flatnonzero(words[0] == words[1])
        kept += bool(len(bands)) and len(ngram_join.surviving(pd.DataFrame({"band": bands[0], "i": 0, "j": 0, "side": [0, 0]}), sigs, 0.8)[0]) == 1
    assert kept == 300
    fewest = ngram_join.fewest_matches(0.8)
    assert list(fewest) == sorted(fewest) and fewest[-1] > 60


def test_one_of_each(spark):
    kept = ngram_join.one_of_each(frame(spark)).collect()
    classes = Counter(brute(TEXTS).elements())
    expected = Counter(i for i, c, _ in classes.elements() if c is None or i == c)
    assert Counter(r.doc_id for r in kept) == expected


def test_empty_table(spark):
    assert ngram_join.ngram_join(pairs(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 5), (7, 8), (8, 7), (6, 6), (None, 1)], "u int, v int")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 1, 7: 7, 8: 7}
    assert components(edges.limit(0)).count() == 0
