import numpy as np
import pytest

from loomspan.llm import common, nearest, queries
from tests.conftest import DATA


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        found = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)
        out[q] = [(i, d) for d, i in found[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, e int, v int, lists int, part int")


def test_recall_and_scores(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    expected = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = answers(queries.op6_nearest(spark, DATA))
    assert got.keys() == expected.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)
    vectors = dict(rows)
    for q, found in got.items():
        assert [d for _, d in found] == sorted(d for _, d in found)
        for i, d in found:
            assert d == pytest.approx(float(np.sqrt(((np.array(vectors[q]) - np.array(vectors[i])) ** 2).sum())), abs=1e-12)


def test_all_lists_and_small_blocks_are_exact_on_ties(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 16)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    monkeypatch.setattr(nearest, "EPSILON", 50.0)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(1, 4, 5) / 4).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 5) for i in range(80)]
    df = table(spark, [(i, v, 1, 1, 1, 1) for i, v in rows])
    asked = [r for r in rows if r[0] % 50 == 0]
    got = answers(nearest.nearest(df, df.where("vec_id % 50 = 0"), k=7, probed=1.0))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in brute(rows, asked, 7).items()}


def test_vectors_meet_those_of_their_own_length(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(8, 3, 5)[i % 3]).tolist()) for i in range(120)] + [(1000, [1.0] * 7), (1100, [2.0] * 7), (1200, [1.0] * 9)]
    df = table(spark, [(i, v, 1, 1, 1, 1) for i, v in rows])
    asked = [r for r in rows if r[0] % 100 == 0]
    expected = {q: [i for i, _ in brute([r for r in rows if len(r[1]) == len(v)], [(q, v)], 4)[q]] for q, v in asked}
    got = answers(nearest.nearest(df, df.where("vec_id % 100 = 0"), k=4, probed=1.0))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: x for q, x in expected.items() if x}


def test_a_query_that_finds_too_few_is_asked_again(spark):
    rows = [(i, [float(i), 1.0]) for i in range(400)] + [(500, [1e6, 1.0])]
    df = table(spark, [(i, v, 1, 1, 1, 1) for i, v in rows])
    got = answers(nearest.nearest(df, df.where("vec_id = 500"), k=10, probed=0.001))
    assert [i for i, _ in got[500]] == list(range(399, 389, -1))


def test_recall_at_two_sizes_with_and_without_structure(spark):
    """Few lists are probed where vectors have structure; recall holds either way."""
    rng = np.random.default_rng(11)
    for n, groups in ((1500, 0), (1500, 30), (6000, 0), (6000, 60)):
        v = rng.normal(size=(n, 16))
        if groups:
            v = rng.normal(size=(groups, 16))[rng.integers(0, groups, n)] * 5 + v * 0.2
        rows = [(i, x) for i, x in enumerate(v.tolist())]
        df = table(spark, [(i, x, 1, 1, 1, 1) for i, x in rows])
        got = answers(nearest.nearest(df, df.where("vec_id % 100 = 0"), k=10))
        near = np.sqrt(((v[::100, None, :] - v[None]) ** 2).sum(axis=2))
        near[np.arange(len(near)), np.arange(0, n, 100)] = np.inf
        true = np.argsort(near, axis=1)[:, :10]
        hits = sum(len({i for i, _ in got[100 * k]} & set(true[k].tolist())) for k in range(len(true)))
        assert hits >= 0.95 * 10 * len(true), (n, groups, hits)
        found = nearest.centres(v, int(n**0.5))
        assert (nearest.probes_needed(v, found, 10) < len(found) // 3) == bool(groups)


def test_the_sample_is_bounded_and_never_empty():
    for n in (1, 20_000, 10**6, 2 * 10**10, 10**11, 10**15):
        rate = (common.threshold(20_000, n) + 2**63) / 2**64
        assert abs(rate - min(1, 20_000 / n)) <= 2**-63 and rate > 0


def test_invalid_vectors_take_no_part(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1.0, 1.0]), (1, [2.0, 0.0])]
    bad = [(3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (200, [0.0, 0.0])]
    df = table(spark, [(i, v, 1, 1, 1, 1) for i, v in good + bad])
    got = answers(nearest.nearest(df, df.where("vec_id % 100 = 0"), k=10))
    assert list(got) == [100] and [i for i, _ in got[100]] == [1, 2, 1]


def test_empty_tables(spark):
    df = table(spark, [])
    assert nearest.nearest(df, df).count() == 0
    one = table(spark, [(100, [1.0, 2.0], 1, 1, 1, 1)])
    assert nearest.nearest(one, one).count() == 0
    assert nearest.nearest(one, df).count() == 0
