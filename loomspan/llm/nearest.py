"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt into lists around centres. Within a probed list they are rotated at random, and their distances are
summed over one block of columns after another; after each block a hypothesis test asks whether the whole distance can
still be among the nearest found so far, and drops the candidate if not. What is left is measured on the original
vectors in double precision."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, small_enough, written

#: Vectors of the (bounded) sample that the centres are fitted on, and of them for each centre at least. There are as many
#: lists as the root of the number of vectors, up to that.
SAMPLE, PER_CENTRE = 20_000, 16

#: Share of true neighbours that the probed lists have to hold, and queries of the sample by which that is measured: of
#: vectors without structure, neighbours lie in nearly all lists, of others in few.
REACHED, MEASURED = 0.98, 256

#: Columns summed between tests; significance of the test (a candidate is dropped if its distance, scaled up from d
#: columns, exceeds the bound by more than EPSILON / sqrt(d) of it).
COLUMNS, EPSILON = 16, 2.1

#: Candidates and queries that meet at once, and candidates between two looks at the bound.
CANDIDATES, QUERIES, CHUNK = 4_096, 4_096, 512

_SEED = 20240301


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centres of a sample; a centre that loses all its vectors stays where it was."""
    rng = np.random.default_rng(_SEED)
    found = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest_lists(sample, found, 1)[:, 0]
        n = np.bincount(near, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, near, sample)
        found[n > 0] = total[n > 0] / n[n > 0, None]
    return found


def nearest_lists(vectors: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    far = (found**2).sum(axis=1) - 2 * vectors @ found.T
    if k == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :k]


class Lists(NamedTuple):
    """Centres of the vectors of one length, and how many lists a query probes."""

    centres: np.ndarray
    probed: int


def probes_needed(sample: np.ndarray, found: np.ndarray, k: int, reached: float = REACHED) -> int:
    """How many of the nearest lists hold the share ``reached`` of the true neighbours, by brute force on the sample."""
    asked = np.random.default_rng(_SEED).choice(len(sample), min(MEASURED, len(sample)), replace=False)
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(found)
    place = np.argsort(nearest_lists(sample[asked], found, len(found)), axis=1)  # of each list, for each query
    home = nearest_lists(sample, found, 1)[:, 0]
    away = (sample**2).sum(axis=1) - 2 * sample[asked] @ sample.T
    away[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(away, k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(reached * len(needed))))]) + 1


def fitted(valid: DataFrame, n: int, k: int, probed: float | None = None, lists: int | None = None) -> dict[int, Lists]:
    """Lists for each length of vector that has enough vectors in a sample of about SAMPLE, twice that at most, drawn by a
    hash of the id. Vectors of other lengths (there are few) are one list for each length."""
    rows = valid.where(drawn(F.xxhash64("vec_id"), SAMPLE, n)).limit(2 * SAMPLE).orderBy("vec_id", "e").toArrow()["e"].combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    flat, starts = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()[:-1]
    out = {}
    for size in np.unique(sizes).tolist():
        sample = flat[starts[sizes == size][:, None] + np.arange(size)]
        most = lists or int((n * len(sample) / len(sizes)) ** 0.5)
        found = centres(sample, max(1, min(most, len(sample) // PER_CENTRE)))
        out[size] = Lists(found, probes_needed(sample, found, k) if probed is None else max(1, int(np.ceil(len(found) * probed))))
    return out


def scan(query: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest of ``data`` (but vectors of its own id): index of the query, id, distance."""
    size = query.shape[1]
    turn = rotation(size)
    rq, rd = query @ turn, data @ turn
    best_d, best_i = np.full((len(query), k), np.inf), np.full((len(query), k), np.iinfo(np.int64).max)
    order = np.lexsort((ids, ((data - query.mean(axis=0)) ** 2).sum(axis=1)))  # likely ones first: the bound falls early
    for at in range(0, len(order), CHUNK):
        these = order[at : at + CHUNK]
        bound = best_d[:, -1] ** 2
        c = rd[these]
        d = min(COLUMNS, size)
        part = (rq[:, None, :d] - c[None, :, :d]) ** 2
        sums = part.sum(axis=2)
        q, x = np.nonzero((sums * (size / d) <= (bound * (1 + EPSILON / d**0.5) ** 2)[:, None]) & (ids[these][None, :] != query_ids[:, None]))
        sums = sums[q, x]
        while d < size:
            e = min(d + COLUMNS, size)
            sums = sums + ((rq[q, d:e] - c[x, d:e]) ** 2).sum(axis=1)
            d = e
            slack = (1 + EPSILON / d**0.5) ** 2 if d < size else 1 + 1e-9
            stay = sums * (size / d) <= bound[q] * slack
            q, x, sums = q[stay], x[stay], sums[stay]
        if not len(q):
            continue
        exact = np.sqrt(((query[q] - data[these[x]]) ** 2).sum(axis=1))
        for i in np.unique(q):
            mine = q == i
            dist, name = np.concatenate([best_d[i], exact[mine]]), np.concatenate([best_i[i], ids[these[x[mine]]]])
            first = np.lexsort((name, dist))[:k]
            best_d[i], best_i[i] = dist[first], name[first]
    q, j = np.nonzero(np.isfinite(best_d))
    return q, best_i[q, j], best_d[q, j]


_LISTED = "vec_id long, v binary, size int, lists array<int>"


def listed(df: DataFrame, model: dict[int, Lists], most: int | None) -> DataFrame:
    """Each vector with its nearest lists: ``most``, or as many as its length's queries probe."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["e"].map(len)):
                v = np.array(part["e"].tolist(), np.float64).reshape(-1, size)
                found = model.get(int(size), Lists(np.zeros((1, size)), 1))
                lists = nearest_lists(v, found.centres, min(most or found.probed, len(found.centres))).astype(np.int32)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "v": [x.tobytes() for x in v], "size": np.int32(size), "lists": list(lists)})

    return df.mapInPandas(near, _LISTED)


def _met(data: pd.DataFrame, query: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(data) or not len(query):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    size = int(data["size"].iloc[0])
    as_array = lambda p: np.frombuffer(b"".join(p["v"]), np.float64).reshape(-1, size)
    own = query["vec_id"].to_numpy(np.int64)
    q, ids, dist = scan(as_array(query), own, as_array(data), data["vec_id"].to_numpy(np.int64), k)
    return pd.DataFrame({"query_id": own[q], "vec_id": ids, "score": dist})


def searched(indexed: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of ``indexed`` for each row of ``probes`` in the lists that it names (both as ``listed`` gives them,
    written). A list's vectors are split into blocks and its queries into parts by counts, so that a task holds CANDIDATES
    vectors and QUERIES queries of one list; a list's vectors are sent once for each part of its own queries."""
    place = ["size", "list"]
    data = indexed.select("vec_id", "v", "size", F.col("lists")[0].alias("list"))
    asked = probes.select("vec_id", "v", "size", F.explode("lists").alias("list"))
    pieces = lambda most: F.ceil(F.count("*") / most).cast("int")
    plan = data.groupBy(*place).agg(pieces(CANDIDATES).alias("blocks")).join(asked.groupBy(*place).agg(pieces(QUERIES).alias("parts")), place)
    plan = written(plan)
    plan = F.broadcast(plan) if small_enough(plan) else plan  # a row for each list
    row = F.monotonically_increasing_id()  # both are read from files, so a task that runs again gives the same
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.withColumn("row", row).join(plan, place).select("vec_id", "v", *place, F.pmod("row", F.col("blocks")).cast("int").alias("block"), every("parts").alias("part"))
    right = asked.withColumn("row", row).join(plan, place).select("vec_id", "v", *place, F.pmod("row", F.col("parts")).cast("int").alias("part"), every("blocks").alias("block"))
    keys = [*place, "block", "part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda d, q: _met(d, q, k), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", probed: float | None = None, lists: int | None = None) -> DataFrame:
    """``query_id`` long, ``rank`` int from 1, ``vec_id`` long, ``score`` double: the ``k`` nearest rows of ``vectors`` that
    were found for each row of ``queries`` by Euclidean distance, nearest first and the smaller id first among equals.

    Every valid row is indexed; only the centres are fitted on a sample of about SAMPLE rows. A query probes as many lists
    as the sample says that it needs (or the share ``probed``), nearest centres first; one that found fewer than ``k`` there
    is asked again in all lists.

    Cases: rows with a null id, and vectors that are null, zero, or hold a null or non-finite component, take no part;
    vectors are compared with those of their own length; a query's own id is never its neighbour; ids that repeat are
    candidates each, but as queries are asked once (the least vector); fewer candidates than ``k`` are all returned;
    without queries or candidates there are no rows; other columns are not read.
    """
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists("e", lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    valid = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e"), F.col(embedding)).where(fine).select("vec_id", "e")
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e"), F.col(embedding)).where(fine).groupBy("vec_id").agg(F.min("e").alias("e"))
    n = valid.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = fitted(valid, n, k, probed, lists)
    indexed = written(listed(valid, model, 1))
    found = written(searched(indexed, written(listed(asked, model, None)), k))
    partial = [size for size, x in model.items() if x.probed < len(x.centres)]
    if not partial:
        return found
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = written(asked.where(F.size("e").isin(partial)).join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    again = searched(indexed, written(listed(short, model, max(len(x.centres) for x in model.values()))), k)
    rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(found.columns)
    return rest.unionByName(again)
