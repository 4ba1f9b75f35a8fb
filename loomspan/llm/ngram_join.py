"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word n-grams. Candidates share a band of MinHash values; their values are then compared a few at a
time, and a pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls below
a tolerance. Pairs that survive are verified exactly on their n-gram sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, marker, named, sifted, small_enough, spread_join, without, written
from .stars import components

#: MinHash values of a text (one byte each), values of a band, bands: a pair at similarity 0.8 shares none of the bands
#: with probability (1 - 0.8^4)^24, about 3 in a million.
VALUES, ROWS, BANDS = 128, 4, 24

#: Values compared before each look at the posterior, and the tolerance below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6

#: Texts of one block, and code points of their texts together (expected). A bucket of more is split into blocks, and each
#: pair of blocks is a piece of work.
BLOCK, BLOCK_CHARS = 256, 4 << 20

_MULTIPLY, _ADD = (np.random.default_rng(20240229).integers(1, 2**32, (2, VALUES), dtype=np.uint64) | 1).astype(np.uint32)
_WORDS: dict[str, int] = {}


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``n`` words (lower-cased, between white space). A text of fewer words
    is one run; one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 150_000:
        _WORDS.clear()
    get, ids = _WORDS.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids.append(h)
    h = np.array(ids, np.uint64)
    run = min(n, len(h))
    out = h[: len(h) - run + 1].copy()
    for k in range(1, run):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - run + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """One byte of each MinHash value of a set that isn't empty."""
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at : at + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    least ^= least >> np.uint32(16)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


@cache
def fewest_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each look, the fewest equal values with which a pair stays: with fewer, P(similarity >= threshold) under a
    uniform prior is below the tolerance. Bytes of unlike values are equal once in 256 times."""
    grid = (np.arange(4000) + 0.5) / 4000
    p = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        out.append(int(np.argmax(like[:, grid >= threshold].sum(axis=1) / like.sum(axis=1) >= tolerance)))
    return tuple(out)


def surviving(piece: pd.DataFrame, sigs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a piece of work that pass every look, and whose first common band is this one. Within one block
    all pairs are looked at; between two blocks (side 0 and 1) those across."""
    band, i, j = (int(piece[c].iloc[0]) for c in ("band", "i", "j"))
    side, across = piece["side"].to_numpy(), i != j
    fewest, step = fewest_matches(threshold), max(1, 2_000_000 // (STEP * max(1, len(sigs))))
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(sigs)),) * 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        equal = (sigs[rows, None, :STEP] == sigs[None, right, :STEP]).sum(axis=2, dtype=np.int16)
        a, b = np.nonzero(equal >= fewest[0])
        n, a, b = equal[a, b], rows[a], right[b]
        if not across:
            n, a, b = n[a < b], a[a < b], b[a < b]
        for look, need in enumerate(fewest[1:], 1):
            part = slice(look * STEP, (look + 1) * STEP)
            n = n + (sigs[a, part] == sigs[b, part]).sum(axis=1, dtype=np.int16)
            a, b, n = a[n >= need], b[n >= need], n[n >= need]
        found.append((a, b))
    a, b = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    words = sigs.view(np.uint32)[:, :BANDS]
    first = (words[a] == words[b]).argmax(axis=1) == band
    return a[first], b[first]


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets of each pair reach the threshold, counted exactly: one by one, or by an incidence matrix where
    many pairs of few n-grams are asked for."""
    size = np.array([len(s) for s in sets], np.int64)
    used = np.unique(np.concatenate([a, b]))
    total = int(size[used].sum())
    grams, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True) if len(used) else (np.empty(0), None)
    if len(a) * 2e-5 < 1e-3 + len(used) ** 2 * len(grams) / 2e10 or not len(a):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    else:
        row, place = np.repeat(np.arange(len(used)), size[used]), np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        counts = np.zeros((len(used), len(used)), np.float32)  # whole numbers below 2^24 stay exact
        order = np.argsort(column, kind="stable")
        bounds = np.searchsorted(column[order], np.arange(0, len(grams) + 4096, 4096))
        for k in range(len(bounds) - 1):
            these = order[bounds[k] : bounds[k + 1]]
            m = np.zeros((len(used), 4096), np.float32)
            m[row[these], column[these] - 4096 * k] = 1
            counts += m @ m.T
        common = counts[place[a], place[b]].astype(np.int64)
        assert total < 2**53
    return common >= threshold * (size[a] + size[b] - common) - 1e-9


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _pieces(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """Applies ``work`` to each piece (band, key, i, j); rows come sorted by these, in batches that may cut a piece."""
    held: list[pd.DataFrame] = []

    def of(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = batch[["band", "key", "i", "j"]]
        cut = np.flatnonzero((key.ne(key.shift())).any(axis=1).to_numpy()).tolist()
        return (batch.iloc[x:y] for x, y in zip(cut, [*cut[1:], len(batch)], strict=True))

    for batch in batches:
        if held:
            batch = pd.concat([*held, batch], ignore_index=True)
            held = []
        parts = list(of(batch))
        if parts:
            held = [parts.pop()]
        out = [x for p in parts if (x := work(p)) is not None]
        if out:
            yield pd.concat(out, ignore_index=True)
    for p in held:
        if (x := work(p)) is not None:
            yield x


def ngram_links(docs: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables on distinct texts (named by ``t``, the MD5 of the text): ``t``, ``first_id``, ``copies`` of every text;
    and ``t``, ``links``, ``near`` of pieces of work: how many rows of other texts link to it there, and a text of its
    component there. Nothing is returned by pair: a group of g near copies makes rows in proportion to g."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.unhex(F.md5(F.col(text))).alias("t"))

    @F.pandas_udf("binary")
    def signed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: signature(s).tobytes() if len(s := shingles(x, n)) else None)

    each = rows.where(F.col("text").isNotNull()).select("t", "id", signed("text").alias("sig"), F.length("text").alias("chars"))
    classes = written(each.groupBy("t").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.max("chars").alias("chars")))
    bands = classes.where(F.col("sig").isNotNull()).select("t", "chars", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("sig", k * ROWS + 1, F.lit(ROWS)))).alias("band", "key"))
    shared = written(bands.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("chars").alias("chars")).where(F.col("size") > 1))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.least(F.col("size"), F.col("chars") / BLOCK_CHARS))).cast("int")
    met = spread_join(bands.drop("chars"), shared, {"band": F.col("band"), "key": F.col("key")}, {"size": "size", "chars": "chars"}, "size", classes.count() * BANDS, F.col("t"))
    in_bucket = met.where(F.col("size").isNotNull()).withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash("t"), F.col("blocks")))
    other = in_bucket.select("t", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pieces = other.select("t", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    order = ["band", "key", "i", "j", "t"]
    ready = pieces.join(classes.select("t", "sig", "copies"), "t").repartition("band", "key", "i", "j").sortWithinPartitions(*order)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(p: pd.DataFrame) -> pd.DataFrame | None:
            if len(p) < 2:
                return None
            sigs = np.frombuffer(b"".join(p["sig"]), np.uint8).reshape(-1, VALUES)
            a, b = surviving(p, sigs, threshold)
            return p.iloc[np.unique(np.concatenate([a, b]))] if len(a) else None

        return _pieces(batches, work)

    asked = written(ready.mapInPandas(prune, ready.schema))
    wanted = written(asked.select("t").distinct().join(classes.select("t", "first_id"), "t"))
    w = wanted.select(F.col("t").alias("wt"), "first_id")
    few = small_enough(w)
    source = rows if few else sifted(rows, F.xxhash64("t"), w.select(F.xxhash64("wt")))  # other texts aren't shuffled
    texts = source.join(F.broadcast(w) if few else w, (F.col("t") == F.col("wt")) & F.col("id").eqNullSafe(F.col("first_id"))).select("t", "text").dropDuplicates(["t"])
    last = asked.join(texts, "t").repartition("band", "key", "i", "j").sortWithinPartitions(*order)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(p: pd.DataFrame) -> pd.DataFrame | None:
            sigs = np.frombuffer(b"".join(p["sig"]), np.uint8).reshape(-1, VALUES)
            a, b = surviving(p, sigs, threshold)
            ok = verified([shingles(x, n) for x in p["text"]], a, b, threshold)
            a, b = a[ok], b[ok]
            if not len(a):
                return None
            copies, links = p["copies"].to_numpy(), np.zeros(len(p), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            on, t = links > 0, p["t"].to_numpy()
            return pd.DataFrame({"t": t[on], "links": links[on], "near": t[_roots(len(p), a, b)][on]})

        return _pieces(batches, work)

    links = written(last.mapInPandas(verify, "t binary, links long, near binary"))
    return classes, links


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` with ``class_id`` and ``n_links`` long: the smallest id of its class, which is its connected
    component of links, and how many other rows it links to. Two rows link if the Jaccard similarity of their sets of
    ``n``-word runs is ``threshold`` or more.

    Cases: texts without a word (null, empty, white space) link to nothing and are classes of their own; a text of
    fewer than ``n`` words is a single run; equal texts link; every row counts as a document, repeated rows too; a row
    with a null id takes part, and a class of such rows alone has a null id; an empty table gives no rows; columns of
    ``docs`` named like the outputs are replaced, the others pass through.
    """
    classes, links = ngram_links(docs, n, threshold, doc_id, text)
    edges = links.select(F.col("t").alias("u"), F.col("near").alias("v"))
    rooted = components(edges)  # read from the table of its last round
    ids = written(rooted.join(classes.select(F.col("t").alias("node"), "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("members")))
    n_nodes = ids.agg(F.sum("members")).first()[0] or 0
    known = spread_join(rooted, ids, {"root": F.col("root")}, {"class_id": "class_id"}, "members", n_nodes, F.col("node")).select(F.col("node").alias("t"), "class_id")
    summed = links.groupBy("t").agg(F.sum("links").alias("links"))
    told = classes.where(F.col("sig").isNotNull()).join(known, "t", "left").join(summed, "t", "left")
    told = written(told.select("t", "copies", F.lit(True).alias("known"), F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    total = told.agg(F.sum("copies")).first()[0] or 0
    m = marker(docs)  # the key is a column of its own, so that the text itself isn't shuffled unless it is asked for
    joined = spread_join(docs, told, {"t": F.unhex(F.md5(F.col(text)))}, {f"{m}known": "known", f"{m}class": "class_id", f"{m}links": "n_links"}, "copies", total, F.col(doc_id))
    own = F.when(F.col(f"{m}known").isNull(), F.col(doc_id)).otherwise(F.col(f"{m}class"))
    return joined.select(*without(docs, "class_id", "n_links"), own.alias("class_id"), F.coalesce(f"{m}links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is that of their class, and those of classes without an id. Rows that repeat the id
    stay too, and all columns."""
    outs = ("class_id", "n_links")
    m = marker(docs)
    held = docs.withColumnsRenamed({c: f"{m}{c}" for c in docs.columns if c.lower() in outs})
    joined = ngram_join(held, n, threshold, doc_id, text)
    kept = joined.where(F.col("class_id").isNull() | (F.col(doc_id) == F.col("class_id")))
    return kept.select(*[named(f"{m}{c}" if c.lower() in outs else c).alias(c) for c in docs.columns])
