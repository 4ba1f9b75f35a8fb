"""Nodes on a keyed store of contexts with expiry.

The store is a table (context_key, context_data, created_at, updated_at, expires_at). A graph reads it through the frame
``env['store']`` and never writes while it runs: ``context_store`` returns what is to be written, and ``stored`` merges
that into the table, so a task that runs twice writes once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from .base import Built, Call, NodeType, Value

STORE = "context_key string, context_data string, created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz"


def expiry(now: Column, hours: Column) -> Column:
    """``hours`` from now; null, for never, if they aren't above 0."""
    return F.when(hours > 0, F.timestamp_add("SECOND", (hours * 3600).cast("int"), now))


def age_hours(now: Column, created: Column) -> Column:
    """Hours since, to one decimal place, as text."""
    return F.round(F.timestamp_diff("MICROSECOND", created, now) / F.lit(3_600_000_000.0), 1).cast("string")


def _metadata(df: DataFrame) -> Column:
    """The column ``metadata``, JSON text, which a table of contexts can lack."""
    return F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("string").alias("metadata")


def iso(at: Column) -> Column:
    """``isoformat()`` of a time."""
    micros = F.when(F.date_format(at, "SSSSSS") != "000000", F.date_format(at, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), micros)


def stored(store: DataFrame, writes: DataFrame, overwrite: bool = True) -> DataFrame:
    """The store after some writes (context_key, context_data, written_at, expires_at, and metadata if they have it): for each key the last write wins,
    or without ``overwrite`` what was there, else the first. ``created_at`` is of the first. Writes at the same time go
    by their data. Both tables are aggregated by key with partial maxima, so one hot key costs a row a task."""
    old = store.select("context_key", F.struct(F.lit(0).alias("new"), F.col("updated_at").alias("at"), F.col("context_data").alias("data"), F.col("expires_at").alias("expires"), _metadata(store)).alias("w"), F.col("created_at").alias("since"))
    new = writes.select("context_key", F.struct(F.lit(1).alias("new"), F.col("written_at").alias("at"), F.col("context_data").alias("data"), F.col("expires_at").alias("expires"), _metadata(writes)).alias("w"), F.col("written_at").alias("since"))
    pick = F.max("w") if overwrite else F.min("w")
    merged = old.unionByName(new).groupBy("context_key").agg(pick.alias("w"), F.min("since").alias("created_at"))
    return merged.select("context_key", F.col("w.data").alias("context_data"), "created_at", F.col("w.at").alias("updated_at"), F.col("w.expires").alias("expires_at"), F.col("w.metadata").alias("metadata"))


def purged(store: DataFrame, now: Column) -> DataFrame:
    """The store without what has expired before now."""
    return store.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def listed(store: DataFrame, now: Column, part: str = "", limit: int | None = 50, include_expired: bool = False) -> DataFrame:
    """Keys that hold ``part``, with age, expiry, size, times and metadata, in order of the key."""
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False))
    rows = store.where(F.contains("context_key", F.lit(part))) if part else store
    rows = rows if include_expired else rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    out = rows.select("context_key", age_hours(now, F.col("created_at")).alias("age_hours"), gone.alias("is_expired"), F.length("context_data").alias("data_size"), *[iso(F.col(c)).alias(c) for c in ("created_at", "updated_at", "expires_at")], F.coalesce(_metadata(store), F.lit("{}")).alias("metadata"))
    return out.orderBy("context_key").limit(limit) if limit is not None else out


def insert_absent(known: DataFrame, new: DataFrame, key: str = "context_key") -> DataFrame:
    """The rows of ``new`` whose key isn't known yet, one of each: immutable contexts are written once. Equal keys stand
    for equal contents, so whichever copy is kept is the same."""
    return new.join(known.select(key), key, "left_anti").dropDuplicates([key])


def _store_table(call: Call) -> DataFrame:
    return call.env.get("store") if call.env.get("store") is not None else call.spark.createDataFrame([], STORE)


def _now(call: Call) -> Column:
    return F.lit(call.env["now"]).cast("timestamp_ntz") if call.env.get("now") else F.localtimestamp()


def _context_store(call: Call) -> Built:
    key = call.get("context_key").text()
    key = F.coalesce(texts.present(key), texts.present(F.lit(str(call.params.get("context_key", "")))), F.concat(F.lit("ctx_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))
    data = call.get("context_data").text()
    error = F.when(texts.present(data).isNull(), "context_data is required")
    meta = call.inputs["metadata"].json() if "metadata" in call.inputs else F.lit("{}")
    known = _store_table(call).select(F.col("context_key").alias(f"{call.node_id}__known")).distinct()
    keyed = call.frame.withColumn(f"{call.node_id}__key", key)
    frame = keyed.join(known, F.col(f"{call.node_id}__key") == F.col(f"{call.node_id}__known"), "left")
    there = F.col(f"{call.node_id}__known").isNotNull()
    ok = F.lit(True) if call.params.get("overwrite", True) else ~there
    done = ok & error.isNull()
    hours = F.lit(float(call.params.get("expires_hours", 24) or 0))
    taken = F.concat(F.lit("Context key '"), F.col(f"{call.node_id}__key"), F.lit("' already exists and overwrite is disabled"))
    ports = {
        "stored_key": Value(F.col(f"{call.node_id}__key")),
        "context_key": Value(F.col(f"{call.node_id}__key")),
        "success": Value(F.when(done, "true").otherwise("false")),
        "error": Value(F.coalesce(error, F.when(~ok, taken))),
        "write": Value(F.when(done, F.struct(F.col(f"{call.node_id}__key").alias("context_key"), data.alias("context_data"), _now(call).alias("written_at"), expiry(_now(call), hours).alias("expires_at"), meta.alias("metadata"))), "other"),
    }
    return Built(ports, frame=frame)


def _context_retrieve(call: Call) -> Built:
    now, store = _now(call), _store_table(call)
    if call.params.get("cleanup_expired", True):
        store = purged(store, now)
    mine = {c: f"{call.node_id}__{c}" for c in ("context_key", "context_data", "created_at", "expires_at")}
    noted = f"{call.node_id}__noted"
    table = store.select(*[F.col(c).alias(n) for c, n in mine.items()], _metadata(store).alias(noted))
    asked = F.coalesce(texts.present(call.get("context_key").text()), F.lit(str(call.params.get("context_key", ""))))
    frame = call.frame.withColumn(f"{call.node_id}__asked", asked).join(table, F.col(f"{call.node_id}__asked") == F.col(mine["context_key"]), "left")
    hit = F.col(mine["context_key"]).isNotNull()
    late = F.coalesce(F.col(mine["expires_at"]) < now, F.lit(False))
    default = call.params.get("default_value", call.params.get("default_context", {}))
    default = F.lit(json.dumps(default) if isinstance(default, (dict, list)) else str(default))
    found = F.coalesce(F.when(hit & ~late, F.col(noted)), F.lit("{}"))
    ports = {
        "metadata": Value(F.try_parse_json(found), "json", raw=found),
        "context_data": Value(F.when(hit & ~late, F.col(mine["context_data"])).otherwise(default)),
        "found": Value(F.when(hit & ~late, "true").otherwise("false")),
        "age_hours": Value(F.when(~hit, "0").when(late, "expired").otherwise(age_hours(now, F.col(mine["created_at"])))),
    }
    return Built(ports, frame=frame)


def _context_list(call: Call) -> Built:
    """The listing is the same for every row: one array, of at most ``limit`` entries."""
    part, limit = str(call.params.get("filter") or call.params.get("pattern") or ""), int(call.params.get("limit", 50))
    rows = listed(_store_table(call), _now(call), part, limit, bool(call.params.get("include_expired", False)))
    entry = F.struct("context_key", F.col("age_hours").cast("double").alias("age_hours"), "created_at", "updated_at", "expires_at", "is_expired", F.try_parse_json("metadata").alias("metadata"), "data_size")
    order = lambda a, b: F.when(a["context_key"] < b["context_key"], -1).when(a["context_key"] > b["context_key"], 1).otherwise(0)
    every = rows.agg(F.array_sort(F.collect_list(entry), order).alias(f"{call.node_id}__list"))
    frame = call.frame.crossJoin(F.broadcast(every))  # one row, of a bounded list
    col = F.col(f"{call.node_id}__list")
    return Built({"contexts": Value(F.to_json(col)), "count": Value(F.size(col).cast("string"))}, frame=frame)


def hash_key(seed: Column, prefix: str = "", length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(seed, 256), 1, length))


def _random_key(call: Call) -> Built:
    length, prefix = int(call.params.get("key_length", 12)), str(call.params.get("prefix", "key_"))
    form, seed = call.params.get("format") or call.params.get("key_format", "uuid"), call.params.get("seed")
    unique = lambda n: F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, n)
    #: The words of keys made of words.
    words = "red blue fast slow big small hot cold cat dog sun moon tree rock wave star".split()
    if form == "alphanumeric":
        key = F.lower(F.randstr(F.lit(length), F.lit(seed)) if seed is not None else F.randstr(F.lit(length)))
    elif form == "words":
        mixed = F.shuffle(F.array(*map(F.lit, words)), seed) if seed is not None else F.shuffle(F.array(*map(F.lit, words)))
        key = F.substring(F.array_join(F.slice(mixed, 1, min(3, length // 3 + 1)), "-"), 1, length)
    else:
        key = unique(length)
    stamp = F.concat(F.lit("_"), F.unix_timestamp(_now(call).cast("timestamp")).cast("string")) if call.params.get("include_timestamp") else F.lit("")
    name = f"{call.node_id}__random"
    frame = call.frame.withColumn(name, F.concat(F.lit(prefix), key, stamp))
    data = texts.present(call.get("seed_data").text())
    hashed = F.when(data.isNull(), F.col(name)).otherwise(F.concat(hash_key(data, prefix, length), stamp))
    return Built({"random_key": Value(F.col(name)), "short_key": Value(F.concat(F.lit(prefix), unique(8))), "hash_key": Value(hashed)}, frame=frame)


CONTEXT = [
    NodeType("context_store", "Context", {"context_data": True, "context_key": False, "metadata": False}, ("stored_key", "context_key", "success", "error", "write"), _context_store, {"context_key": "", "expires_hours": 24, "overwrite": True}),
    NodeType("context_retrieve", "Context", {"context_key": False}, ("context_data", "metadata", "found", "age_hours"), _context_retrieve, {"default_context": {}, "cleanup_expired": True}),
    NodeType("context_list", "Context", {}, ("contexts", "count"), _context_list, {"pattern": "", "limit": 50, "include_expired": False}),
    NodeType("generate_random_key", "Utility", {"seed_data": False}, ("random_key", "short_key", "hash_key"), _random_key, {"key_format": "uuid", "key_length": 12, "prefix": "key_", "include_timestamp": False}),
]
