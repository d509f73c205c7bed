"""Changes between consecutive full snapshots by content-defined chunks.

Rows are laid out by one range shuffle on the key, all snapshots alike, and read in key order. A key whose hash has
its low bits zero starts a chunk, so an insertion moves no other boundary. Per chunk and snapshot a digest over keys
and contents is kept; where two consecutive snapshots agree, their rows are discarded, and only rows of the other
chunks are joined to tell added, removed and changed keys.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key starts a chunk when its hash modulo this is 0: the mean length of a chunk in keys.
MEAN_CHUNK = 8
#: An odd multiplier that makes the second half of a digest independent of the first.
_MIX = np.uint64(0x9E3779B97F4A7C15)


@F.pandas_udf(T.StringType())
def canonical_sha256(payload: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text's content: keys sorted, ``", "`` and ``": "`` between; text that is no JSON as it is."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            text = json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)
        except ValueError:
            text = text.strip()
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    return payload.map(one, na_action="ignore") if payload.notna().any() else payload


def content_hash(given: Column, payload: Column) -> Column:
    """The given hash as 32 bytes, or the payload's own where none is given; no bytes if there is neither."""
    hex_part = F.regexp_extract(F.lower(given), "([0-9a-f]{64})", 1)
    known = F.nullif(hex_part, F.lit(""))
    return F.unhex(F.coalesce(known, canonical_sha256(F.when(known.isNull(), payload)), F.lit("")))


def ready_sequence(snapshots: DataFrame) -> DataFrame:
    """dataset, day, seq of the READY snapshots, from 1 in each dataset; a small manifest table."""
    day = F.to_date(F.col("snapshot_date").cast("string"))
    ready = snapshots.where(F.upper(F.trim("status")) == "READY").select(F.trim("dataset_id").alias("dataset"), day.alias("day")).where("dataset IS NOT NULL AND day IS NOT NULL").distinct()
    lists = ready.groupBy("dataset").agg(F.array_sort(F.collect_set("day")).alias("days"))
    return lists.select("dataset", F.posexplode("days").alias("seq", "day")).select("dataset", "day", (F.col("seq") + 1).alias("seq"))


def snapshot_rows(rows: DataFrame, dataset: Column, snapshot: Column, key: Column, content: Column, version: Column, ready: DataFrame) -> DataFrame:
    """dataset, key, seq, content: one row per key and READY snapshot, of repeated rows that of the latest version.

    Rows without dataset, key or a READY snapshot are left out; a NULL version is the earliest, of equal versions the
    greatest content counts. Other columns are dropped, whatever their names.
    """
    day = F.try_to_date(F.regexp_replace(snapshot, "[^0-9]", ""), "yyyyMMdd")
    kept = rows.select(F.trim(dataset).alias("dataset"), day.alias("day"), F.trim(key).alias("key"), F.struct(version.alias("v"), content.alias("c")).alias("_state")).where("key IS NOT NULL")
    kept = kept.join(F.broadcast(ready), ["dataset", "day"])
    return kept.groupBy("dataset", "key", "seq").agg(F.max("_state")["c"].alias("content"))


def _discard_matching(mean_chunk: int):
    """For batches in (dataset, key, seq) order: rows of chunks that differ from the snapshot before or after."""

    def cut(table: pa.Table, h_key: np.ndarray, start: np.ndarray) -> pa.Table:
        seq = table["seq"].to_numpy().astype(np.int64)
        h_row = table["h_row"].to_numpy().view(np.uint64)
        group = np.cumsum(start) * (int(seq.max()) + 3) + seq
        groups, inverse = np.unique(group, return_inverse=True)
        digest = np.zeros((2, len(groups)), dtype=np.uint64)  # 128 bits: 64 would let chunks of a huge table collide
        with np.errstate(over="ignore"):
            first = h_row ^ (h_key >> np.uint64(7))
            second = (first ^ (first >> np.uint64(29))) * _MIX
            np.add.at(digest[0], inverse, first)
            np.add.at(digest[1], inverse, second ^ (second >> np.uint64(32)))
        count = np.bincount(inverse, minlength=len(groups))

        def differs(step: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(groups, groups + step), len(groups) - 1)
            return ~((groups[at] == groups + step) & (digest[:, at] == digest).all(axis=0) & (count[at] == count))

        as_new = differs(-1)[inverse] & (seq > 1)
        as_old = differs(1)[inverse] & (seq < table["n_seq"].to_numpy())
        out = table.select(["dataset", "key", "seq", "content"]).append_column("as_new", pa.array(as_new)).append_column("as_old", pa.array(as_old))
        return out.filter(pa.array(as_new | as_old))

    def starts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h_key = table["h_key"].to_numpy().view(np.uint64)
        first = np.concatenate([[True], h_key[1:] != h_key[:-1]])
        return h_key, first & (h_key % np.uint64(mean_chunk) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # from the start of the chunk that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            h_key, start = starts(held)
            n = int(np.flatnonzero(start)[-1]) if start.any() else 0
            if n:
                yield from cut(held.slice(0, n), h_key[:n], start[:n]).to_batches()
                held = held.slice(n)
        if held is not None:
            yield from cut(held, *starts(held)).to_batches()

    return run


def unmatched_rows(rows: DataFrame, ready: DataFrame, mean_chunk: int = MEAN_CHUNK) -> DataFrame:
    """Rows of unmatched chunks with ``as_new`` (against the snapshot before) and ``as_old`` (against the next).

    A partition's first key starts a chunk as well; partitions are the same for all snapshots. Only a chunk's rows
    are held at a time, so a dataset of any size streams through.
    """
    last = ready.groupBy("dataset").agg(F.max("seq").alias("n_seq"))
    laid = rows.select("dataset", "key", F.col("seq").cast("int").alias("seq"), "content").repartitionByRange("dataset", "key").sortWithinPartitions("dataset", "key", "seq")
    hashed = laid.join(F.broadcast(last), "dataset").select("dataset", "key", "seq", "content", "n_seq", F.xxhash64("dataset", "key").alias("h_key"), F.xxhash64("key", "content").alias("h_row"))
    return hashed.mapInArrow(_discard_matching(mean_chunk), "dataset string, key string, seq int, content binary, as_new boolean, as_old boolean")


def classify_changes(unmatched: DataFrame, ready: DataFrame, keys: Sequence[str] = ("dataset", "key")) -> DataFrame:
    """dataset, key, day, change_kind for each later snapshot; the first of a dataset has none."""
    sides = F.array(
        F.when(F.col("as_new"), F.struct(F.col("seq").alias("seq"), F.lit(None).cast("binary").alias("old"), F.col("content").alias("new"))),
        F.when(F.col("as_old"), F.struct((F.col("seq") + 1).alias("seq"), F.col("content").alias("old"), F.lit(None).cast("binary").alias("new"))),
    )
    pairs = unmatched.select(*keys, F.explode(F.array_compact(sides)).alias("side")).select(*keys, "side.seq", "side.old", "side.new")
    states = pairs.groupBy(*keys, "seq").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return states.withColumn("change_kind", kind).where("seq > 1 AND change_kind IS NOT NULL").join(F.broadcast(ready), ["dataset", "seq"]).select(*keys, "day", "change_kind")
