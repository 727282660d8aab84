"""Sharding: a keyed Feistel permutation over global row numbers, with cycle walking.

Rows are numbered by (doc_id, then the hash of the whole row); the permuted number p gives shard
p mod shards and slot p div shards, so shard sizes differ by one row at most (the law `rows`) and both
can be computed for any row number without a shuffle of the texts' order. `position` and `row_at`
are the same mapping and its inverse for single numbers.

Defined results: null ids come first; rows equal in all columns are interchangeable; an empty table
gives an empty table; very long texts are read but for their hash moved as they are; all columns are read and kept, whatever their
names, and columns named shard or slot are replaced.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Own, mix64, shared_path, ship, shuffle_partitions

ROUNDS = 6


def _sides(n: int) -> tuple[int, int]:
    """a * b is the least product of near-equal sides that holds n, so few numbers have to walk."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _keys(seed: int) -> np.ndarray:
    return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))


def _round(x: np.ndarray, a: int, b: int, k: int, keys: np.ndarray, back: bool) -> np.ndarray:
    """One round over numbers l + a * r: even rounds move l by a hash of r, odd rounds r by one of l."""
    left, right = x % np.uint64(a), x // np.uint64(a)
    fixed, m = (right, a) if k % 2 == 0 else (left, b)
    with np.errstate(over="ignore"):
        by = mix64(fixed * np.uint64(0xD1342543DE82EF95) + keys[k]) % np.uint64(m)
    by = np.uint64(m) - by if back else by
    if k % 2 == 0:
        left = (left + by) % np.uint64(a)
    else:
        right = (right + by) % np.uint64(b)
    return left + np.uint64(a) * right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse. Numbers that land beyond n walk on until they are inside."""
    a, b = _sides(n)
    keys, out = _keys(seed), np.asarray(x).astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        y = out[walk]
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            y = _round(y, a, b, k, keys, back)
        out[walk] = y
        walk = out >= np.uint64(n)
    return out.astype(np.int64)


def position(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that has this shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """docs with `row`, the global row number in order of (id, hash of the row), and the number of rows. docs has no
    column row, part, at, start, id or hash.

    The sorted rows are written once to the shared folder with their partition and place, so the
    offsets, one number per partition, are counted from the very rows that are numbered.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "numbered")
    order = [F.col("id").asc_nulls_first(), F.col("hash")]
    laid = docs.select("*", F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("hash"))
    laid = laid.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("id", "hash")
    laid.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    back = spark.read.parquet(path)
    part = F.shiftright(F.col("at"), 33)
    counts = sorted((r["part"], r["n"]) for r in back.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row per shuffle partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "part long, start long")
    rows = back.withColumn("part", part).join(F.broadcast(offsets), "part")
    return rows.withColumn("row", F.col("start") + F.col("at").bitwiseAND(2**33 - 1)).drop("part", "start", "at"), total


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240601, id_col: str = "doc_id") -> DataFrame:
    """docs with shard (int) and slot (long); columns of these names are replaced."""
    ship(docs.sparkSession)
    own = Own(docs)
    used = [c for c, n in zip(own.columns, own.names, strict=True) if n.lower() not in ("shard", "slot")]
    rows, n = numbered(own.df.select(*used), own.at(id_col))

    @F.pandas_udf("long")
    def moved(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    out = rows.withColumn("to", moved("row"))
    out = out.withColumn("shard", F.pmod("to", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"to div {shards}"))
    return own.back(out, "shard", "slot")


def op8(spark, sf_dir):
    """Law `rows`. The text itself isn't moved: its size and checksum are taken first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard(small, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
