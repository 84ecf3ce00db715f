"""Placement of documents in shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: an offset and a stride from its name's hash. The
shards take turns in claiming the first slot they prefer that is still free, so each gets an equal number of slots (or one
by weight), and when a shard leaves, few slots of the others change. A document goes to the shard of slot hash(key) mod
size: one lookup, whatever the number of shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names

#: A prime. The table is broadcast, so it and the number of shards are bounded.
SLOTS, MOST_SLOTS = 4099, 1 << 20
SHARDS = [f"shard-{i:02d}" for i in range(40)]


def _digits(name: str, salt: str, n: int) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:12], 16) % n


def fill(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> np.ndarray:
    """Index of a shard for each slot. A shard of weight w claims w slots a turn, one of weight 0 none."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or slots > MOST_SLOTS:
        raise ValueError("need 1 to `slots` distinct shards and at most 2^20 slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime: every stride then reaches every slot")
    weight = [(weights or {}).get(s, 1) for s in shards]
    if set(weights or {}) - set(shards) or min(weight) < 0 or not any(weight):
        raise ValueError("weights must be of the shards, none negative, not all 0")
    at = [_digits(s, "offset", slots) for s in shards]
    stride = [_digits(s, "stride", slots - 1) + 1 for s in shards]
    table, free = np.full(slots, -1, np.int32), slots
    while free:
        for i, s in enumerate(shards):
            for _ in range(weight[i]):
                if not free:
                    break
                while table[at[i]] >= 0:
                    at[i] = (at[i] + stride[i]) % slots
                table[at[i]] = i
                free -= 1
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """First 32 bits of the key's MD5, mod the number of slots; a null key counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots


def place(df: DataFrame, key: Column, shards: list[str] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None, spread: Column | None = None, hot: float = 0.0) -> DataFrame:
    """Add `slot` and `shard`. Rows with equal keys share a shard, unless `hot` > 0 and the key has more than that share
    of all rows: then `spread` joins its key, so that no shard gets a third of the table from one source.

    Null keys share a shard, repeated rows too. Empty tables give empty tables, other columns pass through; `slot` and
    `shard` replace columns of these names.
    """
    spark = df.sparkSession
    df = df.drop("slot", "shard")
    key_, hot_ = free_names(df, "__key", "__hot")
    if hot > 0:
        kept = key.cast("string")
        total = df.count()
        # At most 1/hot keys can be hot: the list is short enough to broadcast.
        heavy = df.groupBy(kept.alias(key_)).count().where(F.col("count") > hot * total).select(key_, F.lit(True).alias(hot_))
        df = df.withColumn(key_, kept).join(F.broadcast(heavy), key_, "left")
        key = F.when(F.col(hot_), F.concat_ws("/", F.col(key_), spread.cast("string"))).otherwise(F.col(key_))
    table = fill(shards, slots, weights)
    lookup = F.broadcast(spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot long, shard string"))
    return df.withColumn("slot", slot(key, slots)).join(lookup, "slot").drop(key_, hot_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes, and where it would go without the last shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    now = place(docs, F.col("doc_id"))
    fewer = SHARDS[:-1]
    table = F.broadcast(spark.createDataFrame([(i, fewer[s]) for i, s in enumerate(fill(fewer).tolist())], "slot long, shard_without_last string"))
    return now.join(table, "slot").select("doc_id", "n_chars", "slot", "shard", "shard_without_last")


def oracle() -> str:
    rows = lambda shards: "[" + ",".join(f"'{shards[s]}'" for s in fill(shards).tolist()) + "]"
    at = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {SLOTS}"
    return f"""WITH t AS (SELECT {rows(SHARDS)} AS now, {rows(SHARDS[:-1])} AS fewer), d AS (SELECT doc_id, n_chars, {at} AS slot FROM documents)
SELECT doc_id, n_chars, slot, now[slot + 1] AS shard, fewer[slot + 1] AS shard_without_last FROM d, t"""
