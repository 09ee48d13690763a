"""Sharding through a permutation-filled lookup table of prime size.

Every shard has a preference order over the slots, (offset + j * skip) mod size; shards take turns, each claiming the
first free slot of its order, until the table is full. So shards own equal numbers of slots (plus or minus one), and
when a shard goes, few keys of others move. The table has a fixed number of slots whatever the data's size; it is
broadcast, and placing a row is one hash and one look-up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

SHARDS, SLOTS = 16, 1609


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or not _is_prime(slots) or slots < len(shards) or len(set(shards)) < len(shards):
        raise ValueError("needs distinct shards and a prime number of slots, as many as shards at least")
    offset = [_hash("offset:" + s) % slots for s in shards]
    skip = [_hash("skip:" + s) % (slots - 1) + 1 for s in shards]
    turn = [0] * len(shards)
    table = [-1] * slots
    left = slots
    while left:
        for k in range(len(shards)):
            while table[at := (offset[k] + turn[k] * skip[k]) % slots] >= 0:
                turn[k] += 1
            table[at] = k
            left -= 1
            if not left:
                break
    return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """(doc_id, slot, shard) of every row of docs, by its key's decimal spelling.

    Rows with a null key go to the slot of the empty string; equal keys share a shard; other columns don't matter.
    """
    names = shards or shard_names()
    table = docs.sparkSession.createDataFrame([(k, s) for k, s in enumerate(fill_table(names, slots))], "_slot int, shard int")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    placed = docs.select(F.col(key).alias("doc_id"), (hashed % slots).cast("int").alias("slot"))
    return placed.join(F.broadcast(table), placed.slot == table._slot, "left").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> None:
    """Writes docs under path, a folder _shard=N for each shard, with one shuffle: a shard is written by as many tasks as are its share of
    spark.sql.shuffle.partitions, rows of one key by several too if they differ.

    Null keys go to the shard of the empty string, repeated rows are all written, no rows give no folders. All columns are kept; if there is
    one named _shard, the folders have another underscore before the name.
    """
    names = shards or shard_names()
    folder = "_shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema if f.dataType.simpleString() in ("string", "bigint", "int", "double", "date", "timestamp", "boolean")]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*plain), F.lit(-(-width // len(names)))) if plain else F.lit(0)
    table = docs.sparkSession.createDataFrame([(k, s) for k, s in enumerate(fill_table(names, slots))], "slot int, shard int")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = whole.select("row", (hashed % slots).alias("h"), part.alias("part")).join(F.broadcast(table), F.col("h") == F.col("slot"))
    placed.repartition(width, "shard", "part").select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
