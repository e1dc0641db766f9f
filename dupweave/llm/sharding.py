"""Shard placement by a permutation-filled lookup table.

Every shard owns a permutation of the slots of a prime-sized table. Shards take turns, each claiming
the first slot of its permutation that is still free, until the table is full; shard sizes then differ
by one slot at most, and adding or removing a shard moves few slots. A row is placed by one hash and
one look at the table, which is broadcast: its size is a parameter and doesn't depend on the data.

Defined results: a null id is replaced by a digest of the text, so null ids spread over the shards; rows
that repeat an id go to the same shard; an empty table gives an empty result; input columns named like
the output columns are replaced; all other columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hex_fraction, put, ref, row_key

SHARDS = 64
SLOTS_PER_SHARD = 100
SEED = "shard-1"
MOST_SLOTS = 2_000_000


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: int = SHARDS, slots: int | None = None, seed: str = SEED) -> list[int]:
    """The shard of each slot. `slots` is raised to a prime; its bound is MOST_SLOTS."""
    size = next_prime(slots or shards * SLOTS_PER_SHARD)
    if not 1 <= shards <= size <= MOST_SLOTS:
        raise ValueError(f"{shards} shards in {size} slots: at least one slot a shard, at most {MOST_SLOTS} in all")
    at = [_number(f"{seed}:offset:{i}") % size for i in range(shards)]
    step = [_number(f"{seed}:skip:{i}") % (size - 1) + 1 if size > 2 else 1 for i in range(shards)]
    owner, free = [-1] * size, size
    while free:
        for shard in range(min(shards, size)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int, seed: str = SEED) -> Column:
    return F.pmod(hex_fraction(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 15), F.lit(slots))


def lookup_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The table as rows (slot, shard), made from one literal on the JVM side."""
    shards = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(shards).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def assign_shards(docs: DataFrame, *, shards: int = SHARDS, slots: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `slot` and `shard`. One narrow pass: no shuffle, the table is broadcast."""
    owner = lookup_table(shards, slots, seed)
    mine = fresh(docs, "slot")
    keyed = docs.withColumn(mine, slot_of(row_key(id_col, text_col), len(owner), seed).cast("int"))
    places = lookup_frame(docs.sparkSession, owner).select(F.col("slot").alias(f"{mine}t"), F.col("shard").alias(f"{mine}s"))
    placed = keyed.join(F.broadcast(places), F.col(mine) == F.col(f"{mine}t"))
    placed = put(put(placed, "slot", F.col(mine)), "shard", F.col(f"{mine}s"))
    return placed.select(*[ref(c) for c in placed.columns if not c.startswith(mine)])


def assign_sql(shards: int = SHARDS, slots: int | None = None, seed: str = SEED, rows: str = "documents") -> str:
    """DuckDB SQL for (doc_id, slot, shard) of `rows`; the table itself is a literal (its filling is tested apart)."""
    owner = lookup_table(shards, slots, seed)
    return f"""
WITH places AS (SELECT unnest(range({len(owner)})) AS slot, unnest([{",".join(map(str, owner))}]) AS shard),
keyed AS (SELECT *, CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))), 1, 15)) AS BIGINT) % {len(owner)} AS slot FROM {rows})
SELECT keyed.doc_id, CAST(keyed.slot AS INTEGER) AS slot, CAST(places.shard AS INTEGER) AS shard FROM keyed JOIN places ON keyed.slot = places.slot"""
