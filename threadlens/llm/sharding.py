"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, made
from two hashes of its name (offset and skip). Shards take turns: each claims
its first slot that nobody holds yet, until the table is full. A row then goes
to ``table[hash(key) mod size]``. Shares differ by at most one slot per turn,
and a change of the shard list moves few slots besides those that must move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replace_columns

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE,
               weights: Sequence[int] | None = None) -> list[int]:
    """Index of the shard that holds each slot. ``weights``: claims per turn (1 by default).

    ``size`` must be prime, so that every skip visits every slot, and at least
    the number of shards; names must differ. The work is a fixed multiple of
    ``size`` and doesn't depend on the data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, at least the number of shards")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights must be non-negative, one for each shard, and not all zero")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    held, free = [-1] * size, size
    while free:
        for i, claims in enumerate(weights):
            for _ in range(min(claims, free)):
                while held[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % size
                held[at[i]] = i
                free -= 1
    return held


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE,
          weights: Sequence[int] | None = None, split: int = 1) -> DataFrame:
    """Add ``slot`` and ``shard`` (the shard's name) to every row; no shuffle.

    The lookup table has ``size`` rows whatever the data, so broadcasting it is
    bounded. ``split`` > 1 deals each key over that many slots, by a hash of the
    whole row, for keys that hold a large share of the rows.

    Rows whose keys are all null are dealt by a hash of the whole row, so that
    they don't meet in one shard. Equal keys get equal slots (with ``split`` 1);
    repeated rows always do. Empty tables give empty results. Columns named
    ``slot`` or ``shard`` are replaced.
    """
    spark = df.sparkSession
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    own = [F.col(f"`{k}`") for k in keys]
    key = F.xxhash64(*own) if split <= 1 else F.xxhash64(*own, F.pmod(whole, F.lit(split)))
    no_key = F.lit(True)
    for c in own:
        no_key = no_key & c.isNull()
    key = F.when(no_key, whole).otherwise(key)
    placed = replace_columns(df, {"shard": F.lit(None), "slot": F.pmod(key, F.lit(size))}).drop("shard")
    claimed = [(i, shards[s]) for i, s in enumerate(fill_table(shards, size, weights))]
    lookup = spark.createDataFrame(claimed, "slot long, shard string")
    return placed.join(F.broadcast(lookup), "slot").select(*placed.columns, "shard")
