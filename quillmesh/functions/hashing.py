"""Stable hashes: indexes, seeds, orders and digests that do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_hex(t: Column) -> Column:
    return F.sha2(t.cast("string").cast("binary"), 256)


def stable_index(t: Column, n: int | Column) -> Column:
    """The first 32 bits of the SHA-256 of a text, modulo n."""
    head = F.conv(F.substring(sha_hex(t), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, n if isinstance(n, Column) else F.lit(n))


def user_seed(user: Column, pool_hash: Column) -> Column:
    """63 bits from a user and a pool, for a reproducible draw."""
    digest = F.substring(sha_hex(F.concat_ws(":", user.cast("string"), pool_hash)), 1, 16)
    return (F.conv(digest, 16, 10).cast("decimal(20,0)") % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)")


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A pseudo-random order by seed and key, the same on any cluster."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"), 256)


def set_digest(key: Column) -> Column:
    """An aggregate: 16 hex digits over the sorted distinct keys."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(key.cast("string"))), "\n").cast("binary"), 256), 1, 16)
