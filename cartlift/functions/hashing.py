"""Keyed uniforms: reproducible randomness that is a function of the key.

Sampling, the train/test split, period halves and the exploration slice are
all ``u(id, salt) < p``.  The value depends only on the key and the salt, so
it survives repartitioning, task retries and executor loss, and DuckDB can
compute the same number for the oracle:

    u = int(first 8 hex digits of md5(str(id) || ':' || salt), 16) / 2**32
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def keyed_uniform(key: Column | str, salt: str) -> Column:
    """Uniform [0, 1) double derived from ``md5(key || ':' || salt)``."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(":" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_32)


def duck_keyed_uniform(key_sql: str, salt: str) -> str:
    """The same uniform written in DuckDB SQL (used by the oracles)."""
    return (f"cast(('0x'||substr(md5(cast({key_sql} as varchar)||':{salt}'),1,8)) as bigint)"
            f"/4294967296.0")


def salted_uniform(key: Column | str, salt: Column) -> Column:
    """:func:`keyed_uniform` with a salt that differs from row to row."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), salt))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_32)
