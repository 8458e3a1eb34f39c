"""Helpers shared by the operators: table access, row batching in Arrow tasks,
word splitting and stable hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlift.session import materialize  # noqa: F401  (re-exported for the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_FOLD = str.maketrans(UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  All-ASCII texts take the byte-wise ``lower``;
    others ``translate``, which leaves accented letters alone."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def replacing(rows: DataFrame, *names: str | None) -> DataFrame:
    """The rows without columns of these names (in any case), which are about to be appended."""
    taken = {n.lower() for n in names if n}
    return rows.select(*[rows[f"`{c}`"] for c in rows.columns if c.lower() not in taken])


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (a null id counts as -1, in no fold)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def row_chunks(batches: Iterator, columns: list[str], max_chars: int = 4_000_000) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as lists of Python tuples of at most ``max_chars``
    characters of string cells (one row at least), so that a task's Python
    memory depends neither on Arrow's batch size nor on the partition."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        held, size = [], 0
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in cols)
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes))) + 64
            if size >= max_chars:
                yield held
                held, size = [], 0
        if held:
            yield held


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split cuts exactly there)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered while fewer than ``limit`` words are held."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit integers (bijective, so no collisions of its own)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
