"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition becomes one *run*: its rows' digests, sorted.  Runs are
merged in binomial rounds: in each round the runs whose numbers agree above
the lowest ``log2(arity)`` bits exchange their entries, and a multiway merge
keeps, for each verified digest, the surviving identifier and the number of
rows.  An entry of a round is at most one row per digest and merged run, so a
digest that a third of all rows share arrives with at most ``arity`` entries.

The survivors go back down the same tree: root entry -> each run's entry ->
the rows of that run.  No join key holds more rows than one input partition
has, hence nothing needs salting and nothing is broadcast or collected.

Verification: entries merge only if SHA-256, an independent 64-bit hash and
the byte length agree.  Only these narrow columns are shuffled, never texts.

Defined cases: a null text counts as empty; null identifiers are never
preferred as survivor; of repeated rows (same identifier and text) one row
survives; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlift.llm.common import ascii_lower, materialize, text_or_empty

KEY = ["digest", "chk", "n_bytes"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True) -> DataFrame:
    """One row per document: run number, row number, id and digest, sorted in each run."""
    text = text_or_empty(text_col)
    norm = ascii_lower(text) if fold_case else text
    return (docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
            .select(F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("rid"), "id",
                    F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
                    F.xxhash64("norm").alias("chk"), F.octet_length("norm").alias("n_bytes"))
            .sortWithinPartitions(*KEY))


def merge_rounds(runs: DataFrame, n_runs: int, arity: int, keep: str) -> DataFrame:
    """Root of the merge tree: one row per digest with ``best`` and ``n``."""
    bits = arity.bit_length() - 1
    pick = F.min if keep == "smallest" else F.max
    level, left = runs, max(1, n_runs)
    while left > 1:
        level = (level.groupBy(*KEY, F.shiftright("run", bits).alias("run"))
                 .agg(pick("best").alias("best"), F.sum("n").alias("n")))
        left = -(-left // arity)
    return level


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                fold_case: bool = True, arity: int = 16) -> DataFrame:
    """Verdict per row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest" (identifier that survives); ``arity``
    (a power of two) is the number of runs merged in one round.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    if arity < 2 or arity & (arity - 1):
        raise ValueError("arity is a power of two")
    # written once: run and row numbers must be the same for every later reader
    leaf = materialize(digest_runs(docs, id_col, text_col, fold_case), "digest_runs")
    n_runs = (leaf.agg(F.max("run")).first()[0] or 0) + 1
    best = (F.struct(F.col("id").isNull().alias("no_id"), "id", "rid") if keep == "smallest"
            else F.struct("id", "rid"))
    pick = F.min if keep == "smallest" else F.max
    entries = leaf.groupBy(*KEY, "run").agg(pick(best).alias("best"), F.count(F.lit(1)).alias("n"))
    root = merge_rounds(entries, n_runs, arity, keep).select(
        *KEY, F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), F.col("n").alias("group_size"))
    down = entries.select(*KEY, "run").join(root, KEY)
    return (leaf.join(down, [*KEY, "run"])
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("rid") == F.col("keep_rid")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                      fold_case: bool = True) -> DataFrame:
    """The surviving documents with all their columns.  Rows are found again by
    id and digest; the few that repeat under one id are reduced to one row."""
    verdict = exact_dedup(docs, id_col, text_col, keep, fold_case)
    ids = verdict.groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).agg(
        F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__same"))
    text = text_or_empty(text_col)
    sha = F.sha2((ascii_lower(text) if fold_case else text).cast("binary"), 256)
    marked = docs.withColumn("__sha0", sha).join(
        ids.where("__kept"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha0") == F.col("__sha")))
    once = marked.where("__same = 1")
    repeated = marked.where("__same > 1").dropDuplicates(["__id", "__sha"])
    return once.unionByName(repeated).select(*docs.columns)
