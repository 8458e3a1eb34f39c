"""Line deduplication: explode normalised lines, hash, count documents, reassemble.

Every text is cut at ``\\n``.  A line's key is the line without white space
(``[\\x20\\x09-\\x0D]``) at its ends, A-Z lower-cased; keys of ``min_chars``
code points or more are hashed (MD5).  A key found in ``min_docs`` documents
or more is *common*: its lines go, except those of the document that keeps it.

Counting shuffles hashes, never lines.  A document offers each key once, and
keys are counted in two steps, by (key, run) and by key, where a run is one
input partition; both combine map-side.  The verdict goes back the same way,
key -> (key, run) -> lines of that run, so a line that every document holds
meets at most one row per run in one task, and one run's lines in the next.
Texts move once, to meet the positions of their own dropped lines.

Defined cases: a null or empty text is one empty line; a document is a row, so
repeated rows count as documents of their own; of rows with the same id the
one that was read last keeps a line; null ids never keep a line that a row with
an id holds; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlift.llm.common import ascii_lower, materialize, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: Column, min_chars: int) -> Column:
    """Per line the MD5 (hex) of its key, null if the key is too short."""
    trimmed = F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(trimmed, lambda key: F.when(F.length(key) >= min_chars, F.md5(key.cast("binary"))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
               min_docs: int = 3, keep: str = "largest") -> DataFrame:
    """Per document: id, n_lines (before), n_dropped, kept_text.

    ``keep`` is "largest" or "smallest" (id of the document that keeps a
    common line) or "none" (common lines go everywhere).
    """
    if keep not in ("largest", "smallest", "none"):
        raise ValueError("keep is 'largest', 'smallest' or 'none'")
    pick = F.min if keep == "smallest" else F.max
    # written once: row and run numbers must be the same for every later reader
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select(
            F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), "id", "text",
            line_keys(F.col("text"), min_chars).alias("keys")), "lines", codec="zstd")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row") if keep == "smallest" else F.struct("id", "row")
    offered = rows.select("run", order.alias("at"),
                          F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
    entries = (offered.select("run", "at", F.unhex("key").alias("key")).groupBy("key", "run")
               .agg(F.count(F.lit(1)).alias("n"), pick("at").alias("at")))
    common = (entries.groupBy("key").agg(F.sum("n").alias("n"), pick("at").alias("at"))
              .where(F.col("n") >= min_docs)
              .select("key", F.lit(-1).alias("holder") if keep == "none" else F.col("at.row").alias("holder")))
    down = entries.select("key", "run").join(common, "key")
    lines = rows.select("row", "run", F.posexplode("keys").alias("pos", "key")).where("key is not null").select(
        "row", "run", "pos", F.unhex("key").alias("key"))
    gone = (lines.join(down, ["key", "run"]).where("row <> holder")
            .groupBy("row").agg(F.collect_list("pos").alias("gone")))
    # ``lines`` is used twice below, so Spark computes it once a row and not once an element
    cut = rows.select("row", "id", "text").join(gone, "row", "left").select(
        "id", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return cut.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(left, lambda p: F.get(F.col("lines"), p)), "\n")).alias("kept_text"))
