"""Training-corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Between stages the rows are written
as Parquet to the shared folder and read again, so a lost executor never sends
the run back to an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlift.llm import langid
from cartlift.llm.common import materialize, read_table
from cartlift.llm.exact_dedup import keep_first_copies
from cartlift.llm.near_dup import near_duplicates
from cartlift.llm.packing import pack
from cartlift.llm.secrets import redact

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 2048


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a missing ``lang`` is filled in, or stays null
    if no row is labelled.  Rejected: null texts and texts without a letter."""
    model = langid.fit(docs)
    found = langid.identify(docs, model, pred_col="__pred", score_col="__score", letter_col="__letter").where("__letter")
    if model.tables:
        found = found.withColumn("lang", F.coalesce("lang", "__pred"))
    return found.select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (up to A-Z case): that with the largest doc_id."""
    return keep_first_copies(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 over 5-word shingles: that with
    the smallest doc_id, of equal ids the first row; null ids come last.  Rows
    are told apart by a number that is written once, so ids may repeat."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "near_rows")
    groups = near_duplicates(rows, id_col="__row", width=5, percent=80).select(
        "__row", F.col("component_id").alias("__group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row"))
    kept = (groups.join(rows.select("__row", "doc_id"), "__row").groupBy("__group").agg(first.alias("__first"))
            .select(F.col("__first.__row").alias("__row")))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secret values replaced by a mark; clean ones unchanged."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048."""
    return pack(docs, public_tokenizers.path(TOKENIZER), SEQUENCE_TOKENS)


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("secrets", secret_stage), ("packing", packing_stage)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
