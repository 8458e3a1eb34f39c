"""Landing of delimited source files: broken lines set aside and counted (O-01, O-05).

Lines are read as text fields; nothing is dropped in silence.  A line goes to
the quarantine table, as it stood, for the first reason that applies:

* ``columns``: more or fewer fields than the schema has;
* ``no_client``: no client id;
* ``number:<column>``: a numeric field that holds something else.

An unparsable time does not quarantine a line (its transaction still counts):
the time becomes NULL and the line is counted under ``time`` besides.

Each landing takes the files that no earlier landing has taken, by path, length
and modification time, and writes ``staged/`` (whole and broken lines in folders
of their own) and ``reasons/`` under ``landing=<id>``; its manifest of files is written last.  Readers take the
manifest's landings only, so a landing that died half way is invisible and the
next one takes its files again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.sources.raw import ID, parse_timestamp

CORRUPT = "_line"


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", F.col("modificationTime").alias("modified")))


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, length, modified, landing) of all files that complete landings took."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/manifest")
    except AnalysisException:  # nothing was landed yet
        return None


def read_lines(spark: SparkSession, paths: list[str], schema: T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """All fields as text, and the whole line where their number is wrong."""
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(text).option("header", str(header).lower()).option("sep", sep).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", "true").csv(paths))


def classify(lines: DataFrame, schema: T.StructType, times: tuple[str, ...] = ()) -> DataFrame:
    """Typed fields with ``_reason`` (NULL: the line is whole), ``_bad_time`` and ``_line``."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "columns").when(F.coalesce(F.trim(ID), F.lit("")) == "", "no_client")
    cols = []
    for f in schema.fields:
        raw = F.col(f.name)
        if f.name in times:
            cols.append(parse_timestamp(f.name).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(raw)
        else:
            value = F.trim(raw).try_cast(f.dataType)
            reason = reason.when(raw.isNotNull() & (F.trim(raw) != "") & value.isNull(), f"number:{f.name}")
            cols.append(F.nanvl(value, F.lit(None)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else value.alias(f.name))
    bad_time = F.lit(False)
    for t in times:
        bad_time = bad_time | (F.col(t).isNotNull() & (F.trim(t) != "") & parse_timestamp(t).isNull())
    line = F.coalesce(CORRUPT, F.to_csv(F.struct(*[f.name for f in schema.fields])))
    return lines.select(*cols, reason.alias("_reason"), bad_time.alias("_bad_time"), line.alias(CORRUPT))


def land(spark: SparkSession, source: str, root: str, schema: T.StructType, times: tuple[str, ...] = (),
         header: bool = True, sep: str = ",") -> str | None:
    """Land the new files below ``source``; returns the landing's id, None if there are none."""
    root = root.rstrip("/")
    found, taken = files_under(spark, source), manifest(spark, root)
    new = found if taken is None else found.join(taken.select("path", "length", "modified"),
                                                 ["path", "length", "modified"], "left_anti")
    files = new.collect()  # one row per file
    if not files:
        return None
    landing = uuid.uuid4().hex
    seen = classify(read_lines(spark, [r["path"] for r in files], schema, header, sep), schema, times)
    seen = seen.withColumn("_status", F.when(F.col("_reason").isNull(), "whole").otherwise("broken"))
    # one pass over the text: both outcomes are written side by side, then read apart
    staged = f"{root}/staged/landing={landing}"
    seen.write.partitionBy("_status").parquet(staged)
    both = spark.read.schema(seen.schema).parquet(staged)
    whole = F.col("_status") == "whole"
    reasons = [F.when(~whole, F.col("_reason")), F.when(whole & F.col("_bad_time"), "time"), F.when(whole, "landed")]
    (both.select(F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull())).alias("reason"))
     .groupBy("reason").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{root}/reasons/landing={landing}"))
    spark.createDataFrame(files, found.schema).coalesce(1).write.parquet(f"{root}/manifest/landing={landing}")  # the commit
    return landing


def _complete(spark: SparkSession, root: str, df: DataFrame) -> DataFrame:
    done = manifest(spark, root)
    landings = [r["landing"] for r in done.select("landing").distinct().collect()] if done is not None else []
    return df.where(F.col("landing").isin(*landings)) if landings else df.limit(0)


def landed(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Whole lines of all complete landings."""
    names = [f.name for f in schema.fields]
    df = _complete(spark, root, spark.read.parquet(f"{root.rstrip('/')}/staged"))
    return df.where("_status = 'whole'").select(*names)


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """(landing, reason, line) of the lines that were set aside."""
    df = _complete(spark, root, spark.read.parquet(f"{root.rstrip('/')}/staged"))
    return df.where("_status = 'broken'").select("landing", F.col("_reason").alias("reason"), F.col(CORRUPT).alias("line"))


def landing_report(spark: SparkSession, root: str) -> DataFrame:
    """Lines per reason over all complete landings; ``landed`` counts the whole ones."""
    df = _complete(spark, root, spark.read.parquet(f"{root.rstrip('/')}/reasons"))
    return df.groupBy("reason").agg(F.sum("n").alias("n"))
