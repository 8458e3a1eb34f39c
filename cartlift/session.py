"""Session construction and checkpoint-folder resolution."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle partitions to the advisory size, not to many tiny tasks
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # independent readouts are submitted from several driver threads
    "spark.scheduler.mode": "FAIR",
}


def build_session(master: str | None = "local[8]", app: str = "cartlift",
                  shuffle_partitions: int | None = None, driver_memory: str = "8g",
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the engine relies on.

    On a cluster pass ``master=None`` and let spark-submit decide: memory,
    shuffle partitions and addresses are set for a local master only (8
    shuffle partitions unless given).
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            conf.setdefault("spark.sql.shuffle.partitions", "8")
            conf["spark.driver.host"] = "127.0.0.1"
            conf["spark.driver.bindAddress"] = "127.0.0.1"
            conf["spark.driver.memory"] = driver_memory
            conf["spark.scheduler.allocation.file"] = _pool_file()
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


LEARNER_POOL = "learners"


def _pool_file() -> str:
    """FAIR pool definitions read by the (local) driver: the learner fits are the
    longest chain of a run, so their pool gets a larger weight and a minimum
    share.  On a cluster pass ``spark.scheduler.allocation.file`` explicitly."""
    path = os.path.join(tempfile.gettempdir(), "cartlift-pools.xml")
    with open(path, "w") as fh:
        fh.write(f"""<?xml version="1.0"?>
<allocations>
  <pool name="{LEARNER_POOL}"><schedulingMode>FAIR</schedulingMode><weight>3</weight><minShare>4</minShare></pool>
</allocations>
""")
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only when it is unset *and* the master is local (tests,
    laptop runs) is a private scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="cartlift-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df, name: str | None = None, codec: str | None = None):
    """Cut lineage: write ``df`` as a Parquet table in the shared checkpoint
    folder and read it back.

    Used for tables that many later jobs read (the customer table, the scored
    split).  Compared with ``Dataset.checkpoint`` the table is columnar, so
    later jobs prune columns and push filters into the scan; a lost executor
    re-reads files instead of re-running the purchase scan and shuffles.
    ``codec`` names another Parquet compression than the session's.
    """
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name or 'table'}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


_written: list[str] = []  # folders of materialised tables, in the order of writing


def written_tables() -> int:
    """A mark for :func:`drop_tables`: how many tables were materialised so far."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that :func:`materialize` wrote after the mark; frames
    that read them must not be used any more.  Returns their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = _written[since:]
    del _written[since:]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)
