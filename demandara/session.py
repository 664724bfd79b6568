"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job sets on its session. Sizes of shuffles and scans are left to the
# cluster: AQE coalesces and splits shuffle partitions from measured sizes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def build_session(app: str = "demandara", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings above and the given ones."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that must outlive an executor.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where neither that
    setting nor a directory set earlier exists, and the master is local, a fresh local
    folder is made.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getCheckpointDir())
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="demandara-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Used where several later steps read the same intermediate result (raw rows are then
    scanned and windows computed once, and each step still reads only its columns), and
    where two branches must see exactly the same partitions. A lost executor re-reads files
    instead of recomputing the history. With ``by`` each value of these columns has a folder of its
    own, and a filter on them reads only that.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder, wherever Spark can read it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return at.getFileSystem(conf).getContentSummary(at).getLength()


def release(df: DataFrame) -> None:
    """Delete the files of a table from ``materialise`` that no later step reads."""
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    make = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = make(folder)
        path.getFileSystem(conf).delete(path, True)
