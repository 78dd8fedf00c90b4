"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator here assumes.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Worth setting when the session is built. Call sites are recorded for every column
# function otherwise, which takes longer than planning a query of many expressions.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_BASES: dict[str, str] = {}


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a session of one machine
    (master ``local``) may go without it, and then gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL_BASES:
        _LOCAL_BASES[context.applicationId] = tempfile.mkdtemp(prefix="gleanery-")
    return _LOCAL_BASES[context.applicationId]


def session_folder(spark: SparkSession) -> str:
    return f"{scratch_base(spark)}/gleanery/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for intermediate tables and stream checkpoints."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is a file, not a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isFile()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(target, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session; frames over them end with it."""
    remove_folder(spark, session_folder(spark))


def scratch_tables(spark: SparkSession) -> set[str]:
    """The folders of intermediate tables that this session has now."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().toString() for s in system.listStatus(folder)} if system.exists(folder) else set()


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the scratch folder, for input that is read several times
    and costs more to compute than to read. Later readers get only their columns. The
    table stays until ``remove_scratch``."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
