"""Micro-batches as report files, with a manifest of those that are committed.

A batch is written below `_staging`, moved to `batch=<number>` and entered in
`_manifest/<number>`. Only the last step makes it part of the output: a batch that was
killed before leaves nothing that a reader sees, and its repetition replaces what it left.
A batch that is in the manifest is not written again. All steps are those of the file
system that Spark writes to; on object stores the move is a copy, and the manifest entry
is still one write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import remove_folder
from gleanery.sinks.writers import WRITERS


class _Files:
    """The file system of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.system = self.new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.new(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.new(path)))

    def move(self, source: str, target: str) -> None:
        if not self.system.rename(self.new(source), self.new(target)):
            raise OSError(f"cannot move {source} to {target}")

    def touch(self, path: str) -> None:
        self.system.create(self.new(path), False).close()


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches in the manifest, in order."""
    return sorted(int(name) for name in _Files(spark, path).names(f"{path}/_manifest") if name.isdigit())


def write_batch(batch: DataFrame, path: str, number: int, format: str) -> None:
    """Write and commit one batch; one that is committed already is left as it is."""
    if format not in WRITERS:
        raise ValueError(f"unsupported format: {format}")
    spark = batch.sparkSession
    files = _Files(spark, path)
    staged, final, entry = f"{path}/_staging/{number}", f"{path}/batch={number}", f"{path}/_manifest/{number}"
    if files.exists(entry):
        return
    # What a killed run has left of this batch.
    remove_folder(spark, f"{path}/_staging")
    remove_folder(spark, final)
    try:
        WRITERS[format](batch, staged, "error")
        files.move(staged, final)
        files.touch(entry)
    except BaseException:
        remove_folder(spark, f"{path}/_staging")
        raise


def read_committed(spark: SparkSession, path: str, reader) -> DataFrame | None:
    """`reader(folders)` over the folders of the committed batches; None before the first."""
    folders = [f"{path}/batch={n}" for n in committed_batches(spark, path)]
    return reader(folders) if folders else None
