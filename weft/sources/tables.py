"""Folders that are replaced as a whole, and streams whose batches are written once.

A versioned folder holds one folder for each version and a pointer, the file `_current`, whose first line names the version that
counts.  A new version is written beside the others and the pointer is moved last, by one rename: until then, and where the
write fails, readers see the old one; so a table may be read and replaced in one job.  Some versions before the current one are
kept for those who are still reading them.

A stream's output holds one folder for each micro-batch and a mark for each batch that is whole.  A batch that is marked is skipped
when it is replayed; one that was written but not marked is written anew.  Readers take marked batches only, so each row is there
once, whatever failed in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer replaced the folder meanwhile."""


class Files:
    """The few operations on files that this needs, in whatever store holds the path, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop, self._gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
        conf, at = spark._jsc.hadoopConfiguration(), self._hadoop.Path(path)
        self._system = at.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._system.getUri(), conf)

    def exists(self, path: str) -> bool:
        return self._system.exists(self._hadoop.Path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none where it does not exist."""
        return sorted(x.getPath().getName() for x in self._system.listStatus(self._hadoop.Path(path))) if self.exists(path) else []

    def remove(self, path: str) -> None:
        self._system.delete(self._hadoop.Path(path), True)

    def read(self, path: str) -> str | None:
        """A small file's text; nothing where it does not exist."""
        at = self._hadoop.Path(path)
        if not self._system.exists(at):
            return None
        data = bytearray()
        source = self._system.open(at)
        try:
            while (x := source.read()) >= 0:
                data.append(x)
        finally:
            source.close()
        return data.decode()

    def put(self, path: str, text: str) -> None:
        """Write a small file beside its place and move it there, over the old one: others see either the old text or the new."""
        parked = f"{path}.{uuid.uuid4().hex}"
        out = self._system.create(self._hadoop.Path(parked), False)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(parked, path)

    def move(self, path: str, to: str) -> None:
        """Rename, over what is there."""
        kind = getattr(self._hadoop, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self._context.rename(self._hadoop.Path(path), self._hadoop.Path(to), how)

    def make(self, path: str) -> None:
        self._system.mkdirs(self._hadoop.Path(path))


# Versions


def _versions(files: Files, path: str) -> list[str]:
    return (files.read(f"{path}/_current") or "").split()


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that counts."""
    held = _versions(Files(spark, path), path)
    if not held:
        raise FileNotFoundError(f"no version was ever written to {path}")
    return f"{path}/{held[0]}"


def replace(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Call write() with a new folder; once it has returned, that folder is the version that counts.  Gives the folder.

    Any writer of this library will do.  The last `keep` versions are kept.  A write that fails leaves nothing behind; a writer that
    finds on its return that another one was faster raises Conflict.
    """
    files = Files(spark, path)
    before, own = _versions(files, path), f"v-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{own}")
        if _versions(files, path) != before:
            raise Conflict(f"{path} was replaced meanwhile")
    except BaseException:
        files.remove(f"{path}/{own}")
        raise
    held = [own, *before]
    files.put(f"{path}/_current", "\n".join(held[:keep]))
    for name in held[keep:]:
        files.remove(f"{path}/{name}")
    return f"{path}/{own}"


def write_table(df: DataFrame, path: str, keep: int = 2) -> str:
    """Replace a table by df, which may be read from it."""
    return replace(df.sparkSession, path, lambda folder: df.write.parquet(folder), keep)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


# Batches of a stream


def write_batch(batch: DataFrame, number: int, path: str) -> bool:
    """Write a micro-batch with its number; whether there was anything to do."""
    files = Files(batch.sparkSession, path)
    mark, folder = f"{path}/_batches/{number:020d}", f"{path}/batch={number}"
    if files.exists(mark):
        return False
    files.remove(folder)  # of an attempt that failed before its mark
    batch.write.parquet(folder)
    files.make(f"{path}/_batches")
    files.put(mark, str(number))
    return True


def once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: every batch of the stream is in the output once.  A stream has a path and a checkpoint of its own."""
    return lambda batch, number: (write_batch(batch, number, path), None)[1]


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that are whole, and column batch."""
    files = Files(spark, path)
    numbers = [int(x) for x in files.names(f"{path}/_batches") if x.isdigit()]
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(*(f"{path}/batch={n}" for n in numbers))
