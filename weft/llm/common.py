"""Shared plumbing: the scratch folder all executors see, materialised tables and byte-bounded Arrow slices."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09-\x0D, as a class for Java's regular expressions.
WS = r"[\x20\x09-\x0D]"

_made: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset a local master gets a temporary folder; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the scratch folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/weft-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean, spark)
    _made.add(path)
    return path


def _clean(spark: SparkSession) -> None:
    try:
        discard(spark, _made)
    except Exception:  # the JVM may be gone already; the folder is the cluster's scratch space
        pass


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """What make() gives, written and read back, and its path; the scratch tables that it needed on the way are removed."""
    before = set(_made)
    out = make()
    path = scratch_path(spark, label)
    out.write.parquet(path)
    discard(spark, _made - before - {path})
    return spark.read.schema(out.schema).parquet(path), path


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _made.discard(path)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores after it while a column already has the name (Spark compares names without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and, last, what tells each row apart however often it is read (its file and place there), and that column's name.

    A table that comes from no Parquet file is written to files of its own first.
    """
    (name,) = free_names(docs.columns, "row")
    try:
        at = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.concat_ws(":", at["file_path"], at["row_index"])), name
    except AnalysisException as e:
        if not str(e.getCondition()).startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):  # no file, or one without row numbers
            raise
        return numbered(save(docs, "documents"))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named string or binary column holds about `most` bytes a slice (one row at least)."""
    for batch in batches:
        data, start, total = batch.column(column), 0, 0
        sizes = pa.compute.binary_length(data).to_pylist()
        for i, size in enumerate(sizes):
            if total and total + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if start < len(sizes):
            yield batch.slice(start)
