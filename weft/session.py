"""What every session needs: the package itself on the executors, and tables whose rows keep all cores busy."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session's application, once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="weft-code-")
        atexit.register(shutil.rmtree, folder, True)
        at = os.path.join(folder, "weft_code.zip")
        with zipfile.ZipFile(at, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see: in spark.checkpoint.dir, or, where that is unset, a temporary one of a
    local master.  It is removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    path = f"{root.rstrip('/')}/weft-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already; the folder is the cluster's scratch space
        pass


def read_table(spark: SparkSession, path: str, small: int = 64 << 20) -> DataFrame:
    """A Parquet table.  A task reads a row group at least, and a small table often has one only: tables of less than `small` bytes
    in few parts are dealt out to all cores; others are read as they are, without a shuffle."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1 << 18 < size < small and df.rdd.getNumPartitions() <= 2 * cores else df


def dealt(df: DataFrame, key: str, each: int = 4 << 20) -> DataFrame:
    """df in parts of about `each` bytes by a key, which Spark is not to bring together again, for a join and much work on each row
    after it: by their bytes alone few tasks would do all of it.  A table that is no larger than a part for each core stays as it is."""
    parts = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // each
    return df.repartition(parts, key) if parts > df.sparkSession.sparkContext.defaultParallelism else df
