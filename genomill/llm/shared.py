"""What operators keep between jobs: tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, wherever the driver was started."""
    _bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ship-")
    path = os.path.join(folder, "genomill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("genomill", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)


#: Bytes of an Arrow batch on its way to a worker: rows with long texts or tiles must not fill a worker's memory.
BATCH_BYTES = 8 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))
    if now is None or not 0 < int(now.group(1)) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, as a URI.

    Where the setting is absent, as in tests of one machine, a temporary folder stands in for it; with
    executors on other machines it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="genomill-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return f"{root.rstrip('/')}/genomill-{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return what reads it back: its lineage ends here."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run in here go when it has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def clear(spark: SparkSession) -> None:
    """Remove everything that operators of this application kept; results not yet read are lost."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
