"""Where queries write what they read again: below spark.checkpoint.dir, or a temporary folder on one machine."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_FOLDERS: dict[str, str] = {}


def place(spark: SparkSession, name: str) -> str:
    """A new path that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _FOLDERS:
            _FOLDERS[app] = tempfile.mkdtemp(prefix="genomill-")
            atexit.register(shutil.rmtree, _FOLDERS[app], True)
        root = "file://" + _FOLDERS[app]
    return f"{root.rstrip('/')}/genomill-plans-{app}/{name}-{uuid.uuid4().hex[:12]}"
