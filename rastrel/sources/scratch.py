"""Folders for files that queries pass through."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset, under a temporary folder that goes with the
    process, which only a local master can use (ValueError for others)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="rastrel-files-")
            atexit.register(shutil.rmtree, _own[application], ignore_errors=True)
        root = _own[application]
    return f"{root.rstrip('/')}/rastrel/{tag}-{uuid.uuid4().hex}"
