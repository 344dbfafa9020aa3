"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path that no other call uses, below spark.checkpoint.dir.  Only a
    local session may go without that setting: its folder is then in /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file:///tmp/checkpoints/keyfold"
    return f"{folder.rstrip('/')}/keyfold-{label}-{uuid.uuid4().hex}"
