"""The folder that every node sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``; where that is unset on a local master (tests), in a local one.

    The caller's tables live there as long as it wants them; nothing deletes them.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that every node sees")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="basalt-"))
        found = _own[0]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
