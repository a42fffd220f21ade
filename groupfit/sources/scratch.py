"""A folder that all executors share, for streaming checkpoints and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import FitError


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or in a temporary one where it is unset (tests on one machine)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise FitError("NO_SHARED_FOLDER", "spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="groupfit-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
