"""A folder that driver and executors share, for tables that a job writes on its way."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset (local tests), in the warehouse, which is shared too."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{shared.rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
