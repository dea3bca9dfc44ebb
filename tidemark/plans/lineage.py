"""Cutting lineage where a derived table is read several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ready_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; only a local session may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[[^\]]*\])?$", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{_ready_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a derived table to the shared checkpoint folder and read it from there.

    For small results of long plans that later steps read more than once.
    """
    _ready_folder(df.sparkSession)
    return df.checkpoint(eager=True)
