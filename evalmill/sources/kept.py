"""Tables between steps, in the folder all executors share: a lost executor loses nothing, and what is read twice is made once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def scratch(spark, name: str) -> str:
    """A new folder for files that are written and read again: in ``spark.checkpoint.dir``, which all executors share; without it only a session on this machine has one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to a new table and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
