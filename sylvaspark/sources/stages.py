"""Written stages: tables in the shared folder that cut lineage and survive lost executors."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options of a stage's write to folders of the scheme file (others ignore them): no checksum files.  Without native code Hadoop
#: starts chmod for every folder and file that a task makes, and as it starts a process an executor's memory shows twice.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sylvaspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**PLAIN_FILES).parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    back._written_at = at
    return back


def release(*stages: DataFrame) -> None:
    """Empty the folders of written stages that nothing reads any more."""
    for df in stages:
        df.sparkSession.range(0).coalesce(1).write.mode("overwrite").options(**PLAIN_FILES).parquet(df._written_at)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of finite numbers and strings as one literal: no Python worker starts to read them."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))
