"""Parquet and CSV scans and sinks, artifacts with identity in their path, and footer facts."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def artifacts(spark: SparkSession, glob: str) -> DataFrame:
    """Parquet files of many runs with ``dataset``, ``method`` and ``seed`` from .../{dataset}/{method}_seed{n}.parquet."""
    at = F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", "")  # a file, or a folder of part files
    df = spark.read.option("mergeSchema", True).parquet(glob)
    return df.withColumns({"dataset": F.regexp_extract(at, r"/([^/]+)/[^/]+$", 1), "method": F.regexp_extract(at, r"/([^/]+)_seed\d+[^/]*$", 1), "seed": F.regexp_extract(at, r"_seed(\d+)[^/]*$", 1).try_cast("int")})


def save(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def listed(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(path, modificationTime, length) of the files below a folder, in any store Spark reads; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, or a folder of any files, is there, in any store Spark reads."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def validated(spark: SparkSession, path: str, rows: int) -> None:
    """Raise unless the table written at ``path`` has as many rows as were meant."""
    found = footers(spark, path).agg(F.sum("rows").alias("n")).first()["n"] or 0
    if found != rows:
        raise OSError(f"{path} has {found} rows, not {rows}")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows) of each Parquet file below ``path``: no column is read, so row counts come from the footers alone."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))


def footer_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, metadata) the key-values of each Parquet file's schema, such as a dataset's ground truth.

    Spark does not show them, so the files, which hold one dataset each, are read whole; no page of data is decoded.
    """

    def run(batches):
        for batch in batches:
            pairs = [[(k.decode(), v.decode(errors="replace")) for k, v in (pq.read_schema(pa.BufferReader(c.as_buffer())).metadata or {}).items()] for c in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(pairs, pa.map_(pa.string(), pa.string()))], names=["path", "metadata"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, metadata map<string,string>")


def dataset_shape(spark: SparkSession, path: str, target: str = "y") -> tuple[int, int]:
    """(rows, features) of a dataset, from its footers."""
    names = spark.read.option("recursiveFileLookup", True).parquet(path).columns
    return footers(spark, path).agg(F.sum("rows").alias("n")).first()["n"], len([c for c in names if c != target])


def datasets(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the datasets below a folder: files, or folders of part files, called ``prefix``name.parquet."""
    name = F.regexp_extract("path", rf"/{prefix}([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return sorted(r[0] for r in listed(spark, folder).select(name.alias("n")).where("n <> ''").distinct().collect())


def pending(grid: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The experiments of a grid that are not done."""
    return grid.join(done.select(*key).distinct(), key, "left_anti")


def config_id(name: str, params: dict) -> str:
    """``name__`` and 16 hex digits of the MD5 of the parameters as sorted JSON."""
    import hashlib
    import json

    return f"{name}__{hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]}"
