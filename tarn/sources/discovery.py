"""Finding telemetry files: a tree of year, month and day folders with plain names, and parquet files in the day folders.

The list of files is a DataFrame (path, year, month, day, file_name), so pruning is filtering, before any data are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYSTEMS = ("stampede", "conte", "anvil")
PROBES = 20
PATH = r"(?:^|/)([^/]+)/([^/]+)/([^/]+)/([^/]+)$"


def list_paths(spark: SparkSession, data_dir: str) -> list[str]:
    """All parquet files three folders below data_dir, sorted; any file system that Spark reads."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{data_dir.rstrip('/')}/*/*/*/*.parquet")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in (fs.globStatus(pattern) or []) if s.isFile())


def files_from_paths(paths: DataFrame) -> DataFrame:
    """Year, month, day and name of each path (column path)."""
    part = lambda k: F.regexp_extract("path", PATH, k)
    return paths.select("path", part(1).alias("year"), part(2).alias("month"), part(3).alias("day"), part(4).alias("file_name"))


def discover(spark: SparkSession, data_dir: str) -> DataFrame:
    return files_from_paths(spark.createDataFrame([(p,) for p in list_paths(spark, data_dir)], "path string"))


def prune_years(files: DataFrame, years: list[int] | None) -> DataFrame:
    """Only the given years. Years are read as numbers only then, and a folder whose name is none is an error."""
    return files.where(F.col("year").cast("int").isin(*years)) if years else files


def filter_system(files: DataFrame, system: str | None) -> DataFrame:
    """Only files whose names carry the system's mark: _S, _C or neither. A name with both marks is of two systems; other systems filter nothing."""
    s, c = F.col("file_name").contains("_S"), F.col("file_name").contains("_C")
    tests = {"stampede": s, "conte": c, "anvil": ~s & ~c}
    name = (system or "all").lower()
    if name not in (*tests, "all"):
        import logging

        logging.getLogger(__name__).warning("unknown system %r: no filter", system)
    return files.where(tests[name]) if name in tests else files


def limit_per_day(files: DataFrame, n: int | None) -> DataFrame:
    """The first n files of each day by name, after any other filter."""
    if not n:
        return files
    w = W.partitionBy("year", "month", "day").orderBy("file_name")
    return files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def stride(files: DataFrame, probes: int = PROBES) -> DataFrame:
    """Every (n // probes)-th file in order of the paths, from the first; all if there are fewer than two strides."""
    w = W.orderBy("path")  # a list of files, not data
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy()) / probes))
    return files.withColumn("_k", F.row_number().over(w) - 1).withColumn("_step", step).where(F.col("_k") % F.col("_step") == 0).drop("_k", "_step")


def select_files(files: DataFrame, years: list[int] | None = None, per_day: int | None = None, system: str | None = None) -> DataFrame:
    return limit_per_day(filter_system(prune_years(files, years), system), per_day)
