"""Writing results: job tables as compressed CSV, summaries as JSON, figure data as parquet, figures as text."""

from __future__ import annotations

import datetime
import json
import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tarn.operators.jobs import JOB_COLUMNS
from tarn.operators.waste import WASTE_COLUMNS


def write_jobs(jobs: DataFrame, path: str, single_file: bool = False) -> None:
    """Gzip CSV with a header, in the fixed order of columns, the UTC date last. One file only on request: it is written by one task."""
    out = jobs.withColumn("date", F.to_date("start_time")).select(*JOB_COLUMNS, *WASTE_COLUMNS, "date")
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def plain(value):
    """What JSON can hold: NaN and infinities become null, dates text, rows records."""
    if isinstance(value, Row):
        return plain(value.asDict())
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file on any file system that Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_summary(spark: SparkSession, stats: dict, path: str) -> None:
    write_text(spark, path, json.dumps(plain(stats), indent=2))


def write_plot_data(frames: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Each frame, all of them small, as one parquet file, which keeps its order; returns the frames as they were written."""
    out = {}
    for name, frame in frames.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")
    return out
