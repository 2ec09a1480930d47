"""Waste metrics and classes of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.numeric import DURATION, SEVERITY, SIZE, binned, clip01

# Memory per core of the systems in GB, and the names of the metrics in the order of their columns.
MEMORY = {"stampede": 2.0, "conte": 4.0, "anvil": 2.0}
WASTE_COLUMNS = ("cpu_waste", "system", "mem_per_core", "estimated_requested_mem_gb", "mem_waste", "composite_waste", "cpu_hours_wasted", "mem_gb_hours_wasted", "duration_category", "size_category", "waste_category")


def with_cpu_waste(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("cpu_waste", clip01(F.lit(1.0) - F.col("job_cpu_usage") / F.lit(100.0)))


def with_system(jobs: DataFrame, strict: bool = True) -> DataFrame:
    """The system by a mark in the queue's name. A null queue is an error, unless not strict: then the system is null."""
    queue = F.col("queue")
    named = F.when(queue.contains("_S"), F.lit("stampede")).when(queue.contains("_C"), F.lit("conte")).when(queue.isNotNull(), F.lit("anvil"))
    return jobs.withColumn("system", named.otherwise(F.raise_error(F.lit("a job has no queue")).cast("string")) if strict else named)


def with_memory_per_core(jobs: DataFrame) -> DataFrame:
    out = None
    for name, gb in MEMORY.items():
        test = F.col("system") == F.lit(name)
        out = F.when(test, F.lit(gb)) if out is None else out.when(test, F.lit(gb))
    return jobs.withColumn("mem_per_core", out)


def with_mem_waste(jobs: DataFrame) -> DataFrame:
    asked = jobs.withColumn("estimated_requested_mem_gb", F.col("ncores") * F.col("mem_per_core"))
    return asked.withColumn("mem_waste", clip01(F.lit(1.0) - F.try_divide(F.col("value_memused"), F.col("estimated_requested_mem_gb"))))


def with_composite(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("composite_waste", F.lit(0.5) * F.col("cpu_waste") + F.lit(0.5) * F.col("mem_waste"))


def with_economics(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({
        "cpu_hours_wasted": F.col("cpu_waste") * F.col("ncores") * F.col("duration_hours"),
        "mem_gb_hours_wasted": F.col("mem_waste") * F.col("estimated_requested_mem_gb") * F.col("duration_hours"),
    })


def with_categories(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({"duration_category": binned(F.col("duration_hours"), *DURATION), "size_category": binned(F.col("ncores"), *SIZE), "waste_category": binned(F.col("composite_waste"), *SEVERITY)})


def with_waste(jobs: DataFrame, strict: bool = True) -> DataFrame:
    """The eleven derived columns, in their order."""
    out = with_categories(with_economics(with_composite(with_mem_waste(with_memory_per_core(with_system(with_cpu_waste(jobs), strict))))))
    return out.select(*jobs.columns, *WASTE_COLUMNS)
