"""Summary statistics of jobs with waste metrics. Every function returns a small DataFrame; none collects rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.numeric import DOMAINS, exact_sum, ordinal, round_even
from tarn.operators.ranks import quantiles

MEASURES = ("cpu_waste", "mem_waste", "composite_waste")
THRESHOLDS = (0.5, 0.75, 0.9)
TOP_USERS, LEAST_JOBS = 20, 5


def pearson(x: str, y: str) -> Column:
    """Correlation over rows with both values; null where one is constant, which corr() takes as a division by zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def overall(jobs: DataFrame) -> DataFrame:
    plain = jobs.agg(
        F.count("*").alias("total_jobs"), F.avg("cpu_waste").alias("cpu_waste_mean"), F.stddev_samp("cpu_waste").alias("cpu_waste_std"), F.avg("mem_waste").alias("mem_waste_mean"),
        F.avg("composite_waste").alias("composite_waste_mean"),
    )
    middle = quantiles(jobs.select(F.col("cpu_waste").alias("v")), (0.5,), []).select(F.col("q")[0].alias("cpu_waste_median"))  # one row, or none
    return plain.join(middle, F.lit(True), "left").select("total_jobs", "cpu_waste_mean", "cpu_waste_median", "cpu_waste_std", "mem_waste_mean", "composite_waste_mean")


def thresholds(jobs: DataFrame) -> DataFrame:
    """One row per threshold: the share of jobs above it in each measure, in percent. Null is not above."""
    cells = [(F.avg(F.when(F.col(c) > t, 1.0).otherwise(0.0)) * 100).alias(f"{c}_{k}") for k, t in enumerate(THRESHOLDS) for c in MEASURES]
    wide = jobs.agg(*cells)
    rows = ", ".join(f"'>{int(t * 100)}%', " + ", ".join(f"{c}_{k}" for c in MEASURES) for k, t in enumerate(THRESHOLDS))
    return wide.selectExpr(f"stack({len(THRESHOLDS)}, {rows}) as (threshold, cpu_waste_pct, mem_waste_pct, composite_waste_pct)")


def total(column: str) -> Column:
    """The sum of a column, 0 without rows, whatever the order in which rows are added."""
    return F.coalesce(exact_sum(F.col(column)), F.lit(0.0))


def totals(jobs: DataFrame) -> DataFrame:
    mean = lambda c: F.try_divide(exact_sum(F.col(c)), F.count(c))
    return jobs.agg(
        total("cpu_hours_wasted").alias("total_cpu_hours_wasted"), mean("cpu_hours_wasted").alias("avg_cpu_hours_wasted_per_job"),
        total("mem_gb_hours_wasted").alias("total_mem_gb_hours_wasted"), mean("mem_gb_hours_wasted").alias("avg_mem_gb_hours_wasted_per_job"),
    )


def _stats() -> list[Column]:
    return [round_even(F.avg("composite_waste")).alias("mean"), round_even(F.stddev_samp("composite_waste")).alias("std"), F.count("composite_waste").alias("count")]


def by_key(jobs: DataFrame, key: str) -> DataFrame:
    """Mean, deviation and count of the composite waste per key, rounded; null keys are left out."""
    return jobs.where(F.col(key).isNotNull()).groupBy(key).agg(*_stats()).orderBy(key)


def domain(jobs: DataFrame, key: str) -> DataFrame:
    """The fixed labels of a category with their ordinals."""
    labels = DOMAINS[key]
    return jobs.sparkSession.createDataFrame(list(enumerate(labels)), "ordinal int, label string")


def by_category(jobs: DataFrame, key: str) -> DataFrame:
    """The same per category, with categories that no job has, in order of the domain."""
    found = jobs.groupBy(key).agg(*_stats())
    dense = domain(jobs, key).join(found, F.col("label") == F.col(key), "left")
    return dense.select(F.col("label").alias(key), "ordinal", "mean", "std", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")).orderBy("ordinal")


def user_waste(jobs: DataFrame) -> DataFrame:
    return (
        jobs.where(F.col("job_username").isNotNull()).groupBy("job_username")
        .agg(
            F.count("composite_waste").alias("job_count"), round_even(F.avg("composite_waste")).alias("avg_waste"),
            round_even(F.stddev_samp("composite_waste")).alias("std_waste"), round_even(total("cpu_hours_wasted")).alias("total_cpu_hours_wasted"),
        )
    )


def top_wasting_users(jobs: DataFrame) -> DataFrame:
    """Of users with LEAST_JOBS jobs or more, those with the largest rounded averages; ties by name."""
    return user_waste(jobs).where(F.col("job_count") >= LEAST_JOBS).orderBy(F.desc("avg_waste"), "job_username").limit(TOP_USERS)


def top_impact_users(jobs: DataFrame) -> DataFrame:
    """The users with the most wasted core-hours; ties by name."""
    impact = jobs.where(F.col("job_username").isNotNull()).groupBy("job_username").agg(total("cpu_hours_wasted").alias("total_cpu_hours_wasted"))
    return impact.orderBy(F.desc("total_cpu_hours_wasted"), "job_username").limit(TOP_USERS)


def correlations(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        pearson("cpu_waste", "mem_waste").alias("cpu_mem_correlation"), pearson("cpu_waste", "duration_hours").alias("cpu_duration_correlation"),
        pearson("cpu_waste", "ncores").alias("cpu_size_correlation"),
    )


def category_counts(jobs: DataFrame, key: str = "waste_category") -> DataFrame:
    """Jobs and their share per category, with empty categories, most frequent first. Jobs without a category don't count."""
    found = jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    dense = domain(jobs, key).join(found, F.col("label") == F.col(key), "left").select(F.col("label").alias(key), "ordinal", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    whole = found.agg(F.sum("n").alias("whole"))  # one row
    return dense.crossJoin(whole).select(key, F.col("n").alias("count"), F.try_divide(F.col("n") * 100.0, F.col("whole")).alias("pct")).orderBy(F.desc("count"), ordinal(F.col(key), DOMAINS[key]))


def exitcode_order(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("job_exitcode").isNotNull()).groupBy("job_exitcode").agg(F.avg("composite_waste").alias("mean")).orderBy(F.desc("mean"), "job_exitcode")


def daily(jobs: DataFrame) -> DataFrame:
    """Per UTC day: mean, deviation and count of the composite waste, and wasted core-hours."""
    day = F.to_date("start_time").alias("date")
    return jobs.where(F.col("start_time").isNotNull()).groupBy(day).agg(
        F.avg("composite_waste").alias("mean"), F.stddev_samp("composite_waste").alias("std"), F.count("composite_waste").alias("count"), total("cpu_hours_wasted").alias("cpu_hours_wasted"),
    ).orderBy("date")


def percentiles(jobs: DataFrame, of: str = "composite_waste", points: tuple[int, ...] = (25, 50, 75, 90)) -> DataFrame:
    """Exact percentiles with linear interpolation, one row each."""
    wide = quantiles(jobs.select(F.col(of).alias("v")), tuple(p / 100 for p in points), [])
    return wide.select(F.posexplode("q").alias("k", "value")).select(F.element_at(F.array(*[F.lit(p) for p in points]), F.col("k") + 1).alias("percentile"), "value")


def counters(jobs: DataFrame, samples: DataFrame) -> DataFrame:
    """Jobs, and files with a valid sample."""
    return jobs.agg(F.count("*").alias("total_jobs")).crossJoin(samples.agg(F.count_distinct("file_id").alias("non_empty_files")))
