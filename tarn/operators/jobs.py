"""One row per job: sampling of jobs, partial aggregates per file, and the job table."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.ranks import smallest

# The attributes and measures of a job, in the order of its columns.
FIRSTS = ("start_time", "end_time", "job_exitcode", "queue", "job_username", "ncores", "nhosts", "duration_hours")
#: What samples have if they are valid (see cleaning.valid).
NEVER_NULL = ("start_time", "end_time", "ncores", "duration_hours")
MEASURES = ("job_cpu_usage", "value_memused")
JOB_COLUMNS = ("jid", *FIRSTS, *MEASURES)
SEED = 42


def partial_jobs(samples: DataFrame) -> DataFrame:
    """Per file and job: the first non-null value of each attribute in row order, means and counts of the measures."""
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_index"))).alias(f"{c}_first") for c in FIRSTS]
    sums = [f(F.col(c)).alias(f"{c}_{n}") for c in MEASURES for f, n in ((F.avg, "mean"), (F.count, "count"))]
    return samples.where(F.col("jid").isNotNull()).groupBy("file_id", "jid").agg(*firsts, *sums)


def merge_partials(partials: DataFrame) -> DataFrame:
    """Jobs from partials of files: attributes of the first file that has the job, null or not; means weighted by counts."""
    firsts = [F.min_by(F.col(f"{c}_first"), F.col("file_id")).alias(c) for c in FIRSTS]
    means = []
    for c in MEASURES:
        n = F.sum(f"{c}_count")
        means.append(F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(F.sum(F.col(f"{c}_mean") * F.col(f"{c}_count")), n)).alias(c))
    return partials.groupBy("jid").agg(*firsts, *means)


def job_table(samples: DataFrame, keys: tuple[str, ...] = (), valid: bool = False) -> DataFrame:
    """The same jobs in one aggregation, whose partial step Spark plans itself: of the first file that has the job, the first non-null
    value. The weighted mean of means is the mean of the samples. `keys` keeps runs apart that share samples. Of `valid` samples those attributes that have no nulls come from the first row together."""
    together = [c for c in FIRSTS if valid and c in NEVER_NULL]

    def first(c: str) -> Column:
        return F.min_by(F.col(c), F.struct(F.col("file_id"), F.col(c).isNull(), F.col("row_index"))).alias(c)

    row = [F.min_by(F.struct(*together), F.struct("file_id", "row_index")).alias("_first")] if together else []
    means = [F.avg(c).alias(c) for c in MEASURES]
    found = samples.where(F.col("jid").isNotNull()).groupBy(*keys, "jid").agg(*row, *[first(c) for c in FIRSTS if c not in together], *means)
    return found.select(*keys, "jid", *[F.col(f"_first.{c}").alias(c) if c in together else F.col(c) for c in FIRSTS], *MEASURES)


def distinct_jobs(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("jid").isNotNull()).select("jid").distinct()


def sample_size(n: int, fraction: float) -> int:
    """The share of n, half rounded to even."""
    return int((Decimal(n) * Decimal(str(fraction))).quantize(Decimal(1), ROUND_HALF_EVEN))


def sample_job_ids(samples: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """round(fraction * n) of the n job ids, those with the smallest digests of seed and id; only their number comes to the driver."""
    ids = distinct_jobs(samples).withColumn("_digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("jid").cast("string"))))
    return smallest(ids, "_digest", sample_size(ids.count(), fraction)).select("jid")


def filter_sampled(samples: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The samples of the chosen jobs; all samples if none are chosen. Spark picks the join: ids grow with the jobs, so no broadcast is forced."""
    if ids is None or ids.isEmpty():
        return samples
    return samples.join(ids, "jid", "left_semi")
