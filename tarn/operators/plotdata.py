"""The data behind the figures, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.numeric import DOMAINS, DURATION, ordinal
from tarn.operators import ranks, summaries

DAYS = 7


def histogram(jobs: DataFrame, of: str = "composite_waste", bins: int = 50) -> DataFrame:
    """Counts in equal bins between the least and the largest value, which belongs to the last bin; empty bins too."""
    edges = jobs.agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo is not null")  # one row
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    placed = jobs.where(F.col(of).isNotNull()).select(F.col(of).alias("v")).crossJoin(edges)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)).cast("int")).otherwise(F.lit(0))
    counts = placed.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), (F.col("lo") + F.col("bin") * width).alias("low_edge"))
    return grid.join(counts, "bin", "left").select("bin", "low_edge", F.coalesce("n", F.lit(0)).cast("bigint").alias("count")).orderBy("bin")


def boxes(jobs: DataFrame, key: str, of: str = "composite_waste") -> DataFrame:
    """Per group: quartiles, whiskers (the furthest values within 1.5 interquartile ranges of the box), and how many values lie outside them."""
    rows = jobs.where(F.col(key).isNotNull() & F.col(of).isNotNull()).select(F.col(key).alias("g"), F.col(of).alias("v"))
    q = ranks.quantiles(rows, (0.25, 0.5, 0.75), ["g"])
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col("v") >= F.col("q")[0] - reach) & (F.col("v") <= F.col("q")[2] + reach)
    out = rows.join(q, "g").groupBy("g", "q", "n").agg(F.avg("v").alias("m"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"))
    order = ordinal(F.col("g"), DOMAINS[key]) if key in DOMAINS else -F.col("m")
    shown = out.orderBy(order, "g")
    return shown.select(F.col("g").alias(key), F.col("n").alias("count"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_low", "whisker_high", F.col("outliers").cast("bigint").alias("outliers"))


def scatter(jobs: DataFrame) -> DataFrame:
    """All points of the scatter plot."""
    return jobs.select("jid", "cpu_waste", "mem_waste", "composite_waste")


def scatter_cells(jobs: DataFrame, cells: int = 100) -> DataFrame:
    """The scatter plot counted on a grid, of a size that does not grow with the jobs."""
    at = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1)).cast("int")
    return jobs.groupBy(at("cpu_waste").alias("x"), at("mem_waste").alias("y")).agg(F.count("*").alias("count"), F.avg("composite_waste").alias("composite_waste"))


def rolling(jobs: DataFrame) -> DataFrame:
    """Daily means with centred means over DAYS days that have jobs, and the band of one rolling deviation. Windows that are cut off, or with
    a null in them, are null. Days are few: the one window without partitions is over days, not over jobs."""
    days = summaries.daily(jobs)
    w = W.orderBy("date").rowsBetween(-(DAYS // 2), DAYS // 2)
    centred = lambda c: F.when(F.count(c).over(w) == DAYS, F.avg(c).over(w))
    out = days.withColumns({"rolling_mean": centred("mean"), "rolling_std": centred("std")})
    return out.select("date", "mean", "std", "count", "cpu_hours_wasted", "rolling_mean", "rolling_std", (F.col("rolling_mean") - F.col("rolling_std")).alias("band_low"), (F.col("rolling_mean") + F.col("rolling_std")).alias("band_high"))


def user_heatmap(jobs: DataFrame) -> DataFrame:
    """Mean composite waste of the users with the most wasted core-hours by duration category, by falling mean of the cells. Users without a cell are left out."""
    users = summaries.top_impact_users(jobs).select("job_username")
    cells = jobs.join(F.broadcast(users), "job_username", "left_semi")  # at most TOP_USERS names
    table = cells.groupBy("job_username").pivot("duration_category", list(DURATION[1])).agg(F.avg("composite_waste"))
    labels = DURATION[1]
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in labels[1:]), F.coalesce(F.col(f"`{labels[0]}`"), F.lit(0.0)))
    count = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in labels[1:]), F.col(f"`{labels[0]}`").isNotNull().cast("int"))
    named = [F.col(f"`{c}`").alias(n) for c, n in zip(labels, ("short", "medium", "long", "very_long"))]
    return table.withColumn("_avg", F.try_divide(total, count)).where("_avg is not null").orderBy(F.desc("_avg"), "job_username").select("job_username", *named)
