"""Standard errors, confidence intervals and group comparison tests. Statistics are aggregated in Spark; only their p-values and quantiles are computed on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.distributions import chi2_sf, f_sf, t_quantile
from tarn.operators import ranks

MEASURES = ("cpu_waste", "mem_waste", "composite_waste")
MORE_THAN = 5


def standard_errors(jobs: DataFrame) -> DataFrame:
    """One row per measure: n, mean and standard error."""
    cells = [x for c in MEASURES for x in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c).cast("double"))).alias(f"sem_{c}"))]
    rows = ", ".join(f"'{c}', n_{c}, mean_{c}, sem_{c}" for c in MEASURES)
    return jobs.agg(*cells).selectExpr(f"stack({len(MEASURES)}, {rows}) as (measure, n, mean, sem)")


def confidence_intervals(jobs: DataFrame, level: float = 0.95) -> DataFrame:
    """t-intervals of the means with n - 1 degrees of freedom; null bounds for one job."""
    rows = standard_errors(jobs).collect()  # one row per measure
    out = []
    for r in rows:
        q = t_quantile((1 + level) / 2, r.n - 1) if r.sem is not None else math.nan
        out.append((r.measure, r.n, r.mean, r.sem, *((None, None) if math.isnan(q) else (r.mean - q * r.sem, r.mean + q * r.sem))))
    return jobs.sparkSession.createDataFrame(out, "measure string, n long, mean double, sem double, low double, high double")


def anova_statistic(jobs: DataFrame, key: str = "job_exitcode", of: str = "composite_waste") -> DataFrame:
    """One-way analysis of variance over groups of more than MORE_THAN rows: F and its degrees of freedom. No row with fewer than two groups."""
    groups = jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), F.count(of).cast("double").alias("n"), F.avg(of).alias("m"), F.coalesce(F.var_samp(of), F.lit(0.0)).alias("v")).where(F.col("rows") > MORE_THAN)
    # Sums of squares between groups from sums over groups; centred on the grand mean for precision.
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    all_ = groups.agg(F.count("*").alias("k"), F.sum("n").alias("total"), grand.alias("gm"))
    centred = groups.crossJoin(all_)  # one row
    sums = centred.groupBy("k", "total").agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    freedom = (F.col("k") - 1).cast("double"), F.col("total") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("between"), freedom[0]), F.try_divide(F.col("within"), freedom[1]))
    return sums.where("k > 1").select(f.alias("f_statistic"), (F.col("k") - 1).cast("bigint").alias("df_between"), freedom[1].cast("bigint").alias("df_within"))


def _tested(rows: DataFrame, test) -> DataFrame:
    """The statistic of a test, at most one row, with its p-value; null where the statistic is."""
    found = [(*r, None if r[0] is None else test(*r)) for r in rows.collect()]
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    return rows.sparkSession.createDataFrame(found, f"{schema}, p_value double")


def anova(jobs: DataFrame, key: str = "job_exitcode", of: str = "composite_waste") -> DataFrame:
    """anova_statistic with its p-value."""
    return _tested(anova_statistic(jobs, key, of), f_sf)


def anova_test(jobs: DataFrame, key: str = "job_exitcode") -> dict | None:
    row = anova(jobs, key).first()
    return row and {"f_statistic": row.f_statistic, "p_value": row.p_value}


def kruskal_statistic(jobs: DataFrame, key: str = "size_category", of: str = "composite_waste") -> DataFrame:
    """Kruskal-Wallis H with average ranks and the correction for ties, over groups of more than MORE_THAN rows; null if all values are equal. No row with fewer than two groups.

    Values are counted per group and cell (see ranks.py). A window within the cell ranks them there; of each group and cell only the sum of these ranks, the rows and the ties go
    on, and what lies in lower cells is added to them. So no task holds all values, and jobs are read twice: for the groups' sizes, and for this.
    """
    rows = jobs.where(F.col(key).isNotNull() & F.col(of).isNotNull()).select(F.col(key).alias("g"), F.col(of).alias("v"))
    large = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > MORE_THAN)
    counts = rows.join(large.select("g"), "g", "left_semi").groupBy("v", "g").agg(F.count("*").alias("c")).withColumn("cell", ranks.cell(F.col("v")))
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    here = counts.withColumns({"t": F.sum("c").over(W.partitionBy("cell", "v")), "upto": F.sum("c").over(W.partitionBy("cell").orderBy("v"))})
    cells = here.groupBy("cell", "g").agg(F.sum("c").alias("n"), F.sum(c * (F.col("upto") - t + (t + 1) / 2)).alias("r"), F.sum(c * (t * t - 1)).alias("ties"))
    lower = F.coalesce(F.sum("n").over(W.orderBy("cell").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))  # over cells and groups, not over jobs
    by_group = cells.withColumn("lower", lower).groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("r") + F.col("n") * F.col("lower")).alias("r"), F.sum("ties").alias("ties"))
    h = by_group.agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("total"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("ties").alias("ties")).where("k > 1")
    total = F.col("total")
    plain = F.lit(12.0) / (total * (total + 1)) * F.col("s") - 3 * (total + 1)
    correction = 1 - F.try_divide(F.col("ties"), F.pow(total, 3) - total)
    return h.select(F.try_divide(plain, F.nullif(correction, F.lit(0.0))).alias("h_statistic"), (F.col("k") - 1).cast("bigint").alias("df"))


def kruskal(jobs: DataFrame, key: str = "size_category", of: str = "composite_waste") -> DataFrame:
    """kruskal_statistic with its p-value."""
    return _tested(kruskal_statistic(jobs, key, of), chi2_sf)


def kruskal_test(jobs: DataFrame, key: str = "size_category") -> dict | None:
    row = kruskal(jobs, key).first()
    return row and {"h_statistic": row.h_statistic, "p_value": row.p_value}


def density(jobs: DataFrame, of: str = "composite_waste", grid: int = 200, bins: int = 2048) -> DataFrame:
    """A Gaussian kernel density with Scott's bandwidth, on `grid` points from the least to the largest value.

    Values are counted in fine bins first, so the work does not grow with the jobs; a bin is far narrower than the bandwidth.
    """
    edges = jobs.agg(F.min(of).alias("lo"), F.max(of).alias("hi"), F.count(of).alias("n"), F.stddev_samp(of).alias("s"))  # one row
    with_edges = jobs.where(F.col(of).isNotNull()).select(F.col(of).alias("v")).crossJoin(edges)
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), step)), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = with_edges.groupBy("lo", "hi", "n", "s", place.alias("bin")).agg(F.count("*").alias("c"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * step
    width = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    points = counted.select("c", "n", "lo", "hi", centre.alias("x0"), width.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k"))
    x = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1))
    z = F.try_divide(x - F.col("x0"), F.col("h"))
    weight = F.try_divide(F.col("c") * F.exp(-z * z / 2), F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return points.groupBy("k").agg(F.first(x).alias("x"), F.sum(weight).alias("density")).orderBy("k")
