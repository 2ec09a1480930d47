"""Exact ranks and quantiles without bringing all values into one task.

Values are counted per distinct value and dealt into cells of equal relative width: a function of the value alone, so a skewed range needs no look at the data first, and every reader
of a cell sees the same rows. Totals of the cells (a bounded table) give each cell its offset, and a window within the cell does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells per doubling of a value's size.
CELLS = 2048
_END = 1 << 30


def cell(v: Column) -> Column:
    """The number of a value's cell, which never falls as values rise: 0 for zero, mirrored for negative values, an end each for infinities. NaN is taken as the largest value, as in Spark's order."""
    size = F.floor((F.log2(F.abs(v)) + F.lit(1100.0)) * F.lit(float(CELLS))).cast("int")
    far = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(v == 0, F.lit(0)).when(far, F.when(v < 0, F.lit(-_END)).otherwise(F.lit(_END))).when(v > 0, size).otherwise(-size)


def counted(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Distinct values per key with their counts (t) and cells."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("t")).withColumn("cell", cell(F.col(value)))


def offsets(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and cell: how many rows lie in it (size) and before it (before), and how many the key has (total). CELLS rows a key and doubling at most."""
    cells = values.groupBy(*keys, "cell").agg(F.sum("t").alias("size"))
    upto = F.sum("size").over(W.partitionBy(*keys).orderBy("cell"))
    return cells.withColumns({"before": upto - F.col("size"), "total": F.sum("size").over(W.partitionBy(*keys))})


def cumulative(values: DataFrame, offs: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Adds cum: how many rows of the key are not above the value."""
    here = F.sum("t").over(W.partitionBy(*keys, "cell").orderBy(value))
    return values.withColumn("_here", here).join(offs, [*keys, "cell"]).withColumn("cum", F.col("before") + F.col("_here")).drop("_here")


def quantiles(rows: DataFrame, points: tuple[float, ...], keys: list[str], value: str = "v") -> DataFrame:
    """Per key: n, and q, an array of quantiles with linear interpolation between neighbours. Only cells that hold a wanted rank are sorted."""
    values = counted(rows, keys, value)
    offs = offsets(values, keys)
    at = [F.lit(p) * (F.col("total") - 1) for p in points]
    wanted = [f(x).cast("bigint") for x in at for f in (F.floor, F.ceil)]  # ranks from 0
    hit = None
    for w in wanted:
        one = (w >= F.col("before")) & (w < F.col("before") + F.col("size"))
        hit = one if hit is None else hit | one
    placed = cumulative(values, offs.where(hit), keys, value)
    picked = [F.max(F.when((w < F.col("cum")) & (w >= F.col("cum") - F.col("t")), F.col(value))) for w in wanted]
    parts = placed.groupBy(*keys, "total").agg(*[p.alias(f"_{k}") for k, p in enumerate(picked)])
    between = [F.col(f"_{2 * k}") + (F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1))) * (F.col(f"_{2 * k + 1}") - F.col(f"_{2 * k}")) for k, p in enumerate(points)]
    return parts.select(*keys, F.col("total").alias("n"), F.array(*between).alias("q"))


def smallest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows with the smallest hexadecimal digests in column `order`, ties by all columns: a top-k whose k may be as large as the table."""
    dealt = rows.withColumn("cell", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("size"))  # at most 16**3 rows
    before = sizes.select("cell", (F.sum("size").over(W.orderBy("cell")) - F.col("size")).alias("before")).where(F.col("before") < n)
    rank = F.row_number().over(W.partitionBy("cell").orderBy(order, *[c for c in rows.columns if c != order]))
    return dealt.withColumn("_rank", rank).join(before, "cell").where(F.col("before") + F.col("_rank") <= n).select(*rows.columns)
