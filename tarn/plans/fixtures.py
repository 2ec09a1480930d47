"""Stand-ins for telemetry over the driver's tables: valid and invalid samples, and raw rows of both layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _times() -> dict:
    start = F.col("o_orderdate").cast("timestamp")
    seconds = F.when(F.col("o_orderkey") % 97 == 0, F.lit(0)).otherwise(F.floor(F.col("o_totalprice") * F.lit(0.36)).cast("bigint"))
    return {"start_time": start, "end_time": F.timestamp_micros(F.unix_micros(start) + seconds * 1_000_000)}


def _common() -> dict:
    priority, cores = F.col("o_orderpriority"), F.pow(F.lit(2.0), (F.col("o_orderkey") % 10).cast("double"))
    queue = F.when(priority == "1-URGENT", F.concat(priority, F.lit("_S"))).when(priority == "2-HIGH", F.concat(priority, F.lit("_C"))).otherwise(priority)
    return {
        "jid": F.col("l_orderkey"), "row_index": F.col("l_orderkey"), "time": F.col("l_shipdate").cast("timestamp"), **_times(), "queue": queue,
        "value_memused": F.col("l_extendedprice") / F.lit(1000.0), "ncores": cores, "nhosts": F.ceil(cores / F.lit(16.0)).cast("double"),
    }


def _user():
    return F.concat(F.lit("u"), (F.col("o_custkey") % 200).cast("string"))


def mark():
    n = F.col("l_linenumber") % 3
    return F.when(n == 0, F.lit("_S")).when(n == 1, F.lit("_C")).otherwise(F.lit(""))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised samples: one per line item, a job per order, a file per line number. Some have no CPU value or no duration."""
    cpu = F.when(F.col("l_discount") != F.lit(0.0), F.col("l_quantity") * 2)
    own = {"file_id": F.col("l_linenumber"), "file_name": F.concat(F.col("l_linenumber").cast("string"), mark(), F.lit(".parquet")), "job_exitcode": F.col("o_orderstatus"), "job_username": _user(), "job_cpu_usage": cpu}
    return _orders_lines(spark, sf_dir).select(*[c.alias(n) for n, c in (_common() | own).items()])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: a file per month and line number, in the shifted layout before 1998. Times are text; a few can't be read."""
    legacy = F.year("o_orderdate") < 1998
    cpu = F.col("l_quantity") * 2
    common = _common()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    own = {
        "file_id": F.concat(F.date_format("o_orderdate", "yyyy/MM/"), F.col("l_linenumber").cast("string"), mark(), F.lit(".parquet")),
        "time": F.when(F.col("l_orderkey") % 1999 == 7, F.lit("not a time")).otherwise(text(common["time"])), "start_time": text(common["start_time"]), "end_time": text(common["end_time"]),
        "jobname": F.when(legacy, F.when(F.col("o_orderstatus") == "F", F.lit("FAILED")).otherwise(F.lit("COMPLETED"))).otherwise(F.concat(F.lit("job"), F.col("l_orderkey").cast("string"))),
        "exitcode": F.when(legacy, F.concat(F.lit("{NODE"), F.col("l_suppkey").cast("string"), F.lit("}"))).otherwise(F.col("o_orderstatus")),
        "host_list": F.when(legacy, _user()), "username": F.when(legacy, cpu.cast("string")).otherwise(_user()), "value_cpuuser": F.when(~legacy, cpu),
    }
    return _orders_lines(spark, sf_dir).select(*[c.alias(n) for n, c in (common | own).items()])


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, good and bad: plain, exponents, suffixes, underscores, blanks, words."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    forms = F.when(n == 1, q).when(n == 2, F.concat(q, F.lit("e1"))).when(n == 3, F.concat(q, F.lit(".0d"))).when(n == 4, F.concat(F.lit("1_"), q)).when(n == 5, F.concat(F.lit(" "), q, F.lit(" "))).when(n == 6, F.lit("none"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("jid"), n.alias("file_id"), forms.alias("value"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a tree with day folders, from ship dates and line numbers."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(F.concat(F.lit("data/"), F.date_format("l_shipdate", "yyyy/MM/dd/"), F.col("l_linenumber").cast("string"), mark(), F.lit(".parquet")).alias("path")).distinct()
