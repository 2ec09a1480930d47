"""From raw telemetry rows of either layout to valid samples.

Rows carry file_id and row_index: the file that they are from and their place in it. The layout is a property of a file, found from its first rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.numeric import to_number

STATES = ("COMPLETED", "FAILED", "TIMEOUT", "CANCELLED")
SNIFFED = 5
TIMES, NUMBERS = ("time", "start_time", "end_time"), ("job_cpu_usage", "value_memused", "ncores", "nhosts")
REQUIRED = ("time", "start_time", "end_time", "job_exitcode", "queue", "job_username", "job_cpu_usage", "value_memused", "ncores", "nhosts", "jid")


def detect_layout(raw: DataFrame) -> DataFrame:
    """One row per file: is_legacy, when early job names are final states and early exit codes are node lists. Early are the first SNIFFED values that are not null.

    One scan: both tests of a row are two rows here, and of each file and test only the first few are exchanged.
    """
    if not {"jobname", "exitcode"} <= set(raw.columns):
        return raw.select("file_id").distinct().withColumn("is_legacy", F.lit(False))
    tests = F.array(F.struct(F.lit(0).alias("test"), F.col("jobname").cast("string").isin(*STATES).alias("ok")), F.struct(F.lit(1).alias("test"), F.col("exitcode").cast("string").startswith("{").alias("ok")))
    rows = raw.select("file_id", F.col("row_index").alias("row"), F.explode(tests).alias("t")).select("file_id", "row", "t.*")
    early = F.row_number().over(W.partitionBy("file_id", "test").orderBy(F.col("ok").isNull(), "row"))
    first = rows.withColumn("n", early).where(F.col("n") <= SNIFFED)
    passed = lambda k: F.coalesce(F.max(F.when(F.col("test") == k, F.col("ok"))), F.lit(False))
    return first.groupBy("file_id").agg((passed(0) & passed(1)).alias("is_legacy"))


def _renamed(raw: DataFrame, sources: dict[str, str]) -> DataFrame:
    kinds = dict(raw.dtypes)
    for target, source in sources.items():
        if source in kinds:
            value = to_number(F.col(source), kinds[source]) if target == "job_cpu_usage" else F.col(source)
            raw = raw.withColumn(target, value)
    return raw


def normalize_legacy(raw: DataFrame) -> DataFrame:
    """Legacy files have their columns shifted: states in jobname, users in host_list, CPU use in username."""
    return _renamed(raw, {"job_exitcode": "jobname", "job_username": "host_list", "job_cpu_usage": "username"})


def normalize_current(raw: DataFrame) -> DataFrame:
    return _renamed(raw, {"job_exitcode": "exitcode", "job_username": "username", "job_cpu_usage": "value_cpuuser"})


def normalize(raw: DataFrame, legacy: bool | None = None) -> DataFrame:
    """The required columns under the same names. All files of `raw` share a schema, so what a file lacks is known without reading it. Without `legacy`, the layout
    of each file is looked up and joined; with it, all files are of that layout."""
    keep = ["file_id", "row_index", *REQUIRED]
    if legacy is None:
        flagged = raw.join(detect_layout(raw), "file_id")
        sides = [normalize_legacy(flagged.where("is_legacy")), normalize_current(flagged.where("not is_legacy"))]
    else:
        sides = [(normalize_legacy if legacy else normalize_current)(raw)]
    ready = [s.select(*keep) for s in sides if set(REQUIRED) <= set(s.columns)]
    if not ready:
        return raw.limit(0).select("file_id", "row_index", *[F.lit(None).cast("string").alias(c) for c in REQUIRED])
    if len(ready) == 2:
        kinds = [dict(r.dtypes) for r in ready]
        differ = [c for c in keep if kinds[0][c] != kinds[1][c]]
        ready = [r.withColumns({c: F.col(c).cast("string") for c in differ}) if differ else r for r in ready]
        return ready[0].unionByName(ready[1])
    return ready[0]


def _micros(nanos: Column) -> Column:
    """Whole microseconds of nanoseconds since 1970, rounded down without a detour over doubles."""
    return F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))


def cast_timestamps(df: DataFrame, few_files: bool = False) -> DataFrame:
    """Times as timestamps. A file with a value that can't be read is dropped whole; `few_files` says that the names of all files may be broadcast. Numbers,
    whole or not, are nanoseconds since 1970; NaN, infinities and what no long holds are missing."""
    kinds = dict(df.dtypes)

    def parsed(c: str) -> Column:
        if kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            return F.timestamp_micros(_micros(F.col(c).cast("bigint")))
        if kinds[c] in ("float", "double") or kinds[c].startswith("decimal"):
            return F.timestamp_micros(_micros(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).try_cast("bigint")))
        return F.try_to_timestamp(F.col(c)) if kinds[c] == "string" else F.col(c).cast("timestamp")

    out = df.withColumns({f"_{c}": parsed(c) for c in TIMES})
    strings = [c for c in TIMES if kinds[c] == "string"]
    if strings:
        bad = None
        for c in strings:
            one = F.col(c).isNotNull() & F.col(f"_{c}").isNull()
            bad = one if bad is None else bad | one
        poisoned = out.where(bad).select("file_id").distinct()
        out = out.join(F.broadcast(poisoned) if few_files else poisoned, "file_id", "left_anti")
    return out.withColumns({c: F.col(f"_{c}") for c in TIMES}).drop(*[f"_{c}" for c in TIMES])


def cast_numerics(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: to_number(F.col(c), kinds[c]) for c in NUMBERS})


def with_duration(df: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    return df.withColumn("duration_seconds", micros / F.lit(1e6)).withColumn("duration_hours", F.col("duration_seconds") / F.lit(3600.0))


def valid(df: DataFrame) -> DataFrame:
    """Samples with a positive duration and core count and with both measures."""
    return df.where((F.col("duration_seconds") > 0) & F.col("job_cpu_usage").isNotNull() & F.col("value_memused").isNotNull() & (F.col("ncores") > 0))


def clean(df: DataFrame, few_files: bool = False) -> DataFrame:
    """Normalised rows to valid samples."""
    return valid(with_duration(cast_numerics(cast_timestamps(df, few_files))))
