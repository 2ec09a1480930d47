"""The registered queries over the stand-in telemetry. Doubles are rounded half to even, so that sums of another order compare equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.numeric import round_even
from tarn.operators import cleaning, inference, jobs, plotdata, summaries, waste
from tarn.plans import fixtures, pipeline
from tarn.sources import discovery

Query = Callable[[SparkSession, str], DataFrame]
#: Columns rounded to other than six digits: means and products of decimals to more, so that none lies half way.
DIGITS = {
    "cpu_hours_wasted": 8, "mem_gb_hours_wasted": 8,
    **{f"{c}{s}": 9 for c in ("job_cpu_usage", "value_memused") for s in ("", "_mean")},
}
FRACTION = 0.1


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, dates as text, doubles rounded."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((c.cast("timestamp_ntz") if kind == "timestamp" else round_even(c, DIGITS.get(name, 6)) if kind == "double" else c.cast("string") if kind == "date" else c).alias(name))
    return df.select(*out)


def clean_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.valid(cleaning.with_duration(cleaning.cast_numerics(fixtures.samples(spark, sf_dir))))


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_table(clean_samples(spark, sf_dir), valid=True)


def waste_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waste.with_waste(job_rows(spark, sf_dir))


def _on(source: Query, *steps: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        for step in steps:
            df = step(df)
        return plain(df)

    return query


def _pick(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*columns)


def _normalized(legacy: bool) -> Callable[[DataFrame], DataFrame]:
    def step(raw: DataFrame) -> DataFrame:
        side = raw.join(cleaning.detect_layout(raw), "file_id").where("is_legacy" if legacy else "not is_legacy")
        out = (cleaning.normalize_legacy if legacy else cleaning.normalize_current)(side)
        return out.select("file_id", "jid", "job_exitcode", "job_username", "job_cpu_usage")

    return step


def sample_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_samples(spark, sf_dir)
    return plain(jobs.filter_sampled(clean, jobs.sample_job_ids(clean, FRACTION)).select("jid", "file_id", "job_cpu_usage", "value_memused"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_samples(spark, sf_dir)
    return summaries.counters(jobs.distinct_jobs(clean), clean)


def cast_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.functions.numeric import to_number

    texts = fixtures.number_texts(spark, sf_dir)
    return plain(texts.select("jid", "file_id", to_number(F.col("value"), "string").alias("value")))


QUERIES: dict[str, Query] = {
    "scan_samples": _on(fixtures.samples, _pick("jid", "file_id", "time", "start_time", "end_time", "job_exitcode", "queue", "job_username", "job_cpu_usage", "value_memused", "ncores", "nhosts")),
    "discover_files": _on(fixtures.files, discovery.files_from_paths),
    "prune_years": _on(fixtures.files, discovery.files_from_paths, lambda f: discovery.prune_years(f, [1995, 1996])),
    "filter_system_files": _on(fixtures.files, discovery.files_from_paths, lambda f: discovery.filter_system(f, "Stampede")),
    "limit_files_per_day": _on(fixtures.files, discovery.files_from_paths, lambda f: discovery.limit_per_day(f, 2)),
    "stride_files": _on(fixtures.files, discovery.files_from_paths, discovery.stride),
    "detect_layout": _on(fixtures.raw, cleaning.detect_layout),
    "normalize_legacy": _on(fixtures.raw, _normalized(True)),
    "normalize_current": _on(fixtures.raw, _normalized(False)),
    "cast_timestamps": _on(fixtures.raw, _pick("file_id", "jid", "time", "start_time", "end_time"), cleaning.cast_timestamps),
    "cast_numerics": cast_numerics,
    "job_duration": _on(fixtures.samples, cleaning.with_duration, _pick("jid", "file_id", "duration_seconds", "duration_hours")),
    "clean_samples": _on(clean_samples, _pick("jid", "file_id", "job_cpu_usage", "value_memused", "ncores", "duration_hours")),
    "sample_filter": sample_filter,
    "sample_jobs": lambda spark, sf_dir: jobs.sample_job_ids(clean_samples(spark, sf_dir), FRACTION),
    "distinct_jobs": _on(clean_samples, jobs.distinct_jobs),
    "run_counters": run_counters,
    "job_partial": _on(clean_samples, jobs.partial_jobs),
    "job_weighted_mean": _on(clean_samples, jobs.partial_jobs, jobs.merge_partials, _pick("jid", "job_cpu_usage", "value_memused")),
    "job_table": _on(job_rows),
    "cpu_waste": _on(job_rows, waste.with_cpu_waste, _pick("jid", "cpu_waste")),
    "job_system": _on(job_rows, waste.with_system, _pick("jid", "system")),
    "mem_per_core": _on(job_rows, waste.with_system, waste.with_memory_per_core, _pick("jid", "mem_per_core")),
    "mem_waste": _on(waste_rows, _pick("jid", "estimated_requested_mem_gb", "mem_waste")),
    "composite_waste": _on(waste_rows, _pick("jid", "composite_waste")),
    "economic_waste": _on(waste_rows, _pick("jid", "cpu_hours_wasted", "mem_gb_hours_wasted")),
    "duration_category": _on(waste_rows, _pick("jid", "duration_category")),
    "size_category": _on(waste_rows, _pick("jid", "size_category")),
    "waste_category": _on(waste_rows, _pick("jid", "waste_category")),
    "overall_stats": _on(waste_rows, summaries.overall),
    "waste_sem": _on(waste_rows, inference.standard_errors),
    "confidence_intervals": _on(waste_rows, inference.confidence_intervals),
    "waste_thresholds": _on(waste_rows, summaries.thresholds),
    "total_waste": _on(waste_rows, summaries.totals),
    "by_exitcode": _on(waste_rows, lambda j: summaries.by_key(j, "job_exitcode")),
    "by_queue": _on(waste_rows, lambda j: summaries.by_key(j, "queue")),
    "by_duration": _on(waste_rows, lambda j: summaries.by_category(j, "duration_category")),
    "by_size": _on(waste_rows, lambda j: summaries.by_category(j, "size_category")),
    "user_waste": lambda spark, sf_dir: summaries.user_waste(waste_rows(spark, sf_dir)),
    "top_wasting_users": lambda spark, sf_dir: summaries.top_wasting_users(waste_rows(spark, sf_dir)),
    "top_impact_users": _on(waste_rows, summaries.top_impact_users),
    "waste_correlations": _on(waste_rows, summaries.correlations),
    "anova_exitcode": _on(waste_rows, inference.anova),
    "kruskal_size": _on(waste_rows, inference.kruskal),
    "waste_kde": _on(waste_rows, inference.density),
    "waste_percentiles": _on(waste_rows, summaries.percentiles),
    "waste_category_counts": _on(waste_rows, summaries.category_counts),
    "waste_histogram": _on(waste_rows, plotdata.histogram),
    "exitcode_order": _on(waste_rows, summaries.exitcode_order),
    "box_exitcode": _on(waste_rows, lambda j: plotdata.boxes(j, "job_exitcode")),
    "box_duration": _on(waste_rows, lambda j: plotdata.boxes(j, "duration_category")),
    "box_size": _on(waste_rows, lambda j: plotdata.boxes(j, "size_category")),
    "scatter_waste": _on(waste_rows, plotdata.scatter),
    "daily_waste": _on(waste_rows, summaries.daily),
    "rolling_waste": _on(waste_rows, plotdata.rolling),
    "user_heatmap": _on(waste_rows, plotdata.user_heatmap),
    "system_comparison": _on(clean_samples, pipeline.system_comparison),
}
