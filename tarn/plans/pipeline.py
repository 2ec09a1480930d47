"""The whole analysis: find files, read and clean, one row per job, waste, statistics, figure data, results."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tarn.operators import inference, jobs, plotdata, summaries, waste
from tarn.plans import figures, report
from tarn.sources import discovery, sinks, telemetry

log = logging.getLogger(__name__)
RUNS = ("conte", "anvil", "stampede", "all")
TEST_FILES_PER_DAY, TEST_FRACTION, SYSTEM_FRACTION = 2, 0.1, 0.25


def sampled(samples: DataFrame, probes: DataFrame, fraction: float | None) -> DataFrame:
    """Samples of a share of the jobs in the probed files; all of them without a fraction below one. An empty draw keeps all, with a warning."""
    if not fraction or fraction >= 1:
        return samples
    ids = jobs.sample_job_ids(probes, fraction)
    if ids.isEmpty():
        log.warning("the sample is empty: all jobs are analysed")
    return jobs.filter_sampled(samples, ids)


def statistics(table: DataFrame) -> dict:
    """All summaries of a job table with waste, as plain Python; every part is a few rows."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    stats = {"overall": rows(summaries.overall(table))[0]}
    for r in inference.confidence_intervals(table).collect():
        stats["overall"][f"{r.measure}_95ci"] = (r.low, r.high)
    stats["waste_thresholds"] = rows(summaries.thresholds(table))
    stats["total_waste"] = rows(summaries.totals(table))[0]
    stats["by_exitcode"] = rows(summaries.by_key(table, "job_exitcode"))
    if test := inference.anova_test(table):
        stats["exitcode_anova"] = test
    stats["by_queue"] = rows(summaries.by_key(table, "queue"))
    stats["by_duration"] = rows(summaries.by_category(table, "duration_category"))
    stats["by_size"] = rows(summaries.by_category(table, "size_category"))
    if test := inference.kruskal_test(table):
        stats["size_kruskal"] = test
    stats["top_wasting_users"] = rows(summaries.top_wasting_users(table))
    stats["waste_correlations"] = rows(summaries.correlations(table))[0]
    return stats


def plots(table: DataFrame) -> dict[str, DataFrame]:
    return {
        "histogram": plotdata.histogram(table), "density": inference.density(table), "percentiles": summaries.percentiles(table), "category_counts": summaries.category_counts(table),
        "box_exitcode": plotdata.boxes(table, "job_exitcode"), "box_duration": plotdata.boxes(table, "duration_category"), "box_size": plotdata.boxes(table, "size_category"),
        "scatter_cells": plotdata.scatter_cells(table), "time_series": plotdata.rolling(table), "user_heatmap": plotdata.user_heatmap(table),
    }


def by_system(samples: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Samples once per run that they belong to: all, and each system of their file's name. One exchange serves every run."""
    s, c = F.col(file_name).contains("_S"), F.col(file_name).contains("_C")
    runs = F.array(F.lit("all"), F.when(s, F.lit("stampede")), F.when(c, F.lit("conte")), F.when(~s & ~c, F.lit("anvil")))
    return samples.withColumn("run", F.explode(F.array_compact(runs)))


def system_comparison(samples: DataFrame, file_name: str = "file_name") -> DataFrame:
    """One row per run: jobs, mean wastes and wasted core-hours."""
    table = waste.with_waste(jobs.job_table(by_system(samples, file_name), ("run",), valid=True))
    return table.groupBy(F.col("run").alias("system")).agg(
        F.count("*").alias("total_jobs"), F.avg("cpu_waste").alias("cpu_waste_mean"), F.avg("mem_waste").alias("mem_waste_mean"),
        F.avg("composite_waste").alias("composite_waste_mean"), summaries.total("cpu_hours_wasted").alias("total_cpu_hours_wasted"),
    )


@dataclass
class Pipeline:
    """Analyses of one data folder. Each run writes to a folder of its own below output_dir."""

    spark: SparkSession
    data_dir: str
    output_dir: str
    skipped: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def _table(self, files: telemetry.Files, probes: list[str], fraction: float | None) -> DataFrame:
        """The job table with waste. Without a probe that can be read all jobs are kept."""
        samples, some = files.samples(), None
        if fraction and fraction < 1:
            try:
                some = files.samples(probes)
            except ValueError:
                log.warning("no probe can be read: all jobs are analysed")
        chosen = sampled(samples, some, fraction) if some is not None else samples
        return waste.with_waste(jobs.job_table(chosen, valid=True)).persist(StorageLevel.MEMORY_AND_DISK)  # some twenty aggregates read it

    def run(self, limit_years: list[int] | None = None, sample_jobs_fraction: float | None = None, test_mode: bool = False, system: str | None = None, name: str | None = None) -> dict:
        """One analysis. A file that turns out damaged while it is read is skipped whole, and the job table is made again without it."""
        per_day = TEST_FILES_PER_DAY if test_mode else None
        fraction = sample_jobs_fraction or (TEST_FRACTION if test_mode else None)
        chosen = discovery.select_files(discovery.discover(self.spark, self.data_dir), limit_years, per_day, system).persist()
        paths = [r.path for r in chosen.select("path").orderBy("path").collect()]
        if not paths:
            raise ValueError("no files found")
        probes, without, table = [r.path for r in discovery.stride(chosen).collect()], set(), None
        chosen.unpersist()
        while table is None:
            files = telemetry.open_files(self.spark, paths, without)
            self.skipped = sorted(files.skipped)
            table = self._table(files, probes, fraction)
            try:
                n = table.count()
            except (PySparkException, Py4JJavaError) as e:
                table.unpersist()
                table, bad = None, telemetry.unreadable(e)
                if not bad or bad in without:
                    raise
                log.warning("skipped %s: it can't be read", bad)
                without.add(bad)
        try:
            if not n:
                raise ValueError("no data could be processed from the files")
            stats = statistics(table) | {"hpc_system": system or "all", "files_processed": len(paths)}
            place = f"{self.output_dir.rstrip('/')}/{name or system or 'all'}"
            frames = sinks.write_plot_data(plots(table), f"{place}/plots")
            for figure, svg in figures.draw(frames, stats).items():
                sinks.write_text(self.spark, f"{place}/{figure}.svg", svg)
            sinks.write_jobs(table, f"{place}/job_data_with_waste_metrics.csv.gz")
            sinks.write_summary(self.spark, stats, f"{place}/summary_statistics.json")
            print(report.key_findings(stats))
            return stats
        finally:
            table.unpersist()

    def run_system(self, system: str) -> dict:
        return self.run(sample_jobs_fraction=SYSTEM_FRACTION, system=system)

    def compare_systems(self, sample_jobs_fraction: float = TEST_FRACTION) -> list[dict]:
        """A run per system, each with a sample of its own files' jobs, and one of all files."""
        out = []
        for system in RUNS:
            try:
                s = self.run(sample_jobs_fraction=sample_jobs_fraction, system=system)
            except ValueError as e:
                log.warning("%s: %s", system, e)
                continue
            out.append({"system": system, "files_processed": s["files_processed"], **{k: s["overall"][k] for k in ("total_jobs", "cpu_waste_mean", "mem_waste_mean", "composite_waste_mean")}, "total_cpu_hours_wasted": s["total_waste"]["total_cpu_hours_wasted"]})
        print(report.comparison(out))
        return out
