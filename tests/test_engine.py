"""Edge cases of the telemetry engine on small frames."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tarn.functions import distributions as dist
from tarn.functions.numeric import DURATION, SEVERITY, SIZE, binned, clip01, round_even, to_number
from tarn.operators import cleaning, inference, jobs, plotdata, summaries, waste
from tarn.plans import pipeline
from tarn.sources import discovery, sinks, telemetry


def values(df, column="v"):
    return [r[column] for r in df.collect()]


def test_distribution_values():
    assert dist.t_quantile(0.975, 99) == pytest.approx(1.9842169514381818, rel=1e-10)
    assert dist.f_sf(3, 2, 10) == pytest.approx(0.095367431640625, rel=1e-12)
    assert dist.chi2_sf(5, 3) == pytest.approx(0.17179714429673532, rel=1e-12)
    assert math.isnan(dist.t_quantile(0.975, 0)) and dist.chi2_sf(0, 3) == 1 and dist.f_sf(0, 2, 5) == 1


def test_distributions_equal_commons_math(spark):
    math3 = spark._jvm.org.apache.commons.math3.distribution
    for df in (1, 2, 5, 30, 1000):
        assert dist.t_quantile(0.9, df) == pytest.approx(math3.TDistribution(float(df)).inverseCumulativeProbability(0.9), rel=1e-6)
        for x in (0.1, 1.0, 7.5, 40.0):
            assert dist.chi2_sf(x, df) == pytest.approx(1 - math3.ChiSquaredDistribution(float(df)).cumulativeProbability(x), abs=1e-9)
            assert dist.f_sf(x, df, 7) == pytest.approx(1 - math3.FDistribution(float(df), 7.0).cumulativeProbability(x), abs=1e-9)


def test_numbers_from_text(spark):
    texts = ["1", " 2.5 ", "1e3", ".5", "5.", "inf", "-Infinity", "1.0d", "2f", "1_000", "", "nan", "x", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(to_number(F.col("t"), "string").alias("v"))
    assert values(df) == [1.0, 2.5, 1000.0, 0.5, 5.0, math.inf, -math.inf, None, None, None, None, None, None, None]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "t double").select(to_number(F.col("t")).alias("v"))
    assert values(nan) == [None, 1.0]


@pytest.mark.parametrize(
    ("bins", "points", "labels"),
    [
        (DURATION, [0.0, 0.5, 1.0, 1.1, 8.0, 24.0, 24.1], [None, 0, 0, 1, 1, 2, 3]),
        (SIZE, [0.0, 16.0, 17.0, 64.0, 256.0, 257.0], [None, 0, 1, 1, 2, 3]),
        (SEVERITY, [0.0, 0.25, 0.26, 0.5, 0.75, 1.0, None], [None, 0, 1, 1, 2, 3, None]),
    ],
)
def test_bins_are_closed_on_the_right(spark, bins, points, labels):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(points)], "k int, x double").orderBy("k").select(binned(F.col("x"), *bins).alias("v"))
    assert values(df) == [None if k is None else bins[1][k] for k in labels]


def test_clip_and_round(spark):
    df = spark.createDataFrame([(0, -1.0), (1, None), (2, 2.0), (3, 0.5), (4, 1.5), (5, 2.5)], "k int, x double").orderBy("k")
    assert values(df.select(clip01(F.col("x")).alias("v"))) == [0.0, None, 1.0, 0.5, 1.0, 1.0]
    assert values(df.select(round_even(F.col("x"), 0).alias("v"))) == [-1.0, None, 2.0, 0.0, 2.0, 2.0]


def job_frame(spark, rows):
    """(jid, composite, group) rows as a job table with the columns that summaries read."""
    df = spark.createDataFrame(rows, "jid string, composite_waste double, g string")
    return df.withColumns({"cpu_waste": F.col("composite_waste"), "mem_waste": F.lit(0.5), "job_exitcode": F.col("g"), "duration_hours": F.lit(1.0), "ncores": F.lit(2.0), "job_username": F.col("g"), "cpu_hours_wasted": F.lit(1.0), "mem_gb_hours_wasted": F.lit(1.0)})


def test_groups_of_five_are_too_small(spark):
    rows = [(f"a{k}", 0.1 * k, "a") for k in range(6)] + [(f"b{k}", 0.1 * k, "b") for k in range(5)]
    assert inference.anova_test(job_frame(spark, rows)) is None
    rows += [("b5", 0.9, "b")]
    test = inference.anova_test(job_frame(spark, rows))
    assert 0 < test["p_value"] < 1


def test_kruskal_ties(spark):
    same = job_frame(spark, [(f"{g}{k}", 0.5, g) for g in "ab" for k in range(6)]).withColumn("size_category", F.col("g"))
    assert inference.kruskal_test(same) == {"h_statistic": None, "p_value": None}
    mixed = [(0.1, "a"), (0.1, "b"), (0.2, "a"), (0.2, "a"), (0.3, "b"), (0.0, "a"), (0.0, "b"), (-0.5, "a"), (7.0, "b"), (7.0, "b"), (0.3, "b"), (9.0, "a"), (8.0, "tiny")]
    tied = job_frame(spark, [(str(k), v, g) for k, (v, g) in enumerate(mixed)]).withColumn("size_category", F.col("g"))
    vs = sorted(v for v, g in mixed if g != "tiny")
    rank = {v: vs.index(v) + (vs.count(v) + 1) / 2 for v in vs}
    by = {g: [rank[v] for v, x in mixed if x == g] for g in "ab"}
    n = len(vs)
    h = (12 / (n * (n + 1)) * sum(sum(r) ** 2 / len(r) for r in by.values()) - 3 * (n + 1)) / (1 - sum(vs.count(v) ** 3 - vs.count(v) for v in set(vs)) / (n**3 - n))
    assert inference.kruskal_test(tied)["h_statistic"] == pytest.approx(h)
    apart = job_frame(spark, [(f"{g}{k}", 0.1 * k + (g == "b"), g) for g in "ab" for k in range(6)]).withColumn("size_category", F.col("g"))
    assert inference.kruskal_test(apart)["h_statistic"] == pytest.approx(8.307692307692307)  # ranks 1-6 and 7-12 without ties


def test_one_job(spark):
    one = job_frame(spark, [("a", 0.5, "x")])
    row = inference.confidence_intervals(one).collect()[0]
    assert row.low is None and row.high is None
    assert summaries.correlations(one).first().cpu_mem_correlation is None


def test_constant_column_has_no_correlation(spark):
    assert summaries.correlations(job_frame(spark, [("a", 0.1, "x"), ("b", 0.9, "x")])).first().cpu_mem_correlation is None


def test_empty_jobs(spark):
    none = job_frame(spark, [("a", 0.5, "x")]).limit(0).withColumn("size_category", F.lit("Small (1-16)"))
    assert summaries.totals(none).first().total_cpu_hours_wasted == 0.0
    assert plotdata.histogram(none).count() == 0
    assert values(summaries.by_category(none, "size_category"), "count") == [0, 0, 0, 0]


def test_user_needs_five_jobs(spark):
    rows = [(f"a{k}", 0.9, "a") for k in range(4)] + [(f"b{k}", 0.1, "b") for k in range(5)] + [("n", 0.5, None)]
    assert values(summaries.top_wasting_users(job_frame(spark, rows)), "job_username") == ["b"]


def test_sample_size_rounds_half_to_even():
    assert [jobs.sample_size(n, 0.1) for n in (5, 15, 25)] == [0, 2, 2]


def test_null_queue_is_an_error(spark):
    df = spark.createDataFrame([(None,)], "queue string")
    with pytest.raises(Exception, match="no queue"):
        waste.with_system(df).collect()
    assert waste.with_system(df, strict=False).first().system is None


def test_first_values(spark):
    """The first file decides; in it the first non-null value by row; a file of nulls gives null."""
    cols = "jid string, file_id string, row_index long, start_time timestamp, end_time timestamp, job_exitcode string, queue string, job_username string, ncores double, nhosts double, duration_hours double, job_cpu_usage double, value_memused double"
    base = lambda f, r, code, queue, cpu: ("j", f, r, None, None, code, queue, "u", 1.0, 1.0, 1.0, cpu, 1.0)
    df = spark.createDataFrame([base("b", 0, "B", "qb", 10.0), base("a", 1, "A", None, 20.0), base("a", 0, None, None, 60.0)], cols)
    times = df.withColumns({"start_time": F.timestamp_seconds("row_index"), "end_time": F.timestamp_seconds(F.lit(9))})  # valid samples have both
    for table in (jobs.job_table(df), jobs.merge_partials(jobs.partial_jobs(df)), jobs.job_table(times, valid=True)):
        row = table.first()
        assert (row.job_exitcode, row.queue, row.job_cpu_usage) == ("A", None, pytest.approx(30.0))


def test_rolling_needs_seven_days(spark):
    rows = [(f"j{d}{k}", 0.1 * k, d) for d in range(8) for k in range(1 if d == 7 else 2)]
    df = spark.createDataFrame(rows, "jid string, composite_waste double, d int").withColumns({"start_time": F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, d)"), "cpu_hours_wasted": F.lit(1.0)})
    out = plotdata.rolling(df).orderBy("date").collect()
    assert [r.rolling_mean is not None for r in out] == [False] * 3 + [True, True] + [False] * 3
    assert [r.rolling_std is not None for r in out] == [False] * 3 + [True] + [False] * 4  # the last day has one job


def test_file_filters(spark):
    paths = [f"d/{y}/01/02/{n}" for y in (2013, 2023) for n in ("a_S.parquet", "b_C.parquet", "c_S_C.parquet", "e.parquet")] + ["d/x/01/02/f.parquet"]
    files = discovery.files_from_paths(spark.createDataFrame([(p,) for p in paths], "path string"))
    names = lambda df: sorted({r.file_name[0] for r in df.collect()})
    assert names(discovery.filter_system(files, "STAMPEDE")) == ["a", "c"] and names(discovery.filter_system(files, "conte")) == ["b", "c"]
    assert names(discovery.filter_system(files, "anvil")) == ["e", "f"] and len(discovery.filter_system(files, "other").collect()) == 9
    assert names(discovery.limit_per_day(discovery.filter_system(files, "conte"), 1)) == ["b"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        discovery.prune_years(files, [2013]).collect()
    assert discovery.prune_years(files, None).count() == 9
    assert discovery.stride(files).count() == 9


RAW = ("jid", "time", "start_time", "end_time", "queue", "jobname", "exitcode", "host_list", "username", "value_cpuuser", "value_memused", "ncores", "nhosts")


def write_file(root, path, rows, drop=(), **types):
    import pandas as pd

    df = pd.DataFrame(rows, columns=RAW).drop(columns=list(drop)).astype(types)
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    df.to_parquet(f"{root}/{path}")


def new(jid, cpu=50.0, cores=4, time="2023-01-01 00:00:00", queue="q"):
    return (jid, time, "2023-01-01 00:00:00", "2023-01-01 02:00:00", queue, "my job", "COMPLETED", "{N1}", "ann", cpu, 2.0, cores, 1)


def old(jid, cpu="25"):
    return (jid, "2013-01-01 00:00:00", "2013-01-01 00:00:00", "2013-01-01 12:00:00", "q_S", "COMPLETED", "{NODE1}", "bob", cpu, 0.0, 2.0, 16, 1)


@pytest.fixture
def tree(tmp_path):
    root = f"{tmp_path}/data"
    write_file(root, "2013/01/01/a_S.parquet", [old("1"), old("1", "75"), old("2", "bad")])
    write_file(root, "2023/01/01/b.parquet", [new("3"), new("4", cores=0), new(None)])
    write_file(root, "2023/01/01/c_C.parquet", [new("3", 100.0), new("5")], ncores="float64", nhosts="float64")
    write_file(root, "2023/01/02/poisoned.parquet", [new("6"), new("7", time="soon")])
    write_file(root, "2023/01/02/short.parquet", [new("8")], drop=["value_memused"])
    os.makedirs(f"{root}/2023/01/03", exist_ok=True)
    with open(f"{root}/2023/01/03/broken.parquet", "wb") as f:
        f.write(b"not parquet")
    return root


def test_reading_a_tree(spark, tree):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    paths = discovery.list_paths(spark, tree)
    assert len(paths) == 6
    samples, skipped = telemetry.read_samples(spark, paths)
    assert sorted(os.path.basename(p) for p in skipped) == ["broken.parquet", "short.parquet"]
    table = {r.jid: r for r in jobs.job_table(samples).collect()}
    assert sorted(table) == ["1", "3", "5"]  # 2: no number; 4: no cores; 6, 7: their file has a time that can't be read
    assert (table["1"].job_exitcode, table["1"].job_username, table["1"].job_cpu_usage, table["1"].duration_hours) == ("COMPLETED", "bob", 50.0, 12.0)
    assert table["3"].job_cpu_usage == 75.0
    with pytest.raises(ValueError):
        telemetry.read_samples(spark, [p for p in paths if "broken" in p])


def damage(path):
    """Overwrite the data pages of a file, but not its footer."""
    import pyarrow.parquet as pq

    column = pq.ParquetFile(path).metadata.row_group(0).column(11)
    with open(path, "r+b") as f:
        f.seek(column.data_page_offset)
        f.write(b"\xff" * min(24, column.total_compressed_size))


def test_damaged_file_is_skipped_whole(spark, tree, tmp_path):
    damage(f"{tree}/2023/01/01/c_C.parquet")
    run = pipeline.Pipeline(spark, tree, f"{tmp_path}/out")
    assert run.run()["overall"]["total_jobs"] == 2
    assert sorted(os.path.basename(p) for p in run.skipped) == ["broken.parquet", "c_C.parquet", "short.parquet"]
    files = telemetry.open_files(spark, discovery.list_paths(spark, tree))
    with pytest.raises(Exception) as failed:
        files.samples().collect()
    assert telemetry.unreadable(failed.value).endswith("c_C.parquet")


def test_unreadable_probes_keep_all_jobs(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(discovery, "stride", lambda files: files.where("file_name = 'broken.parquet'"))
    run = pipeline.Pipeline(spark, tree, f"{tmp_path}/out")
    assert run.run(sample_jobs_fraction=0.5)["overall"]["total_jobs"] == 3 and len(run.skipped) == 2


def test_files_are_read_without_joins(spark, tree):
    """One scan per schema and layout; files of both layouts under one schema are two groups."""
    write_file(tree, "2013/01/01/d.parquet", [new("9", "12")])  # the schema of a_S.parquet in the other layout
    files = telemetry.open_files(spark, [p for p in discovery.list_paths(spark, tree) if "poisoned" not in p])
    assert sorted((len(p), legacy) for p, legacy in files.groups) == [(1, False), (1, False), (1, False), (1, True)]
    plan = files.samples()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 8 and "LeftAnti" in plan and "Inner" not in plan  # a second scan each looks for bad times


def test_numeric_times_are_nanoseconds(spark):
    rows = [(1_700_000_000_123_456_789, 1.7e18, "2023-11-14 22:13:20"), (-1, float("nan"), None), (None, float("inf"), None)]
    df = spark.createDataFrame([("f", *r) for r in rows], "file_id string, time long, start_time double, end_time string")
    out = [(r.a, r.b) for r in cleaning.cast_timestamps(df).selectExpr("unix_micros(time) as a", "unix_micros(start_time) as b").collect()]
    assert out == [(1_700_000_000_123_456, 1_700_000_000_000_000), (-1, None), (None, None)]


def test_sums_do_not_depend_on_order(spark):
    from tarn.functions.numeric import exact_sum

    rows = [0.1, 0.2, 0.3, 1e12, -1e12, 7651.80665]
    both = [spark.createDataFrame([(x,) for x in order], "x double").coalesce(1).agg(exact_sum(F.col("x")).alias("v")).first().v for order in (rows, rows[::-1])]
    assert both[0] == both[1] == 7652.40665
    assert spark.createDataFrame([(math.inf,), (1.0,)], "x double").agg(exact_sum(F.col("x")).alias("v")).first().v == math.inf
    assert spark.createDataFrame([(None,)], "x double").agg(exact_sum(F.col("x")).alias("v")).first().v is None


def test_cells_rise_with_values(spark):
    from tarn.operators import ranks

    points = sorted([0.0, -0.0, 1e-300, 0.1, 0.5, 0.5000001, 1.0, 2.0, 1e300, math.inf, -math.inf, -1.0, -0.1, -1e-9, -1e300])
    found = values(spark.createDataFrame([(p,) for p in points], "x double").coalesce(1).select(ranks.cell(F.col("x")).alias("v")))
    assert found == sorted(found) and len(set(found)) == len(points) - 2  # both zeros, and both close to a half


def test_whole_run(spark, tree, tmp_path, capsys):
    run = pipeline.Pipeline(spark, tree, f"{tmp_path}/out")
    stats = run.run()
    assert "jobs" in capsys.readouterr().out
    assert stats["overall"]["total_jobs"] == 3 and stats["files_processed"] == 6 and len(run.skipped) == 2
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/all/job_data_with_waste_metrics.csv.gz").columns[-1] == "date"
    assert os.path.exists(f"{tmp_path}/out/all/summary_statistics.json")
    import xml.etree.ElementTree as ET

    figures = {n: ET.parse(f"{tmp_path}/out/all/{n}.svg").getroot() for n in ("waste_distributions", "waste_by_characteristics", "waste_time_series", "user_waste_heatmap")}
    bars = [e for e in figures["waste_distributions"].iter() if e.tag.endswith("rect")]
    assert len(bars) == 1 + 50 + 4 and "bob" in "".join(figures["user_waste_heatmap"].itertext())
    assert not [e for f in figures.values() for e in f.iter() if "nan" in "".join(e.attrib.values()).lower()]
    assert run.run(system="stampede", limit_years=[2013])["overall"]["total_jobs"] == 1
    with pytest.raises(ValueError):
        run.run(limit_years=[1999])
    assert [r["system"] for r in run.compare_systems()]


def test_json_values():
    assert sinks.plain({"a": float("nan"), 1: (1.5, None), "b": [math.inf]}) == {"a": None, "1": [1.5, None], "b": [None]}


def test_layout_needs_both_signs(spark):
    rows = [("f", k, "COMPLETED" if k == 4 else "job", "{N1}" if k == 4 else "OK") for k in range(5)] + [("g", k, "COMPLETED" if k == 5 else "job", "{N}") for k in range(6)] + [("h", 0, "FAILED", None), ("i", 0, None, None), ("i", 9, "TIMEOUT", "{")]
    found = {r.file_id: r.is_legacy for r in cleaning.detect_layout(spark.createDataFrame(rows, "file_id string, row_index long, jobname string, exitcode string")).collect()}
    assert found == {"f": True, "g": False, "h": False, "i": True}


def test_incremental_jobs(spark, tmp_path):
    from tarn.streaming import incremental

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root, table, mark = f"{tmp_path}/data", f"{tmp_path}/partials", f"{tmp_path}/mark"
    write_file(root, "2023/01/01/a.parquet", [new("1", 20.0), new("1", 40.0), new("2")])
    schema = spark.read.parquet(f"{root}/2023/01/01/a.parquet").schema
    incremental.start(spark, root, schema, table, mark).awaitTermination(60)
    write_file(root, "2023/01/02/b.parquet", [new("1", 90.0), new("3", cores=0)])
    incremental.start(spark, root, schema, table, mark).awaitTermination(60)
    found = {r.jid: r.job_cpu_usage for r in incremental.job_table(spark, table).collect()}
    assert found == {"1": 50.0, "2": 50.0}
