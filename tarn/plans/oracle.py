"""The same queries as DuckDB SQL over the driver's tables, written from their meaning rather than from the DataFrame code."""

from __future__ import annotations

from tarn.functions.numeric import DURATION, SEVERITY, SIZE


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits} as {name}"


def _sum(column: str) -> str:
    """The sum of a column in whole units of 1e-9, which no order of the rows changes."""
    return f"sum(round_even({column} * 1e9, 0)::hugeint)::double / 1e9"


_QUEUE = "case when o_orderpriority = '1-URGENT' then o_orderpriority || '_S' when o_orderpriority = '2-HIGH' then o_orderpriority || '_C' else o_orderpriority end as queue"
_CORES = "power(2, o_orderkey % 10)::double as ncores, ceil(power(2, o_orderkey % 10) / 16)::double as nhosts"
_END = "make_timestamp(epoch_us(o_orderdate) + 1000000 * (case when o_orderkey % 97 = 0 then 0 else floor(o_totalprice * 0.36::double)::bigint end))"
_MARK = "case l_linenumber % 3 when 0 then '_S' when 1 then '_C' else '' end"
_USER = "'u' || (o_custkey % 200)::varchar"
_LABELS = lambda x, bins: "case " + " ".join(f"when {x} > {lo}" + (f" and {x} <= {hi}" if hi != float("inf") else "") + f" then '{label}'" for lo, hi, label in zip(bins[0], bins[0][1:], bins[1])) + " end"

SAMPLES = f"""samples as (select l_orderkey as jid, l_linenumber as file_id, l_orderkey as row_index, {_MARK} as mark, l_shipdate::timestamp as time, o_orderdate::timestamp as start_time, {_END} as end_time,
 o_orderstatus as job_exitcode, {_QUEUE}, {_USER} as job_username, case when l_discount = 0 then null else l_quantity * 2 end as job_cpu_usage, l_extendedprice / 1000.0::double as value_memused, {_CORES}
 from lineitem join orders on l_orderkey = o_orderkey)"""
CLEAN = SAMPLES + """, timed as (select *, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 as duration_seconds from samples),
 clean as (select *, duration_seconds / 3600.0::double as duration_hours from timed where duration_seconds > 0 and job_cpu_usage is not null and value_memused is not null and ncores > 0)"""


def _jobs(source: str = "clean", key: str = "jid", name: str = "jobs") -> str:
    return f""", {name}_first as (select *, row_number() over (partition by {key} order by file_id, row_index) as rn from {source}),
 {name}_mean as (select {key}, avg(job_cpu_usage) as cpu, avg(value_memused) as mem from {source} group by {key}),
 {name} as (select f.* exclude (job_cpu_usage, value_memused, rn), m.cpu as job_cpu_usage, m.mem as value_memused from {name}_first f join {name}_mean m using ({key}) where rn = 1)"""


def _waste(source: str = "jobs", name: str = "w") -> str:
    return f""", {name}1 as (select *, greatest(0.0, least(1.0, 1 - job_cpu_usage / 100.0::double))::double as cpu_waste, case when queue like '%\\_S%' escape '\\' then 'stampede' when queue like '%\\_C%' escape '\\' then 'conte' else 'anvil' end as system from {source}),
 {name}2 as (select *, case system when 'conte' then 4.0::double else 2.0::double end as mem_per_core from {name}1), {name}3 as (select *, ncores * mem_per_core as estimated_requested_mem_gb from {name}2),
 {name}4 as (select *, greatest(0.0, least(1.0, 1 - value_memused / estimated_requested_mem_gb))::double as mem_waste from {name}3),
 {name}5 as (select *, 0.5::double * cpu_waste + 0.5::double * mem_waste as composite_waste from {name}4),
 {name} as (select *, cpu_waste * ncores * duration_hours as cpu_hours_wasted, mem_waste * estimated_requested_mem_gb * duration_hours as mem_gb_hours_wasted,
 {_LABELS('duration_hours', DURATION)} as duration_category, {_LABELS('ncores', SIZE)} as size_category, {_LABELS('composite_waste', SEVERITY)} as waste_category from {name}5)"""


_SAMPLED = f"with {SAMPLES} "
_CLEAN = f"with {CLEAN} "
_JOBS = f"with {CLEAN}{_jobs()} "
_WASTE = f"with {CLEAN}{_jobs()}{_waste()} "
_RAW = f"""raw as (select l_orderkey as jid, l_orderkey as row_index, strftime(o_orderdate, '%Y/%m/') || l_linenumber::varchar || {_MARK} || '.parquet' as file_id,
 case when l_orderkey % 1999 = 7 then null else l_shipdate::timestamp end as time, o_orderdate::timestamp as start_time, {_END} as end_time, year(o_orderdate) < 1998 as legacy, o_orderstatus, {_USER} as usr, l_quantity * 2 as cpu
 from lineitem join orders on l_orderkey = o_orderkey)"""
_FILES = f"""paths as (select distinct 'data/' || strftime(l_shipdate, '%Y/%m/%d/') || l_linenumber::varchar || {_MARK} || '.parquet' as path from lineitem),
 files as (select path, string_split(path, '/')[2] as year, string_split(path, '/')[3] as month, string_split(path, '/')[4] as day, string_split(path, '/')[5] as file_name from paths)"""
_STATS = f"{_r('avg(composite_waste)', 'mean', 4)}, {_r('stddev_samp(composite_waste)', 'std', 4)}, count(composite_waste) as count"
_SAMPLE = "ids as (select jid, row_number() over (order by md5('42:' || jid::varchar), jid) as k, count(*) over () as n from (select distinct jid from clean)), chosen as (select jid from ids where k <= round_even(n / 10.0::double, 0))"


def _by(key: str) -> str:
    return f"{_WASTE} select {key}, {_STATS} from w where {key} is not null group by {key}"


def _dense(key: str, labels: tuple[str, ...]) -> str:
    values = ", ".join(f"({k}, '{label}')" for k, label in enumerate(labels))
    return f"""{_WASTE}, dom(ordinal, label) as (values {values}) select label as {key}, ordinal::integer as ordinal, {_r('avg(composite_waste)', 'mean', 4)}, {_r('stddev_samp(composite_waste)', 'std', 4)}, count(composite_waste) as count
 from dom left join w on label = {key} group by all"""


def _box(key: str) -> str:
    return f"""{_WASTE}, v as (select {key} as g, composite_waste as v from w where {key} is not null), q as (select g, count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3 from v group by g),
 x as (select v.g, v, n, q1, q2, q3, v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from v join q on v.g = q.g)
 select g as {key}, n as count, {_r('q1', 'q1')}, {_r('q2', 'median')}, {_r('q3', 'q3')}, {_r('min(v) filter (inside)', 'whisker_low')}, {_r('max(v) filter (inside)', 'whisker_high')}, count(*) filter (not inside) as outliers from x group by g, n, q1, q2, q3"""


_HOURS = 8
_DAILY = ', d as (select start_time::date as date, avg(composite_waste) as mean, stddev_samp(composite_waste) as std, count(composite_waste) as count, ' + _sum("cpu_hours_wasted") + ' as cpu_hours_wasted from w group by 1)'
_DAYS = f"date::varchar as date, {_r('mean', 'mean')}, {_r('std', 'std')}, count, {_r('cpu_hours_wasted', 'cpu_hours_wasted', _HOURS)}"
_CELLS = ", ".join(_r(f"avg(composite_waste) filter (duration_category = '{c}')", n) for c, n in zip(DURATION[1], ("short", "medium", "long", "very_long")))
_FIRST = ("start_time", "end_time", "job_exitcode", "queue", "job_username")

ORACLE: dict[str, str] = {
    "scan_samples": f"{_SAMPLED} select jid, file_id, time, start_time, end_time, job_exitcode, queue, job_username, {_r('job_cpu_usage', 'job_cpu_usage', 9)}, {_r('value_memused', 'value_memused', 9)}, ncores, nhosts from samples",
    "discover_files": f"with {_FILES} select * from files",
    "prune_years": f"with {_FILES} select * from files where year in ('1995', '1996')",
    "filter_system_files": f"with {_FILES} select * from files where contains(file_name, '_S')",
    "limit_files_per_day": f"with {_FILES} select path, year, month, day, file_name from files qualify row_number() over (partition by year, month, day order by file_name) <= 2",
    "stride_files": f"with {_FILES}, k as (select *, row_number() over (order by path) - 1 as k, count(*) over () as n from files) select path, year, month, day, file_name from k where k % greatest(1, n // 20) = 0",
    "detect_layout": f"with {_RAW} select distinct file_id, legacy as is_legacy from raw",
    "normalize_legacy": f"with {_RAW} select file_id, jid, case o_orderstatus when 'F' then 'FAILED' else 'COMPLETED' end as job_exitcode, usr as job_username, {_r('cpu', 'job_cpu_usage', 9)} from raw where legacy",
    "normalize_current": f"with {_RAW} select file_id, jid, o_orderstatus as job_exitcode, usr as job_username, {_r('cpu', 'job_cpu_usage', 9)} from raw where not legacy",
    "cast_timestamps": f"with {_RAW}, bad as (select distinct file_id from raw where time is null) select file_id, jid, time, start_time, end_time from raw where file_id not in (select file_id from bad)",
    "cast_numerics": "select l_orderkey as jid, l_linenumber as file_id, case l_linenumber when 1 then l_quantity::integer::double when 2 then l_quantity::integer * 10.0::double when 5 then l_quantity::integer::double end as value from lineitem",
    "job_duration": f"with {CLEAN} select jid, file_id, duration_seconds, {_r('duration_seconds / 3600.0::double', 'duration_hours')} from timed",
    "clean_samples": f"{_CLEAN} select jid, file_id, {_r('job_cpu_usage', 'job_cpu_usage', 9)}, {_r('value_memused', 'value_memused', 9)}, ncores, {_r('duration_hours', 'duration_hours')} from clean",
    "sample_filter": f"{_CLEAN}, {_SAMPLE} select jid, file_id, {_r('job_cpu_usage', 'job_cpu_usage', 9)}, {_r('value_memused', 'value_memused', 9)} from clean where jid in (select jid from chosen)",
    "sample_jobs": f"{_CLEAN}, {_SAMPLE} select jid from chosen",
    "distinct_jobs": f"{_CLEAN} select distinct jid from clean",
    "run_counters": f"{_CLEAN} select count(distinct jid) as total_jobs, count(distinct file_id) as non_empty_files from clean",
    "job_partial": f"{_CLEAN} select file_id, jid, " + ", ".join(f"first({c} order by row_index) as {c}_first" for c in (*_FIRST, "ncores", "nhosts")) + f", {_r('first(duration_hours order by row_index)', 'duration_hours_first')}, {_r('avg(job_cpu_usage)', 'job_cpu_usage_mean', 9)}, count(job_cpu_usage) as job_cpu_usage_count, {_r('avg(value_memused)', 'value_memused_mean', 9)}, count(value_memused) as value_memused_count from clean group by file_id, jid",
    "job_weighted_mean": f"{_CLEAN} select jid, {_r('avg(job_cpu_usage)', 'job_cpu_usage', 9)}, {_r('avg(value_memused)', 'value_memused', 9)} from clean group by jid",
    "job_table": f"{_JOBS} select jid, {', '.join(_FIRST)}, ncores, nhosts, {_r('duration_hours', 'duration_hours')}, {_r('job_cpu_usage', 'job_cpu_usage', 9)}, {_r('value_memused', 'value_memused', 9)} from jobs",
    "cpu_waste": f"{_WASTE} select jid, {_r('cpu_waste', 'cpu_waste')} from w",
    "job_system": f"{_WASTE} select jid, system from w",
    "mem_per_core": f"{_WASTE} select jid, mem_per_core from w",
    "mem_waste": f"{_WASTE} select jid, estimated_requested_mem_gb, {_r('mem_waste', 'mem_waste')} from w",
    "composite_waste": f"{_WASTE} select jid, {_r('composite_waste', 'composite_waste')} from w",
    "economic_waste": f"{_WASTE} select jid, {_r('cpu_hours_wasted', 'cpu_hours_wasted', _HOURS)}, {_r('mem_gb_hours_wasted', 'mem_gb_hours_wasted', _HOURS)} from w",
    "duration_category": f"{_WASTE} select jid, duration_category from w",
    "size_category": f"{_WASTE} select jid, size_category from w",
    "waste_category": f"{_WASTE} select jid, waste_category from w",
    "overall_stats": f"{_WASTE} select count(*) as total_jobs, {_r('avg(cpu_waste)', 'cpu_waste_mean')}, {_r('median(cpu_waste)', 'cpu_waste_median')}, {_r('stddev_samp(cpu_waste)', 'cpu_waste_std')}, {_r('avg(mem_waste)', 'mem_waste_mean')}, {_r('avg(composite_waste)', 'composite_waste_mean')} from w",
    "waste_sem": _WASTE + " union all ".join(f"select '{c}' as measure, count({c}) as n, {_r(f'avg({c})', 'mean')}, {_r(f'stddev_samp({c}) / sqrt(count({c}))', 'sem')} from w" for c in ("cpu_waste", "mem_waste", "composite_waste")),
    # Quantiles of t by the expansion around the normal one, which is exact to all digits shown for over a thousand jobs.
    "confidence_intervals": _WASTE + ", e as (" + " union all ".join(f"select '{c}' as measure, count({c}) as n, avg({c}) as mean, stddev_samp({c}) / sqrt(count({c})) as sem from w" for c in ("cpu_waste", "mem_waste", "composite_waste")) + f"""),
 z as (select *, 1.959963984540054::double as z, (n - 1)::double as d from e), q as (select *, z + (z ** 3 + z) / (4 * d) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * d ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * d ** 3) as q from z)
 select measure, n, {_r('mean', 'mean')}, {_r('sem', 'sem')}, {_r('mean - q * sem', 'low')}, {_r('mean + q * sem', 'high')} from q""",
    "waste_thresholds": _WASTE + " union all ".join(f"select '>{int(t * 100)}%' as threshold, " + ", ".join(_r(f"100.0::double * count(*) filter ({c} > {t}) / count(*)", f"{c}_pct") for c in ("cpu_waste", "mem_waste", "composite_waste")) + " from w" for t in (0.5, 0.75, 0.9)),
    "total_waste": f"{_WASTE} select {_r(_sum('cpu_hours_wasted'), 'total_cpu_hours_wasted')}, {_r(_sum('cpu_hours_wasted') + ' / count(cpu_hours_wasted)', 'avg_cpu_hours_wasted_per_job')}, {_r(_sum('mem_gb_hours_wasted'), 'total_mem_gb_hours_wasted')}, {_r(_sum('mem_gb_hours_wasted') + ' / count(mem_gb_hours_wasted)', 'avg_mem_gb_hours_wasted_per_job')} from w",
    "by_exitcode": _by("job_exitcode"),
    "by_queue": _by("queue"),
    "by_duration": _dense("duration_category", DURATION[1]),
    "by_size": _dense("size_category", SIZE[1]),
    "user_waste": f"{_WASTE} select job_username, count(composite_waste) as job_count, {_r('avg(composite_waste)', 'avg_waste', 4)}, {_r('stddev_samp(composite_waste)', 'std_waste', 4)}, {_r(_sum('cpu_hours_wasted'), 'total_cpu_hours_wasted', 4)} from w group by 1",
    "top_wasting_users": f"{_WASTE} select job_username, count(composite_waste) as job_count, {_r('avg(composite_waste)', 'avg_waste', 4)}, {_r('stddev_samp(composite_waste)', 'std_waste', 4)}, {_r(_sum('cpu_hours_wasted'), 'total_cpu_hours_wasted', 4)} from w group by 1 having count(composite_waste) >= 5 order by avg_waste desc, job_username limit 20",
    "top_impact_users": f"{_WASTE} select job_username, {_r(_sum('cpu_hours_wasted'), 'total_cpu_hours_wasted')} from w group by 1 order by {_sum('cpu_hours_wasted')} desc, job_username limit 20",
    "waste_correlations": f"{_WASTE} select {_r('corr(cpu_waste, mem_waste)', 'cpu_mem_correlation')}, {_r('corr(cpu_waste, duration_hours)', 'cpu_duration_correlation')}, {_r('corr(cpu_waste, ncores)', 'cpu_size_correlation')} from w",
    # With three exit codes the tail of F is a power of its argument.
    "anova_exitcode": f"""{_WASTE}, v as (select job_exitcode as g, composite_waste as v from w qualify count(*) over (partition by job_exitcode) > 5), m as (select v.*, avg(v) over (partition by g) as gm, avg(v) over () as am from v),
 f as (select (sum((gm - am) * (gm - am)) / (count(distinct g) - 1)) / (sum((v - gm) * (v - gm)) / (count(*) - count(distinct g))) as f, count(distinct g) - 1 as d1, count(*) - count(distinct g) as d2 from m having count(distinct g) > 1)
 select {_r('f', 'f_statistic')}, d1 as df_between, d2 as df_within, {_r('case when d1 = 2 then power(d2 / (d2 + 2 * f), d2 / 2.0::double) end', 'p_value')} from f""",
    # The tail of chi-squared as a sum over its density.
    "kruskal_size": f"""{_WASTE}, v as (select size_category as g, composite_waste as v from w where size_category is not null qualify count(*) over (partition by size_category) > 5),
 r as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double as rk from v), s as (select sum(h) as h, sum(n)::double as n, count(*) as k from (select count(*) as n, sum(rk) * sum(rk) / count(*) as h from r group by g)),
 t as (select sum(c * c * c - c) as t from (select count(*)::double as c from v group by v)), h as (select (12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - t / (n * n * n - n)) as h, (k - 1)::bigint as df from s, t where k > 1)
 select {_r('h', 'h_statistic')}, df, {_r('(select sum(0.02 * exp((df / 2.0::double - 1) * ln(h + 0.02 * (i + 0.5::double)) - (h + 0.02 * (i + 0.5::double)) / 2 - df / 2.0::double * ln(2) - lgamma(df / 2.0::double))) from range(10000) r(i))', 'p_value')} from h""",
    "waste_kde": f"""{_WASTE}, e as (select min(composite_waste) as lo, max(composite_waste) as hi, count(*) as n, stddev_samp(composite_waste) * power(count(*), -0.2) as h from w),
 b as (select least(floor((composite_waste - lo) / ((hi - lo) / 2048)), 2047) as bin, count(*) as c from w, e group by 1), g as (select k::integer as k, lo + k * (hi - lo) / 199.0::double as x from e, range(200) t(k))
 select k, {_r('x', 'x')}, {_r('sum(c * exp(-0.5::double * power((x - (lo + (bin + 0.5::double) * (hi - lo) / 2048)) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density')} from g, b, e group by k, x""",
    "waste_percentiles": _WASTE + " union all ".join(f"select {p}::integer as percentile, {_r(f'quantile_cont(composite_waste, {p / 100})', 'value')} from w" for p in (25, 50, 75, 90)),
    "waste_category_counts": f"{_WASTE}, dom(label) as (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in SEVERITY[1])}), c as (select label, count(jid) as n from dom left join w on label = waste_category group by 1) select label as waste_category, n as count, {_r('n * 100.0::double / sum(n) over ()', 'pct')} from c",
    "waste_histogram": f"""{_WASTE}, e as (select min(composite_waste) as lo, max(composite_waste) as hi from w), b as (select least(floor((composite_waste - lo) / ((hi - lo) / 50.0::double)), 49)::integer as bin, count(*) as n from w, e group by 1)
 select k::integer as bin, {_r('lo + k * ((hi - lo) / 50.0::double)', 'low_edge')}, coalesce(n, 0)::bigint as count from e, range(50) t(k) left join b on k = bin""",
    "exitcode_order": f"{_WASTE} select job_exitcode, {_r('avg(composite_waste)', 'mean')} from w group by 1",
    "box_exitcode": _box("job_exitcode"),
    "box_duration": _box("duration_category"),
    "box_size": _box("size_category"),
    "scatter_waste": f"{_WASTE} select jid, {_r('cpu_waste', 'cpu_waste')}, {_r('mem_waste', 'mem_waste')}, {_r('composite_waste', 'composite_waste')} from w",
    "daily_waste": f"{_WASTE}{_DAILY} select {_DAYS} from d",
    "rolling_waste": f"""{_WASTE}{_DAILY}, m as (select *, case when count(mean) over seven = 7 then avg(mean) over seven end as rm, case when count(std) over seven = 7 then avg(std) over seven end as rs from d window seven as (order by date rows between 3 preceding and 3 following))
 select {_DAYS}, {_r('rm', 'rolling_mean')}, {_r('rs', 'rolling_std')}, {_r('rm - rs', 'band_low')}, {_r('rm + rs', 'band_high')} from m""",
    "user_heatmap": f"{_WASTE}, top as (select job_username from w group by 1 order by {_sum('cpu_hours_wasted')} desc, job_username limit 20) select job_username, {_CELLS} from w where job_username in (select job_username from top) group by 1",
    "system_comparison": f"""with {CLEAN}, runs as (select *, unnest(['all', case mark when '_S' then 'stampede' when '_C' then 'conte' else 'anvil' end]) as run, run || '/' || jid::varchar as run_jid from clean){_jobs('runs', 'run_jid', 'jobs')}{_waste()}
 select run as system, count(*) as total_jobs, {_r('avg(cpu_waste)', 'cpu_waste_mean')}, {_r('avg(mem_waste)', 'mem_waste_mean')}, {_r('avg(composite_waste)', 'composite_waste_mean')}, {_r(_sum('cpu_hours_wasted'), 'total_cpu_hours_wasted')} from w group by run""",
}
