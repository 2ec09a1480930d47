"""Reading telemetry files whose columns and types differ from file to file.

Footers are read first, then the early rows that tell the layouts apart. Files are grouped by schema and layout; each group is read, renamed and cast by itself, without any
join, and only then are the groups put together, so types that differ between files (a core count that is an integer here and a double there) never meet in one scan.
"""

from __future__ import annotations

import logging
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import cleaning

log = logging.getLogger(__name__)
SAMPLE_COLUMNS = ("file_id", "row_index", "jid", "time", "start_time", "end_time", "job_exitcode", "queue", "job_username", "job_cpu_usage", "value_memused", "ncores", "nhosts", "duration_seconds", "duration_hours")
#: Files whose names may be broadcast: a few MB.
FEW = 20_000


def same_path(path: str) -> str:
    """One spelling of local paths, with and without a scheme."""
    return re.sub(r"^file:/+", "/", path)


def unreadable(error: Exception) -> str | None:
    """The file that a failed job couldn't read, if that is why it failed."""
    found = re.search(r"FAILED_READ_FILE[^]]*\] Encountered error while reading file (\S+?)\.?\s+(?:SQLSTATE|[A-Z])", str(error))
    return found and same_path(found[1])


class Files:
    """Telemetry files, their schemas and layouts looked up once. `skipped` are those that can't be read or lack a required column."""

    def __init__(self, spark: SparkSession, paths: list[str], without: set[str] = frozenset()):
        self.spark, self.skipped = spark, [p for p in paths if same_path(p) in without]
        #: (paths, legacy) by schema and layout.
        self.groups: list[tuple[list[str], bool]] = []
        for members in self._schemas([p for p in paths if same_path(p) not in without]).values():
            raw = self._raw(members)
            found = {same_path(r.file_id): r.is_legacy for r in cleaning.detect_layout(raw).collect()} if {"jobname", "exitcode"} <= set(raw.columns) else {}  # a row per file, as the list of paths is
            for legacy in (False, True):
                if some := [p for p in members if found.get(same_path(p), False) == legacy]:
                    named = (cleaning.normalize_legacy if legacy else cleaning.normalize_current)(raw).columns
                    if set(cleaning.REQUIRED) <= set(named):
                        self.groups.append((some, legacy))
                    else:
                        log.warning("skipped %d files without %s", len(some), sorted(set(cleaning.REQUIRED) - set(named)))
                        self.skipped += some

    def _schemas(self, paths: list[str]) -> dict[str, list[str]]:
        """Paths by schema, from their footers."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()

        def schema(path: str) -> str | None:
            try:
                file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
                reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
                try:
                    return reader.getFooter().getFileMetaData().getSchema().toString()
                finally:
                    reader.close()
            except Exception as e:  # whatever is wrong with a file, it contributes nothing
                log.warning("skipped %s: %s", path, str(e).splitlines()[0])
                return None

        groups: dict[str, list[str]] = {}
        with ThreadPoolExecutor(16) as pool:
            for path, s in zip(paths, pool.map(schema, paths)):
                groups.setdefault(s or "", []).append(path)
        self.skipped += groups.pop("", [])
        return groups

    def _raw(self, paths: list[str]) -> DataFrame:
        raw = self.spark.read.parquet(*paths)
        return raw.withColumns({"file_id": F.col("_metadata.file_path"), "row_index": F.col("_metadata.row_index")})

    def samples(self, paths: list[str] | None = None) -> DataFrame:
        """Valid samples of all files, or of some of them."""
        some = paths and {same_path(p) for p in paths}
        parts = []
        for members, legacy in self.groups:
            if chosen := [p for p in members if not some or same_path(p) in some]:
                clean = cleaning.clean(cleaning.normalize(self._raw(chosen), legacy), len(chosen) <= FEW)
                parts.append(clean.select(*[F.col(c).cast("string") if c in ("jid", "job_exitcode", "queue", "job_username") else F.col(c) for c in SAMPLE_COLUMNS]))
        if not parts:
            raise ValueError("no file could be read")
        return reduce(DataFrame.unionByName, parts)


def open_files(spark: SparkSession, paths: list[str], without: set[str] = frozenset()) -> Files:
    """Files, without those whose early rows can't be read."""
    without = set(without)
    while True:
        try:
            return Files(spark, paths, without)
        except (PySparkException, Py4JJavaError) as e:
            bad = unreadable(e)
            if not bad or bad in without:
                raise
            log.warning("skipped %s: it can't be read", bad)
            without.add(bad)


def read_samples(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Valid samples of all files, and the files that were skipped: those without a footer that can be read or without a required column. A file with a damaged page
    fails the job that reads it, so that no part of it counts; unreadable() names it, and open_files() does without it."""
    files = open_files(spark, paths)
    return files.samples(), files.skipped
