"""Job tables that grow with newly arriving files (an extension: the batch pipeline does without).

Each micro-batch is cleaned and reduced to partial rows per file and job, which are appended to a table; merging them gives the job table at any time.
A batch that is run again after a failure replaces its own folder, so no partial counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarn.operators import cleaning, jobs


def start(spark: SparkSession, data_dir: str, schema: StructType, table: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Take in all files that are there and end; to be called again for those that come later. All files share one schema."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("ignoreCorruptFiles", "true").parquet(f"{data_dir.rstrip('/')}/*/*/*")
    raw = raw.withColumns({"file_id": F.col("_metadata.file_path"), "row_index": F.col("_metadata.row_index")})

    def take(batch: DataFrame, number: int) -> None:
        partials = jobs.partial_jobs(cleaning.clean(cleaning.normalize(batch)))
        partials.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_table(spark: SparkSession, table: str) -> DataFrame:
    return jobs.merge_partials(spark.read.parquet(table).drop("batch"))
