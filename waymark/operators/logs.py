"""Log tails and the status of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tail(lines: DataFrame, n: int = 20, key: str = "run_id", order: str = "line_no") -> DataFrame:
    """The last n lines of each run. Spark limits a group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return lines.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def job_status(lines: DataFrame, start: str = "Starting full pipeline%", key: str = "run_id") -> DataFrame:
    """Steps of each job with the seconds since the step before. A line like `start` opens a job; a log is one group."""
    log = Window.partitionBy(key).orderBy("line_no")
    jobs = lines.withColumn("job", F.sum(F.when(F.col("message").like(start), 1).otherwise(0)).over(log))
    step = Window.partitionBy(key, "job").orderBy("line_no")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (at - F.lag(at).over(step)) / 1000000
    return jobs.withColumn("step", F.row_number().over(step)).withColumn("seconds", seconds)
