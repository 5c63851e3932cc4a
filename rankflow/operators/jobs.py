"""Jobs, outcomes and dead letters.

Expected and processed counts are both aggregates over the record tables, so
there is no shared counter to race on; each aggregate is partial (map-side)
before its shuffle, which also absorbs a job holding most of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions.text import py_isoformat

COUNTED = ("success", "not_found")


def create_jobs(new_records: DataFrame, source_col: str, as_of) -> DataFrame:
    """One RUNNING job per source with >= 1 new record."""
    ts = F.lit(as_of).cast("timestamp")
    return (new_records.groupBy(F.col(source_col).alias("source_file"))
                       .agg(F.count(F.lit(1)).alias("expected_count"))
                       .select(F.sha2(F.col("source_file"), 256).alias("job_id"), "source_file",
                               "expected_count", F.lit(0).alias("processed_count"),
                               F.lit("RUNNING").alias("status"), ts.alias("started_at"),
                               ts.alias("created_at"), ts.alias("updated_at")))


def classify_outcomes(decoded: DataFrame, lookup_col: str = "lookup_status") -> DataFrame:
    """Outcome per decoded message.

    ``lookup_col`` holds the catalogue result (success / not_found / NULL for
    a failed lookup).  Messages without a Message or with an empty track give
    no row, as in the reference.
    """
    st = F.col("message_state")
    blank = (F.col("title") == "") | (F.col("artist") == "")
    status = (F.when(st == "undecodable", "error")
               .when(blank, "failed")
               .when(F.col(lookup_col) == "success", "success")
               .when(F.col(lookup_col) == "not_found", "not_found")
               .otherwise("failed"))
    error = (F.when(st == "undecodable", "undecodable message")
              .when(blank, "missing title or artist")
              .when(F.col(lookup_col) == "success", F.lit(None))
              .when(F.col(lookup_col) == "not_found",
                    F.concat(F.lit("No YouTube results found for: "), F.col("title"), F.lit(" - "), F.col("artist")))
              .otherwise("processing failed"))
    label = F.when((st == "ok") & ~blank, F.concat(F.col("title"), F.lit(" - "), F.col("artist"))).otherwise("unknown")
    return (decoded.where(st.isin("ok", "undecodable"))
                   .withColumn("status", status).withColumn("error", error).withColumn("track", label))


def split_dead_letters(df: DataFrame, as_of, status_col: str = "status",
                       reason_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(kept, dead letters); ``not_found`` rows become dead letters."""
    dead = df.where(F.col(status_col) == "not_found")
    letters = dead.select("*", F.col(reason_col).alias("failure_reason"),
                          py_isoformat(F.lit(as_of)).alias("dead_at"))
    return df.where(F.col(status_col) != "not_found"), letters


def job_progress(results: DataFrame, job_col: str = "job_id", status_col: str = "status") -> DataFrame:
    """Per job, outcomes that count toward completion (success, not_found)."""
    return (results.where(F.col(job_col).isNotNull() & (F.col(job_col) != ""))
                   .groupBy(F.col(job_col).alias("job_id"))
                   .agg(F.count_if(F.col(status_col).isin(*COUNTED)).alias("processed_count")))


def completed_jobs(jobs: DataFrame, progress: DataFrame, as_of, bucket: str | None = None) -> DataFrame:
    """Jobs whose processed count reached the expected count, one
    completion event each.  A job completes only on an increment, so a job
    with nothing processed never completes (even when it expected 0)."""
    ts = F.lit(as_of).cast("timestamp")
    j = jobs.drop("processed_count").join(progress, "job_id")
    done = j.where((F.col("processed_count") >= F.col("expected_count")) & (F.col("processed_count") > 0))
    has_file = F.coalesce(F.col("source_file") != "", F.lit(False))
    return done.select("job_id", "source_file", "expected_count", "processed_count", "created_at",
                       F.lit("completed").alias("status"), ts.alias("completed_at"),
                       F.when(has_file, F.lit(bucket)).alias("s3_bucket"),
                       F.when(has_file, F.col("source_file")).alias("s3_key"))
