"""Rows are dealt to tasks by their number, whatever the files' splits say."""

from rankflow.plans import bindings
from rankflow.plans.tables import TASK_ROWS, table
from rankflow.session import work_dir
from rankflow.streaming import batches_of
from rankflow.streaming.jobs import _put_whole


def one_file(spark, rows):
    d = work_dir(spark, "one-file")
    spark.range(rows).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def sizes(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_one_row_group_is_dealt_to_tasks_of_bounded_rows(spark):
    # more splits than cores, but one row group: the scan alone has one task with rows
    d = one_file(spark, 6 * TASK_ROWS + 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert table(spark, d, "events").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        found = sizes(table(spark, d, "events", spread=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(found) == 6 * TASK_ROWS + 5 and len(found) >= 7 and max(found) <= TASK_ROWS * 1.1


def test_an_arrival_is_as_many_files_as_cores(spark):
    rows = spark.range(24_000).selectExpr("id AS user_id")
    out, seen = work_dir(spark, "arrived"), []

    def write(batch, batch_id):
        seen.append(batch.rdd.getNumPartitions())
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    bindings._run(bindings._arrivals(spark, rows).writeStream.foreachBatch(write)
                  .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
    got = spark.read.parquet(out)
    assert len(seen) == bindings.STREAM_FILES and min(seen) > 1  # one file a batch would be one task
    assert got.select("user_id").distinct().count() == got.count() == 24_000
    assert got.groupBy("batch_id").count().count() == bindings.STREAM_FILES


def test_rows_out_of_many_state_partitions_are_one_batch_of_the_next_stream(spark):
    out = work_dir(spark, "chained")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as inside a micro-batch
    try:
        for k in range(3):
            _put_whole(spark.range(k * 100, k * 100 + 100).repartition(40), out, k)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    batches = []
    bindings._run(batches_of(spark, out, "id long", 16).writeStream.foreachBatch(lambda b, k: batches.append(b.count()))
                  .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
    assert batches == [300]
