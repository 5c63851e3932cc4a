"""Arrival-driven jobs on Structured Streaming.

What a stream has to remember lives in Spark's state store (RocksDB): ids of
messages seen (``dropDuplicates``), one row per track, one per job.  A
micro-batch touches the state of its own keys, so its cost follows its rows, not
the history, and nothing is ever too late.  No watermark drops anything.

Sinks are idempotent per micro-batch id: a batch writes only its own
``batch_id=`` folders with mode overwrite, so a batch replayed after an executor
or driver loss rewrites the same output.  Offsets and state live in the
checkpoint folder the caller passes (under the cluster's shared
``spark.checkpoint.dir``).

The jobs are chained by their outputs: messages -> outcomes -> ``progress_stream``
-> ``completion_stream`` -> ``playlist_stream``.  Each reads the files that the one
before writes, and each drops what it has seen, so a file read twice does nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from rankflow.operators import jobs as J
from rankflow.operators import joins, playlist, records
from rankflow.sources import envelopes

# Reference micro-batch: at most 10 records per trigger, every 5 seconds.
MAX_FILES_PER_TRIGGER = 10
PROCESSING_TIME = "5 seconds"
#: files of a batch that another stream reads
CHAINED_FILES = 16

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_SNAPSHOT = "Failed to download playlist data from S3"

JOB_SCHEMA = ("job_id string, source_file string, expected_count long, processed_count int, status string, "
              "started_at timestamp, created_at timestamp, updated_at timestamp")
PROGRESS_SCHEMA = ("job_id string, processed_count long, expected_count long, source_file string, created_at timestamp, "
                   "reached boolean")
COMPLETION_SCHEMA = ("job_id string, source_file string, expected_count long, processed_count long, created_at timestamp, "
                     "status string, completed_at timestamp, s3_bucket string, s3_key string")


def file_stream(spark: SparkSession, directory: str, schema: StructType | str, glob: str = "*",
                fmt: str = "parquet", max_files: int | None = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Files arriving in ``directory`` as a stream (new files only, each once); without ``max_files`` a batch takes
    all there are."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(directory)


def batches_of(spark: SparkSession, directory: str, schema: str, max_files: int | None = None) -> DataFrame:
    """The ``batch_id=`` folders that another stream fills, as a stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return file_stream(spark, directory, f"{schema}, batch_id int", "*.parquet", max_files=max_files).drop("batch_id")


def _start(out: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool,
           mode: str = "append") -> StreamingQuery:
    conf = out.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    writer = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=PROCESSING_TIME)


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    """The part of ``path`` that this batch owns."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _put_whole(rows: DataFrame, path: str, batch_id: int) -> None:
    """Like ``_put``, for rows as they leave a stream's state: in at most ``CHAINED_FILES`` files, not one per state
    partition.  A stream that reads them takes so many files a batch.  (Adaptive execution, which would choose their
    number, is off inside a micro-batch.)"""
    _put(rows.repartition(min(CHAINED_FILES, rows.sparkSession.sparkContext.defaultParallelism)), path, batch_id)


def first_deliveries(messages: DataFrame, id_col: str) -> DataFrame:
    """The first row of each message id, however late a redelivery comes.  A row without an id is a message of its
    own."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\0"), F.uuid()))
    return messages.withColumn("_delivery", key).dropDuplicates(["_delivery"]).drop("_delivery")


def _table(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A table by path, as it is now; a DataFrame is taken as given."""
    return spark.read.parquet(source) if isinstance(source, str) else source


# ---------------------------------------------------------------- objects named by rows
def read_named(names: DataFrame, root: str, bucket: str = "bucket", key: str = "key") -> DataFrame:
    """(bucket, key, json) of the objects that ``names`` names and that exist under ``root/<bucket>/<key>``.

    The names stay a DataFrame: tasks open the objects, whole, through Arrow's file systems (local, S3, GCS, HDFS),
    and no list of them comes to the driver."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
        for batch in batches:
            for where in batch.to_pylist():
                try:
                    with store.open_input_stream(f"{base.rstrip('/')}/{where['bucket']}/{where['key']}") as f:
                        text = f.read().decode("utf-8", "replace")
                except (FileNotFoundError, IsADirectoryError):
                    continue
                yield pa.RecordBatch.from_pylist([{**where, "json": text}], schema=pa.schema(
                    [(c, pa.string()) for c in ("bucket", "key", "json")]))

    wanted = names.select(F.col(bucket).alias("bucket"), F.col(key).alias("key")).where("bucket IS NOT NULL AND key IS NOT NULL")
    return wanted.distinct().mapInArrow(read, "bucket string, key string, json string")


def stored_objects(root: str) -> Callable[[DataFrame], DataFrame]:
    """A reader of named objects under ``root``, for ``playlist_stream``."""
    return lambda names: read_named(names, root)


# ---------------------------------------------------------------- O50
def ingest_stream(docs: DataFrame, known: str | DataFrame, out_dir: str, checkpoint: str, as_of,
                  json_col: str = "json", source_col: str = "source_file", key: str = "track_id",
                  objects_root: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Snapshot documents -> records (O22, O23) -> new records (O29) ->
    ``records``, ``messages`` (O07) and ``jobs`` (O35) under ``out_dir``.

    With ``objects_root`` the stream carries arrival notifications instead
    (O05): tasks read the objects that a batch names (O01), whole, under
    ``objects_root/<bucket>/<key>``.  ``known`` given as a path is read anew by
    every batch.  A source file whose records come in several batches stays one
    job: ``jobs`` has what each batch adds to it (``job_table`` sums it up, and
    so does ``progress_stream``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if objects_root:
            named = envelopes.decode_notifications(batch).where("outcome = 'processed'")
            batch = read_named(named, objects_root).select("json", F.col("key").alias(source_col))
        found = records.normalize_records(records.locate_records(batch, json_col))
        _put(joins.new_records(found, _table(spark, known), key=key), f"{out_dir}/records", batch_id)
        new = spark.read.parquet(f"{out_dir}/records/batch_id={batch_id}")
        _put(J.create_jobs(new, source_col, as_of), f"{out_dir}/jobs", batch_id)
        tracks = [c for c in new.columns if c not in (source_col, "original_data", "source")]
        messages = envelopes.build_messages(new.withColumn("job_id", F.sha2(F.col(source_col), 256)), source_col, "job_id",
                                            as_of, track_cols=[c for c in tracks if c != "job_id"])
        _put(messages.select("message", "subject", "attributes"), f"{out_dir}/messages", batch_id)

    return _start(docs, write, checkpoint, available_now)


def job_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per job of the ``jobs`` folder of an ingest stream, with the sum of its batches."""
    return spark.read.parquet(path).groupBy("job_id", "source_file").agg(
        F.sum("expected_count").alias("expected_count"), F.min("created_at").alias("created_at"))


# ---------------------------------------------------------------- O51
def lookup_stream(outcomes: DataFrame, base: DataFrame, table_path: str, checkpoint: str, as_of,
                  key: str = "track_id", fill: dict[str, str] | None = None,
                  insert_cols: dict[str, str] | None = None, order_col: str | None = None,
                  insert_source: str = "ytmusic", available_now: bool = True) -> StreamingQuery:
    """Classified outcomes -> the conditional upsert of their hits.

    State is one row per key: its base row and its first hit (by micro-batch,
    then by ``order_col``).  ``base`` is a stream too (``file_stream`` over the
    table's files): its rows fill the state when they arrive, and rows added to
    the table later reach the state as well.  Redelivered hits change nothing.
    Rows that a batch changed go to ``table_path/batch_id=``; ``current_table``
    is the last row of each key.
    """
    fill = fill or {"youtube_video_id": "youtube_video_id", "youtube_url": "youtube_url"}
    insert_cols = insert_cols or {"title": "title", "artist": "artist"}
    guard = list(fill)[0]
    hit_cols = sorted({*fill.values(), *insert_cols.values()})
    order = F.col(order_col or fill[guard]).cast("string")
    base_kind = base.schema.simpleString()
    hit_kind = "struct<" + ",".join(f"`{c}`:{outcomes.schema[c].dataType.simpleString()}" for c in hit_cols) + ">"
    hits = outcomes.where((F.col("status") == "success") & F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(
        F.col(key).alias("_key"), F.lit(None).cast(base_kind).alias("_base"),
        F.struct(*[F.col(c) for c in hit_cols]).alias("_hit"), order.alias("_order"))
    rows = base.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.struct(*[F.col(c) for c in base.columns]).alias("_base"),
        F.lit(None).cast(hit_kind).alias("_hit"), F.lit(None).cast("string").alias("_order"))
    # the time of the micro-batch orders what comes in different batches
    both = rows.unionByName(hits).withColumn("_at", F.current_timestamp())
    is_hit, is_base = F.col("_hit").isNotNull(), F.col("_base").isNotNull()
    state = both.groupBy("_key").agg(
        F.max("_at").alias("_now"),
        F.max(F.when(is_base, F.col("_at"))).alias("_base_at"), F.max_by("_base", F.when(is_base, F.col("_at"))).alias("_base"),
        F.min(F.when(is_hit, F.col("_at"))).alias("_hit_at"),
        F.min_by("_hit", F.when(is_hit, F.struct("_at", "_order"))).alias("_hit"))
    ts = F.lit(as_of).cast("timestamp")
    in_base = F.col("_base").isNotNull()
    filled = F.col("_hit").isNotNull() & (~in_base | F.col(f"_base.{guard}").isNull())

    def value(c: str) -> Column:
        old = F.col(f"_base.{c}")
        if c == key:
            return F.col("_key")
        if c in fill:
            return F.when(filled, F.col(f"_hit.{fill[c]}")).otherwise(old)
        if c == "updated_at":
            return F.when(filled, ts).otherwise(old)
        new = {"created_at": ts, "source": F.lit(insert_source)}.get(c)
        if c in insert_cols:
            new = F.col(f"_hit.{insert_cols[c]}")
        return old if new is None else F.when(in_base, old).otherwise(new)

    changed = state.where((F.col("_base_at") == F.col("_now")) | (filled & (F.col("_hit_at") == F.col("_now"))))
    out = changed.select(*[value(c).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    return _start(out, lambda batch, batch_id: _put(batch, table_path, batch_id), checkpoint, available_now, "update")


def current_table(spark: SparkSession, table_path: str, key: str = "track_id") -> DataFrame:
    """The keyed table as of the last committed micro-batch of ``lookup_stream``."""
    rows = spark.read.parquet(table_path)
    cols = [c for c in rows.columns if c not in (key, "batch_id")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
    return last.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns if c != "batch_id"])


def dead_letter_stream(outcomes: DataFrame, dlq_dir: str, checkpoint: str, as_of, id_col: str | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """O08 on a stream: misses to dead letters, each message id once."""
    _, dead = J.split_dead_letters(outcomes, as_of)
    dead = first_deliveries(dead, id_col) if id_col else dead
    return _start(dead, lambda batch, batch_id: _put(batch, dlq_dir, batch_id), checkpoint, available_now)


# ---------------------------------------------------------------- O52
def progress_stream(outcomes: DataFrame, jobs: DataFrame, progress_dir: str, checkpoint: str, id_col: str,
                    available_now: bool = True) -> StreamingQuery:
    """At-least-once outcomes -> job counters that count each message once.

    ``jobs`` is a stream of job rows (``batches_of`` the jobs of an ingest
    stream); several rows of a job add up to what it expects.  State is one row
    per message id and one per job, whichever of outcomes and job comes first.
    Jobs that a batch touched go to ``progress_dir/batch_id=`` with their totals
    and whether they ``reached`` what they expect.
    """
    counted = F.col("status").isin(*J.COUNTED).cast("long")
    done = first_deliveries(outcomes.select(id_col, "job_id", "status"), id_col).where(
        F.col("job_id").isNotNull() & (F.col("job_id") != "")).select(
        "job_id", counted.alias("_done"), F.lit(None).cast("long").alias("_expected"),
        F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("timestamp").alias("created_at"))
    made = jobs.select("job_id", F.lit(0).cast("long").alias("_done"), F.col("expected_count").cast("long").alias("_expected"),
                       "source_file", F.col("created_at").cast("timestamp"))
    state = done.unionByName(made).groupBy("job_id").agg(
        F.sum("_done").alias("processed_count"), F.sum("_expected").alias("expected_count"),
        F.max("source_file").alias("source_file"), F.min("created_at").alias("created_at"))
    reached = F.coalesce((F.col("processed_count") > 0) & (F.col("processed_count") >= F.col("expected_count")), F.lit(False))
    return _start(state.withColumn("reached", reached), lambda batch, batch_id: _put_whole(batch, progress_dir, batch_id),
                  checkpoint, available_now, "update")


def job_totals(spark: SparkSession, progress_dir: str) -> DataFrame:
    """job_id and processed_count of the jobs with outcomes, as of the last committed micro-batch."""
    last = spark.read.parquet(progress_dir).groupBy("job_id").agg(F.max_by("processed_count", "batch_id").alias("processed_count"))
    return last


# ---------------------------------------------------------------- O53
def completion_stream(progress: DataFrame, completions_dir: str, checkpoint: str, as_of, bucket: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Job counters (``batches_of`` a progress stream) -> one completion event per job, in O44's columns."""
    ts = F.lit(as_of).cast("timestamp")
    has_file = F.coalesce(F.col("source_file") != "", F.lit(False))
    done = progress.where("reached").dropDuplicates(["job_id"]).select(
        "job_id", "source_file", "expected_count", "processed_count", "created_at", F.lit("completed").alias("status"),
        ts.alias("completed_at"), F.when(has_file, F.lit(bucket)).alias("s3_bucket"),
        F.when(has_file, F.col("source_file")).alias("s3_key"))
    return _start(done, lambda batch, batch_id: _put_whole(batch, completions_dir, batch_id), checkpoint, available_now)


def playlist_stream(completions: DataFrame, read: Callable[[DataFrame], DataFrame], tracks: str | DataFrame, out_dir: str,
                    checkpoint: str, as_of, available_now: bool = True) -> StreamingQuery:
    """Completions -> the playlist of each job, made once however often its completion is delivered.

    ``read`` gives (bucket, key, json) for a DataFrame of (bucket, key)
    (``stored_objects`` or a lookup in a snapshot table); ``tracks`` given as a
    path is read anew by every batch.  Per batch: the snapshots of its jobs
    (O01), enriched (O30), go in order (O40) to ``items``, skipped rows
    with their reason included; totals, names and links (O42), or the error of a
    job without a playlist (O28), to ``playlists``.
    """
    once = completions.dropDuplicates(["job_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _put_whole(batch, f"{out_dir}/jobs", batch_id)
        jobs = spark.read.parquet(f"{out_dir}/jobs/batch_id={batch_id}")
        here = F.coalesce(F.col("s3_bucket") != "", F.lit(False)) & F.coalesce(F.col("s3_key") != "", F.lit(False))
        names = jobs.where(here).select(F.col("s3_bucket").alias("bucket"), F.col("s3_key").alias("key"))
        _put(read(names.distinct()).where(F.try_parse_json("json").isNotNull()), f"{out_dir}/objects", batch_id)
        found = spark.read.parquet(f"{out_dir}/objects/batch_id={batch_id}")
        owners = jobs.select("job_id", F.col("s3_bucket").alias("bucket"), F.col("s3_key").alias("key"))
        _put(joins.enrich(playlist.snapshot_tracks(found).join(owners, ["bucket", "key"]), _table(spark, tracks)),
             f"{out_dir}/rows", batch_id)
        rows = spark.read.parquet(f"{out_dir}/rows/batch_id={batch_id}")
        numbered = playlist.playlist_items(rows.where("status = 'enriched'"), ["job_id"], ["rec_pos"], "video_id")
        skipped = rows.where("status <> 'enriched'").withColumn("added", F.lit(False))
        columns = ["job_id", "rec_pos", "track_id", "title", "artist", "status", "reason", "video_id", "video_url", "position", "added"]
        _put(numbered.unionByName(skipped, allowMissingColumns=True).select(*columns), f"{out_dir}/items", batch_id)
        items = spark.read.parquet(f"{out_dir}/items/batch_id={batch_id}")
        checked = playlist.validate_location(rows, jobs, "job_id")
        there = found.select("bucket", "key").withColumn("_there", F.lit(True))
        checked = checked.join(there, (F.col("s3_bucket") == F.col("bucket")) & (F.col("s3_key") == F.col("key")), "left").drop("bucket", "key")
        missing = F.when(~here, "Missing s3_bucket or s3_key in job completion event").when(F.col("_there").isNull(), NO_SNAPSHOT)
        made = playlist.playlist_header(
            checked.withColumn("error", F.coalesce(missing, "error")).drop("_there")
                   .join(playlist.playlist_summary(items, ["job_id"]), "job_id", "left"), as_of, job_col="job_id")
        no = F.col("error").isNotNull()
        hidden = ("playlist_id", "playlist_url", "music_url", "playlist_name", "description")
        _put(made.select(*[F.when(~no, F.col(c)).alias(c) if c in hidden else F.col(c) for c in made.columns]),
             f"{out_dir}/playlists", batch_id)

    return _start(once, write, checkpoint, available_now)


# ---------------------------------------------------------------- O46 per micro-batch
class OutcomeCounts(StreamingQueryListener):
    """Processed / skipped / failed of every micro-batch of the streams that ``observed`` marks with ``name``: Spark
    counts them while the batch runs, and reports them with its progress.  One entry a batch, kept by (query, batch)."""

    def __init__(self, name: str = "outcomes"):
        self.name, self.batches = name, {}

    def observed(self, decoded: DataFrame) -> DataFrame:
        return decoded.observe(self.name, *[F.count_if(F.col("outcome") == o).alias(o) for o in ("processed", "skipped", "failed")])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def wait(self, batches: int, seconds: float = 30) -> None:
        """Until so many batches are reported (reports come a moment after a stream's end)."""
        until = time.time() + seconds
        while len(self.batches) < batches and time.time() < until:
            time.sleep(0.05)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(query, batch_id, processed, skipped, failed)."""
        rows = [(q, b, m["processed"], m["skipped"], m["failed"]) for (q, b), m in sorted(self.batches.items())]
        return spark.createDataFrame(rows, "query string, batch_id long, processed long, skipped long, failed long")


def notification_stream(records_in: DataFrame, counts: OutcomeCounts, out_dir: str, checkpoint: str,
                        available_now: bool = True, **how) -> StreamingQuery:
    """O05 and O46 on a stream: decoded notifications to ``out_dir/batch_id=``, their outcomes counted by batch."""
    decoded = counts.observed(envelopes.decode_notifications(records_in, **how))
    return _start(decoded, lambda batch, batch_id: _put(batch, out_dir, batch_id), checkpoint, available_now)
