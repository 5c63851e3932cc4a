from rankflow.streaming.jobs import (  # noqa: F401
    COMPLETION_SCHEMA, JOB_SCHEMA, PROGRESS_SCHEMA, OutcomeCounts, batches_of, completion_stream, current_table,
    dead_letter_stream, file_stream, first_deliveries, ingest_stream, job_table, job_totals, lookup_stream,
    notification_stream, playlist_stream, progress_stream, read_named, stored_objects,
)
