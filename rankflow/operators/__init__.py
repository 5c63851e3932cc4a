"""Table-level operators: records, joins, merges, jobs, playlists, history."""

from rankflow.operators.history import (
    diff_summary, get_by_key, order_changes, quarantine, retain_recent, retain_versions, scan_limited,
    snapshot_diff, top_k,
)
from rankflow.operators.jobs import classify_outcomes, completed_jobs, create_jobs, job_progress, split_dead_letters
from rankflow.operators.joins import enrich, lookup_by_content, lookup_exact, match_top1, new_records
from rankflow.operators.merge import fill_all, fill_by_content, insert_with_defaults, patch, patch_report, upsert_if_missing
from rankflow.operators.ordinal import ordinal_in_group
from rankflow.operators.playlist import playlist_from_ids, playlist_header, playlist_items, playlist_summary, route, validate
from rankflow.operators.records import locate_records, normalize_records, plain_numbers, sparse

__all__ = [
    "classify_outcomes", "completed_jobs", "create_jobs", "diff_summary", "enrich", "fill_all", "fill_by_content",
    "get_by_key", "insert_with_defaults", "job_progress", "locate_records", "lookup_by_content", "lookup_exact",
    "match_top1", "new_records", "normalize_records", "order_changes", "ordinal_in_group", "patch", "patch_report",
    "plain_numbers", "playlist_from_ids", "playlist_header", "playlist_items", "playlist_summary", "quarantine",
    "retain_recent", "retain_versions", "route", "scan_limited", "snapshot_diff", "sparse", "split_dead_letters",
    "top_k", "upsert_if_missing", "validate",
]
