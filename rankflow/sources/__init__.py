"""Sources and sinks: snapshot files, message envelopes, raw pages."""

from rankflow.sources.envelopes import build_messages, decode_messages, decode_notifications, outcome_summary
from rankflow.sources.pages import (
    ExtractRules, assemble_snapshot, extract_fields, extract_rows, number_with_unit, pattern_extract, split_rows,
    valid_rows,
)
from rankflow.sources.snapshots import (
    latest_snapshot, list_snapshot_files, list_snapshots, parse_snapshots, read_snapshots, write_snapshots,
)
from rankflow.sources.tables import open_bucketed, write_bucketed, write_point_table

__all__ = [
    "ExtractRules", "assemble_snapshot", "build_messages", "decode_messages", "decode_notifications",
    "extract_fields", "extract_rows", "latest_snapshot", "list_snapshot_files", "list_snapshots", "number_with_unit",
    "open_bucketed", "outcome_summary", "parse_snapshots", "pattern_extract", "read_snapshots", "split_rows", "valid_rows",
    "write_bucketed", "write_point_table", "write_snapshots",
]
