"""Tables of a snapshot and of a comparison, and the checks that hold on them."""

from __future__ import annotations

# Names and types of columns. Keys are logical (root_label, rel_path); numbers that SQLite files use are import-only.
TABLES = {
    "snapshot_info": "snapshot_uuid string, schema_version int, tool_version string, started_at_utc string, finished_at_utc string, status string, has_file_issues int, has_unstable int, has_gaps int, hash_coverage string, path_key_rule int, counts_json string",
    "roots": "root_label string, root_path string, volume_serial string, filesystem string, bus_type string, enum_status string",
    "dirs": "root_label string, rel_path string, path_key string, enum_status string, error_message string, file_count bigint, subdir_count bigint, attributes bigint, observed_at_utc string",
    "entries": "root_label string, rel_path string, path_key string, name string, extension string, media_kind string, size_bytes bigint, created_at_utc string, modified_at_utc string, attributes bigint, is_placeholder int, hard_link_count bigint, volume_serial string, file_index_hex string, observed_at_utc string, meta_status string, hash_status string",
    "hashes": "root_label string, rel_path string, algorithm string, hash_hex string, origin string, source_snapshot_uuid string, source_computed_at_utc string, reuse_basis string, size_bytes bigint, bytes_read bigint, chunk_bytes bigint, started_at_utc string, finished_at_utc string, pre_size bigint, pre_mtime_utc string, post_size bigint, post_mtime_utc string, status string, failure_reason string, tool string, tool_version string",
    "raw_payloads": "root_label string, rel_path string, provider string, payload_zlib binary, payload_sha256 string, uncompressed_bytes bigint, provider_version string, profile_version bigint, parsed_at_utc string",
    "metadata_diagnostics": "root_label string, rel_path string, diagnostic_pk bigint, provider string, severity string, diagnostic_code string, field_name string, message string, raw_value string, observed_at_utc string",
    "errors": "root_label string, rel_path string, is_dir int, error_pk bigint, stage string, error_code string, message string, occurred_at_utc string",
    "entry_attempts": "root_label string, rel_path string, attempt_id bigint, session_id string, stage string, attempt_number bigint, status string, tool_name string, started_at_utc string, ended_at_utc string, bytes_read bigint, end_reason string, error_code string, error_message string, result_json string",
    "read_performance": "root_label string, rel_path string, attempt_id bigint, session_id string, stage string, origin string, size_bytes bigint, bytes_read bigint, elapsed_seconds double, active_read_seconds double, stall_count bigint, longest_stall_seconds double, final_offset bigint, ended_reason string, candidate_confidence string, candidate_reason string, recorded_at_utc string",
    "format_checks": "root_label string, rel_path string, attempt_id bigint, validator string, status string, stat_match int, detail string, checked_at_utc string",
}

#: What a published snapshot says of its own making.
EVIDENCE = {
    "snapshot_manifest": "manifest_json string, embedded_at_utc string",
    "run_events": "event_seq bigint, occurred_at_utc string, event string, payload_json string",
}

#: Tables of a stored comparison.
COMPARISON = {
    "diff_info": "diff_uuid string, status string, schema_version int, old_schema_version int, new_schema_version int, old_snapshot_uuid string, new_snapshot_uuid string, old_hash_coverage string, new_hash_coverage string, forced int, tool_version string, created_at_utc string",
    "entries": "path_key string, old_root string, new_root string, old_path string, new_path string, old_size bigint, new_size bigint, old_hash string, new_hash string, status string, evidence string, reason string, metadata_changed int, old_mtime string, new_mtime string, old_origin string, new_origin string, group_hash string",
    "groups": "hash_hex string, old_count bigint, new_count bigint, old_hardlink_sets bigint, new_hardlink_sets bigint, classification string",
    "dirs": "path_key string, old_root string, new_root string, old_path string, new_path string, old_enum string, new_enum string, status string, reason string",
    "subtrees": "side string, root_label string, rel_path string, enum_status string, affected_estimate bigint",
}

#: Conditions that every row meets; a null counts as met, as in SQL's CHECK.
CHECKS = {
    "roots": {"enum_status": "enum_status in ('pending', 'ok', 'failed')"},
    "dirs": {"enum_status": "enum_status in ('ok', 'access_denied', 'io_error', 'skipped_reparse', 'skipped_excluded', 'timeout', 'not_enumerated')"},
    "entries": {"size": "size_bytes >= 0", "placeholder": "is_placeholder in (0, 1)", "path_key": "path_key is not null"},
    "hashes": {"status": "status in ('valid', 'failed', 'unstable', 'skipped')", "valid_has_hash": "status <> 'valid' or hash_hex is not null", "reused_has_source": "origin <> 'reused' or source_snapshot_uuid is not null", "origin": "origin in ('computed', 'reused')"},
    "metadata_diagnostics": {"severity": "severity in ('warning', 'error', 'validation')"},
}
KEYS = {"roots": ["root_label"], "dirs": ["root_label", "rel_path"], "entries": ["root_label", "rel_path"], "hashes": ["root_label", "rel_path", "algorithm"], "raw_payloads": ["root_label", "rel_path", "provider"]}
#: table: (columns, the table that holds them, its columns)
REFERENCES = {"entries": (["root_label"], "roots"), "dirs": (["root_label"], "roots"), "hashes": (["root_label", "rel_path"], "entries"), "raw_payloads": (["root_label", "rel_path"], "entries")}
