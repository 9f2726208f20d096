"""Schemas of all domain tables, as DDL; nothing is ever inferred."""

RUNS = (
    "id string, site_name string, scope string, status string, forced boolean, started_at timestamp, finished_at timestamp, "
    "duration_millis bigint, error_category string, error_message string, created_at timestamp, updated_at timestamp"
)
PACKAGES = "id string, run_id string, source_kind string, source_name string, destination string, object_key string, size bigint, sha256 string, status string, error_message string, created_at timestamp"
REPORT_DELIVERIES = "report_type string, period string, delivered_at timestamp, created_at timestamp"
NOTIFICATION_STATES = "key string, fingerprint string, last_sent timestamp"
SITES = "name string, enabled boolean, backup_mode string, destinations array<string>, keep_last int"
STORAGES = "name string, type string, primary boolean"
OBJECTS = "destination string, site_name string, key string, size bigint, modified_at timestamp"
LOCKS = "site_name string, verified boolean, pid bigint, acquired_at timestamp"
SNAPSHOTS = (
    "id string, time timestamp, parent string, tree string, paths array<string>, hostname string, username string, excludes array<string>, tags array<string>, "
    "summary struct<files_new:int,files_changed:int,files_unmodified:int,data_added:bigint,total_files_processed:int,total_bytes_processed:bigint,total_duration:double>"
)
TREE_NODES = (
    "tree_id string, name string, type string, mode bigint, mtime timestamp, ctime timestamp, uid bigint, gid bigint, inode decimal(20,0), device_id decimal(20,0), size decimal(20,0), "
    "links decimal(20,0), linktarget string, linktarget_raw string, device decimal(20,0), content array<string>, subtree string"
)
INDEX_ENTRIES = "index_id string, pack_id string, type string, id string, offset bigint, length bigint, uncompressed_length bigint"
PACK_FILES = "pack_id string, size bigint"
PACK_HEADERS = "pack_id string, ordinal int, type string, id string, offset bigint, length bigint, compressed boolean, uncompressed_length bigint"
FINDINGS = "type string, id string, snapshot_id string, pack_id string, blob_count int, detail string"
INCIDENT_EVENTS = "ts timestamp, server_id string, site string, scope string, channel string, channel_type string, event string, error_category string, error_message string"
TABLE_CHECKS = "table_name string, engine string, type string, message string"

#: Closed sets.
RUN_STATUSES = ("running", "success", "partial", "failed", "cancelled", "skipped", "no_change")
REPORT_STATUSES = ("success", "partial", "failed", "cancelled", "skipped", "no_change")
GOOD = ("success", "no_change")
