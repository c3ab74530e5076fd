"""Table schemas of build history, manifests, file snapshots, traces and stored objects."""

from __future__ import annotations

INFO = "id INT, version INT, client_version BIGINT, iteration BIGINT"
KEY_NAMES = "id BIGINT, key BINARY"
RULE_RESULTS = "key_id BIGINT, value BINARY, signature BIGINT, built_at BIGINT, computed_at BIGINT, start DOUBLE, `end` DOUBLE, dependencies BINARY"
EDGES = "key_id BIGINT, ordinal INT, dep_key_id BIGINT, order_only BOOLEAN, single_use BOOLEAN"
RULES = "key STRING, signature STRING"
PRIOR = "key STRING, value STRING, signature STRING, built_at BIGINT, computed_at BIGINT"
KEY_EDGES = "key STRING, ordinal INT, dep STRING, order_only BOOLEAN, single_use BOOLEAN"
VALID = "key STRING, ok BOOLEAN"
NODES = "name STRING, kind STRING, mutated BOOLEAN, command_timestamp BOOLEAN, exclusion_patterns ARRAY<STRING>, must_scan_after ARRAY<STRING>"
COMMANDS = "name STRING, tool STRING, inputs ARRAY<STRING>, outputs ARRAY<STRING>, attrs MAP<STRING,STRING>, list_attrs MAP<STRING,ARRAY<STRING>>"
FILE_INFO = "path STRING, device DECIMAL(20,0), inode DECIMAL(20,0), mode BIGINT, size BIGINT, mtime_s BIGINT, mtime_ns INT, checksum BINARY"
TRACE_EVENTS = "seq BIGINT, tag STRING, a1 STRING, a2 STRING, a3 STRING"
PROCESSES = "pid BIGINT, parent BIGINT, name STRING, args ARRAY<STRING>, start_us BIGINT, exit_us BIGINT, user_start_us BIGINT, user_exit_us BIGINT, user_s DOUBLE, sys_s DOUBLE"
CAS = "id STRING, refs ARRAY<STRING>, data BINARY"
ACTION_CACHE = "label STRING, type STRING, key_id STRING, value_id STRING"
