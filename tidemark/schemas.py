"""Table schemas. Names here are the library's own; files keep their published keys."""

from __future__ import annotations

VALUE_TYPE = "decimal(18,6)"
STORED_VALUE_TYPE = "decimal(38,18)"

# Outcomes as they arrive: everything is text until it has been validated.
RAW_OUTCOME = (
    "series string, outcome_id string, value string, ts string, collection_ts string, "
    "started_at string, pre_observed_at string, pre_data string, post_data string, raw_data string"
)

# Validated outcomes; the key is (series, outcome_id).
OUTCOME = (
    f"series string, outcome_id string, value {STORED_VALUE_TYPE}, ts timestamp, "
    "collection_ts timestamp, started_at timestamp, pre_observed_at timestamp, "
    "pre_data string, post_data string, raw_data string"
)
OUTCOME_COLUMNS = [part.split()[0] for part in OUTCOME.split(", ")]

# Document key -> column of the outcome table.
DOCUMENT_KEYS = {
    "source": "series",
    "round_id": "outcome_id",
    "multiplier": "value",
    "timestamp": "ts",
    "collection_timestamp": "collection_ts",
    "started_at": "started_at",
    "pre_round_observed_at": "pre_observed_at",
    "pre_round_data": "pre_data",
    "post_round_data": "post_data",
    "raw_data": "raw_data",
}
REQUIRED_DOCUMENT_KEYS = ["source", "round_id", "multiplier", "timestamp", "collection_timestamp"]

FIELD = "struct<path:string,kind:string,value:double,sha256_24:string,length:int>"
CATEGORY = "struct<path:string,value:string>"
SHAPE = "struct<path:string,type:string>"

# One observation line of the collector's JSONL files.
OBSERVATION_LINE = f"""
observed_at string, kind string, url string, socket_id string, opcode int, status int,
series string,
payload struct<
  bytes:bigint, sha256:string, format:string, root_type:string,
  shape:array<{SHAPE}>, game_fields:array<{FIELD}>, categorical_fields:array<{CATEGORY}>,
  binary_fingerprint:struct<entropy_bucket:double, printable_ratio_bucket:double,
    zero_ratio_bucket:double, high_bit_ratio_bucket:double, unique_byte_bucket:int>>
"""

# Flat observations, the input of profiling, features, triggers and audits.
OBSERVATION = f"""
series string, obs_id string, ts timestamp, kind string, url string, socket string,
direction string, opcode int, status int, payload_bytes bigint, payload_format string,
payload_sha256 string, entropy double, printable_ratio double, zero_ratio double,
high_bit_ratio double, unique_byte_bucket int, shape array<{SHAPE}>, fields array<{FIELD}>,
categories array<{CATEGORY}>
"""

CANDIDATE = (
    "struct<multiplier:string,x_bucket:int,y_bucket:int,width_bucket:int,height_bucket:int>"
)
SNAPSHOT_LINE = (
    f"observed_at string, kind string, url string, series string, canvas_count int, "
    f"candidates array<{CANDIDATE}>"
)
MARKER_LINE = "observed_at string, kind string, series string, event string, multiplier double"

SIGNATURE_SEQUENCE = "array<struct<signature:string,gap_ms:double>>"

# One line of the forecast ledger; the union of all event kinds, ordered by (series, seq).
FORECAST_LEDGER = """
series string, seq bigint, event string, ledger_version int, lock_id string, source string,
collector_session_id string, history_count bigint, history_last_round_id string,
history_last_timestamp string, locked_at string, scored_at string, armed_at string,
invalidated_at string, observed_at string, status string, reason string,
actual_round_id string, actual_timestamp string, actual_multiplier string,
after_lock_id string, unpredicted_rounds bigint, first_unpredicted_round_id string,
last_unpredicted_round_id string, predicted_multiplier string,
prediction_interval struct<lower:string,upper:string>,
threshold_probabilities map<string,string>,
threshold_model_details map<string,struct<source:string,reason:string,
  baseline_probability:string,raw_candidate_probability:string>>
"""

# One line of the snapshot ledger, likewise.
SNAPSHOT_LEDGER = f"""
series string, seq bigint, event string, ledger_version int, snapshot_id string,
collector_session_id string, locked_at string, observed_at string, armed_at string,
scored_at string, invalidated_at string, reason string, previous_round_id string,
previous_round_timestamp string, history_count bigint, history_last_round_id string,
actual_round_id string, actual_timestamp string, actual_multiplier string,
trigger_signature string, trigger_score double, trigger_age_after_previous_seconds double,
training_starts bigint, signature_count bigint, historical_rounds bigint,
probabilities map<string,string>,
features struct<event_count_since_previous:bigint, received_count:bigint, sent_count:bigint,
  binary_count:bigint, total_payload_bytes:bigint, signature_counts:map<string,bigint>,
  transition_counts:map<string,bigint>, recent_sequence:{SIGNATURE_SEQUENCE}>,
forecast struct<historical_probabilities:map<string,string>, probabilities:map<string,string>,
  candidate_probabilities:map<string,string>, prior_reconstructed_for_audit:boolean>
"""

# One row of the ledgers that streams write, of both kinds; instants are microseconds.
STREAM_LEDGER = (
    "series string, seq bigint, event string, us bigint, lock_id string, "
    "collector_session_id string, history_count bigint, reference_id string, "
    "actual_id string, actual_value string, probabilities map<string,string>, "
    "candidate_probabilities map<string,string>, historical_probabilities map<string,string>, "
    "briers map<string,string>, "
    "unpredicted bigint, trigger_signature string, trigger_score double, "
    "trigger_age_seconds double, features string, reason string, status string, "
    "details map<string,struct<source:string,reason:string,baseline_probability:string,raw_candidate_probability:string,"
    "selected_c:double,candidate_skill_pct:double,candidate_weight:double>>, "
    "predicted string, interval struct<lower:string,upper:string>, point string, "
    "point_score struct<absolute_error:string,relative_error:string,within_interval:boolean>"
)

HEARTBEAT = "kind string, observed_at string, collector_session_id string, capture_ready boolean"
LEDGER_VERSION = 1
