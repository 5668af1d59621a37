"""Schemas of the event tables."""

from __future__ import annotations

CLEAN = (
    "event_id string, session_id string, visitor_id string, member_id string, event_ts timestamp, event_name string, page_type string, "
    "product_id string, category string, search_term string, device string, membership_tier string, app_version string, order_id string, "
    "order_total double, schema_version string, _persona string, _is_bot boolean"
)
BRONZE = CLEAN + ", item_id string, ingested_at timestamp, _true_ts timestamp, _bot_spoofed boolean, _was_buffered boolean, _is_duplicate boolean, _drifted boolean"
QUARANTINE = BRONZE + ", quarantine_reason string"
#: Ground truth: evaluation may read it, the pipeline may not.
TRUTH = ("_persona", "_is_bot", "_true_ts", "_bot_spoofed", "_was_buffered", "_is_duplicate", "_drifted")
