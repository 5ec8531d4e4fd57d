"""Row types of the engine's tables."""

REPORT = (
    "links_removed BIGINT, hidden_text_removed BOOLEAN, control_chars_removed BIGINT, punycode_domains ARRAY<STRING>, "
    "mixed_script_domains ARRAY<STRING>, truncated BOOLEAN, html_divergent BOOLEAN, html_rejected BOOLEAN, links_capped BOOLEAN, "
    "blocked_attachments BIGINT, reply_to_mismatch BOOLEAN, return_path_mismatch BOOLEAN, id_collision BOOLEAN, "
    "forged_markers BIGINT, encrypted BOOLEAN, auth_results MAP<STRING,STRING>"
)
ATTACHMENT = "filename_sanitized STRING, declared_mime STRING, detected_kind STRING, size_bytes BIGINT, processed BOOLEAN, extracted_chars BIGINT"
RAW_MAIL = (
    "message_id STRING, dedupe_key STRING, from_addr STRING, from_domain STRING, reply_to STRING, from_address STRING, "
    "reply_to_address STRING, reply_to_addresses ARRAY<STRING>, return_path_domain STRING, to_addrs ARRAY<STRING>, "
    "subject_raw STRING, date TIMESTAMP, date_offset_min INT, auth_results_header STRING, mime_bytes BINARY, "
    "size_bytes BIGINT, content_hash STRING, id_collision BOOLEAN, ingest_failed BOOLEAN"
)
SANITIZED_MAIL = (
    "dedupe_key STRING, from_display STRING, from_domain STRING, subject STRING, date TIMESTAMP, date_offset_min INT, "
    f"body_text STRING, attachment_texts ARRAY<STRUCT<name: STRING, text: STRING>>, attachments ARRAY<STRUCT<{ATTACHMENT.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT').replace(' BOOLEAN', ': BOOLEAN')}>>, "
    f"links_found ARRAY<STRING>, report STRUCT<{REPORT.replace(' BIGINT', ': BIGINT').replace(' BOOLEAN', ': BOOLEAN').replace(' ARRAY', ': ARRAY').replace(' MAP', ': MAP')}>"
)
SUMMARY = "headline STRING, summary_text STRING, importance STRING, importance_reason STRING, category STRING, attachment_summaries ARRAY<STRUCT<name: STRING, text: STRING>>, injection_suspected BOOLEAN"
VERDICT = "phishing_risk STRING, risk_reasons ARRAY<STRING>, summary_accurate BOOLEAN, notes STRING"
SEEN_MAILS = "message_id_hash STRING, first_seen_at TIMESTAMP, status STRING, error_class STRING, retry_count INT, content_hash STRING"
LOW_QUEUE = "id BIGINT, message_id_hash STRING, received_at TIMESTAMP, headline STRING, category STRING, from_domain STRING"
OUTBOX = "id BIGINT, message_id_hash STRING, kind STRING, payload STRING, attempts INT, first_queued_at TIMESTAMP, next_attempt_at TIMESTAMP, last_error STRING"
