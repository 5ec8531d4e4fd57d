"""Bounds of every stage. They are observable behaviour."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    mail_bytes: int = 25 * 1024 * 1024
    text_chars: int = 30_000
    raw_factor: int = 16
    mime_depth: int = 10
    mime_parts: int = 500
    attachments_processed: int = 20
    attachments_listed: int = 100
    pdf_seconds: float = 30.0
    html_elements: int = 50_000
    html_bytes: int = 1024 * 1024
    html_parts: int = 4
    html_depth: int = 2000
    subject_chars: int = 300
    display_chars: int = 120
    links: int = 2000
    links_listed: int = 100
    footnote_chars: int = 5000
    defanged_chars: int = 300
    divergence_words: int = 5
    divergence_share: float = 0.5
    control_burst: int = 8
    excerpt_chars: int = 400
    headline_chars: int = 100
    reasons: int = 5
    reason_chars: int = 200
    spoofing_signals: int = 3
    digest_items: int = 60
    category_chars: int = 40
    guard_rounds: int = 4
    delivery_attempts: int = 5
    delivery_backoff: tuple[int, ...] = (60, 300, 900, 2100)
    delivery_deadline: int = 3600
    plausible_age: int = 86_400
    age_slack: int = 3600
    future_tolerance: int = 7200
    outbox_batch: int = 50
    header_chars: int = 4096
    header_values: int = 32
    recipients: int = 200


LIMITS = Limits()
