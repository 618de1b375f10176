"""Schemas of the state tables; never inferred."""

from __future__ import annotations

#: Schema versions in order, with the tables each introduces.  Columns that a version adds are null in older rows.
MIGRATIONS = (
    ("001_initial", ("mbox_sources", "ingest_runs", "ingest_errors", "messages", "threads", "attachments", "labels",
                     "message_labels", "categories", "category_aliases", "category_rules", "classifications",
                     "category_proposals", "security_findings", "exports", "export_items")),
    ("002_multi_account", ("accounts",)),
)

TABLES = {
    "accounts": "account_key string, display_name string, email_address string, provider string, notes string, created_at string",
    "mbox_sources": ("source_id long, account_key string, file_path string, source_name string, source_slug string, "
                     "file_size long, file_mtime timestamp, sha256 string"),
    "ingest_runs": ("id long, source_id long, account_key string, status string, last_mbox_key long, messages_seen long, "
                    "messages_inserted long, messages_skipped long, messages_replaced long, errors_count long, "
                    "started_at string, finished_at string"),
    "ingest_errors": "account_key string, ingest_run_id long, source_id long, mbox_key long, error_type string, error_message string",
    "messages": ("id long, account_key string, source_id long, mbox_key long, message_id string, thread_key string, subject string, "
                 "sender string, recipients array<string>, cc array<string>, bcc array<string>, date_header string, date_utc string, "
                 "body_text string, body_html string, body_hash string, body_chars int, body_word_count int, attachment_count int, "
                 "raw_headers map<string,string>, labels array<string>"),
    "threads": ("account_key string, source_id long, thread_key string, message_count long, date_min string, date_max string, "
                "subject string, participants array<string>"),
    "attachments": ("account_key string, message_db_id long, source_id long, original_filename string, safe_filename string, "
                    "content_type string, content_disposition string, size_bytes long, sha256 string, storage_path string, "
                    "extraction_status string, error_message string"),
    "labels": "account_key string, label_name string, normalized_name string",
    "message_labels": "account_key string, message_db_id long, label_name string",
    "categories": ("account_key string, path string, display_name string, parent_path string, description string, "
                   "locked boolean, active boolean"),
    "category_aliases": "account_key string, alias string, path string",
    "category_rules": "account_key string, name string, rule_json string, priority int, active boolean",
    "classifications": ("id long, account_key string, target_type string, message_db_id long, thread_key string, category_path string, "
                        "sensitivity string, notebooklm_priority string, export_profile string, classifier_type string, "
                        "classifier_name string, confidence double, prompt_version string, summary string, raw_output_json string"),
    "category_proposals": ("id long, account_key string, proposed_path string, reason string, confidence double, status string, "
                           "created_at string, reviewed_note string, reviewed_at string"),
    "security_findings": ("account_key string, target_type string, message_db_id long, finding_type string, severity string, "
                          "detector string, excerpt string"),
    "exports": ("id long, account_key string, export_type string, export_profile string, output_path string, limit_profile string, "
                "status string, source_count long, message_count long, started_at string, finished_at string"),
    "export_items": "account_key string, export_id long, output_file string, category_path string",
    "schema_migrations": "version string, applied_at string",
}
