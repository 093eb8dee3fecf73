"""Declared table schemas. Nothing is inferred from data."""

from __future__ import annotations


# Table columns, as DDL text.
RAW_LISTING = (
    "id string, slug string, company string, position string, location string, "
    "tags array<string>, description string, url string, date string, "
    "salary_min string, salary_max string"
)
USERS = "user_id bigint, email string, full_name string, created_at timestamp"
PROFILES = (
    "profile_id bigint, user_id bigint, headline string, summary string, "
    "target_roles array<string>, target_locations array<string>, "
    "min_salary double, remote_only boolean, updated_at timestamp"
)
SKILLS = "skill_id bigint, user_id bigint, skill_name string, years_experience double"
POSTINGS = (
    "job_id string, source string, title string, company string, location string, "
    "remote boolean, salary_min double, salary_max double, description string, "
    "tags array<string>, url string, posted_at timestamp, payload string, synced_at timestamp"
)
CHUNKS = (
    "job_id string, chunk_index int, chunk_text string, embedding array<float>, "
    "model_name string, text_hash string, created_at timestamp"
)
SAVED_JOBS = (
    "saved_job_id bigint, user_id bigint, job_id string, stage string, "
    "match_score double, saved_at timestamp, updated_at timestamp"
)
APPLICATIONS = (
    "saved_job_id bigint, cover_letter string, resume_bullet string, "
    "applied_at timestamp, last_updated_at timestamp"
)
NOTES = "note_id bigint, saved_job_id bigint, note_text string, follow_up_at timestamp, created_at timestamp"
CONTACTS = (
    "contact_id bigint, saved_job_id bigint, name string, role string, "
    "email string, notes string, created_at timestamp"
)
COMMANDS = (
    "user_id bigint, job_id string, seq bigint, ts timestamp, op string, "
    "stage string, match_score double"
)
DRAFTS = "user_id bigint, job_id string, seq bigint, ts timestamp, kind string, text string"
NOTE_COMMANDS = (
    "user_id bigint, job_id string, seq bigint, ts timestamp, note_text string, "
    "follow_up_at timestamp"
)
MESSAGES = "conv_id bigint, turn bigint, role string, text string"

# The stages a saved job may have, in display order.
STAGES = ("saved", "applied", "interviewing", "rejected", "offer")
ACTIVE_STAGES = ("applied", "interviewing")

# Defaults.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
SEARCH_LIMIT = 8
STALE_DAYS = 7
HISTORY_MESSAGES = 12
EMBEDDING_DIM = 1024
