"""Schemas of the caption tables."""

DOCUMENT = "events array<struct<tStartMs: double, dDurationMs: double, wWinId: int, aAppend: int, segs: array<struct<utf8: string, tOffsetMs: double>>>>"
JOB = "id string, video_id string, lang string, tlang string, track string, fmt string, source_hash string, status string, retry_count int, next_retry_at long, error_code string, error_message string, bilingual_json string, created_at long, updated_at long, expires_at long"
JOB_KEY = ["video_id", "lang", "tlang", "track", "fmt"]
JOB_STATES = ("pending", "translating", "done", "failed")
SEGMENT = "id string, job_id string, segment_index int, start_ms long, end_ms long, source_text string, translated_text string, status string, created_at long, updated_at long"
