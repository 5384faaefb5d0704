"""Schemas of the logical tables, and the constraints that their rows must meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO = "video_id string, channel_id string, title string, published_at timestamp, duration_seconds bigint, view_count bigint, like_count bigint, comment_count bigint, tags array<string>, privacy_status string"
SEGMENT = "start double, `end` double, duration double, text string"
TRANSCRIPT = f"video_id string, segments array<struct<start:double,`end`:double,duration:double,text:string>>"  # noqa: F541
DAILY = "date string, views bigint, estimated_minutes_watched double, average_view_duration double, average_view_percentage double"
RETENTION = "video_id string, elapsed_ratio double, audience_watch_ratio double, relative_retention double"
COMMENT = "comment_id string, video_id string, author string, text string, published_at timestamp, like_count bigint, parent_comment_id string, reply_count bigint"
PARSED_TITLE = "video_id string, original_title string, professor array<string>, course string, year int, semester int, week int, session int, department string, category string, parse_error boolean, matched_pattern string"
MANIFEST = "video_id string, mp4_filename string, failed_stage string, reason string, last_attempt_at string, attempt_count int"


def checks(entity: str) -> list[tuple[str, Column]]:
    """Named constraints of an entity; a null condition counts as met."""
    c = F.col
    return {
        "video": [("views_not_negative", c("view_count") >= 0), ("duration_not_negative", c("duration_seconds") >= 0), ("title_not_blank", F.trim("title") != "")],
        "channel": [("id_prefix", F.startswith("channel_id", F.lit("UC")))],
        "retention": [("ratio_in_range", c("elapsed_ratio").between(0, 1)), ("watch_not_negative", c("audience_watch_ratio") >= 0)],
        "segment": [("end_after_start", c("end") > c("start")), ("difficulty_in_range", c("difficulty").between(0, 1))],
        "parsed_title": [("semester_known", c("semester").isin(1, 2)), ("week_positive", c("week") > 0)],
        "manifest": [("attempted", c("attempt_count") >= 1)],
    }[entity]
