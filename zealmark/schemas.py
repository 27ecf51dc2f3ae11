"""Table contracts. Reads and writes go through ``enforce_schema``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, L, D, N = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


METRICS = (
    "num_checkins",
    "num_bookmarks",
    "speakers_bookmarked",
    "speakers_viewed",
    "speakers_viewed_timespent",
    "sessions_viewed",
    "sessions_timespent",
)
DWELL_METRICS = ("speakers_viewed_timespent", "sessions_timespent")

_KEYS = (
    ("application_id", S),
    ("global_user_id", S),
    ("created", N),
    ("session_track", S),
    ("itemid", S),
    ("filterid", S),
    ("session_name", S),
)
_METRIC_FIELDS = tuple((m, D if m in DWELL_METRICS else L) for m in METRICS)


def _touch(metric: str, kind: T.DataType, app: str = "application_id", batch: str | None = "batchid") -> T.StructType:
    fields = [
        (app, S),
        ("global_user_id", S),
        ("created", N),
        ("session_track", S),
        (metric, kind),
        ("itemid", L),
        ("filterid", L),
        ("session_name", S),
    ]
    return _struct(*fields, *([(batch, L)] if batch else []))


_PERSON = (
    ("application_id", S),
    ("event_name", S),
    ("startdate", N),
    ("enddate", N),
    ("global_user_id", S),
    ("title", S),
    ("session_track", S),
    ("created", N),
    ("itemid", S),
    ("filterid", S),
    ("session_name", S),
    ("emailaddress", S),
    ("firstname", S),
    ("lastname", S),
    ("company", S),
    ("phone", S),
    ("detailed_title", S),
    ("batchid", L),
)

TABLES: dict[str, T.StructType] = {
    "sessions_bookmarked": _touch("num_bookmarks", L),
    "sessions_viewed": _touch("num_views", L),
    "sessions_viewed_timespent": _touch("timespent", D, batch="batch_id"),
    "sessions_speakers_bookmarked": _touch("num_bookmarks", L),
    "sessions_speakers_viewed": _touch("num_views", L),
    "sessions_speakers_viewed_timespent": _touch("timespent", D),
    "sessions_checkins_status": _touch("num_checkins", L, app="applicationid", batch=None),
    "combine_1": _struct(*_KEYS, *_METRIC_FIELDS[:2]),
    "combine_2": _struct(*_KEYS, *_METRIC_FIELDS[:3]),
    "combine_3": _struct(*_KEYS, *_METRIC_FIELDS[:4]),
    "combine_4": _struct(*_KEYS, *_METRIC_FIELDS[:5]),
    "combine_5": _struct(*_KEYS, *_METRIC_FIELDS[:6]),
    "combine_6": _struct(*_KEYS, *_METRIC_FIELDS),
    "actions_stag": _struct(*_KEYS, *_METRIC_FIELDS, ("batchid", L)),
    "scores": _struct(*_KEYS, *_METRIC_FIELDS, ("batchid", L), ("zscore", D), ("grade_score", S)),
    "leads": _struct(*_PERSON, ("zscore", D), ("grade_score", S)),
    "actions_semantic": _struct(*_KEYS, *_METRIC_FIELDS, ("batchid", L), ("semantic_topic", S), ("tot", L)),
    "scores_semantic": _struct(
        *_KEYS, *_METRIC_FIELDS, ("batchid", L), ("semantic_topic", S), ("tot", L), ("V18", D), ("grade_score", S)
    ),
    "leads_semantic": _struct(*_PERSON, ("semantic_topic", S), ("z_score", D), ("grade_score", S)),
    "topic_validation": _struct(
        ("itemid", L),
        ("num_manual", L),
        ("num_generated", L),
        ("num_manual_matches", L),
        ("num_manual_notmatches", L),
        ("precision", D),
        ("recall", D),
    ),
    "cohorts": _struct(
        ("userid", L),
        ("applicationid", S),
        ("topic_1", S),
        ("topic_2", S),
        ("identification_type", S),
        ("event_name", S),
    ),
    "chat_responses": _struct(("application_id", S), ("body", S)),
    "run_marks": _struct(("source", S), ("mark", L)),
    "score_pairs": _struct(("svd_social", D), ("svd_content", D)),
    "event_config": _struct(
        ("Applicationid", S), ("Event name", S), ("Number of sessions", L), ("Tagger", S), ("userid", L), ("email", S)
    ),
}


class SchemaMismatch(ValueError):
    """A frame lacks a column that its table needs."""


def enforce_schema(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Select the table's columns by name, in order and with its types.

    A missing column fails before any job starts; a value that does not fit its
    type fails when it is written (ANSI cast), so nothing is appended by position.
    """
    schema = TABLES[schema] if isinstance(schema, str) else schema
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns: {', '.join(missing)}")
    return df.selectExpr(*[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in schema])
