"""Stored tables, thresholds and fixed lists."""

from __future__ import annotations

from dataclasses import dataclass

CHECK_IN = "id BIGINT, ts TIMESTAMP, zone_id STRING, day DATE, mood INT, energy INT, note STRING"
CHECK_IN_TAG = "check_in_id BIGINT, tag STRING"
TAG = "name STRING, sort_order INT, enabled BOOLEAN"
DAILY_METRIC = (
    "day DATE, screen_minutes DOUBLE, social_media_minutes DOUBLE, late_night_screen_minutes DOUBLE, unlock_count INT, sleep_minutes DOUBLE, sleep_source STRING, "
    "sleep_start_utc BIGINT, sleep_end_utc BIGINT, steps DOUBLE, exercise_minutes DOUBLE, resting_hr DOUBLE, hrv DOUBLE, updated_at_utc BIGINT"
)
#: Long form of a series: unique on the first three, no row where nothing was observed.
SERIES = "subject_id STRING, metric_key STRING, day DATE, value DOUBLE"

# Metric keys with labels and units, in their order, and the tags of a new store.
METRICS = (
    ("sleep_minutes", "Sleep", "min"),
    ("screen_minutes", "Screen time", "min"),
    ("social_media_minutes", "Social media", "min"),
    ("late_night_screen_minutes", "Late-night screen time", "min"),
    ("unlock_count", "Phone pickups", ""),
    ("steps", "Steps", ""),
    ("exercise_minutes", "Exercise", "min"),
    ("resting_hr", "Resting heart rate", "bpm"),
    ("hrv", "Heart rate variability", "ms"),
)
DEFAULT_TAGS = ("caffeine", "alcohol", "social contact", "stress", "ate well", "outdoors", "exercise", "sick")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


# Gates and levels that results must be computed with.
@dataclass(frozen=True)
class Thresholds:
    """Gates and levels of an analysis."""

    min_days_same_day: int = 14
    min_days_lagged: int = 21
    min_days_sleep_debt: int = 21
    min_days_dow: int = 42
    min_days_tag: int = 14
    min_group: int = 4
    max_lag: int = 3
    familywise_alpha: float = 0.05
    fdr_q: float = 0.10
    display_alpha: float = 0.05
    replicates: int = 1000
    detrend_window: int = 29
    null_samples: int = 300
    exact_null_days: int = 333
    min_effect: float = 0.20
    seed: int = 20260827


THRESHOLDS = Thresholds()


# Defaults of the preferences.
@dataclass(frozen=True)
class Settings:
    """Preferences with their defaults."""

    reminder_enabled: bool = True
    reminder_hour: int = 21
    reminder_minute: int = 0
    midday_reminder_enabled: bool = False
    midday_reminder_hour: int = 13
    late_night_hour: int = 23
