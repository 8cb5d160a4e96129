"""Labels and texts of scales and findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of -3 to +3; the last also covers anything unmatched.
MOOD = ("Very low", "Low", "Slightly low", "Neutral", "Slightly good", "Good", "Very good")
ENERGY = ("Drained", "Tired", "Sluggish", "Neutral", "Alert", "Energised", "Wired")


def _scale(value: Column, labels: tuple[str, ...]) -> Column:
    return F.when(value.between(-3, 2), F.get(F.array(*map(F.lit, labels)), (value + 3).cast("int"))).otherwise(labels[-1])


def mood_label(value: Column) -> Column:
    return _scale(value, MOOD)


def energy_label(value: Column) -> Column:
    return _scale(value, ENERGY)


def clamp_scale(raw: Column) -> Column:
    """Rounded half up, then held to the scale."""
    return F.greatest(F.lit(-3), F.least(F.lit(3), F.floor(raw + 0.5))).cast("int")


def format_minutes(minutes: Column) -> Column:
    total = minutes.cast("int")
    hours, rest = F.floor(total / 60).cast("int"), (total % 60).cast("string")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest, F.lit("m"))).otherwise(F.concat(rest, F.lit("m")))


def signed(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(value.cast("string"))


def two_places(value: Column) -> Column:
    return F.format_string("%.2f", value)


def strength(effect: Column) -> Column:
    size = F.abs(effect)
    return F.when(size < 0.20, F.lit(None)).when(size < 0.35, "weak").when(size < 0.55, "moderate").otherwise("strong")


def direction(effect: Column) -> Column:
    return F.when(effect >= 0, "higher").otherwise("lower")


def rank_score(effect: Column, confidence: Column) -> Column:
    return F.abs(effect) * F.when(confidence == "CLEAR", 1.0).otherwise(0.6)


def lag_phrase(lag: Column) -> Column:
    return F.when(lag == 1, "the day before").otherwise(F.concat(lag.cast("string"), F.lit(" days earlier")))


def pair_of(test_id: Column) -> Column:
    """The id up to its last lag."""
    return F.regexp_replace(test_id, "^(.*):lag.*$", "$1")


def days_remaining(available: Column, required: Column) -> Column:
    return F.greatest(F.lit(0), required - available)


def progress(available: Column, required: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), available / required))


def sentence(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def clean_tag(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def csv_cell(value: Column) -> Column:
    """Quoted only where the cell holds a comma, a quote or a line feed."""
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


# What a report says of its findings, and where there are none.
CONFIDENCE = {"CLEAR": "Well supported", "TENTATIVE": "Worth watching"}
NOTHING = "Nothing stands out yet"


def confidence_label(c: Column) -> Column:
    return F.when(c == "CLEAR", CONFIDENCE["CLEAR"]).when(c == "TENTATIVE", CONFIDENCE["TENTATIVE"])
