"""Phone usage: events to foreground intervals, intervals to minutes of a day, silent nights to sleep.

An event is (subject_id, zone_id, ts, event_id, app, kind): ``open`` and ``close`` of an app, ``unlock``, and ``off``
when the screen goes dark. Only one app is in front at a time, so an interval runs from an open to the first later
event of the subject that is a close of that app, any open, or off. Where none comes within ``longest``, the closing
event is taken for lost and the interval lasts ``longest``. A close without an open has no effect.

Nothing looks further ahead than ``longest``, so a subject's events are cut into chunks of a day, each with a copy of
the next chunk's first ``longest``; a subject with very many events is spread over as many tasks as it has days.

Events without subject, time or kind are ignored. Times are instants; days change at 04:00 by ``dates.local_day``, and
what a change of clocks adds or takes counts as it was lived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import day_start, local_day, wall_clock

USAGE_EVENT = "subject_id STRING, zone_id STRING, ts TIMESTAMP, event_id BIGINT, app STRING, kind STRING"
MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def _micros(c: Column | str) -> Column:
    return F.unix_micros(c)


def foreground(events: DataFrame, longest_hours: float = 4) -> DataFrame:
    """(subject_id, zone_id, app, start, end, lost): what was in front, and whether its end had to be assumed."""
    longest = int(longest_hours * HOUR)
    chunk_of = max(DAY, longest)
    at = _micros("ts")
    own = F.floor(at / chunk_of)
    seen = events.filter("subject_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL").withColumn("own", own)
    copies = F.when(at - F.col("own") * chunk_of <= longest, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))
    seen = seen.withColumn("chunk", F.explode(copies))
    # From the last event to the first, so that what follows is what a running frame has seen.
    backwards = Window.partitionBy("subject_id", "chunk").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    same_app = Window.partitionBy("subject_id", "chunk", "app").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    other = F.last(F.when(kind.isin("open", "off"), F.col("ts")), ignorenulls=True).over(backwards)
    close = F.last(F.when(kind == "close", F.col("ts")), ignorenulls=True).over(same_app)
    opened = seen.withColumns({"other": other, "close": close}).filter((kind == "open") & (F.col("chunk") == F.col("own")))
    found = opened.withColumn("end", F.least("other", "close"))
    lost = F.col("end").isNull() | (_micros("end") - _micros("ts") > longest)
    capped = F.timestamp_micros(_micros("ts") + longest)
    return found.withColumn("lost", lost).select("subject_id", "zone_id", "app", F.col("ts").alias("start"), F.when(F.col("lost"), capped).otherwise(F.col("end")).alias("end"), "lost")


def split_days(intervals: DataFrame, late_hour: int = 23) -> DataFrame:
    """(subject_id, app, day, micros, late_micros): intervals cut at each day's change; late is from ``late_hour`` to the day's end.

    Lengths are whole microseconds, so sums are exact. An hour up to 4 is one after midnight. Intervals without length have no row.
    """
    last = F.timestamp_micros(_micros("end") - 1)
    days = F.sequence(local_day(F.col("start"), F.col("zone_id")), local_day(last, F.col("zone_id")))
    cut = intervals.filter(F.col("start") < F.col("end")).withColumn("day", F.explode(days))
    zone, following = F.col("zone_id"), F.date_add("day", 1)
    cut = cut.withColumns({"begun": F.greatest("start", day_start(F.col("day"), zone)), "done": F.least("end", day_start(following, zone))})
    late = wall_clock(following if late_hour <= 4 else F.col("day"), late_hour, zone)
    after = F.greatest(F.lit(0), _micros("done") - _micros(F.greatest(F.col("begun"), late)))
    return cut.select("subject_id", "app", "day", (_micros("done") - _micros("begun")).alias("micros"), after.alias("late_micros"))


def daily_usage(events: DataFrame, social: DataFrame, late_hour: int = 23, longest_hours: float = 4) -> DataFrame:
    """(subject_id, day, screen_minutes, social_media_minutes, late_night_screen_minutes, unlock_count).

    ``social``: (subject_id, app) of the apps that each subject counts as social media. A day with any event has a row,
    with zeros where nothing was in front; a day without events has none. Unlocks at one instant are one.
    """
    chosen = social.select("subject_id", "app", F.lit(True).alias("chosen")).distinct()
    pieces = split_days(foreground(events, longest_hours), late_hour).join(chosen, ["subject_id", "app"], "left")
    none = F.lit(None).cast("timestamp")
    used = pieces.select("subject_id", "day", "micros", F.when(F.col("chosen"), F.col("micros")).otherwise(0).alias("social"), "late_micros", none.alias("unlocked"))
    seen = events.filter("subject_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL")
    zero = F.lit(0).cast("long")
    seen = seen.select("subject_id", local_day(F.col("ts"), F.col("zone_id")).alias("day"), zero.alias("micros"), zero.alias("social"), zero.alias("late_micros"), F.when(F.col("kind") == "unlock", F.col("ts")).alias("unlocked"))
    # Unlocks are told apart before the sums, so that the count needs no second shuffle of rows.
    both = used.unionByName(seen).groupBy("subject_id", "day", "unlocked").agg(*[F.sum(c).alias(c) for c in ("micros", "social", "late_micros")])
    named = {"micros": "screen_minutes", "social": "social_media_minutes", "late_micros": "late_night_screen_minutes"}
    return both.groupBy("subject_id", "day").agg(*[(F.sum(c) / MINUTE).alias(n) for c, n in named.items()], F.count("unlocked").cast("int").alias("unlock_count"))


def touches(events: DataFrame, longest_hours: float = 4) -> DataFrame:
    """(subject_id, zone_id, start, end): intervals in front, and every event as a moment."""
    seen = events.filter("subject_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL")
    moments = seen.select("subject_id", "zone_id", F.col("ts").alias("start"), F.col("ts").alias("end"))
    return foreground(events, longest_hours).select("subject_id", "zone_id", "start", "end").unionByName(moments)


def sleep_proxy(used: DataFrame, evening: int = 21, morning: int = 10) -> DataFrame:
    """(subject_id, day, sleep_start, sleep_end, sleep_minutes, sleep_source): the longest silence of each night.

    ``used``: (subject_id, zone_id, start, end), in any order and overlap. A night runs from ``evening`` to ``morning`` of
    the day that it is named by; what is used is clipped to it and merged, and the edges of the night bound a silence. Of
    equally long ones the first counts. A night without any use has no row: nothing tells sleep from a phone left behind.
    A night seen from two zones runs from the earlier evening to the later morning.
    """
    zone = F.col("zone_id")
    first, last = (F.from_utc_timestamp(c, zone).cast("date") for c in ("start", "end"))
    nights = used.withColumn("day", F.explode(F.sequence(first, F.date_add(last, 1))))
    nights = nights.withColumns({"dusk": wall_clock(F.date_sub("day", 1), evening, zone), "dawn": wall_clock(F.col("day"), morning, zone)})
    inside = (F.col("start") < F.col("dawn")) & ((F.col("end") > F.col("dusk")) | ((F.col("start") == F.col("end")) & (F.col("start") >= F.col("dusk"))))
    nights = nights.filter(inside).select("subject_id", "day", "dusk", "dawn", F.greatest("start", "dusk").alias("s"), F.least("end", "dawn").alias("e"))
    before = Window.partitionBy("subject_id", "day").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("subject_id", "day")
    nights = nights.withColumns({"since": F.coalesce(F.max("e").over(before), F.min("dusk").over(whole)), "dawn": F.max("dawn").over(whole)})
    silence = lambda since, until: F.struct((_micros(until) - _micros(since)).alias("length"), (-_micros(since)).alias("first"))
    longest = nights.groupBy("subject_id", "day").agg(F.max(silence(F.col("since"), F.col("s"))).alias("a"), F.max("e").alias("e"), F.max("dawn").alias("dawn"))
    found = longest.withColumn("best", F.greatest(F.col("a"), silence(F.col("e"), F.col("dawn"))))
    start = -F.col("best.first")
    out = found.select("subject_id", "day", F.timestamp_micros(start).alias("sleep_start"), F.timestamp_micros(start + F.col("best.length")).alias("sleep_end"), (F.col("best.length") / MINUTE).alias("sleep_minutes"))
    return out.withColumn("sleep_source", F.lit("proxy"))


#: Sources of sleep, the most trusted first.
SOURCES = ("manual", "wearable", "proxy")


def sleep_by_source(claims: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(subject_id, day, sleep_start, sleep_end, sleep_minutes, sleep_source) of the claims of several sources.

    ``claims``: (subject_id, zone_id, start, end, source, asleep). A night is named by the local day on which an asleep
    claim ends, and only the most trusted source with one decides on it. Awake claims, of that source or of a more
    trusted one, then cut their own spans out of it, over the edges of days and clock changes. Claims of one source may
    overlap and repeat: they count as their union. A night of which nothing remains has a row with zero minutes and no
    times. Claims without length, of other sources or with nulls are ignored.
    """
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    good = claims.filter("subject_id IS NOT NULL AND start < end AND asleep IS NOT NULL").withColumn("rank", order).filter("rank > 0")
    zone = F.col("zone_id")
    ends = F.from_utc_timestamp(F.col("end"), zone).cast("date")
    night = Window.partitionBy("subject_id", "day")
    asleep = good.filter("asleep").withColumn("day", ends).withColumn("best", F.min("rank").over(night)).filter("rank = best")
    # An awake claim can cut into the nights of its own days and of the next.
    awake = good.filter("NOT asleep").withColumn("day", F.explode(F.sequence(F.from_utc_timestamp("start", zone).cast("date"), F.date_add(ends, 1))))
    both = asleep.select("subject_id", "day", "rank", "start", "end", F.lit(1).alias("sleep")).unionByName(awake.select("subject_id", "day", "rank", "start", "end", F.lit(0).alias("sleep")))
    both = both.withColumn("best", F.min(F.when(F.col("sleep") == 1, F.col("rank"))).over(night)).filter("best IS NOT NULL AND rank <= best")
    edge = lambda at, by: F.struct(_micros(at).alias("at"), (F.col("sleep") * by).alias("sleep"), ((1 - F.col("sleep")) * by).alias("awake"))
    edges = both.select("subject_id", "day", "best", F.inline(F.array(edge("start", 1), edge("end", -1))))
    edges = edges.groupBy("subject_id", "day", "best", "at").agg(F.sum("sleep").alias("sleep"), F.sum("awake").alias("awake"))
    running = night.orderBy("at")
    parts = edges.withColumns({"sleep": F.sum("sleep").over(running), "awake": F.sum("awake").over(running), "next": F.lead("at").over(running)})
    kept = (F.col("sleep") > 0) & (F.col("awake") == 0) & F.col("next").isNotNull()
    out = parts.groupBy("subject_id", "day", "best").agg(F.min(F.when(kept, F.col("at"))).alias("s"), F.max(F.when(kept, F.col("next"))).alias("e"), F.coalesce(F.sum(F.when(kept, F.col("next") - F.col("at"))), F.lit(0)).alias("n"))
    source = F.get(F.array(*map(F.lit, sources)), (F.col("best") - 1).cast("int"))
    return out.select("subject_id", "day", F.timestamp_micros("s").alias("sleep_start"), F.timestamp_micros("e").alias("sleep_end"), (F.col("n") / MINUTE).alias("sleep_minutes"), source.alias("sleep_source"))
