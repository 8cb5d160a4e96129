"""The state of a subject's day from three changing tables: check-ins, tags and daily metrics.

Changes of all three come as one stream of (subject_id, source, key, version, ts, day, payload, deleted); each table has
keyed state of its own, and every batch that changes a subject emits its day anew. A change counts if its version is
greater than that of its key, so late, repeated and reordered rows do no harm; a deletion is kept as a version too. The
state of a day goes ``keep_days`` after it ended, by timers on the watermark; what comes later than that is ignored.
Tags belong to no day and stay.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGE = "subject_id STRING, source STRING, key STRING, version BIGINT, ts TIMESTAMP, day DATE, payload STRING, deleted BOOLEAN"
TODAY = "subject_id STRING, day DATE, entries ARRAY<STRING>, tags ARRAY<STRING>, metrics STRING"
SOURCES = ("check_in", "tag", "daily_metric")
_VALUE = "version BIGINT, day DATE, payload STRING, deleted BOOLEAN"


def check_in_changes(rows: DataFrame, version: str) -> DataFrame:
    """Changes from check-ins with subject_id; payloads are JSON."""
    payload = F.to_json(F.struct("id", "mood", "energy", "note"))
    return _changes(rows, "check_in", F.col("id").cast("string"), version, F.col("day"), payload)


def tag_changes(rows: DataFrame, version: str) -> DataFrame:
    """Changes from tags (subject_id, name, sort_order, enabled); a disabled tag is not there. The payload is the order."""
    return _changes(rows.withColumn("deleted", ~F.col("enabled")), "tag", F.col("name"), version, F.lit(None).cast("date"), F.format_string("%010d", F.col("sort_order")))


def metric_changes(rows: DataFrame, version: str) -> DataFrame:
    """Changes from daily metrics with subject_id."""
    values = [c for c in rows.columns if c not in ("subject_id", "day", "ts", "deleted", version)]
    return _changes(rows, "daily_metric", F.col("day").cast("string"), version, F.col("day"), F.to_json(F.struct(*values)))


def _changes(rows: DataFrame, source: str, key, version: str, day, payload) -> DataFrame:  # type: ignore[no-untyped-def]
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(False)
    return rows.select("subject_id", F.lit(source).alias("source"), key.alias("key"), F.col(version).cast("long").alias("version"), "ts", day.alias("day"), payload.alias("payload"), deleted.alias("deleted"))


class _Today(StatefulProcessor):
    def __init__(self, keep_days: int):
        self.keep = dt.timedelta(days=keep_days + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = {s: handle.getMapState(s, "key STRING", _VALUE) for s in SOURCES}

    def _gone(self, day: dt.date) -> int:
        """Milliseconds at which the state of a day goes."""
        return int((dt.datetime.combine(day, dt.time(), dt.UTC) + self.keep).timestamp() * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, days, tagged = timerValues.getCurrentWatermarkInMs(), set(), False
        for batch in rows:
            for r in batch.itertuples(index=False):
                day = None if pd.isna(r.day) else pd.Timestamp(r.day).date()
                if r.source not in self.state or r.key is None or pd.isna(r.version) or (r.source != "tag" and (day is None or self._gone(day) <= now)):
                    continue
                state, own = self.state[r.source], (str(r.key),)
                old = state.getValue(own) if state.containsKey(own) else None
                if old is not None and old[0] >= int(r.version):
                    continue
                state.updateValue(own, (int(r.version), day, None if pd.isna(r.payload) else r.payload, bool(r.deleted)))
                if day is None:
                    tagged = True
                else:
                    days |= {day} | ({old[1]} if old is not None and old[1] is not None else set())
                    self.handle.registerTimer(self._gone(day))
        if days or tagged:
            yield self._states(key[0], days, tagged)

    def _states(self, subject: str, days: set, tagged: bool) -> pd.DataFrame:
        tags = sorted((v[2], k[0]) for k, v in self.state["tag"].iterator() if not v[3])
        check_ins = [(v[1], k[0], v[2]) for k, v in self.state["check_in"].iterator() if not v[3]]
        metrics = {v[1]: v[2] for k, v in self.state["daily_metric"].iterator() if not v[3]}
        if tagged:  # a tag shows on every day that is kept
            days = days | {d for d, _, _ in check_ins} | set(metrics)
        out = [(subject, d, [p for e, _, p in sorted(check_ins) if e == d], [name for _, name in tags], metrics.get(d)) for d in sorted(days)]
        return pd.DataFrame(out, columns=["subject_id", "day", "entries", "tags", "metrics"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for source in ("check_in", "daily_metric"):
            for k in [k for k, v in self.state[source].iterator() if self._gone(v[1]) <= at]:
                self.state[source].removeKey(k)
        yield pd.DataFrame(columns=["subject_id", "day", "entries", "tags", "metrics"])

    def close(self) -> None:
        pass


def today(changes: DataFrame, keep_days: int = 7, late: str = "1 day") -> DataFrame:
    """(subject_id, day, entries, tags, metrics) of every subject and day that a batch changes, for output mode ``update``.

    ``entries`` are check-ins as JSON, ``tags`` the enabled tags in order, ``metrics`` the day's metrics as JSON, null
    without any. Needs RocksDB as the state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = changes.filter("subject_id IS NOT NULL").withWatermark("ts", late).groupBy("subject_id")
    return keyed.transformWithStateInPandas(_Today(keep_days), TODAY, "Update", "EventTime")
