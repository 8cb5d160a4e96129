"""Raw usage events and the days made of them: only what a batch touches is computed, and raw days go once they are covered."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions.dates import local_day
from tideline.operators import usage
from tideline.sources.cache import fingerprint
from tideline.sources.versions import Manifest, Versions

DAILY_USAGE = "subject_id STRING, day DATE, screen_minutes DOUBLE, social_media_minutes DOUBLE, late_night_screen_minutes DOUBLE, unlock_count INT"
#: A local day lies within these many UTC days before and after its own name, what its intervals look at included.
BEFORE, AFTER = 1, 2


class PurgeRefused(RuntimeError):
    """Raw days whose events the daily table does not cover, or that new batches may still touch."""


def _shifted(day: str, by: int) -> str:
    return (dt.date.fromisoformat(day) + dt.timedelta(days=by)).isoformat()


class UsageStore:
    """usage_event in parts of a UTC day, daily_usage in parts of a local day, both named by one manifest.

    Usage events come late, and an end may come days after its open; so each batch names the local days that it can
    change, those within ``longest_hours`` of its events, and only these are computed, from the raw days about them, and
    replaced. Files of all other days stay as they are. Repeated events (subject, id) are kept once.

    Notes of the manifest: ``covered``, for each raw day the fingerprint of the events that the daily table was made of;
    ``pending``, local days to be computed; ``purged``, raw days that are gone; ``refused``, the number of events that came
    too late for these; ``batch``, the last batch of a stream. Each has an entry a day at most.
    """

    def __init__(self, spark: SparkSession, root: str, social: DataFrame, late_hour: int = 23, longest_hours: float = 4):
        self.spark, self.social, self.late_hour, self.longest = spark, social, late_hour, longest_hours
        self.versions = Versions(spark, root, {"usage_event": usage.USAGE_EVENT, "daily_usage": DAILY_USAGE})

    def events(self, manifest: Manifest | None = None, days: Iterable[str] | None = None) -> DataFrame:
        return self.versions.read("usage_event", manifest, days)

    def daily(self, manifest: Manifest | None = None) -> DataFrame:
        return self.versions.read("daily_usage", manifest)

    def append(self, batch: DataFrame) -> Manifest:
        """Stores events; the days that they touch are left to ``aggregate``."""
        return self.versions.save(lambda base: self._appended(base, batch))

    def aggregate(self) -> Manifest:
        """Computes the days that are pending."""
        return self.versions.save(self._aggregated)

    def ingest(self, batch: DataFrame, number: int | None = None) -> Manifest:
        """Stores events and computes the days that they touch, in one version. A batch whose number was seen does nothing."""
        base = self.versions.current()
        if number is not None and base.notes.get("batch", -1) >= number:
            return base

        def change(base: Manifest) -> tuple[dict, dict]:
            raw, notes = self._appended(base, batch)
            merged = Manifest(base.version, {t: dict(p) for t, p in base.tables.items()}, {**base.notes, **notes})
            merged.tables["usage_event"] = {**merged.tables.get("usage_event", {}), **{k: f for k, f in raw["usage_event"].items() if f}}
            daily, more = self._aggregated(merged)
            return {**raw, **daily}, {**notes, **more, **({} if number is None else {"batch": number})}

        return self.versions.save(change)

    def purge(self, before: str, keep_days: int = 7) -> Manifest:
        """Drops raw days before a date. Refused, with nothing dropped, if one of them holds events that the daily table
        does not cover, or if it is among the last ``keep_days`` (3 at least) before the newest raw day."""

        def change(base: Manifest) -> tuple[dict, dict]:
            raw = base.tables.get("usage_event", {})
            gone = sorted(d for d in raw if d < before)
            newest = max(raw, default=before)
            early = [d for d in gone if d > _shifted(newest, -max(3, keep_days))]
            have, covered = self._prints(base, gone), base.notes.get("covered", {})
            open_ = {d for p in base.notes.get("pending", []) for d in self._around(p)}
            bare = [d for d in gone if have.get(d) != covered.get(d) or d in open_]
            if early or bare:
                raise PurgeRefused(f"not covered: {bare}; too new: {early}")
            return {"usage_event": dict.fromkeys(gone)}, {"covered": {d: p for d, p in covered.items() if d not in gone}, "purged": sorted({*base.notes.get("purged", []), *gone})}

        return self.versions.save(change)

    @staticmethod
    def _around(day: str) -> list[str]:
        return [_shifted(day, k) for k in range(-BEFORE, AFTER + 1)]

    def _prints(self, manifest: Manifest, days: Iterable[str]) -> dict[str, str]:
        rows = self.events(manifest, days).withColumn("date", F.col("ts").cast("date").cast("string"))
        return {r["date"]: r["print"] for r in fingerprint(rows, ["date"]).collect()}  # a row a day

    def _appended(self, base: Manifest, batch: DataFrame) -> tuple[dict, dict]:
        dated = batch.filter("subject_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL").withColumn("date", F.col("ts").cast("date").cast("string"))
        reach = F.make_dt_interval(secs=F.lit(self.longest * 3600.0))
        first, last = (local_day(c, F.col("zone_id")) for c in (F.col("ts") - reach, F.col("ts") + reach))
        found = dated.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set(F.sequence(first, last)))).alias("days")).collect()  # a row a day
        purged = set(base.notes.get("purged", []))
        late = [r["date"] for r in found if r["date"] in purged]
        dates = sorted(r["date"] for r in found if r["date"] not in purged)
        touched = {d.isoformat() for r in found if r["date"] not in purged for d in r["days"]}
        touched = {d for d in touched if not purged.intersection(self._around(d))}
        fresh = dated.filter(F.col("date").isin(dates)) if dates else dated.limit(0)
        both = self.events(base, dates).unionByName(fresh.select(*self.events(base, []).columns)).dropDuplicates(["subject_id", "event_id"])
        written = self.versions.write("usage_event", both, F.col("ts").cast("date"), dates)
        notes = {"pending": sorted({*base.notes.get("pending", []), *touched}), "refused": base.notes.get("refused", 0) + sum(r["n"] for r in found if r["date"] in late)}
        return {"usage_event": written}, notes

    def _aggregated(self, base: Manifest) -> tuple[dict, dict]:
        pending = base.notes.get("pending", [])
        around = sorted({d for p in pending for d in self._around(p)})
        raw = self.events(base, around)
        found = usage.daily_usage(raw, self.social, self.late_hour, self.longest).filter(F.col("day").cast("string").isin(pending)) if pending else self.daily(base).limit(0)
        written = self.versions.write("daily_usage", found, F.col("day"), pending)
        # Days that a batch touched are computed with all events stored by now, so these are what is covered.
        return {"daily_usage": written}, {"pending": [], "covered": {**base.notes.get("covered", {}), **self._prints(base, around)}}


def stream_usage(source: DataFrame, store: UsageStore, checkpoint: str) -> StreamingQuery:
    """Feeds a stream of usage events into the store; a batch that is sent again after a failure changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        store.ingest(batch, number)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
