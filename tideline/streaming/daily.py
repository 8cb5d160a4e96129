"""Daily aggregates over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.sources.store import upsert_latest
from tideline.sources.versions import Manifest, Versions


def daily_means(events: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "7 days") -> DataFrame:
    """Mean per key and UTC day, closed once the watermark has passed the day."""
    day = F.window(ts, "1 day")
    found = events.withWatermark(ts, late).groupBy(*keys, day.alias("w")).agg(F.avg(value).alias("value"))
    return found.select(*keys, F.col("w.start").cast("date").alias("day"), "value")


def latest_rows(source: DataFrame, path: str) -> Versions:
    """The table that ``upserted`` keeps under ``path``, as ``rows``."""
    return Versions(source.sparkSession, path, {"rows": source.schema})


def upserted(source: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key in a versioned table; a batch rewrites only the buckets of keys that it holds.

    The batch's number is swapped in with the table, so a batch that is sent again changes nothing. Folders that the last
    two versions do not name are deleted.
    """
    versions = latest_rows(source, path)
    part = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")

    def merge(batch: DataFrame, number: int) -> None:
        if versions.current().notes.get("batch", -1) >= number:
            return

        def change(base: Manifest) -> tuple[dict, dict]:
            parts = [r[0] for r in batch.select(part).distinct().collect()]  # at most ``buckets`` values
            both = upsert_latest(versions.read("rows", base, parts), batch, keys, order)
            return {"rows": versions.write("rows", both, part, parts)}, {"batch": number}

        versions.save(change)
        versions.vacuum()

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
