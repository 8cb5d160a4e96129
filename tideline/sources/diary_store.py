"""A diary on disk: check-ins with their tags, saved together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.schema import CHECK_IN, CHECK_IN_TAG
from tideline.sources import store
from tideline.sources.versions import Manifest, Versions


class DiaryStore:
    """check_in and check_in_tag in buckets of ids; a save rewrites the buckets it touches, of both tables, in one version.

    ``buckets`` is fixed for a store: the parts of a manifest, some thousands at most.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.versions = Versions(spark, root, {"check_in": CHECK_IN, "check_in_tag": CHECK_IN_TAG})
        found = self.versions.current().notes.get("buckets", buckets)
        self.buckets = int(found)

    def bucket(self, id_: str) -> Column:
        return F.pmod(F.xxhash64(F.col(id_).cast("long")), F.lit(self.buckets)).cast("string")

    def check_ins(self, manifest: Manifest | None = None) -> DataFrame:
        return self.versions.read("check_in", manifest)

    def tags(self, manifest: Manifest | None = None) -> DataFrame:
        return self.versions.read("check_in_tag", manifest)

    def _touched(self, ids: DataFrame) -> list[str]:
        return [r[0] for r in ids.select(self.bucket("id")).distinct().collect()]  # at most ``buckets`` values

    def save(self, changes: DataFrame, tags: DataFrame) -> Manifest:
        """Inserts or updates check-ins (id, ts, zone_id, mood, energy, note) and makes ``tags`` (check_in_id, tag) theirs.

        Both tables change in one version. Tags of check-ins that are not among ``changes`` are ignored.
        """
        own = tags.join(changes.select(F.col("id").alias("check_in_id")), "check_in_id", "left_semi")

        def change(base: Manifest) -> tuple[dict, dict]:
            parts = self._touched(changes)
            saved = store.save_check_ins(self.versions.read("check_in", base, parts), changes)
            tagged = store.replace_tags(self.versions.read("check_in_tag", base, parts), own, changes)
            return self._written(saved, tagged, parts)

        return self.versions.save(change)

    def delete(self, ids: DataFrame) -> Manifest:
        """Deletes check-ins and their tags, in one version."""

        def change(base: Manifest) -> tuple[dict, dict]:
            parts = self._touched(ids)
            return self._written(*store.delete_check_ins(self.versions.read("check_in", base, parts), self.versions.read("check_in_tag", base, parts), ids), parts)

        return self.versions.save(change)

    def _written(self, check_ins: DataFrame, tags: DataFrame, parts: list[str]) -> tuple[dict, dict]:
        changed = {"check_in": self.versions.write("check_in", check_ins, self.bucket("id"), parts), "check_in_tag": self.versions.write("check_in_tag", tags, self.bucket("check_in_id"), parts)}
        return changed, {"buckets": self.buckets}
