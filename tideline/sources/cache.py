"""Results kept per subject, computed anew only where the subject's input changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.versions import Manifest, Versions


def fingerprint(rows: DataFrame, keys: list[str], name: str = "print") -> DataFrame:
    """(keys, print) of each group's rows, whatever their order and partitions: their number, and sums of two hashes.

    Sums, unlike differences, also tell how often a row occurs; both are combined before the shuffle.
    """
    columns = sorted(c for c in rows.columns if c not in keys)
    part = lambda seed: F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*keys).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(2)).alias(name))


class ResultCache:
    """``compute(inputs)`` for a growing set of subjects.

    ``compute`` takes and returns tables that have ``subject_id`` and treats every subject by itself. ``settings``
    is part of each fingerprint, so other thresholds make everything new. Each run writes the results of new and changed
    subjects only, in a part of their own; one row a subject tells which part holds its results. Results of subjects that
    are no longer in the input are not returned. ``compact`` rewrites all results as one part.
    """

    def __init__(self, spark: SparkSession, root: str, result_schema: str, compute: Callable[[dict[str, DataFrame]], DataFrame], settings: str = ""):
        self.compute, self.settings = compute, settings
        self.versions = Versions(spark, root, {"results": result_schema, "prints": "subject_id STRING, print STRING, part STRING"})

    def prints(self, inputs: dict[str, DataFrame]) -> DataFrame:
        """(subject_id, print) over all input tables."""
        each = None
        for name in sorted(inputs):
            own = fingerprint(inputs[name].filter("subject_id IS NOT NULL"), ["subject_id"]).withColumn("print", F.concat(F.lit(f"{name}="), "print"))
            each = own if each is None else each.unionByName(own)
        joined = F.concat_ws("|", F.lit(self.settings), F.array_join(F.array_sort(F.collect_list("print")), "|"))
        return each.groupBy("subject_id").agg(F.sha2(joined, 256).alias("print"))

    def results(self, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.versions.current()
        parts = sorted(manifest.tables.get("results", {}))
        out = None
        for p in parts:
            one = self.versions.read("results", manifest, [p]).withColumn("__part", F.lit(p))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.versions.read("results", manifest)
        known = self.versions.read("prints", manifest).select(F.col("subject_id").alias("__s"), F.col("part").alias("__p"))
        return out.join(known, (F.col("subject_id") == F.col("__s")) & (F.col("__part") == F.col("__p")), "left_semi").drop("__part")

    def refresh(self, inputs: dict[str, DataFrame]) -> int:
        """Brings the results up to date; returns how many subjects were computed."""
        done = 0

        def change(base: Manifest) -> tuple[dict, dict]:
            nonlocal done
            part = f"v{base.version + 1}"
            kept = self.versions.read("prints", base).withColumnRenamed("print", "old")
            own = self.prints(inputs).join(kept, "subject_id", "left")
            marked = own.select("subject_id", "print", F.when(F.col("print") == F.col("old"), F.col("part")).otherwise(F.lit(part)).alias("part"))
            prints = self.versions.write("prints", marked, F.lit("all"), ["all"])
            # What was written says which subjects are new; nothing is hashed twice.
            now = self.versions.read("prints", Manifest(tables={"prints": {p: f for p, f in prints.items() if f}}))
            fresh = now.filter(F.col("part") == part).select("subject_id")
            done = fresh.count()
            results: dict[str, str | None] = {}
            if done:
                computed = self.compute({name: df.join(fresh, "subject_id", "left_semi") for name, df in inputs.items()})
                results = self.versions.write("results", computed, F.lit(part), [part])
            used = {r[0] for r in now.select("part").distinct().collect()}  # one value a run
            results |= {p: None for p in base.tables.get("results", {}) if p not in used}
            return {"prints": prints, "results": results}, {}

        self.versions.save(change)
        return done

    def compact(self) -> Manifest:
        """All results in one part."""

        def change(base: Manifest) -> tuple[dict, dict]:
            part = f"v{base.version + 1}"
            results = self.versions.write("results", self.results(base), F.lit(part), [part]) | dict.fromkeys(base.tables.get("results", {}))
            prints = self.versions.write("prints", self.versions.read("prints", base).withColumn("part", F.lit(part)), F.lit("all"), ["all"])
            return {"prints": prints, "results": results}, {}

        return self.versions.save(change)
