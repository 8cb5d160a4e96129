"""As-of joins, and the phase of a cycle on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], bucket: Column | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its time, null where there is none.

    Both sides go through one union and one sort per key, and the last value seen is carried on: no range join, and work
    in proportion to the rows. Of right rows at one time the greatest ``columns`` count. Rows without a key or time find
    nothing and are kept; right rows without are ignored. ``columns`` replace those of the same name on the left.

    ``bucket``, an expression over the column ``__time`` that grows with it (say, its month), splits the rows of a key:
    each (key, bucket) is sorted by itself, and what earlier buckets leave behind comes from one row of each.
    """
    time = left.schema[left_time].dataType
    kept = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("__row"), *[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col(left_time).alias("__time"))
    names = [f"__k{j}" for j in range(len(keys))]
    found = right.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col(right_time).cast(time).alias("__time"), F.struct(*columns).alias("__found"))
    found = found.filter(" AND ".join(f"{n} IS NOT NULL" for n in [*names, "__time"]))
    blank = kept.select("__row", *names, "__time", F.lit(None).cast(found.schema["__found"].dataType).alias("__found"), F.lit(1).alias("__side"))
    both = blank.unionByName(found.withColumns({"__row": F.lit(None).cast(kept.schema["__row"].dataType), "__side": F.lit(0)}))
    order = ["__time", "__side", "__found"]
    if bucket is None:
        seen = F.last("__found", ignorenulls=True).over(Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        out = both.withColumn("__seen", seen).filter("__side = 1")
    else:
        both = both.withColumn("__bucket", bucket)
        w = Window.partitionBy(*names, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        own = both.withColumn("__seen", F.last("__found", ignorenulls=True).over(w)).filter("__side = 1")
        last = both.groupBy(*names, "__bucket").agg(F.max(F.when(F.col("__side") == 0, F.struct("__time", "__found"))).alias("__last"))
        carried = F.last("__last", ignorenulls=True).over(Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
        left_behind = last.select(*[F.col(n).alias(f"{n}b") for n in names], F.col("__bucket").alias("__b"), carried.alias("__carried")).filter("__carried IS NOT NULL")
        same = [F.col(n) == F.col(f"{n}b") for n in names]
        out = own.join(left_behind, [*same, F.col("__bucket") == F.col("__b")], "left").withColumn("__seen", F.coalesce("__seen", "__carried.__found"))
    known = F.lit(True)
    for n in [*names, "__time"]:
        known = known & F.col(n).isNotNull()
    here = [c for c in left.columns if c not in columns]
    return out.select(*[F.col("__row").getField(c).alias(c) for c in here], *[F.when(known, F.col("__seen").getField(c)).alias(c) for c in columns])


#: Days of bleeding, days from ovulation to the next start, days about ovulation, length where none is known, longest cycle.
BLEEDING, LUTEAL, ABOUT, USUAL, LONGEST = 5, 14, 2, 28, 60


def cycle_lengths(starts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(subject_id, start, usual): each different start, with the subject's usual length as known then.

    The usual length is the median of the earlier cycles that lasted ``longest`` days at most, ``USUAL`` before any ended.
    """
    once = starts.filter("subject_id IS NOT NULL AND start IS NOT NULL").select("subject_id", "start").distinct()
    w = Window.partitionBy("subject_id").orderBy("start")
    days = F.datediff("start", F.lag("start").over(w))
    once = once.withColumn("days", F.when(days <= longest, days))
    return once.withColumn("usual", F.coalesce(F.percentile("days", 0.5).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(float(USUAL)))).drop("days")


def cycle_phase(days: DataFrame, starts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``days`` (subject_id, day, ...) with cycle_day from 1, the usual length, and phase.

    A start on the day itself is day 1; several on one day are one. Days before the first start, and more than
    ``longest`` days after the last, when a start was probably not logged, have no phase. Phases: menstrual for ``BLEEDING``
    days, ovulatory within ``ABOUT`` days of ``LUTEAL`` days before the usual end, luteal after, follicular between.
    """
    found = asof_join(days, cycle_lengths(starts, longest), ["subject_id"], "day", "start", ["start", "usual"])
    found = found.withColumn("cycle_day", (F.datediff("day", "start") + 1).cast("int"))
    found = found.withColumns({"cycle_day": F.when(F.col("cycle_day") <= longest, F.col("cycle_day")), "usual": F.when(F.col("cycle_day") <= longest, F.col("usual"))})
    n, ovulation = F.col("cycle_day"), F.col("usual") - LUTEAL
    phase = F.when(n <= BLEEDING, "menstrual").when(F.abs(n - ovulation) <= ABOUT, "ovulatory").when(n > ovulation, "luteal").when(n.isNotNull(), "follicular")
    return found.withColumn("phase", phase).drop("start")
