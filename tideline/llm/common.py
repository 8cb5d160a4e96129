"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.sources.scratch import shared_dir

#: Row groups of at most about 32 MB, and pages of one value if it is large: Parquet's writer looks at sizes after 100 rows
#: only, and what reads a page or a row group holds it whole, so rows of megabytes would make both of hundreds of megabytes.
PARQUET = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

#: White space between words: space and the ASCII controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z in lower case; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation of them.

    Tables that a lazy result still reads stay until the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").options(**PARQUET).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps now instead of at the next JVM collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts at a time become Python objects."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def map_rows(df: DataFrame, schema: str, work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` over dictionaries of column lists. ``work`` yields dictionaries of lists or Arrow arrays."""
    target = spark_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in slices(batches)):
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def spark_arrow(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int, modulus: int, left_out: int) -> DataFrame:
    """(text, y) of at most ``sample`` labelled rows for each label value, by a hash of the id.

    The ids are a bounded number of longs, so their join is a broadcast of proven size.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulus) != left_out)).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(20))
    ids = None
    for value in (0, 1):
        part = known.filter(F.col("y") == value).orderBy(order, "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
