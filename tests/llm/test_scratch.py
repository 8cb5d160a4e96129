"""Tables that steps write for one another."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tideline.llm.common import Scratch


def test_rows_of_megabytes_share_no_row_group_of_a_whole_file(spark):
    """Parquet's writer looks at sizes after 100 rows at first, so 40 rows of 2 MB made one row group of 80 MB with one page."""
    scratch = Scratch(spark, "row-groups")
    rows = spark.range(0, 40, 1, 1).select("id", F.expr("array_join(transform(sequence(1, 32000), k -> sha2(concat(id, '-', k), 256)), '')").alias("text"))
    saved = scratch.save(rows, "large")
    (file,) = [p for p in saved.inputFiles()]
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 64 << 20
    assert saved.count() == 40 and saved.select(F.min(F.length("text")), F.max(F.length("text"))).first() == (2_048_000, 2_048_000)
    scratch.clear()
