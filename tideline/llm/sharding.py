"""Sharding along a Hilbert curve through quantised document metadata.

Each document gets a cell of a grid over (log2 of its size, language, source);
cells are numbered along a Hilbert curve, documents are sorted by that number
and the order is cut into runs of equal row counts (law ``rows``), so that each
shard covers few values of every dimension and readers can skip files by any of
them. Positions come from counts per cell and sub-cell, so no step sorts the
whole table in one task; a cell that holds many rows is cut by a hash of its
ids and texts. ``write_shards`` writes whole documents in that order.

Defined results: a null text has size 1 and the checksum of no bytes; a null
language or source counts as the empty string; rows equal in id and text are
ranked by one task and take neighbouring places in any order; an empty table
gives an empty table; very long texts count by their bytes and are never cut;
further columns are ignored by ``shard`` and written by ``write_shards``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch

DIMENSIONS, BITS = 3, 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Position of a grid point along the Hilbert curve (Skilling's transform)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (v >> b) & 1
    return out


def hilbert_table(dimensions: int = DIMENSIONS, bits: int = BITS) -> list[int]:
    """Curve positions of all grid cells, by the cells' row-major number."""
    mask = (1 << bits) - 1
    return [hilbert_index(tuple((c >> (bits * (dimensions - 1 - k))) & mask for k in range(dimensions)), bits) for c in range(1 << (bits * dimensions))]


def _crc(column: Column) -> Column:
    return F.crc32(column.cast("binary"))


def placed(df: DataFrame, scratch: Scratch, cell: str, spread: str, order: list[str], target: int) -> DataFrame:
    """Adds ``position``, the global rank by (cell, spread, order).

    ``spread`` is a number below 2^32 that cuts large cells into sub-cells of about ``target`` rows.
    The table of cells must be of bounded size; that of sub-cells has at most rows / target more.
    """
    cells = df.groupBy(cell).count().select(F.col(cell).alias("__cell"), F.ceil(F.col("count") / target).cast("long").alias("__subs"))
    cells = scratch.save(cells.coalesce(1), "cells")
    df = df.join(F.broadcast(cells), F.col(cell) == F.col("__cell")).withColumn("__sub", F.shiftright(F.col(spread) * F.col("__subs"), 32))
    sums = df.groupBy("__cell", "__sub").count()
    offsets = sums.select("__cell", "__sub", (F.sum("count").over(Window.orderBy("__cell", "__sub")) - F.col("count")).alias("__offset"))
    offsets = scratch.save(offsets, "offsets").select(F.col("__cell").alias("__c"), F.col("__sub").alias("__s"), "__offset")
    inside = Window.partitionBy("__cell", "__sub").orderBy(spread, *order)
    df = df.withColumn("__rank", F.row_number().over(inside) - 1)
    return df.join(offsets, (F.col("__cell") == F.col("__c")) & (F.col("__sub") == F.col("__s"))).withColumn("position", F.col("__offset") + F.col("__rank")).drop("__cell", "__subs", "__sub", "__c", "__s", "__offset", "__rank")


def shard(docs: DataFrame, shards: int = 8, sub_rows: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve position ``hilbert``.

    ``sub_rows`` is the number of rows that a task ranks together.
    """
    out = _ranked(docs, shards, sub_rows, [])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 8, sub_rows: int = 4096, file_rows: int = 100_000) -> str:
    """Writes the documents, with all their columns, as one folder per shard, in curve order; returns the folders' column.

    A shard is cut into files of about ``file_rows`` neighbours, so that readers skip files by size, language or source.
    """
    folder = "shard"
    while folder in docs.columns:
        folder = "_" + folder
    out = _ranked(docs, shards, sub_rows, [F.struct("*").alias("__row")])
    out = out.repartition("shard", F.expr(f"slot div {file_rows}L")).sortWithinPartitions("shard", "slot")
    out.select("__row.*", F.col("shard").alias(folder)).write.partitionBy(folder).option("maxRecordsPerFile", file_rows).parquet(path)
    return folder


def _ranked(docs: DataFrame, shards: int, sub_rows: int, carried: list[Column]) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and hilbert of every document, and what is carried along."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text) + 1
    log = F.least(F.lit(15), F.floor(F.log2(size.cast("double"))))
    cell = (log * 256 + _crc(F.coalesce("lang", F.lit(""))) % 16 * 16 + _crc(F.coalesce("source", F.lit(""))) % 16).cast("int")
    spread = _crc(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), _crc(text).cast("string")))
    meta = docs.select("doc_id", size.cast("long").alias("size"), _crc(text).alias("text_crc32"), cell.alias("grid"), spread.alias("spread"), *carried)
    curve = spark.createDataFrame(list(enumerate(hilbert_table())), "grid int, hilbert int")  # 4096 rows, fixed
    meta = scratch.save(meta.join(F.broadcast(curve), "grid").drop("grid"), "meta")
    total = meta.count()
    df = placed(meta, scratch, "hilbert", "spread", ["doc_id", "text_crc32", "size"], sub_rows)
    k = F.expr(f"position * {shards} div {max(total, 1)}")
    first = F.expr(f"((position * {shards} div {max(total, 1)}) * {total}L + {shards - 1}) div {shards}")
    return df.select("doc_id", "size", "text_crc32", k.cast("int").alias("shard"), (F.col("position") - first).cast("long").alias("slot"), "hilbert", *(["__row"] if carried else []))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(shards: int = 8) -> str:
    steps = ["p0 AS (SELECT *, CAST(least(15, floor(log2(CAST(size AS DOUBLE)))) AS BIGINT) AS x0, crc_lang % 16 AS x1, crc_source % 16 AS x2 FROM m)"]
    k = 0

    def step(columns: dict[str, str]) -> None:
        nonlocal k
        steps.append(f"p{k + 1} AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in columns.items())}) FROM p{k})")
        k += 1

    for q in (8, 4, 2):
        p = q - 1
        for i in range(3):
            if i == 0:
                step({"x0": f"CASE WHEN x0 & {q} > 0 THEN xor(x0, {p}) ELSE x0 END"})
            else:
                t = f"(xor(x0, x{i}) & {p})"
                step({"x0": f"CASE WHEN x{i} & {q} > 0 THEN xor(x0, {p}) ELSE xor(x0, {t}) END", f"x{i}": f"CASE WHEN x{i} & {q} > 0 THEN x{i} ELSE xor(x{i}, {t}) END"})
    step({"x1": "xor(x1, x0)"})
    step({"x2": "xor(x2, x1)"})
    t = "xor(xor(CASE WHEN x2 & 8 > 0 THEN 7 ELSE 0 END, CASE WHEN x2 & 4 > 0 THEN 3 ELSE 0 END), CASE WHEN x2 & 2 > 0 THEN 1 ELSE 0 END)"
    step({f"x{i}": f"xor(x{i}, {t})" for i in range(3)})
    bits = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(4) for i in range(3))
    crc = crc_sql
    body = ",\n".join(steps)
    return f"""
WITH {crc_table},
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l, coalesce(source, '') AS s, tab FROM documents, crcs),
k AS MATERIALIZED (SELECT *, {crc("t")} AS text_crc32 FROM d),
m AS MATERIALIZED (SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, text_crc32, {crc("l")} AS crc_lang, {crc("s")} AS crc_source,
      {crc("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32)")} AS spread FROM k),
{body},
h AS (SELECT *, CAST({bits} AS INTEGER) AS hilbert FROM p{k}),
r AS (SELECT *, row_number() OVER (ORDER BY hilbert, spread, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM h),
c AS (SELECT *, CAST(pos * {shards} // n AS INTEGER) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, hilbert FROM c"""


#: CRC-32 in SQL: the table of one byte's steps, then a fold over the bytes.
crc_table = """bits AS (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(b)),
crcs AS MATERIALIZED (SELECT list(v ORDER BY b) AS tab FROM bits)"""


def crc_sql(text: str) -> str:
    data = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
ORACLE_SQL = _sql()
