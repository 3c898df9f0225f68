"""Contiguous shards of equal bytes, from a global prefix sum of sizes.

Rows are ordered by key and dealt by range into partitions of their own; each partition's total
gives its offset among all bytes, a window within it the rest. The byte line is cut at equal
targets: a row belongs to the shard in which its middle lies, so shards are contiguous in key
order and a shard misses its target by no more than one row. Only (key, size, digest, number) is
sorted, never a text, and only one total for each partition is summed on its own.

Ties: equal keys, and rows without a key (which come first), are ordered by the number that they
got when they were read, so a hot key is cut like any other stretch. The digest is written once
before it is dealt out and once with its partition, so that no lost executor can renumber it.

Defined cases: a null text has 0 bytes and the overhead alone; repeated rows are rows of their
own; an empty table gives no rows; further columns are ignored, or carried if named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def shard(docs: DataFrame, shards: int, *, key: str = "doc_id", overhead: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, size, carried columns, shard and slot (from 0 in each shard, in key order)."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + F.lit(overhead).cast("long")
    rows = materialize(docs.select(F.col(key).alias("__key"), size.alias("__size"), F.monotonically_increasing_id().alias("__id"), *carry), "sizes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.col("__key").asc_nulls_first(), F.col("__id")).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    totals = dealt.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__rows"))
    line = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(line), F.lit(0)).alias("__byte0"),
        F.coalesce(F.sum("__rows").over(line), F.lit(0)).alias("__row0"),
        F.sum("__bytes").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"),
    )
    inner = Window.partitionBy("__part").orderBy(F.col("__key").asc_nulls_first(), "__id").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("__end", F.sum("__size").over(inner)).withColumn("__n", F.row_number().over(inner))
    placed = placed.join(F.broadcast(offsets), "__part")  # a row for each partition
    placed = placed.withColumn("__shard", F.least(F.expr(f"({shards} * (2 * (__byte0 + __end) - __size)) div (2 * __all)"), F.lit(shards - 1).cast("long")).cast("int")).withColumn("__row", F.col("__row0") + F.col("__n") - 1)
    first = placed.groupBy("__shard").agg(F.min("__row").alias("__first"))
    out = placed.join(F.broadcast(first), "__shard")  # a row for each shard
    return out.select(F.col("__key").alias(key), F.col("__size").alias("size"), *carry, F.col("__shard").alias("shard"), (F.col("__row") - F.col("__first")).alias("slot"))


def oracle(shards: int, overhead: int = 16) -> str:
    """DuckDB SQL for the shards of ``documents`` in doc_id order; the text's CRC-32 by a table of its 256 steps."""
    return f"""
WITH RECURSIVE steps(b, k, v) AS (SELECT b, 0, b FROM range(256) x(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
s AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + {overhead} AS BIGINT) AS size, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS hi, sum(size) OVER () AS total FROM s),
d AS (SELECT *, CAST(least(({shards} * (2 * CAST(hi AS BIGINT) - size)) // (2 * CAST(total AS BIGINT)), {shards - 1}) AS INTEGER) AS shard FROM p),
h AS (SELECT *, hex(encode(text)) AS x FROM d)
SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(strlen(x) AS BIGINT), 2), lambda i: CAST(('0x' || substr(x, i, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM h, crc"""
