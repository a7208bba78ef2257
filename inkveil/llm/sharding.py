"""Contiguous shards of nearly equal bytes, by global prefix sums. DataFrame functions only.

Rows are range-partitioned by id; a total per partition and the sums of the totals before it give
every row its global byte offset; a row belongs to the shard in whose equal share of all bytes its
middle byte lies. Law `bytes`: a shard's size differs from the share by less than one document.

Defined results: a null text counts as empty (its row is kept, with 16 bytes); null ids come first;
repeated ids and repeated rows each get a place of their own (their order among themselves is
fixed by a stored row number); other columns are ignored, whatever their names; an empty table
gives an empty result; a document larger than a share leaves shards empty.
Equal texts are not kept together: contiguous cuts follow the ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, load, whole


def balanced_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The text never moves: size and checksum are taken at the scan. Only (id, size, checksum) is
    range-partitioned, and it is stored once, since both passes must see the same partitions.
    The tables of totals have one row per partition, and are broadcast: partitions are bounded
    by the number of shuffle partitions."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = scratch.save(rows, "rows")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "doc_id", "tie").withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, "dealt")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("own_bytes"), F.coalesce(F.count("size").over(inside), F.lit(0)).alias("own_n"))
    placed = placed.join(F.broadcast(totals), "part")
    share = F.expr(f"((bytes_before + own_bytes) * 2 + size) * {int(n_shards)} div (all_bytes * 2)")
    placed = placed.select("doc_id", "size", "text_crc32", F.least(share, F.lit(n_shards - 1)).cast("int").alias("shard"), (F.col("n_before") + F.col("own_n")).alias("row"))
    placed = scratch.save(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(load(spark, sf_dir, "documents"), 40)



def shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 without the checksum, which SQL lacks."""
    return op3(spark, sf_dir).select("doc_id", "size", "law", "shard", "slot")


ORACLE_SHARDS = """
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size FROM documents),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d),
p AS (SELECT *, CAST(least(((before * 2 + size) * 40) // (total * 2), 39) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot FROM p
"""
