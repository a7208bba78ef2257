"""Joins whose keys may be null, and running numbers within groups that no single task sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators.store import stored


def join_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on keys, null keys being equal; the columns are those of left, then right's others.

    Hash partitioned as any equi-join; hot keys are left to the optimiser's skew handling."""
    named = right.select(*(F.col(c).alias(f"__key_{c}") for c in keys), *(c for c in right.columns if c not in keys))
    on = [left[c].eqNullSafe(named[f"__key_{c}"]) for c in keys]
    return left.join(named, on=on, how=how).drop(*(f"__key_{c}" for c in keys))


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "number") -> DataFrame:
    """rows with their number (from 0) within their group by `order`, nulls first.

    Rows are range-partitioned and stored, so all passes see the same partitions; a row's number is its place
    in its partition and group and the rows of its group in the partitions before, one count for each."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(rows.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part", group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order)) - 1
    out = join_nulls(dealt.withColumn("__own", own), counts, ["__part", group])
    return out.withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")
