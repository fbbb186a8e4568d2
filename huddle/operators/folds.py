"""Exact stratified folds: every class is dealt evenly over the folds.

A class's rows are ranked by a hash of their keys and the rank modulo k is the
fold, so fold sizes of a class differ by one at most.  The rank is not taken
over a whole class in one task: rows are counted by (class, bucket of the
hash), running sums of the counts give each bucket's first rank, and only rows
of one bucket are ranked together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.expressions import split_bucket

#: 2^12 buckets a class: 250,000 rows a bucket at 10^9 rows a class.
BUCKET_BITS = 12


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 3, seed: int = 42, name: str = "fold",
                     bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """``df`` with ``name``, 0 to k - 1.  In SQL: ``(row_number() OVER
    (PARTITION BY label ORDER BY hash, keys) - 1) % k``.  Rows with equal keys
    are told apart by a hash of all columns; null is a class of its own."""
    order = [*keys, F.xxhash64(*df.columns)]
    rows = df.withColumn("_hash", split_bucket(keys, seed + 1, 1 << 32))
    rows = rows.withColumn("_bucket", F.shiftright("_hash", 32 - bucket_bits))
    counts = rows.groupBy(F.col(label).alias("_class"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_hash", *order)) - 1
    ranked = rows.withColumn("_rank", within).join(
        offsets, F.col(label).eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_of")))
    fold = F.pmod(F.col("_first") + F.col("_rank"), F.lit(k)).cast("int")
    return ranked.withColumn(name, fold).drop("_hash", "_bucket", "_class", "_of", "_first", "_rank")
