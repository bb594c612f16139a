"""Positions and running totals that never pull a whole group into one task.

A window over a hot key sorts all of that key in one task. The helpers here cut
each group into value buckets first, so a task sees one bucket and the totals of
the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.session import reliable_checkpoint


def top_rows(
    df: DataFrame, groups: Sequence[str | Column], order: Sequence[Column], k: int = 1
) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark plans a group limit before the shuffle, so a map task sends at most
    ``k`` rows per group however large the group is. The leading hash keeps the
    sort from comparing long paths that start alike.
    """
    w = Window.partitionBy(F.xxhash64(*groups), *groups).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def bucketed_index(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """Zero-based position of each row in its group.

    ``bucket`` must never decrease along ``order``. Position = rows in earlier
    buckets + position inside the bucket; only bucket counts cross buckets.
    """
    keys = list(groups)
    cut = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        null_safe_join(cut.withColumn("_pos", F.row_number().over(inside)), starts, [*keys, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_pos") - 1).cast("bigint"))
        .drop("_bucket", "_pos", "_start")
    )


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows in one global order.

    Rows are range partitioned and checkpointed, so the parts are fixed; each
    part gets the total of the parts before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = reliable_checkpoint(df.repartitionByRange(parts, *order)).withColumn(
        "_part", F.spark_partition_id()
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.sum(value).alias("_sum"))
        # one row per shuffle partition, never more
        .withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        placed.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(starts, "_part")
        .withColumn(out, F.col("_start") + F.col("_before"))
        .drop("_part", "_start", "_before")
    )


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` where null equals null; the key columns come from the left."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for c in keys:
        test = left[c].eqNullSafe(r[f"_r_{c}"])
        on = test if on is None else on & test
    return left.join(r, on, how).drop(*[f"_r_{c}" for c in keys])


def exact_median(df: DataFrame, value: str, bucket_width: float, by: Sequence[str] = ()) -> DataFrame:
    """Exact median of ``value`` per group as column ``median``.

    Equal values are counted first and counts are summed per value bucket, so
    only the buckets around the middle are looked into.
    """
    keys = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.floor(F.col("_v") / bucket_width))
    )
    sums = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    low = F.call_function("div", F.col("_total") - 1, F.lit(2).cast("bigint"))
    high = F.call_function("div", F.col("_total"), F.lit(2).cast("bigint"))
    # windows over bucket counts, not over rows
    starts = sums.withColumns(
        {
            "_start": F.coalesce(F.sum("_size").over(before), F.lit(0)),
            "_total": F.sum("_size").over(Window.partitionBy(*keys)),
        }
    )
    middle = starts.select(
        *keys, "_bucket", "_start", low.alias("_low"), high.alias("_high"), "_size"
    ).filter((F.col("_start") <= F.col("_high")) & (F.col("_start") + F.col("_size") > F.col("_low")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    after = F.col("_first") + F.col("_n")
    return (
        null_safe_join(counts, middle, [*keys, "_bucket"])
        .withColumn("_first", first)
        .groupBy(*keys)
        .agg(
            (
                F.max(F.when((F.col("_first") <= F.col("_low")) & (F.col("_low") < after), F.col("_v")))
                + F.max(
                    F.when((F.col("_first") <= F.col("_high")) & (F.col("_high") < after), F.col("_v"))
                )
            ).alias("_both")
        )
        .select(*keys, (F.col("_both") / 2).alias("median"))
    )
