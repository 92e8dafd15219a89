"""Firsts, ranks and limits of groups, however large a group is.

Two ways, chosen by the caller and not by a size:

- `top_k_per_group` and `first_per_key` are one window, for a small fixed k:
  Spark cuts every group to k rows in each input split before the shuffle.
- `cutoffs` finds the place in a group's order at which a running sum reaches
  a limit, for any limit: a histogram of the coarse part of the order names the
  bucket in question, and prefix sums over a range partition of that bucket's
  rows name the row.  Rows then pass by comparison (`up_to`).  `rank_all`
  numbers rows by the same prefix sums.

The second way moves narrow rows only, reads them from a staged table, and no
task sees more of a group than one range of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.sources.staging import stage


def top_k_per_group(df: DataFrame, keys: list[str], order: list[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k in each group, with their rank, for a small k.

    Each input split sends up to k rows of a group, and a group's rows meet in
    one task.  The order must be total inside a group."""
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of every key in the given order; all columns kept."""
    return top_k_per_group(df, keys, order, 1, rank="_first").drop("_first")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str,
                salt_columns: list[str], salts: int = 16) -> DataFrame:
    """Join in which a hot key of `left` is spread over `salts` join keys.

    `right` should have few rows per key; it is copied `salts` times.  Nothing
    is broadcast by hint: when `right` is small enough for that, Spark finds
    out from its size.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    salt = F.pmod(F.xxhash64(*salt_columns), F.lit(salts)).cast("int")
    joined = left.withColumn("_salt", salt).join(
        right.select("*", copies), [*keys, "_salt"], how
    )
    return joined.drop("_salt")


def _placed(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """The rows range partitioned and sorted by `by`, written once, with their
    partition `_part` and their place `_place` in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # the low bits of the id count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stage(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ranked")


def _sum_before(keys: list[str], order: list[str], n: str) -> Column:
    """Sum of `n` over the earlier rows of a group that has few rows."""
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(earlier), F.lit(0))


def rank_all(df: DataFrame, keys: list[str], order: list[str | Column], rank: str = "rank") -> DataFrame:
    """Every row with its exact rank in its group, however large a group is.

    A rank is the place in the partition plus what earlier partitions hold of
    the group.  All columns are sorted and written once, so pass narrow rows.
    The order must be total inside a group.
    """
    placed = _placed(df, [*keys, *order])
    held = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = held.withColumn("_before", _sum_before(keys, ["_part"], "_n")).drop("_n")
    exact = (F.col("_place") - F.col("_first") + F.col("_before") + 1).cast("int")
    return placed.join(offsets, [*keys, "_part"]).withColumn(rank, exact).drop("_part", "_place", "_first", "_before")


def sums_before(df: DataFrame, keys: list[str], order: list[str], n: str, to: str) -> DataFrame:
    """Every row with the sum of `n` over the earlier rows of its group."""
    placed = _placed(df, [*keys, *order])
    held = placed.groupBy(*keys, "_part").agg(F.sum(n).alias("_n"))
    offsets = held.withColumn("_before", _sum_before(keys, ["_part"], "_n")).drop("_n")
    inside = placed.withColumn("_inside", _sum_before([*keys, "_part"], ["_place"], n))
    return inside.join(offsets, [*keys, "_part"]).withColumn(to, F.col("_before") + F.col("_inside")).drop(
        "_part", "_place", "_before", "_inside")


def cutoffs(rows: DataFrame, keys: list[str], coarse: list[str], fine: list[str], n: str, limit: int) -> DataFrame:
    """Where a running sum of `n` reaches `limit`: one row `(keys, cutoff)` per
    group that gets there; `cutoff` has the order columns of the row that does it.

    `rows` is narrow and read more than once, so stage it.  The order is
    `coarse`, then `fine`, ascending, without nulls and total inside a group.
    `coarse` has few values: one histogram of it per group finds the bucket of
    the cutoff, and only that bucket's rows are sorted."""
    histogram = rows.groupBy(*keys, *coarse).agg(F.sum(n).alias("_n"))
    edge = histogram.withColumn("_before", _sum_before(keys, coarse, "_n")).where(
        (F.col("_before") < limit) & (F.col("_before") + F.col("_n") >= limit)).drop("_n")
    bucket = salted_join(rows.select(*keys, *coarse, *fine, n), edge, [*keys, *coarse], "inner", fine)
    placed = _placed(bucket, [*keys, *fine])
    held = placed.groupBy(*keys, "_part").agg(F.sum(n).alias("_n"), F.first("_before").alias("_before"))
    start = held.withColumn("_start", F.col("_before") + _sum_before(keys, ["_part"], "_n"))
    part = start.where((F.col("_start") < limit) & (F.col("_start") + F.col("_n") >= limit)).select(*keys, "_part", "_start")
    # the rows of one group in one range
    inside = placed.join(part, [*keys, "_part"]).withColumn(
        "_reached", F.col("_start") + _sum_before([*keys, "_part"], ["_place"], n) + F.col(n))
    return inside.where(F.col("_reached") >= limit).groupBy(*keys).agg(F.min(F.struct(*coarse, *fine)).alias("cutoff"))


def up_to(rows: DataFrame, found: DataFrame, keys: list[str], order: list[str], salt_columns: list[str]) -> DataFrame:
    """The rows up to their group's cutoff; all rows of groups without one."""
    joined = salted_join(rows, found, keys, "left", salt_columns)
    return joined.where(F.col("cutoff").isNull() | (F.struct(*order) <= F.col("cutoff"))).drop("cutoff")


def top_k(rows: DataFrame, keys: list[str], coarse: list[str], fine: list[str], k: int) -> DataFrame:
    """The first k rows of each group, for any k; see `cutoffs` for the arguments."""
    counted = rows.withColumn("_one", F.lit(1))
    return up_to(rows, cutoffs(counted, keys, coarse, fine, "_one", k), keys, [*coarse, *fine], fine)
