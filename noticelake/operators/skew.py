"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.session import ensure_checkpoint_dir

HOT_ROWS = 1_000_000
SALTS = 64


def hot_lookup_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], row_id: str, n_col: str, hot_rows: int = HOT_ROWS, salts: int = SALTS
) -> DataFrame:
    """Left join ``rows`` to ``lookup`` (one row per key; ``n_col`` = rows behind the key).

    Keys with more than ``hot_rows`` rows are spread over ``salts`` join partitions. There can be at most
    rows / hot_rows such keys, so the list of hot keys is the only thing broadcast. Rows without a key
    can never match and are spread the same way.
    """
    hot = lookup.filter(F.col(n_col) > hot_rows).select(*on)
    copies = F.when(F.col(n_col) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("_salt", F.explode(copies)).drop(n_col)
    return _salted(rows, hot, on, row_id, salts).join(right, [*on, "_salt"], "left").drop("_salt")


def _salted(rows: DataFrame, hot: DataFrame, on: list[str], row_id: str, salts: int) -> DataFrame:
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)).cast("int")
    return rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot") | no_key, spread).otherwise(0)).drop("_hot")


def wide_lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], row_id: str, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """``hot_lookup_join`` with the hot keys given (columns ``on``, each once): a lookup of wide rows is shuffled once, as it is read."""
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return _salted(rows, hot, on, row_id, salts).join(right, [*on, "_salt"], "left").drop("_salt")


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """0-based position of every row in the total order, without a single-partition sort.

    The range-sorted rows are checkpointed so that their partitioning is fixed; only one count per
    partition is read to compute the offsets.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
        .checkpoint()
    )
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offset, pairs = 0, []
    for part, count in counts:
        pairs += [F.lit(part), F.lit(offset).cast("long")]
        offset += count
    if not pairs:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_part", "_seq")
    start = F.element_at(F.create_map(*pairs), F.col("_part"))
    within = F.col("_seq") - F.shiftleft(F.col("_part").cast("long"), 33)
    return placed.withColumn(name, start + within).drop("_part", "_seq")


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], row_id: str, name: str = "pos") -> DataFrame:
    """1-based position inside each group. A group may span many partitions, unlike with a window."""
    indexed = with_global_index(df, [*[F.col(g).asc() for g in group], *order], "_idx")
    starts = indexed.groupBy(*group).agg(F.min("_idx").alias("_start"), F.count("*").alias("_n"))
    joined = hot_lookup_join(indexed, starts, group, row_id, "_n")
    return joined.withColumn(name, F.col("_idx") - F.col("_start") + 1).drop("_idx", "_start")
