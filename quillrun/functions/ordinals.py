"""Consecutive numbers for rows, without one task that has them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are looked at for each range, to find where ranges begin.
SAMPLE = 100


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Ordinals over a file scan: files in order of their paths, a file's splits by
    where they begin, and rows as they lie in a split. A task may have splits of
    several files in any order, so a split's rows are numbered from its own first.
    Where each split begins is a table of a row a split, which is broadcast: as many
    rows as the driver has splits to plan. Only for plans without a shuffle."""
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_low", low)
    splits = placed.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_low").alias("_first"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select(F.col("_path").alias("_p"), F.col("_start").alias("_s"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    numbered = placed.join(F.broadcast(bases), (F.col("_path") == F.col("_p")) & (F.col("_start") == F.col("_s")))
    return numbered.withColumn(name, (F.col("_base") + F.col("_low")).cast("bigint")).select(*df.columns, name)


def dense_order(df: DataFrame, *order: str, name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start`` in an ascending order of columns.

    Borders of as many ranges as the session has shuffle partitions come from a
    bounded sample of the first column's distinct values (those of least hash, so
    the same on each run), and are literals: which range a row is in doesn't
    depend on where or how often it is computed, as it would with a range
    partitioning under adaptive execution. One pass counts the ranges' rows; ranks
    within a range are a window over it."""
    spark, lead = df.sparkSession, order[0]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(lead).alias("k")).where("k is not null").distinct()
    seen = sorted(r.k for r in keys.orderBy(F.xxhash64("k")).limit(SAMPLE * ranges).collect())
    borders = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []
    if borders:
        kind = df.schema[lead].dataType
        here = F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in borders)), lambda b: b <= F.col(lead)))
    else:
        here = F.lit(0)
    ranged = df.withColumn("_range", here)
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    starts, total = [], start
    for i in range(len(borders) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    w = Window.partitionBy("_range").orderBy(*order)
    base = F.element_at(F.array(*(F.lit(s).cast("bigint") for s in starts)), F.col("_range") + 1)
    return ranged.withColumn(name, (base + F.row_number().over(w) - 1).cast("bigint")).drop("_range")


def dense_number(df: DataFrame, index: str, *, name: str, start: int = 0, width: int = 1 << 16) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of an integer column that is
    spread evenly, as an item's index is. All in one plan: rows are ranked within
    blocks of ``width`` values, and how many rows come before a block is a running
    sum over the blocks' counts, a row a block."""
    blocked = df.withColumn("_block", F.floor(F.col(index) / width))
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(index))
    ranked = blocked.withColumn("_rank", rank).join(bases, F.col("_block").eqNullSafe(F.col("_b")))
    return ranked.withColumn(name, (F.col("_base") + F.col("_rank") + (start - 1)).cast("bigint")).select(*df.columns, *([] if name in df.columns else [name]))
