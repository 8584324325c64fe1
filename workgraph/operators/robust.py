"""Robust statistics that stay exact and parallel however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workgraph.operators.scan import ranked

# The factor that makes a MAD comparable to a standard deviation, and its floor.
MAD_SCALE, MAD_FLOOR = 1.4826, 1e-6


def median(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Exact median per key from the middle of a range-sorted numbering.

    An exact percentile aggregate keeps every distinct value of a group in one
    buffer; numbering by range keeps none.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = ranked(rows.withColumn("_tie", F.monotonically_increasing_id()), keys, [F.col("_v"), F.col("_tie")], "_r")
    middle = numbered.join(sized, keys).filter(
        (F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1))
    return middle.groupBy(*keys).agg(F.avg("_v").alias(out))


def robust_mad(df: DataFrame, keys: Sequence[str], column: str, k: float = 6.0, floor: float = 0.0) -> DataFrame:
    """Rows with their group's median, MAD and whether they stand out by more than ``max(k * mad, floor)``."""
    keys = list(keys)
    centred = df.join(median(df, keys, F.col(column), "median"), keys).withColumn("_d", F.col(column) - F.col("median"))
    spread = median(centred, keys, F.abs("_d"), "_m").withColumn("mad", MAD_SCALE * F.col("_m") + MAD_FLOOR).drop("_m")
    return centred.join(spread, keys) \
        .withColumn("outlier", F.abs("_d") > F.greatest(k * F.col("mad"), F.lit(floor))).drop("_d")


def rolling_median(df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str, rows: int = 31,
                   cap: float = 20.0, highest: float = 40.0, block: int = 4096) -> DataFrame:
    """A running median over ``rows`` centred rows as a baseline, and the value with it taken off.

    Values are capped before and the median is kept within 0..highest; at
    the ends the edge value repeats. A group is cut into blocks that carry the
    rows they need from the blocks around them (several, where the frame is wider
    than a block), so the frame never crosses tasks.
    """
    keys, half = list(keys), rows // 2
    placed = ranked(df, keys, order, "_p").withColumn("_c", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col(column))))
    ends = placed.groupBy(*keys).agg(F.max("_p").alias("_n"), F.min_by("_c", "_p").alias("_first"), F.max_by("_c", "_p").alias("_last"))
    home = F.floor(F.col("_p") / block)
    near = F.sequence(F.floor((F.col("_p") - half) / block), F.floor((F.col("_p") + half) / block))
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(near))
    frame = Window.partitionBy(*keys, "_block").orderBy("_p").rowsBetween(-half, half)
    seen = spread.withColumn("_w", F.collect_list("_c").over(frame)).filter("_block = _home").join(ends, keys)
    before = F.greatest(F.lit(half) - (F.col("_p") - 1), F.lit(0)).cast("int")
    after = F.greatest(F.lit(half) - (F.col("_n") - F.col("_p")), F.lit(0)).cast("int")
    full = F.array_sort(F.concat(F.array_repeat("_first", before), F.col("_w"), F.array_repeat("_last", after)))
    base = F.greatest(F.lit(0.0), F.least(F.lit(highest), F.get(full, F.lit(half))))
    return seen.withColumn("baseline", base).withColumn("flattened", F.col(column) - F.col("baseline")) \
        .drop("_p", "_c", "_home", "_block", "_w", "_n", "_first", "_last")
