"""Range overlap and skew-safe joins.

Catalyst plans a pure range predicate as a nested loop inside the equi key, so
ranges are cut into bins and joined on (keys, bin): a path with very many
ranges spreads over its bins. A pair is kept only in the bin where its overlap
begins, so no duplicate is made and nothing has to be removed afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 64


def _binned(df: DataFrame, start: Column, end: Column, size: int) -> DataFrame:
    bins = F.sequence(F.floor(start / size), F.floor(end / size))
    return df.withColumn("_s", start).withColumn("_e", end).filter("_s <= _e").withColumn("_bin", F.explode(bins))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple, right_range: tuple,
             size: int = BIN) -> DataFrame:
    """Inner join of rows whose closed line ranges overlap; ranges are (start, end) columns."""
    as_col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    a = _binned(left, *map(as_col, left_range), size).withColumnsRenamed({"_s": "_ls", "_e": "_le"})
    b = _binned(right, *map(as_col, right_range), size).withColumnsRenamed({"_s": "_rs", "_e": "_re"})
    met = a.join(b, [*keys, "_bin"]).filter("_ls <= _re AND _rs <= _le") \
        .filter(F.col("_bin") == F.floor(F.greatest("_ls", "_rs") / size))
    return met.drop("_bin", "_ls", "_le", "_rs", "_re")


def new_range() -> tuple[Column, Column]:
    """New-side line range of a hunk; an empty side stands at its start."""
    return F.col("new_start"), F.col("new_start") + F.greatest(F.col("new_lines") - 1, F.lit(0))


def old_range() -> tuple[Column, Column]:
    return F.col("old_start"), F.col("old_start") + F.greatest(F.col("old_lines") - 1, F.lit(0))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int = 1_000_000) -> DataFrame:
    """Inner join that splits keys with more than ``hot_rows`` left rows.

    Left rows of a hot key are dealt over as many salts as it needs and the
    matching right rows repeated per salt; other keys are joined as they are.
    The result is the plain join. At most rows/hot_rows keys can be hot.
    """
    keys = list(keys)
    hot = left.groupBy(*keys).count().filter(F.col("count") > hot_rows) \
        .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    deal = F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    a = left.join(hot, keys, "left").withColumn("_salt", deal).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return a.join(b, [*keys, "_salt"]).drop("_salt")
