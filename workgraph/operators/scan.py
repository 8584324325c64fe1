"""Ordered scans that stay parallel when one key holds most of the rows.

A plain window sorts all rows of a key in one task. These scans split a key
into blocks, summarise each block, scan the (much smaller) summaries and
finish inside the blocks, so no task sees more than one block of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workgraph.session import cut

BLOCK = 4096


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("_scan_block", F.floor(F.col(pos) / block))


def _with_block_state(blocked: DataFrame, keys: list[str], summary: Column, scan, out: list[str]) -> DataFrame:
    """Attach to every row the state its block starts with; ``scan`` gives one column of it per name in ``out``."""
    per_block = blocked.groupBy(*keys, "_scan_block").agg(summary.alias("_scan_summary"))
    before = Window.partitionBy(*keys).orderBy("_scan_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(*keys, "_scan_block", *[c.over(before).alias(o) for c, o in zip(scan(F.col("_scan_summary")), out)])
    return blocked.join(starts, [*keys, "_scan_block"], "left")


def running_total(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, *,
                  inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over the rows up to (and including) this one by ``pos``."""
    keys = list(keys)
    rows = _blocked(df.withColumn("_scan_value", value), pos, block)
    rows = _with_block_state(rows, keys, F.sum("_scan_value"), lambda c: [F.sum(c)], ["_scan_before"])
    frame = Window.partitionBy(*keys, "_scan_block").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    total = F.coalesce("_scan_before", F.lit(0)) + F.coalesce(F.sum("_scan_value").over(frame), F.lit(0))
    return rows.withColumn(out, total).drop("_scan_value", "_scan_before", "_scan_block")


def carry_forward(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, *,
                  inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """The last non-null ``value`` at or before (or strictly before) each row."""
    return carry_all(df, keys, pos, {out: value}, inclusive=inclusive, block=block)


def carry_all(df: DataFrame, keys: Sequence[str], pos: str, values: dict[str, Column], *,
              inclusive: bool = True, backward: bool = False, block: int = BLOCK) -> DataFrame:
    """The last non-null of every value at or before (or strictly before) each row, all in one scan.

    ``backward`` carries the next value upwards instead. A block is summarised by its last value of each name, so summaries
    combine in any grouping and one join brings a block the state it starts with.
    """
    keys, names = list(keys), list(values)
    held = [f"_scan_value{i}" for i in range(len(names))]
    rows = df.select("*", *[c.alias(h) for c, h in zip(values.values(), held)]) \
        .withColumn("_scan_pos", -F.col(pos) if backward else F.col(pos))
    rows = _blocked(rows, "_scan_pos", block)
    last_seen = F.struct(*[F.max_by(h, F.when(F.col(h).isNotNull(), F.col("_scan_pos"))).alias(h) for h in held])
    before = lambda summary: [F.last(summary[h], ignorenulls=True) for h in held]
    rows = _with_block_state(rows, keys, last_seen, before, [f"{h}_before" for h in held])
    frame = Window.partitionBy(*keys, "_scan_block").orderBy("_scan_pos").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    carried = {name: F.coalesce(F.last(h, ignorenulls=True).over(frame), F.col(f"{h}_before")) for name, h in zip(names, held)}
    return rows.withColumns(carried).drop(*held, *[f"{h}_before" for h in held], "_scan_pos", "_scan_block")


def neighbour(df: DataFrame, keys: Sequence[str], pos: str, step: int, columns: dict[str, str]) -> DataFrame:
    """Columns of the row ``step`` places away when ``pos`` is dense: a self equi-join, no window."""
    keys = list(keys)
    other = df.select(*keys, (F.col(pos) - step).alias(pos),
                      *[F.col(source).alias(out) for source, out in columns.items()])
    return df.join(other, [*keys, pos], "left")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``row_number`` per key (``order`` must be total), sorted by range instead of by key.

    Rows are range-partitioned on (keys, order), so a hot key spreads over many
    tasks. Each partition numbers its own rows; only keys that continue from an
    earlier partition need an offset, at most one per partition, so the joined
    offsets never exceed the partition count.
    """
    keys = list(keys)
    names = [f"_o{i}" for i in range(len(order))]
    plain = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    laid_out = cut(plain.repartitionByRange(*[F.col(k) for k in keys], *[F.col(n) for n in names])
                   .withColumn("_scan_part", F.spark_partition_id()))
    counts = laid_out.groupBy(*keys, "_scan_part").count()
    earlier = Window.partitionBy(*keys).orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_scan_part", F.sum("count").over(earlier).alias("_scan_offset")) \
        .filter("_scan_offset IS NOT NULL")
    inside = Window.partitionBy(*keys, "_scan_part").orderBy(*names)
    numbered = laid_out.withColumn("_scan_rn", F.row_number().over(inside))
    return (numbered.join(F.broadcast(offsets), [*keys, "_scan_part"], "left")
            .withColumn(out, (F.col("_scan_rn") + F.coalesce("_scan_offset", F.lit(0))).cast("long"))
            .drop("_scan_rn", "_scan_offset", "_scan_part", *names))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str) -> DataFrame:
    """The first ``n`` rows per key.

    Up to 1000 rows Spark limits each group before the shuffle; past that the
    range-sorted numbering keeps a hot key out of a single task.
    """
    if n > 1000:
        return ranked(df, keys, order, out).filter(F.col(out) <= n)
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(spec)).filter(F.col(out) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key, combined map-side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
