"""Ordered work on units of any length.

A window partitioned by unit alone puts a whole unit into one task. One unit
may hold a third of all rows, so every ordered operator here works on
*segments*: runs of at most ``SEGMENT_ROWS`` consecutive positions of a unit.
Rows are shuffled by ``(unit, segment)``, facts about whole units reach the
rows through tables with one line per segment, and sliding frames get the few
rows before their segment as a halo. Short units have one segment, so nothing
changes for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from ..functions.columns import as_column

UNIT = "unit_id"
ORDER = "cycle"
SEGMENT = "_segment"
HALO = "_halo"
SEGMENT_ROWS = 65_536
HOT_ROWS = 4_000_000
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions that hold about ``TASK_ROWS`` rows, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def segment_of(position: str | Column, segment_rows: int = SEGMENT_ROWS) -> Column:
    """Segment number of a 1-based position."""
    return F.floor((as_column(position) - 1) / F.lit(segment_rows)).cast("long")


def flag_hot(df: DataFrame, by: Sequence[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark rows of groups larger than ``hot_rows``.

    The broadcast list of hot groups has fewer than ``rows / hot_rows`` lines
    (each accounts for more than ``hot_rows`` rows), so it stays small: at most
    250,000 lines for a trillion rows.
    """
    hot = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*by, F.lit(True).alias(out))
    )
    return df.join(F.broadcast(hot), list(by), "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(False))
    )


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    coarse: Sequence[Column],
    out: str,
    previous: dict[str, str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` over ``by`` and ``order`` without one task per group.

    ``coarse`` cuts the order into buckets (each bucket is a run of the order).
    Rows are numbered inside their bucket and shifted by the rows counted in
    earlier buckets; the counts are pre-aggregated, one line per bucket.

    ``previous`` maps an output name to a column that never decreases along the
    order; the output holds its value in the row before, across bucket borders.
    ``tasks`` is the number of shuffle partitions where the session's is too small.
    """
    names = [f"_bucket{i}" for i in range(len(coarse))]
    keys = [*by, *names]
    keyed = df.withColumns(dict(zip(names, coarse)))
    previous = previous or {}

    earlier = Window.partitionBy(*by).orderBy(*names)
    offsets = (
        keyed.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.max(c).alias(f"_last_{c}") for c in previous.values()],
        )
        .select(
            *keys,
            F.coalesce(
                F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_before"),
            *[F.lag(f"_last_{c}").over(earlier).alias(f"_carry_{c}") for c in previous.values()],
        )
    )

    inside = Window.partitionBy(*keys).orderBy(*order)
    if tasks:
        keyed = keyed.repartition(tasks, *keys)
    numbered = keyed.withColumns(
        {
            "_inside": F.row_number().over(inside),
            **{f"_lag_{c}": F.lag(c).over(inside) for c in previous.values()},
        }
    ).join(offsets, keys)
    return numbered.withColumns(
        {
            out: (F.col("_before") + F.col("_inside")).cast("long"),
            **{
                name: F.coalesce(F.col(f"_lag_{c}"), F.col(f"_carry_{c}"))
                for name, c in previous.items()
            },
        }
    ).select(*df.columns, out, *previous)


def with_position(
    df: DataFrame,
    u: str = UNIT,
    o: str = ORDER,
    out: str = "_pos",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Gapless 1-based position of each row in its unit (cycles may have gaps)."""
    return number_rows(df, [u], [o], [segment_of(o, segment_rows)], out)


def positioned(
    df: DataFrame,
    u: str,
    o: str,
    gapless: bool,
    segment_rows: int = SEGMENT_ROWS,
    out: str = "_pos",
) -> DataFrame:
    """Add the position column; a gapless cycle (1, 2, 3, ...) already is the position."""
    if gapless:
        return df.withColumn(out, F.col(o).cast("long"))
    return with_position(df, u, o, out, segment_rows)


def with_halo(
    df: DataFrame, position: str, reach: int, segment_rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, int]:
    """Give each segment the ``reach`` rows before it as halo copies.

    Only the last ``reach`` rows of a full segment are copied, once each.
    Returns the frame and the segment size used (never smaller than ``reach``).
    """
    size = max(segment_rows, reach, 1)
    own = segment_of(position, size)
    edge = F.pmod(F.col(position) - 1, F.lit(size)) >= size - reach
    segments = F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.select("*", F.explode(segments).alias(SEGMENT))
    return spread.withColumn(HALO, F.col(SEGMENT) != own), size


def segment_window(u: str, position: str) -> WindowSpec:
    return Window.partitionBy(u, SEGMENT).orderBy(position)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(SEGMENT, HALO)


def unit_segments(
    rows: DataFrame,
    table: DataFrame,
    u: str = UNIT,
    o: str = ORDER,
    segment_rows: int = SEGMENT_ROWS,
    last: str | None = None,
) -> DataFrame:
    """Repeat each line of a unit-keyed table once per segment of that unit.

    The result has about ``units + rows / segment_rows`` lines. ``last`` names a
    column of ``table`` that already holds the unit's last cycle.
    """
    if last is None:
        ends = rows.groupBy(u).agg(F.max(o).alias("_end"))
        table = table.join(ends, u)
    else:
        table = table.withColumn("_end", F.col(last))
    spans = F.sequence(F.lit(0).cast("long"), F.greatest(segment_of("_end", segment_rows), F.lit(0)))
    return table.select("*", F.explode(spans).alias(SEGMENT)).drop("_end")


def attach_units(
    rows: DataFrame,
    table: DataFrame,
    u: str = UNIT,
    o: str = ORDER,
    how: str = "inner",
    segment_rows: int = SEGMENT_ROWS,
    last: str | None = None,
) -> DataFrame:
    """Join a unit-keyed table to trajectory rows without a hot join key.

    Both sides are keyed by ``(unit, segment)``: a long unit spreads over its
    segments. The size of the table is left to adaptive execution, which
    broadcasts it when its measured size allows and shuffles it otherwise.
    """
    spread = unit_segments(rows, table, u, o, segment_rows, last)
    keyed = rows.withColumn(SEGMENT, F.greatest(segment_of(o, segment_rows), F.lit(0)))
    return keyed.join(spread, [u, SEGMENT], how).drop(SEGMENT)
