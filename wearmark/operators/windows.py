"""Fixed-length windows of unit history, left-padded with zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .segments import (
    ORDER,
    SEGMENT_ROWS,
    UNIT,
    attach_units,
    drop_halo,
    positioned,
    segment_window,
    with_halo,
)


def _row(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in cols])


def _zero_row(width: int) -> Column:
    return F.array(*[F.lit(0.0).cast("float") for _ in range(width)])


def pad_left(seq: Column, width: int, window: int) -> Column:
    """Zero rows in front of the observed rows, up to ``window`` rows."""
    missing = F.greatest(F.lit(window) - F.size(seq), F.lit(0))
    return F.concat(F.array_repeat(_zero_row(width), missing), seq)


def observed_mask(n_observed: Column, window: int) -> Column:
    """0 for padded, 1 for observed positions."""
    zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
    return F.concat(F.array_repeat(zero, F.lit(window) - n_observed), F.array_repeat(one, n_observed))


def sequence_windows(
    df: DataFrame,
    cols: Sequence[str],
    w: int,
    pad: bool = True,
    u: str = UNIT,
    o: str = ORDER,
    keep: Sequence[str] = (),
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One window per end cycle.

    With ``pad`` every row ends a window (zeros in front of short histories) and
    carries its mask; without it only full windows are kept, so units shorter
    than ``w`` give none. ``keep`` names columns of the end row, such as the target.
    """
    rows = positioned(df, u, o, gapless, segment_rows).select(
        u, o, "_pos", *keep, _row(cols).alias("_row")
    )
    spread, _ = with_halo(rows, "_pos", w - 1, segment_rows)
    frame = segment_window(u, "_pos").rowsBetween(-(w - 1), 0)
    ends = drop_halo(spread.withColumn("seq", F.collect_list("_row").over(frame)))
    ends = ends.withColumn("n_observed", F.size("seq"))
    if not pad:
        return ends.filter(F.col("n_observed") == w).select(
            u, F.col(o).alias("end_cycle"), *keep, "n_observed", "seq"
        )
    return ends.select(
        u,
        F.col(o).alias("end_cycle"),
        *keep,
        "n_observed",
        (F.col("n_observed") < w).alias("padded"),
        pad_left(F.col("seq"), len(cols), w).alias("seq"),
        observed_mask(F.col("n_observed"), w).alias("mask"),
    )


def terminal_windows(
    df: DataFrame,
    cols: Sequence[str],
    w: int,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The last window of each unit.

    Only the last ``w`` rows of a unit survive the filter before anything is
    gathered, so no list grows with the trajectory.
    """
    rows = positioned(df, u, o, gapless, segment_rows).select(u, o, "_pos", _row(cols).alias("_row"))
    last = rows.groupBy(u).agg(F.max("_pos").alias("n_cycles"), F.max(o).alias("end_cycle"))
    tail = attach_units(rows, last, u, "_pos", segment_rows=segment_rows, last="n_cycles").filter(
        F.col("_pos") > F.col("n_cycles") - w
    )
    gathered = tail.groupBy(u, "n_cycles", "end_cycle").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_row"))).alias("_tail")
    )
    seq = F.col("_tail._row")
    n_observed = F.size("_tail")
    return gathered.select(
        u,
        "end_cycle",
        "n_cycles",
        n_observed.alias("n_observed"),
        (F.col("n_cycles") < w).alias("padded"),
        pad_left(seq, len(cols), w).alias("seq"),
        observed_mask(n_observed, w).alias("mask"),
    )


def check_cutoffs(manifest: DataFrame, df: DataFrame, u: str = UNIT, o: str = ORDER) -> DataFrame:
    """Manifest lines whose cutoff lies outside the observed cycles of the unit."""
    ends = df.groupBy(u).agg(F.max(o).alias("_end"))
    bad = F.col("_end").isNull() | (F.col("cutoff_cycle") < 1) | (F.col("cutoff_cycle") > F.col("_end"))
    return manifest.join(ends, u, "left").filter(bad).drop("_end")


def full_windows_only(seqs: DataFrame, w: int) -> DataFrame:
    return seqs.filter(F.col("n_observed") == w)
