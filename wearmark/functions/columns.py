"""JVM-side column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decay constants of the asymmetric late-penalty score.
EARLY_DECAY = 13.0
LATE_DECAY = 10.0


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def asymmetric_score(y_true: str | Column, y_pred: str | Column) -> Column:
    """Per-row penalty: late predictions (d >= 0) grow faster than early ones."""
    d = as_column(y_pred).cast("double") - as_column(y_true).cast("double")
    return F.when(d < 0, F.exp(-d / F.lit(EARLY_DECAY))).otherwise(
        F.exp(d / F.lit(LATE_DECAY))
    ) - F.lit(1.0)


def rounded(value: str | Column, digits: int = 6) -> Column:
    """Half-up rounding with negative zero folded into zero."""
    return F.round(as_column(value).cast("double"), digits) + F.lit(0.0)


def clean(value: str | Column) -> Column:
    """NaN becomes NULL, so aggregates skip it as they skip NULL."""
    c = as_column(value).cast("double")
    return F.when(~F.isnan(c), c)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson correlation, NULL when a side never varies (also in ANSI mode).

    Deviations merged from many partitions are not exactly zero for a constant,
    so the least and greatest value tell whether a side varies.
    """
    x, y = as_column(x).cast("double"), as_column(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    vary = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(vary, F.try_divide(F.covar_pop(x, y), spread))


def finite(value: str | Column) -> Column:
    """True for values that are neither NULL, NaN nor infinite."""
    c = as_column(value).cast("double")
    return F.coalesce(
        c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)
    )


def wall_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of the wall-clock fields, whatever the session zone."""
    c = as_column(ts)
    seconds = F.unix_date(F.to_date(c)) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    micros = (F.extract(F.lit("SECOND"), c) * 1000000).cast("long")
    return seconds.cast("long") * F.lit(1000000).cast("long") + micros


def general_format(value: str | Column, digits: int = 6) -> Column:
    """C-style ``%g`` text of a double with ``digits`` significant digits.

    Java's own ``%g`` keeps trailing zeros, so the exponent is read from the
    ``%e`` text and the matching fixed or scientific form is trimmed.
    """
    x = as_column(value).cast("double")
    sci = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.substring_index(sci, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.substring_index(sci, "e", 1), r"\.?0+$", "")
    text = F.concat(mantissa, F.lit("e"), F.substring_index(sci, "e", -1))
    for power in range(-4, digits):
        fixed = F.format_string(f"%.{digits - 1 - power}f", x)
        if digits - 1 - power > 0:
            fixed = F.regexp_replace(fixed, r"\.?0+$", "")
        text = F.when(exponent == power, fixed).otherwise(text)
    return (
        F.when(x == 0, F.lit("0"))
        .when(F.isnan(x), F.lit(""))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(text)
    )
