"""Frame helpers of the tests."""

from __future__ import annotations


def collect(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
