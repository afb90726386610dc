"""Column-level helpers shared by the operators."""

from .columns import (
    asymmetric_score,
    clean,
    finite,
    general_format,
    pearson,
    rounded,
    wall_micros,
)

__all__ = [
    "asymmetric_score",
    "clean",
    "finite",
    "general_format",
    "pearson",
    "rounded",
    "wall_micros",
]
