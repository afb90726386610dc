"""Invented prose for the tests."""

from __future__ import annotations

import random


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    syllables = "the an er ti on re en ha ou ing st ly".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
