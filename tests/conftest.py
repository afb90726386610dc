"""Shared session and small synthetic fleets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from wearmark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoint")
    yield local_session(partitions=4, spark__checkpoint__dir=str(folder))


@pytest.fixture(scope="session")
def ramp(spark):
    """Sensors equal to the cycle; one unit holds a third of all rows and more."""
    lengths = {1: 40, 2: 35, 3: 10, 4: 120}
    rows = [(u, c, float(c), float(c + 100 * u), 1.0) for u, n in lengths.items() for c in range(1, n + 1)]
    return spark.createDataFrame(rows, "unit_id long, cycle long, f1 double, f2 double, f3 double")


@pytest.fixture(scope="session")
def noisy_frame():
    """Random histories of 1, 2, 4, 5, 9, 10, 11, 37 and 150 rows."""
    rng = np.random.default_rng(7)
    parts = []
    for unit, n in enumerate((1, 2, 4, 5, 9, 10, 11, 37, 150), 1):
        parts.append(
            pd.DataFrame(
                {
                    "unit_id": unit,
                    "cycle": np.arange(1, n + 1),
                    "s1": rng.normal(50, 5, n),
                    "s2": rng.normal(0, 1, n),
                    "s3": 2.5,
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def noisy(spark, noisy_frame):
    return spark.createDataFrame(noisy_frame).repartition(3)


@pytest.fixture(scope="session")
def gapped_frame(noisy_frame):
    """The same histories with every third cycle missing."""
    return noisy_frame[noisy_frame["cycle"] % 3 != 2].reset_index(drop=True)
