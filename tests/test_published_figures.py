"""Headline figures of the published tables, recomputed from their rows."""

import pytest

from wearmark.operators import conformal, selection

# Largest absolute error per calibration unit.
UNIT_ERRORS = [
    36.839, 32.0664, 33.8659, 44.7955, 22.4469, 23.7663, 35.044, 34.3984,
    14.2032, 21.7495, 41.4224, 66.2097, 23.2556, 46.5148, 30.9632,
]
# Outer folds of the selected model: best iteration, RMSE, MAE, R2, score total and per unit.
FOLDS = [
    (100, 26.0946, 19.555, 0.8132, 3634.19, 213.776),
    (91, 29.616, 24.3184, 0.6754, 7259.32, 427.0191),
    (69, 25.643, 20.731, 0.7604, 3254.79, 191.4585),
    (97, 32.1987, 26.2097, 0.6856, 7524.33, 442.6075),
    (53, 28.2122, 22.5762, 0.7377, 9609.24, 565.2494),
]


def test_conformal_half_widths(spark):
    scores = spark.createDataFrame([(x,) for x in UNIT_ERRORS], "score double")
    got = {r["alpha"]: (r["q"], r["k"]) for r in conformal.conformal_q(scores).collect()}
    assert got == {0.1: (66.2097, 15), 0.2: (44.7955, 13), 0.3: (41.4224, 12)}


def test_fold_summary_and_final_rounds(spark):
    rows = [("boosted_w90", i, *fold) for i, fold in enumerate(FOLDS, 1)]
    names = "candidate_id string, fold int, best_iteration int, rmse double, mae double, r2 double, score_total double, score_per_unit double"
    frame = spark.createDataFrame(rows, names)
    got = selection.cv_summary(frame).first()
    want = {
        "rmse": (28.3529, 2.6856), "mae": (22.6781, 2.6795), "r2": (0.7345, 0.0565),
        "score_total": (6256.374, 2726.7508), "score_per_unit": (368.0221, 160.397),
    }
    for name, (mean, std) in want.items():
        assert got[f"{name}_mean"] == pytest.approx(mean, abs=1e-4)
        assert got[f"{name}_std"] == pytest.approx(std, abs=1e-4)
    assert selection.final_rounds(frame).first()["rounds"] == 92
