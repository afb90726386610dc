"""Multi-step flows: cross-validation, variant comparison, benchmark, ablation.

The driver walks a small hand-written grid; every fit, score and metric is a
Spark job. Feature tables are computed once per window and written to the
shared folder, so grid points read them instead of recomputing the lineage.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..operators import boosting, checkpoints, evaluate, leastsquares, models, regimes, selection, splits
from ..operators.features import dense_arrays, dense_features, feature_names, features_at, scale_features
from ..operators.profile import lifetimes
from ..operators.segments import ORDER, UNIT, attach_units
from ..operators.target import add_target
from ..session import new_table_path
from ..sources.sinks import append_new


@dataclass(frozen=True)
class Candidate:
    """One grid point."""

    id: str
    model: str
    window: int
    params: dict = field(default_factory=dict)

    @property
    def text(self) -> str:
        return ",".join(f"{k}={v}" for k, v in sorted(self.params.items())) or "none"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: short lineage, safe from lost executors."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CONTROL = (
    "candidate_id string, fold int, model string, window int, parameters string, "
    "best_iteration int, feature_count int, training_time double"
)


# Models whose fits for all folds come from one scan of the rows.
ONE_SCAN = ("mean", "linear")


def _one_scan(candidate: Candidate) -> bool:
    return candidate.model in ONE_SCAN and not candidate.params


def _fold_fits(table: DataFrame, candidate: Candidate, folds: Sequence[int], inputs, inner: bool):
    """Every fold's model and its best round, where monitor units choose it.

    Boosting takes two stages: stage 1 finds the number of rounds on the monitor
    units, stage 2 refits with them. All folds grow from the same scans.
    """
    if candidate.model == "boosted" and inner:
        fits = []
        for f in folds:
            train, stopping = F.col("fold") != f, F.array_contains("stop_folds", f)
            fits.append(boosting.Fit(train & ~stopping, train & stopping, refit=True))
        return [(b.model, b.best_iteration) for b in boosting.boost_many(table, inputs, fits, candidate.params)]
    trains = [table.filter(F.col("fold") != f) for f in folds]
    return [(models.fit_model(candidate.model, train, inputs, candidate.params), None) for train in trains]


def nested_cv(
    df: DataFrame,
    folds: DataFrame,
    k: int,
    candidates: Sequence[Candidate],
    cols: Sequence[str],
    n_stop,
    seed_base: int = 4200,
    fractions: Sequence[float] = checkpoints.BALANCED_FRACTIONS,
    inner: bool = True,
    predict_mode: str = "windowed",
    gapless: bool = True,
    store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cross-validation over unit folds; returns fold rows and predictions.

    The predictions of a candidate and fold go to the folder ``store`` as soon as
    they exist, and pairs found there are not fitted again: a run that broke off
    is resumed by calling it once more with the same folder.

    With ``inner`` the stopping units come from inside each outer training set,
    so the held-out fold influences nothing. Mean and least squares candidates
    are fitted for all folds from one scan. Held-out units are scored at their
    checkpoints. Each unit carries its own fold and the folds where it is a
    stopping unit, so training sets are plain filters on one feature table.
    """
    spark = df.sparkSession
    assignments = splits.fold_assignments(folds, k)
    roles = folds.select(UNIT, "fold")
    if inner:
        stops = (
            splits.inner_split(assignments, n_stop, seed_base)
            .filter(F.col("role") == "inner_stop")
            .groupBy(UNIT)
            .agg(F.sort_array(F.collect_set("fold")).alias("stop_folds"))
        )
        roles = roles.join(stops, UNIT, "left")
    else:
        roles = roles.withColumn("stop_folds", F.lit(None).cast("array<int>"))
    roles = roles.withColumn("stop_folds", F.coalesce("stop_folds", F.array().cast("array<int>")))

    # the fleet's numbering and the units' roles are worked out once, then read several times
    fleet = written(df.select(*dict.fromkeys([UNIT, ORDER, *cols])), "cv_fleet")
    units = written(roles.join(lifetimes(fleet), UNIT), "cv_units")
    members = attach_units(fleet, units, last="lifetime")
    targets = members.withColumn("rul", (F.col("lifetime") - F.col(ORDER)).cast("long"))
    manifest = checkpoints.checkpoint_manifest(units.select(UNIT, "lifetime", "fold"), fractions)
    inputs = feature_names(cols)

    store = store or new_table_path(spark, "cv")
    finished = _stored(spark, f"{store}/control", CONTROL)
    # the grid is hand-written, so its finished pairs are few
    done = {(r["candidate_id"], r["fold"]) for r in finished.select("candidate_id", "fold").collect()}
    todo = [(c, f) for c in candidates for f in range(1, k + 1) if (c.id, f) not in done]
    for w in sorted({c.window for c, _ in todo}):
        table = written(
            dense_features(targets, cols, w, keep=["rul", "fold", "stop_folds"], gapless=gapless), f"dense_w{w}"
        )
        reach = w if predict_mode == "windowed" else None
        held = written(features_at(fleet, manifest, cols, reach, gapless=gapless), f"held_w{w}")
        here = [(c, f) for c, f in todo if c.window == w]
        plain = {c.id: c for c, _ in here if _one_scan(c)}
        if plain:
            started = time.perf_counter()
            fits = written(leastsquares.fold_models(table, inputs), f"fold_models_w{w}")
            spent = (time.perf_counter() - started) / (len(plain) * k)
        for candidate in plain.values():
            # all folds are scored and stored together
            scored = leastsquares.predict_held_out(held, fits, inputs, candidate.model == "mean")
            _scored(scored, candidate).write.mode("overwrite").parquet(f"{store}/predictions/{candidate.id}")
            lines = [(candidate.id, f, candidate.model, w, candidate.text, None, len(inputs), spent) for c, f in here if c.id == candidate.id]
            spark.createDataFrame(lines, CONTROL).write.mode("append").parquet(f"{store}/control")
        fitted: dict[str, list[int]] = {}
        for c, f in here:
            if not _one_scan(c):
                fitted.setdefault(c.id, []).append(f)
        for candidate in (c for c in candidates if c.window == w and c.id in fitted):
            # fits that share their scans end together, others one by one
            shared = candidate.model == "boosted" and inner
            for at in [fitted[candidate.id]] if shared else [[f] for f in fitted[candidate.id]]:
                started = time.perf_counter()
                found = _fold_fits(table, candidate, at, inputs, inner)
                spent = (time.perf_counter() - started) / len(at)
                for f, (model, best) in zip(at, found):
                    scored = _scored(models.predict(held.filter(F.col("fold") == f), model), candidate)
                    # a pair that broke off before its control line is written over
                    scored.write.mode("overwrite").parquet(f"{store}/predictions/{candidate.id}-{f}")
                lines = [
                    (candidate.id, f, candidate.model, w, candidate.text, best, len(inputs), spent)
                    for f, (_, best) in zip(at, found)
                ]
                spark.createDataFrame(lines, CONTROL).write.mode("append").parquet(f"{store}/control")
    parts = [[c.id] if _one_scan(c) else [f"{c.id}-{f}" for f in range(1, k + 1)] for c in candidates]
    predictions = spark.read.parquet(*[f"{store}/predictions/{name}" for names in parts for name in names])
    control = _stored(spark, f"{store}/control", CONTROL)
    rows = evaluate.fold_rows(predictions).join(F.broadcast(control), ["candidate_id", "fold"])
    return rows, predictions


def _scored(scored: DataFrame, candidate: Candidate) -> DataFrame:
    return scored.select(
        F.lit(candidate.id).alias("candidate_id"),
        "fold",
        UNIT,
        "cutoff_cycle",
        "true_raw_rul",
        "fraction",
        "prediction",
    )


def _stored(spark, path: str, schema: str) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def group_cv(df, folds, k, candidates, cols, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Single-level cross-validation: no inner split, fixed rounds."""
    return nested_cv(df, folds, k, candidates, cols, 0, inner=False, **kwargs)


def compare_variants(
    df: DataFrame,
    assignments: DataFrame,
    sensors: Sequence[str],
    settings: Sequence[str],
    w: int,
    n_stop,
    k: int = 6,
    params: dict | None = None,
    variants: Sequence[str] = regimes.VARIANTS,
    seed_base: int = 4200,
    n_init: int = 10,
    fractions: Sequence[float] = checkpoints.BALANCED_FRACTIONS,
) -> tuple[DataFrame, DataFrame]:
    """Input variants A-D under one recipe; returns results and predictions.

    ``assignments`` has roles ``train`` and ``validation``. Preprocessing is
    fitted on inner-fit rows for the stopping stage and on all training rows for
    the final stage.
    """
    spark = df.sparkSession
    train_units = assignments.filter(F.col("role") == "train").select(UNIT)
    held_units = assignments.filter(F.col("role") == "validation").select(UNIT)
    inner = splits.inner_split(
        train_units.withColumns({"fold": F.lit(1), "role": F.lit("outer_train")}), n_stop, seed_base
    )
    # the fleet's numbering is worked out once, then read several times
    fleet = written(df.select(*dict.fromkeys([UNIT, ORDER, *sensors, *settings])), "variant_fleet")
    train = written(add_target(attach_units(fleet, inner.select(UNIT, "role"))), "variant_train")
    held = written(attach_units(fleet, held_units), "variant_held")
    manifest = checkpoints.checkpoint_manifest(lifetimes(held), fractions)

    # A's columns are among B's, and C's among D's, so the larger table serves both
    holders = {v: o for v, o in (("A", "B"), ("C", "D")) if v in variants and o in variants}
    tables: dict[tuple[str, str], DataFrame] = {}

    def rows_of(stage: str, pre: regimes.Preprocessing, fitting: DataFrame) -> DataFrame:
        """Feature rows of a stage; the learner reads them several times, so they are written."""
        holder = holders.get(pre.variant, pre.variant)
        name = "variant_" + "".join(v for v in variants if holders.get(v, v) == holder)
        unscaled = holder in ("A", "B")
        # one scaler for all rows can be applied to the features, so both stages share theirs
        key = (holder, "" if unscaled else stage)
        if key not in tables:
            if unscaled:
                matrix, cols = train, [*sensors, *(settings if holder == "B" else [])]
            else:
                most = pre
                if holder != pre.variant:
                    most = regimes.fit_variant(fitting, holder, sensors, settings, k, n_init=n_init, like=pre)
                matrix, cols = regimes.variant_matrix(train, most), most.inputs
            made = dense_arrays(matrix, cols, w, keep=["rul", "role"], gapless=True)
            tables[key] = written(made, f"{name}_{key[1]}" if key[1] else name)
        return scale_features(tables[key], pre.sensor_params, pre.inputs) if unscaled else tables[key]

    predictions, control = None, []
    first = final = None  # of the variant before: C and D have the same regimes
    for variant in variants:
        started = time.perf_counter()
        fitting = train.filter(F.col("role") == "inner_fit")
        first = regimes.fit_variant(fitting, variant, sensors, settings, k, n_init=n_init, like=first)
        inputs = feature_names(first.inputs)
        dense = rows_of("first", first, fitting)
        best = boosting.boost(dense, inputs, params, stop=F.col("role") == "inner_stop").best_iteration

        final = regimes.fit_variant(train, variant, sensors, settings, k, n_init=n_init, like=final)
        rows = rows_of("final", final, train)
        model = boosting.boost(rows, inputs, {**(params or {}), "maxIter": best + 1}).model
        held_features = features_at(
            regimes.variant_matrix(held, final), manifest, final.inputs, w, gapless=True
        )
        scored = models.predict(held_features, model).select(
            F.lit(variant).alias("variant"), UNIT, "cutoff_cycle", "true_raw_rul", "prediction"
        )
        predictions = scored if predictions is None else predictions.unionByName(scored)
        control.append((variant, len(final.inputs), best, time.perf_counter() - started))
    predictions = written(predictions, "variant_predictions")
    results = evaluate.fold_rows(predictions, ["variant"]).join(
        F.broadcast(
            spark.createDataFrame(
                control, "variant string, inputs int, best_iteration int, training_time double"
            )
        ),
        "variant",
    )
    return results, predictions


def run_benchmark(
    df: DataFrame,
    assignments: DataFrame,
    cols: Sequence[str],
    candidates: Sequence[Candidate],
    fractions: Sequence[float] = checkpoints.LATE_FRACTIONS,
    done: DataFrame | None = None,
    results_path: str | None = None,
) -> DataFrame:
    """Train/validation comparison of a grid; finished experiment ids are skipped.

    Finished are the ids in ``done`` and those stored in ``results_path``. Each
    result is appended there as it comes, keyed by experiment id, so an
    interrupted run can be resumed.
    """
    spark = df.sparkSession
    results_path = results_path or new_table_path(spark, "benchmark")
    grid = spark.createDataFrame([(c.id,) for c in candidates], "experiment_id string")
    stored = _stored(spark, results_path, "experiment_id string")
    for known in [stored] if done is None else [stored, done.select("experiment_id")]:
        grid = grid.join(known, "experiment_id", "left_anti")
    open_ids = {r[0] for r in grid.collect()}
    members = attach_units(df, assignments)
    train = add_target(members.filter(F.col("role") == "train"))
    held = members.filter(F.col("role") == "validation")
    manifest = checkpoints.checkpoint_manifest(lifetimes(held), fractions)
    inputs = feature_names(cols)
    todo = [c for c in candidates if c.id in open_ids]
    for w in sorted({c.window for c in todo}):
        dense = written(dense_features(train, cols, w, keep=["rul"], gapless=True), f"bench_w{w}")
        held_features = written(features_at(held, manifest, cols, w, gapless=True), f"bench_held_w{w}")
        for candidate in (c for c in todo if c.window == w):
            started = time.perf_counter()
            model = models.fit_model(candidate.model, dense, inputs, candidate.params)
            spent = time.perf_counter() - started
            scored = models.predict(held_features, model)
            row = scored.agg(*evaluate.metric_columns("true_raw_rul", "prediction")).select(
                F.lit(candidate.id).alias("experiment_id"),
                F.lit(candidate.model).alias("model"),
                F.lit(w).alias("window"),
                F.lit(candidate.text).alias("parameters"),
                "*",
                F.lit(spent).alias("training_time"),
            )
            append_new(row, results_path, ["experiment_id"])
    return spark.read.parquet(results_path)


GRID = (
    "model string, window int, overrides string, rmse double, mae double, r2 double, score_total double, "
    "score_mean double, bias double, prediction_std double, n long, training_time double"
)
# Overrides that change the rows a learner sees; all others are parameters of the learner.
TARGET_CAP = "cap"


class GridFailure(Exception):
    """Grid points that failed; every other point of the run is stored."""

    def __init__(self, failed: dict[str, BaseException]):
        super().__init__("; ".join(f"{name}: {error}" for name, error in sorted(failed.items())))
        self.failed = failed


class _Once:
    """Values made once by whichever thread asks first; the others wait for it."""

    def __init__(self) -> None:
        self.lock, self.locks, self.values = threading.Lock(), {}, {}

    def get(self, key, make: Callable):
        with self.lock:
            own = self.locks.setdefault(key, threading.Lock())
        with own:
            if key not in self.values:
                self.values[key] = make()
        return self.values[key]


def run_grid(
    df: DataFrame,
    assignments: DataFrame,
    cols: Sequence[str],
    grid: Sequence[Candidate],
    store: str,
    parallel: int = 4,
    fractions: Sequence[float] = checkpoints.LATE_FRACTIONS,
) -> tuple[DataFrame, DataFrame]:
    """Run an ablation grid, several points at once; returns results and predictions by ``experiment_id``.

    Up to ``parallel`` points are fitted side by side from one driver, each in a
    scheduler pool and job group of its own, so under the fair scheduler no long
    fit starves the others. The units' rows are written once and feature tables
    are made once per window. A point stores its predictions and then its result, under its id; what
    the folder ``store`` already holds is not run again, so a run that broke off
    is resumed by calling it once more. When points fail the others still end,
    and ``GridFailure`` names the failed; when the caller is interrupted, running
    points are cancelled.

    The override ``cap`` bounds the training target (errors are always those of
    the uncapped one); other overrides are parameters of the learner.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if len({c.id for c in grid}) != len(grid):
        raise ValueError("experiment ids repeat")
    results = f"{store}/results"
    kind = f"{GRID}, experiment_id string"
    done = {r[0] for r in _stored(spark, results, kind).select("experiment_id").distinct().collect()}
    todo = [c for c in grid if c.id not in done]
    members = attach_units(df, assignments)
    if todo:
        members = written(members, "grid_members")
    train = add_target(members.filter(F.col("role") == "train"))
    held = members.filter(F.col("role") == "validation")
    manifest = checkpoints.checkpoint_manifest(lifetimes(held), fractions)
    inputs = feature_names(cols)
    tables = _Once()
    stopped = threading.Event()

    def go_on() -> None:
        if stopped.is_set():
            raise InterruptedError("the grid was interrupted")

    def dense(w: int) -> DataFrame:
        return written(dense_features(train, cols, w, keep=["rul"], gapless=True), f"grid_w{w}")

    def fitting_rows(model: str, w: int, cap) -> DataFrame:
        # the mean takes nothing but the targets; a cap changes the target alone, so all caps share one table
        rows = train if model == "mean" else tables.get(("train", w), lambda: dense(w))
        return rows if cap is None else rows.withColumn("rul", F.least("rul", F.lit(cap)))

    def run(point: Candidate) -> None:
        sc.setLocalProperty("spark.scheduler.pool", f"grid-{point.id}")
        sc.setJobGroup(f"{store}:{point.id}", f"grid point {point.id}", interruptOnCancel=True)
        params = dict(point.params)
        cap = params.pop(TARGET_CAP, None)
        w = point.window
        rows = fitting_rows(point.model, w, cap)
        ends = tables.get(
            ("held", w), lambda: written(features_at(held, manifest, cols, w, gapless=True), f"grid_held_w{w}")
        )
        go_on()
        started = time.perf_counter()
        model = models.fit_model(point.model, rows, inputs, params)
        spent = time.perf_counter() - started
        go_on()
        path = f"{store}/predictions/experiment_id={point.id}"
        scored = models.predict(ends, model).select(
            UNIT, "cutoff_cycle", "true_raw_rul", "fraction", F.col("prediction").cast("double").alias("prediction")
        )
        scored.write.mode("overwrite").parquet(path)
        line = spark.read.schema(scored.schema).parquet(path).agg(
            *evaluate.metric_columns("true_raw_rul", "prediction")
        )
        # the result comes last: a point without one is run again as a whole
        line.select(
            F.lit(point.model).alias("model"),
            F.lit(w).alias("window"),
            F.lit(point.text).alias("overrides"),
            "*",
            F.lit(spent).alias("training_time"),
        ).write.mode("overwrite").parquet(f"{results}/experiment_id={point.id}")

    failed: dict[str, BaseException] = {}
    with ThreadPoolExecutor(max(1, parallel), thread_name_prefix="grid") as pool:
        running = {pool.submit(inheritable_thread_target(spark)(run), c): c for c in todo}
        try:
            for future in as_completed(running):
                if error := future.exception():
                    failed[running[future].id] = error
        except BaseException:
            stopped.set()
            for future, point in running.items():
                future.cancel()
                sc.cancelJobGroup(f"{store}:{point.id}")
            raise
    if failed:
        raise GridFailure(failed)
    predictions = spark.read.parquet(f"{store}/predictions")
    return _stored(spark, results, kind), predictions


def grid_points(
    windows: Sequence[int],
    models_: Sequence[str],
    overrides: Sequence[tuple[str, int, dict]] = (),
    seed: int = 42,
) -> list[Candidate]:
    """Every model at every window, then the named overrides, under the ids of ``selection.ablation_grid``."""
    runs = [(m, w, {}) for w in windows for m in models_] + list(overrides)
    return [Candidate(selection.experiment_id(m, w, o, seed), m, w, o) for m, w, o in runs]


def choose(rows: DataFrame, candidates: Sequence[Candidate], k: int) -> DataFrame:
    """Completeness gate, summary and selection rule in one step."""
    grid = rows.sparkSession.createDataFrame([(c.id,) for c in candidates], "candidate_id string")
    if not selection.cv_gaps(rows, grid, k).isEmpty():
        raise ValueError("cross-validation is incomplete")
    return selection.select_candidate(selection.cv_summary(rows), k)
