"""Cross-validation summaries, selection rules, ablation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .quantiles import exact_median

SUMMARY_METRICS = ("rmse", "mae", "r2", "score_total", "score_per_unit", "bias", "training_time")
SUMMARY_ATTRIBUTES = ("model", "window", "parameters", "notes")


def cv_gaps(fold_rows: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Missing and repeated (candidate, fold) pairs; empty when the CV is complete."""
    grid = candidates.select("candidate_id").distinct().withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.lit(k)))
    )
    seen = fold_rows.groupBy("candidate_id", F.col("fold").cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return (
        grid.join(seen, ["candidate_id", "fold"], "full_outer")
        .fillna({"rows": 0})
        .join(grid.withColumn("_wanted", F.lit(True)), ["candidate_id", "fold"], "left")
        .withColumn(
            "problem",
            F.when(F.col("_wanted").isNull(), "unexpected")
            .when(F.col("rows") == 0, "missing")
            .when(F.col("rows") > 1, "repeated"),
        )
        .filter(F.col("problem").isNotNull())
        .drop("_wanted")
    )


def cv_summary(
    fold_rows: DataFrame, metrics: Sequence[str] = SUMMARY_METRICS, digits: int = 4
) -> DataFrame:
    """Mean and sample std of each metric over folds; other attributes from the first fold."""
    aggs = [F.count(F.lit(1)).alias("folds")]
    for name in SUMMARY_ATTRIBUTES:
        if name in fold_rows.columns:
            aggs.append(F.min_by(name, "fold").alias(name))
    for m in metrics:
        if m in fold_rows.columns:
            aggs += [
                (F.round(F.avg(m), digits) + F.lit(0.0)).alias(f"{m}_mean"),
                F.round(F.stddev_samp(m), digits).alias(f"{m}_std"),
            ]
    return fold_rows.groupBy("candidate_id").agg(*aggs)


def select_candidate(summary: DataFrame, k: int = 5) -> DataFrame:
    """Apply the pre-stated rule to the summary; one line per candidate.

    The lowest mean score per unit leads. Candidates within one pooled standard
    error of the leader are tied with it; the lowest RMSE, then the smallest
    absolute bias, then the id decides. The accuracy champion is marked apart.
    """
    leader = (
        summary.orderBy("score_per_unit_mean", "candidate_id")
        .limit(1)
        .select(
            F.col("candidate_id").alias("_best"),
            F.col("score_per_unit_mean").alias("_mean"),
            F.col("score_per_unit_std").alias("_std"),
        )
    )
    # the summary has one line per candidate of a hand-written list
    near = summary.crossJoin(F.broadcast(leader))
    error = F.sqrt(
        (F.col("score_per_unit_std") * F.col("score_per_unit_std") + F.col("_std") * F.col("_std")) / k
    )
    tied = (F.col("candidate_id") == F.col("_best")) | F.coalesce(
        F.abs(F.col("_mean") - F.col("score_per_unit_mean")) < error, F.lit(False)
    )
    marked = near.withColumn("tied", tied)
    choice = Window.partitionBy(F.lit(1)).orderBy(
        F.desc("tied"), "rmse_mean", F.abs("bias_mean"), "candidate_id"
    )
    accuracy = Window.partitionBy(F.lit(1)).orderBy("rmse_mean", "candidate_id")
    return marked.withColumns(
        {
            "selected": F.row_number().over(choice) == 1,
            "accuracy_champion": F.row_number().over(accuracy) == 1,
        }
    ).drop("_best", "_mean", "_std")


def select_variant(results: DataFrame) -> DataFrame:
    """Best variant by score per unit, then RMSE, then absolute bias."""
    return results.orderBy("score_per_unit", "rmse", F.abs("bias"), "variant").limit(1)


def final_rounds(best_rounds: DataFrame, kind: str = "best_iteration") -> DataFrame:
    """Rounds of the final fit per candidate: rounded median over folds.

    Iterations are 0-based, so one is added; epochs are counts already.
    """
    extra = 1 if kind == "best_iteration" else 0
    medians = exact_median(best_rounds, kind, by=["candidate_id"], levels=0)
    folds = best_rounds.groupBy("candidate_id").agg(F.count(kind).alias("folds"))
    return medians.join(folds, "candidate_id").select(
        "candidate_id", (F.bround("median", 0).cast("long") + extra).alias("rounds"), "folds"
    )


def experiment_id(model: str, window: int, overrides: dict, seed: int = 42) -> str:
    return f"{model}_w{window}" + "".join(f"_{k}{v}" for k, v in sorted(overrides.items())) + f"_s{seed}"


def ablation_grid(
    spark,
    windows: Sequence[int],
    models: Sequence[str],
    overrides: Sequence[tuple[str, int, dict]] = (),
    done: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """Experiments still to run: model x window, plus named overrides, minus finished ids."""
    runs = [(m, w, {}) for w in windows for m in models] + list(overrides)
    rows = [
        (
            experiment_id(m, w, o, seed),
            m,
            w,
            ";".join(f"{k}={v}" for k, v in sorted(o.items())),
        )
        for m, w, o in runs
    ]
    grid = spark.createDataFrame(rows, "experiment_id string, model string, window int, overrides string")
    if done is None:
        return grid
    return grid.join(done.select("experiment_id"), "experiment_id", "left_anti")


def parse_runs(df: DataFrame, default: str, notes: str = "notes") -> DataFrame:
    """Columns of a run's free-text notes of ``key=value`` words.

    ``variant`` (``default`` when not noted) is further cut at its underscores
    into ``window``, ``cap`` and ``sensors``, each behind a letter of its own but
    for the last; ``loss`` is ``-`` when not noted.
    """
    value = lambda key: F.regexp_extract(F.coalesce(F.col(notes), F.lit("")), rf"\b{key}=(\S+)", 1)
    noted = lambda key, other: F.when(value(key) == "", F.lit(other)).otherwise(value(key))
    named = df.withColumns({"variant": noted("variant", default), "loss": noted("loss", "-")})
    part = lambda i: F.get(F.split("variant", "_"), F.lit(i))
    behind = lambda c: F.substring(c, F.lit(2), F.length(c))
    return named.withColumns(
        {"window": behind(part(0)).try_cast("int"), "cap": behind(part(1)), "sensors": part(2)}
    )


def label_changes(df: DataFrame, baseline: dict[str, str], out: str = "factor") -> DataFrame:
    """Label each run by the attributes in which it differs from a baseline run.

    ``baseline`` names the attributes, in the order of the label, and the
    baseline's values; null counts as a value. ``out`` joins ``attribute=value``
    of the changed ones and ``changed`` counts them: one change is a controlled
    ablation, several are a combined one. Runs equal to the baseline drop out.
    """
    changes = [
        F.when(~F.col(name).cast("string").eqNullSafe(F.lit(value)), F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
        for name, value in baseline.items()
    ]
    found = F.array_compact(F.array(*changes))
    return df.withColumns({out: F.array_join(found, "; "), "changed": F.size(found)}).filter(F.col("changed") > 0)


def check_prediction_counts(df: DataFrame, by: Sequence[str], keys: Sequence[str], expected: int) -> DataFrame:
    """Per group: rows, repeated keys, and whether both are as they should be."""
    per_key = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("repeated")
    ).withColumn("passed", (F.col("rows") == expected) & (F.col("repeated") == 0))
