import pytest
from pyspark.sql import functions as F

from wearmark.operators import checkpoints, profile, splits

# Calibration units of the published seed-42 split of 100 units.
CALIBRATION = {22, 27, 31, 33, 34, 38, 46, 49, 50, 77, 81, 84, 88, 93, 97}


@pytest.fixture(scope="module")
def hundred(spark):
    return spark.range(1, 101).withColumnRenamed("id", "unit_id")


def sizes(roles):
    return {r["role"]: r["count"] for r in roles.groupBy("role").count().collect()}


@pytest.mark.parametrize("method", ["hash", "mt19937"])
def test_split_sizes(spark, hundred, method):
    assert sizes(splits.split_units(hundred, method=method)) == {"train": 80, "validation": 20}
    assert sizes(splits.split_units(hundred, splits.THREE_WAY, method=method)) == {
        "train": 70,
        "validation": 15,
        "calibration": 15,
    }
    many = spark.range(1, 250).withColumnRenamed("id", "unit_id")
    assert sizes(splits.split_units(many, splits.THREE_WAY, method=method)) == {
        "train": 175,
        "validation": 37,
        "calibration": 37,
    }


def test_seed_changes_the_split_and_order_does_not(hundred):
    a = splits.split_units(hundred, seed=42)
    assert a.exceptAll(splits.split_units(hundred.orderBy(F.desc("unit_id")), seed=42)).isEmpty()
    assert not a.exceptAll(splits.split_units(hundred, seed=7)).isEmpty()


def test_python_shuffle_gives_the_published_calibration_set(hundred):
    roles = splits.split_units(hundred, splits.THREE_WAY, 42, "mt19937")
    assert {r[0] for r in roles.filter("role = 'calibration'").select("unit_id").collect()} == CALIBRATION
    with pytest.raises(ValueError):
        splits.ranked_units(hundred, 42, method="mt19937", limit=10)


def test_folds_inner_split_and_guards(spark, hundred):
    calibration = spark.createDataFrame([(i,) for i in sorted(CALIBRATION)], "unit_id long")
    dev = splits.development_units(hundred, calibration)
    assert dev.count() == 85
    folds = splits.group_folds(dev, 5)
    assert [r["count"] for r in folds.groupBy("fold").count().collect()] == [17] * 5
    assigned = splits.fold_assignments(folds, 5)
    inner = splits.inner_split(assigned, 10)
    counted = {(r["fold"], r["role"]): r["count"] for r in inner.groupBy("fold", "role").count().collect()}
    assert set(counted.values()) == {58, 10} and len(counted) == 10
    held = assigned.filter("role = 'outer_eval'").select("unit_id", "fold")
    assert inner.join(held, ["unit_id", "fold"], "left_semi").isEmpty()
    for table in (assigned, inner.unionByName(assigned.filter("role = 'outer_eval'"))):
        assert all(r["passed"] for r in splits.check_assignments(table, dev, calibration).collect())
    leak = assigned.unionByName(spark.createDataFrame([(22, 1, "outer_train")], assigned.schema))
    bad = {r["check"] for r in splits.check_assignments(leak, dev, calibration).collect() if not r["passed"]}
    assert bad == {"no_unknown_units", "calibration_untouched"}
    two = assigned.unionByName(spark.createDataFrame([(1, f, "inner_fit") for f in (1, 2)], assigned.schema))
    assert not splits.check_assignments(two, dev).filter("check = 'roles_disjoint'").first()["passed"]


def test_uneven_folds(hundred, spark):
    with pytest.raises(Exception, match="equal folds"):
        splits.group_folds(hundred, 7).collect()
    loose = splits.group_folds(hundred, 7, strict=False).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in loose] == [15, 15, 14, 14, 14, 14, 14]
    with pytest.raises(ValueError):
        splits.development_units(hundred, spark.createDataFrame([(500,)], "unit_id long"))


def test_rows_for_and_final_population(spark, ramp):
    roles = spark.createDataFrame(
        [(1, "train"), (2, "validation"), (3, "calibration"), (4, "train")], "unit_id long, role string"
    )
    rows = splits.rows_for(ramp, roles, "train", segment_rows=16)
    assert rows.count() == 160
    assert {r[0] for r in splits.final_fit_units(roles).collect()} == {1, 2, 4}


def test_manifest_bounds_and_rounding(spark):
    life = spark.createDataFrame([(i, 128 + i % 50) for i in range(1, 101)], "unit_id long, lifetime long")
    manifest = checkpoints.checkpoint_manifest(life)
    assert manifest.count() == 500
    assert all(r["passed"] for r in checkpoints.check_manifest(manifest).collect())
    facts = profile.manifest_summary(manifest).first()
    assert facts["samples_per_unit"] == 5 and facts["fractions"] == list(checkpoints.BALANCED_FRACTIONS)
    half = spark.createDataFrame([(1, 5), (2, 7), (3, 2)], "unit_id long, lifetime long")
    got = {r["unit_id"]: r["cutoff_cycle"] for r in checkpoints.checkpoint_manifest(half, [0.5]).collect()}
    assert got == {1: 2, 2: 4, 3: 1}
    tiny = checkpoints.check_manifest(checkpoints.checkpoint_manifest(half))
    assert not tiny.filter("check = 'cutoffs_unique'").first()["passed"]


def test_manifest_roles_terminal_and_diff(spark, ramp):
    life = profile.lifetimes(ramp)
    roles = spark.createDataFrame([(1, 1, "outer_eval"), (2, 2, "outer_eval"), (4, 1, "outer_train")], "unit_id long, fold int, role string")
    by_role = checkpoints.manifests_by_role(life, roles)
    assert {(r[0], r[1]) for r in by_role.select("unit_id", "fold").distinct().collect()} == {(1, 1), (2, 2)}
    ends = {r["unit_id"]: r["cutoff_cycle"] for r in checkpoints.terminal_manifest(ramp).collect()}
    assert ends == {1: 40, 2: 35, 3: 10, 4: 120}
    a = checkpoints.checkpoint_manifest(life)
    assert checkpoints.manifest_diff(a, a.orderBy(F.rand())).isEmpty()
    diff = checkpoints.manifest_diff(a, a.filter("unit_id <> 3"))
    assert diff.count() == 5 and diff.filter("side = 'right'").isEmpty()
    stacked = checkpoints.union_folds({1: a.filter("unit_id = 1"), 2: a.filter("unit_id = 2")})
    assert stacked.groupBy("fold").count().count() == 2


def test_lifetime_of_one_is_an_error(spark):
    life = spark.createDataFrame([(1, 1), (2, 50)], "unit_id long, lifetime long")
    with pytest.raises(Exception, match="lifetime of 1"):
        checkpoints.checkpoint_manifest(life).collect()
