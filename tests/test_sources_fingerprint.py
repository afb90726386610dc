import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wearmark.functions import general_format
from wearmark.operators import fingerprint
from wearmark.sources import manifests, sinks, text


def test_trajectory_text(spark, tmp_path):
    (tmp_path / "train_FD009.txt").write_text("1 1   0.5  100.0 1e2 \n1 2 -0.5 100 7\n\n 2 1 0 0 0\n")
    df = text.read_trajectories(spark, str(tmp_path), "FD009", width=5)
    got = df.orderBy("row_idx").drop("row_idx").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0.5, 100.0, 100.0), (1, 2, -0.5, 100.0, 7.0), (2, 1, 0.0, 0.0, 0.0)]
    assert df.columns[:3] == ["unit_id", "cycle", "setting_1"]


def test_labels_and_canonical_names(spark, tmp_path):
    (tmp_path / "RUL_FD009.txt").write_text("112 \n98\n69\n")
    got = text.read_labels(spark, str(tmp_path), "FD009").orderBy("unit_id").collect()
    assert [tuple(r) for r in got] == [(1, 112), (2, 98), (3, 69)]
    assert text.canonical_columns(spark.createDataFrame([(1, 2, 3.0)], "a int, b int, c double")).columns == ["unit_id", "cycle", "setting_1"]
    with pytest.raises(ValueError):
        text.canonical_columns(spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(27)]))


def test_split_documents(spark, tmp_path):
    path = tmp_path / "split.json"
    path.write_text(json.dumps({"seed": 42, "train_engine_ids": [1, 2], "validation_engine_ids": [3]}, indent=2))
    assert {tuple(r) for r in manifests.read_split_json(spark, str(path)).collect()} == {(1, "train"), (2, "train"), (3, "validation")}
    path.write_text(json.dumps({"train_engine_ids": [1, 2], "validation_engine_ids": [2]}))
    with pytest.raises(ValueError):
        manifests.read_split_json(spark, str(path))
    cv = tmp_path / "cv.json"
    cv.write_text(json.dumps({"folds": [{"fold": 1, "training_engine_ids": [2], "validation_engine_ids": [1]},
                                        {"fold": 2, "training_engine_ids": [1], "validation_engine_ids": [2]}]}, indent=1))
    assert manifests.read_folds_json(spark, str(cv)).filter("role = 'outer_eval'").count() == 2


def test_append_rules(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.append_new(df, path, ["k"]).count() == 2
    more = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "k int, v string")
    stored = sinks.append_new(more, path, ["k"])
    assert stored.count() == 3 and stored.filter("k = 2").first()["v"] == "b"
    with pytest.raises(ValueError):
        sinks.append_new(df, path, ["k"], "fail")
    with pytest.raises(ValueError):
        sinks.append_new(spark.createDataFrame([(9, "a"), (9, "b")], "k int, v string"), path, ["k"], "fail")
    assert sinks.append_new(spark.createDataFrame([(9, "a")], "k int, v string"), path, ["k"], "fail").count() == 4


def test_projection(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert tuple(sinks.project_columns(df, ["b", "a", "zzz"]).first()) == ("", "1", "")


@pytest.mark.parametrize(
    "value", [0.25, 30.0, 1234567.0, 1e-5, 0.0001, 100000.0, 999999.5, -2.5, 0.0, 3.14159265, 1e22, 123456.0, 1e-300]
)
def test_general_format_follows_c(spark, value):
    assert spark.range(1).select(general_format(F.lit(value))).first()[0] == f"{value:g}"


def test_fingerprints_ignore_order_and_number_form(spark):
    a = spark.createDataFrame([(1, 30.0, None), (2, 0.25, "x,y")], "id long, f double, t string")
    b = spark.createDataFrame([(2, 0.25, "x,y"), (1, 30.0000001, "")], "id long, f double, t string")
    c = spark.createDataFrame([(2, 0.25, "x,y"), (1, 30.1, "")], "id long, f double, t string")
    for f in (fingerprint.table_fingerprint, fingerprint.canonical_hash):
        assert f(a).collect() == f(b).collect() != f(c).collect()
    with pytest.raises(Exception, match="table_fingerprint"):
        fingerprint.canonical_hash(a, max_rows=1).collect()
    twice = a.unionByName(a.filter("id = 1")).unionByName(a.filter("id = 1"))
    assert fingerprint.table_fingerprint(twice).first()["rows"] == 4


def test_canonical_hash_is_sha256_of_sorted_csv(spark):
    import hashlib

    df = spark.createDataFrame([(10, 0.5), (9, 1.0)], "id long, f double")
    want = hashlib.sha256(b"id,f\n9,1\n10,0.5\n").hexdigest()
    assert fingerprint.canonical_hash(df).first()["sha256"] == want
    ids = hashlib.sha256(b"[9,10]").hexdigest()
    assert fingerprint.id_set_hash(df, "id").first()["sha256"] == ids


def test_canonical_hash_of_many_rows_is_that_of_one_text(spark):
    import hashlib

    rows = 230_000
    df = spark.range(rows).select((F.lit(7) * F.col("id") % rows).alias("id"), (F.col("id") % 3 / 2).alias("f"))
    doubled = df.unionByName(df.filter("id < 50000"))
    lines = sorted([(7 * i % rows, i % 3 / 2) for i in range(rows)])
    lines = [x for x in lines for _ in range(2 if x[0] < 50000 else 1)]
    want = hashlib.sha256(("id,f\n" + "".join(f"{i},{f:g}\n" for i, f in lines)).encode()).hexdigest()
    assert tuple(fingerprint.canonical_hash(doubled.repartition(5)).first()) == (rows + 50000, want)
    nothing = fingerprint.canonical_hash(df.limit(0)).collect()
    assert [tuple(r) for r in nothing] == [(0, hashlib.sha256(b"id,f\n").hexdigest())]


def test_verify(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "table string, rows long")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "table string, rows long")
    assert {r["table"]: r["passed"] for r in fingerprint.verify_fingerprints(old, new).collect()} == {"a": True, "b": False, "c": False}


def test_label_folder_keeps_file_order(spark, tmp_path):
    (tmp_path / "part-0").write_text("1\n2\n")
    (tmp_path / "part-1").write_text("\n".join(map(str, range(3, 40))) + "\n\n")
    (tmp_path / "part-2").write_text("40\n")
    got = {r["unit_id"]: r["true_rul"] for r in text.read_labels(spark, str(tmp_path)).collect()}
    assert got == {i: i for i in range(1, 41)}


def test_tree_hash_by_hand(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, None)]
    df = spark.createDataFrame(rows, "k long, v string")
    tree = {(r["level"], r["node"]): r for r in fingerprint.tree_hash(df, depth=1).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = {}
    for k, v, n in ((1, "a", 1), (2, "b", 2), (3, "", 1)):
        h = sha(f"{k}\x1f{v}")
        leaves.setdefault(h[0], []).append(f"{h}:{n}")
    want = {node: sha(",".join(sorted(lines))) for node, lines in leaves.items()}
    assert {node: r["sha256"] for (level, node), r in tree.items() if level == 1} == want
    assert tree[0, ""]["sha256"] == sha(",".join(f"{n}:{h}" for n, h in sorted(want.items())))
    assert tree[0, ""]["rows"] == 4
    empty = fingerprint.tree_hash(df.limit(0)).collect()
    assert [(r["level"], r["rows"], r["sha256"]) for r in empty] == [(0, 0, sha(""))]


def test_tree_hash_ignores_order_and_locates_changes(spark):
    df = spark.range(5000).select("id", (F.col("id") / 7).alias("x"), F.lit("c").alias("c"))
    roots = [
        fingerprint.tree_hash(frame, depth=2, by=["id"])
        for frame in (df, df.orderBy(F.desc("x")).repartition(7), df.withColumn("x", F.when(F.col("id") == 77, 0.0).otherwise(F.col("x"))))
    ]
    assert fingerprint.tree_changes(roots[0], roots[1]).isEmpty()
    changes = fingerprint.tree_changes(roots[0], roots[2])
    assert sorted(r["level"] for r in changes.collect()) == [0, 1, 2]
    found = fingerprint.rows_under(df, changes, 2, by=["id"])
    assert found.filter("id = 77").count() == 1 and found.count() < 100
    gone = fingerprint.tree_changes(roots[0], fingerprint.tree_hash(df.filter("id != 77"), depth=2, by=["id"]))
    assert {r["rows_before"] - r["rows_after"] for r in gone.collect()} == {1}


def test_tree_depth_grows_with_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "LEAF_ROWS", 10)
    assert [fingerprint.tree_depth(spark.range(n)) for n in (0, 10, 11, 160, 161)] == [0, 0, 1, 1, 2]
