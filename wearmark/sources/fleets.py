"""Fleet views: business tables read as unit trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import wall_micros
from ..operators.segments import HOT_ROWS, flag_hot, number_rows, tasks_for

# Codes of the event types.
EVENT_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
# Codes of the line-item flags.
RETURN_CODES = {"A": 1, "N": 2, "R": 3}
STATUS_CODES = {"F": 1, "O": 2}

EVENT_SENSORS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]
SUPPLIER_SENSORS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]
SETTINGS = ["setting_1", "setting_2", "setting_3"]

MINUTE = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbering_tasks(spark: SparkSession, rows: DataFrame) -> int | None:
    """Shuffle partitions that bound the rows a task sorts; None where those of the session do."""
    tasks = tasks_for(spark, rows.count())
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _code(column: str, codes: dict[str, int]):
    expr = F.lit(0)
    for text, code in codes.items():
        expr = F.when(F.col(column) == text, F.lit(code)).otherwise(expr)
    return expr.cast("double")


def events_fleet(spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each user is a unit, each event a cycle (ordered by time, then id).

    Users with more than ``hot_rows`` events are numbered minute by minute.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit_id"), "event_id", "ts", "event_type", "value", "props"
    )
    flagged = flag_hot(events, ["unit_id"], "_hot", hot_rows).withColumn("_us", wall_micros("ts"))
    minute = F.when(F.col("_hot"), F.floor(F.col("_us") / MINUTE)).otherwise(F.lit(0))
    ordered = number_rows(
        flagged,
        ["unit_id"],
        ["_us", "event_id"],
        [minute],
        "cycle",
        previous={"_us_before": "_us"},
        tasks=numbering_tasks(spark, events),
    )
    return ordered.select(
        "unit_id",
        "cycle",
        F.hour("ts").cast("double").alias("setting_1"),
        F.dayofweek("ts").cast("double").alias("setting_2"),
        _code("event_type", EVENT_CODES).alias("setting_3"),
        F.col("value").cast("double").alias("sensor_1"),
        F.get_json_object("props", "$.k").cast("double").alias("sensor_2"),
        F.coalesce((F.col("_us") - F.col("_us_before")) / F.lit(1e6), F.lit(0.0)).alias("sensor_3"),
        F.lit(1.0).alias("sensor_4"),
    )


def supplier_fleet(
    spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS, tasks: int | None = None
) -> DataFrame:
    """Each supplier is a unit, each shipped line item a cycle.

    Hot suppliers are numbered by ship day and range of order keys.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("unit_id"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )
    flagged = flag_hot(lines, ["unit_id"], "_hot", hot_rows)
    day = F.when(F.col("_hot"), F.unix_date(F.to_date("l_shipdate"))).otherwise(F.lit(0))
    keys = F.when(F.col("_hot"), F.floor(F.col("l_orderkey") / 1_000_000)).otherwise(F.lit(0))
    order = ["_day", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    ordered = number_rows(
        flagged.withColumn("_day", F.unix_date(F.to_date("l_shipdate"))),
        ["unit_id"],
        order,
        [day, keys],
        "cycle",
        tasks=tasks or numbering_tasks(spark, lines),
    )
    return ordered.select("unit_id", "cycle", *_supplier_readings())


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``supplier_fleet`` without their cycles, for fits that no order enters: one scan, no shuffle."""
    placed = F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull()
    return table(spark, sf_dir, "lineitem").filter(placed).select(
        F.col("l_suppkey").alias("unit_id"), *_supplier_readings()
    )


def _supplier_readings() -> list:
    return [
        F.month("l_shipdate").cast("double").alias("setting_1"),
        _code("l_returnflag", RETURN_CODES).alias("setting_2"),
        _code("l_linestatus", STATUS_CODES).alias("setting_3"),
        F.col("l_quantity").alias("sensor_1"),
        F.col("l_extendedprice").alias("sensor_2"),
        F.col("l_discount").alias("sensor_3"),
        F.col("l_tax").alias("sensor_4"),
    ]
