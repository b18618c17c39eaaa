"""Interval views of the provided tables.

metrics: one series per user and event type; a sample lasts until the series' next event.
phases: one series per user; a phase lasts until the user's next event of any type.
shipments: one interval per order line, from the order to the shipment, in days.

Times are kept as whole microseconds until the view is done, so equal times stay equal as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import DURATION, END, START


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros.alias("us"))
    least = events.agg(F.min("us")).scalar()
    return events.withColumn("us", F.col("us") - least)


def _lasting(events: DataFrame, series: list[str]) -> DataFrame:
    after = F.lead("us").over(Window.partitionBy(*series).orderBy("us", "event_id"))
    timed = events.withColumn("until", after).filter(F.col("until") > F.col("us"))
    seconds = {START: F.col("us") / 1e6, END: F.col("until") / 1e6}
    return timed.withColumns(seconds).withColumn(DURATION, F.col(END) - F.col(START))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = ["user_id", "event_type"]
    events = _events(spark, sf_dir).withColumn("capacity", F.max("value").over(Window.partitionBy(*series)))
    user = F.concat(F.lit("/user[id="), F.col("user_id").cast("string"), F.lit("]:"), F.col("event_type"))
    return _lasting(events, series).select(
        START, END, DURATION, F.when(F.col("capacity") == 0, 0.0).otherwise(F.col("value") / F.col("capacity")).alias("utilization"), F.col("value").alias("usage"), "capacity",
        user.alias("path"), F.concat(F.lit("/user:"), F.col("event_type")).alias("type"), "user_id",
    )


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/user[id="), F.col("user_id").cast("string"), F.lit("]/"), F.col("event_type"), F.lit("[n="), F.col("event_id").cast("string"), F.lit("]"))
    return _lasting(_events(spark, sf_dir), ["user_id"]).select(START, END, DURATION, path.alias("path"), F.concat(F.lit("/user/"), F.col("event_type")).alias("type"), "user_id")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as intervals of days since the first order or shipment, under a path of region, nation, customer, order and line."""
    day = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") / 86400e6
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    least = orders.agg(F.min(day("o_orderdate"))).scalar()
    places = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # An order's part of the path is made before its lines are met: once, and lines are moved only once.
    parts = [F.lit(""), F.col("r_name"), F.col("n_name"), F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")]
    placed = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", (day("o_orderdate") - least).alias(START), F.concat_ws("/", *parts).alias("order"))
    rows = placed.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    timed = rows.withColumns({END: day("l_shipdate") - least, "path": F.concat_ws("/", "order", F.col("l_linenumber").cast("string"))})
    return timed.filter(F.col(END) > F.col(START)).withColumn(DURATION, F.col(END) - F.col(START)).select(START, END, DURATION, "path", F.col("l_quantity").alias("quantity"))


def rules(spark: SparkSession) -> DataFrame:
    """Fixed attribution rules for the event types."""
    return spark.createDataFrame([("/user/click", "exact", 5.0), ("/user/purchase", "variable", 2.0), ("/user/view", "variable", 1.0), ("/user/signup", "variable", 0.5)], "type string, rule string, demand double")


#: The same views as common table expressions for DuckDB.
SQL = """
ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS us FROM events),
m0 AS (SELECT *, lead(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS u2, max(value) OVER (PARTITION BY user_id, event_type) AS capacity FROM ev),
metrics AS (SELECT us / 1e6 AS s, u2 / 1e6 AS e, u2 / 1e6 - us / 1e6 AS d, CASE WHEN capacity = 0 THEN 0.0 ELSE value / capacity END AS utilization, value AS usage, capacity,
  '/user[id=' || user_id || ']:' || event_type AS path, '/user:' || event_type AS type, user_id FROM m0 WHERE u2 > us),
p0 AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS u2 FROM ev),
phases AS (SELECT us / 1e6 AS s, u2 / 1e6 AS e, u2 / 1e6 - us / 1e6 AS d, '/user[id=' || user_id || ']/' || event_type || '[n=' || event_id || ']' AS path, '/user/' || event_type AS type, user_id FROM p0 WHERE u2 > us),
rules AS (SELECT * FROM (VALUES ('/user/click', 5.0::DOUBLE, 0.0::DOUBLE), ('/user/purchase', 0.0, 2.0), ('/user/view', 0.0, 1.0), ('/user/signup', 0.0, 0.5)) t(type, exact, variable))
"""
