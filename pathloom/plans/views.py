"""Event logs as views of the test tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = {"signup": "triage", "view": "registration", "click": "assessment", "error": "consult request", "purchase": "discharge"}
DISPOSITIONS = {"F": "Admitted inpatient", "P": "Left Without Being Seen", "O": "Discharged home"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cases: a user's events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("_seq"),
        F.get_json_object("props", "$.k").alias("resource"),
        "value",
    )


def log_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short cases: a user's day."""
    case = F.concat_ws("|", F.col("case_id").cast("string"), F.date_format("timestamp", "yyyy-MM-dd"))
    return log(spark, sf_dir).withColumn("case_id", case)


def log_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short cases with nulls, midnights, ties and repeated rows."""
    day = log_day(spark, sf_dir)
    n = F.col("_seq")
    to = lambda unit: F.date_trunc(unit, "timestamp").cast("timestamp_ntz")
    rows = day.select(
        "case_id",
        F.when(n % 17 != 0, F.col("activity")).alias("activity"),
        F.when(n % 23 == 0, to("day")).when(n % 19 == 0, to("hour")).otherwise(F.col("timestamp")).alias("timestamp"),
        "_seq",
        F.when(n % 11 != 0, F.col("resource")).alias("resource"),
        F.when(n % 7 != 0, F.col("value")).alias("value"),
    )
    return rows.unionByName(rows.where(n % 29 == 0).withColumn("_seq", n + 1_000_000_000))


def log_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' line items: midnights only, many ties."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("_seq"),
        F.col("l_suppkey").cast("string").alias("resource"),
        F.col("l_quantity").alias("value"),
    )


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log whose first events carry an outcome: an order's status."""
    orders = table(spark, sf_dir, "orders")
    pairs = [F.lit(x) for kv in DISPOSITIONS.items() for x in kv]
    return orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.lit("close").alias("activity"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderkey").alias("_seq"),
        F.create_map(*pairs)[F.col("o_orderstatus")].alias("disposition_desc"),
    )


def log_disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short cases whose events carry an outcome: the status of the order that
    has the user's number."""
    outcome = dispositions(spark, sf_dir).select(F.col("case_id").alias("user"), "disposition_desc")
    day = log_day(spark, sf_dir).withColumn("user", F.substring_index("case_id", "|", 1).cast("long"))
    return day.join(outcome, "user", "left").drop("user")


def log_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: a turn a minute."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    minute = F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("role").alias("activity"), (start + minute).alias("timestamp"), F.col("turn").alias("_seq")
    )


_DAY = "concat_ws('|', CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d'))"
_EVENT = "event_type AS activity, ts AS timestamp, event_id AS _seq, json_extract_string(props, '$.k') AS resource, value"
#: The same views as common table expressions.
SQL = {
    "log": f"log AS (SELECT user_id AS case_id, {_EVENT} FROM events)",
    "day": f"day AS (SELECT {_DAY} AS case_id, {_EVENT} FROM events)",
    "dirty": f"""dirty0 AS (SELECT {_DAY} AS case_id, CASE WHEN event_id % 17 <> 0 THEN event_type END AS activity,
        CASE WHEN event_id % 23 = 0 THEN date_trunc('day', ts) WHEN event_id % 19 = 0 THEN date_trunc('hour', ts) ELSE ts END AS timestamp,
        event_id AS _seq, CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') END AS resource,
        CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events),
      dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * REPLACE (_seq + 1000000000 AS _seq) FROM dirty0 WHERE _seq % 29 = 0)""",
    "ship": """ship AS (SELECT l_orderkey AS case_id, l_returnflag || l_linestatus AS activity, l_shipdate AS timestamp,
        CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS _seq, CAST(l_suppkey AS VARCHAR) AS resource, l_quantity AS value FROM lineitem)""",
    "outcome": """outcome AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'Admitted inpatient'
        WHEN 'P' THEN 'Left Without Being Seen' WHEN 'O' THEN 'Discharged home' END AS disposition_desc FROM orders)""",
    "disposed": """disposed AS (SELECT day.*, disposition_desc FROM day LEFT JOIN outcome ON outcome.case_id = CAST(split_part(day.case_id, '|', 1) AS BIGINT))""",
    "conv": """conv AS (SELECT conv_id AS case_id, role AS activity, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INT)) AS timestamp,
        turn AS _seq FROM conversations)""",
    "stages": f"""stages AS (SELECT user_id AS case_id, CASE event_type WHEN 'signup' THEN 'triage' WHEN 'view' THEN 'registration'
        WHEN 'click' THEN 'assessment' WHEN 'error' THEN 'consult request' WHEN 'purchase' THEN 'discharge' END AS activity,
        ts AS timestamp, event_id AS _seq, value FROM events)""",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + ("," if body.lstrip().startswith("+") else "") + "\n" + body.lstrip().removeprefix("+")
