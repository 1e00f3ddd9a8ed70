"""Driver tables as logical inputs of the review operators. The SQL runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candorlake.session import MOST_SENT

REVIEWS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS review_id,
  CAST(o_custkey AS STRING) AS reviewer_user_id, c_name AS reviewer_name,
  concat('https://maps.example/place/data=!4m2!1s0x', CAST(l_suppkey AS STRING), '!2s', CAST(l_linenumber % 2 AS STRING)) AS place_url,
  CAST(l_suppkey AS STRING) AS place_id, CAST(l_partkey AS STRING) AS product_id, s_name AS place_name,
  CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS rating_stars,
  CAST(1 + l_suppkey % 40 / 10.0 AS DOUBLE) AS place_overall_rating, CAST(l_suppkey * 7 % 900 AS DOUBLE) AS place_total_reviews,
  l_shipdate + INTERVAL '1' HOUR * l_linenumber AS created_at,
  CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL '1' HOUR * (l_linenumber + CAST(l_quantity AS INT)) END AS edited_at,
  o_orderdate AS crawl_timestamp,
  CASE WHEN l_discount >= 0.05 THEN CAST(1 + l_partkey % 5 AS DOUBLE) END AS sub_rating_food,
  CASE WHEN l_discount >= 0.07 THEN CAST(1 + l_orderkey % 5 AS DOUBLE) END AS sub_rating_service,
  CASE WHEN l_tax >= 0.04 THEN CAST(1 + l_linenumber % 5 AS DOUBLE) END AS sub_rating_atmosphere,
  l_linestatus = 'F' AS has_review_text, c_mktsegment = 'BUILDING' AS reviewer_is_local_guide,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 11 AS DOUBLE) END AS reviewer_level,
  CAST(1 + o_custkey % 200 AS DOUBLE) AS reviewer_review_count, CAST(o_custkey % 97 AS DOUBLE) AS reviewer_photo_count,
  CASE WHEN l_linenumber % 3 = 0 THEN 'en' WHEN l_linenumber = 7 THEN 'unknown' ELSE 'de' END AS review_language,
  CASE WHEN l_returnflag <> 'N' THEN p_type END AS attr_meal_type, CASE WHEN p_size <= 40 THEN p_brand END AS attr_price_range
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
"""
EVENTS_SQL = """
SELECT CAST(event_id AS STRING) AS review_id, CAST(user_id AS STRING) AS reviewer_user_id,
  concat(event_type, '-', CAST(hour(ts) AS STRING)) AS place_id, ts AS created_at,
  CAST(1 + event_id % 5 AS DOUBLE) AS rating_stars, event_id % 3 <> 0 AS has_review_text, value, event_type
FROM {events}
"""
_TABLES = ("lineitem", "orders", "customer", "part", "supplier", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review-like rows of the order tables.

    REVIEWS_SQL with its joins in an order that moves little: lines, the longest table, meet the narrow tables first
    and the orders, with their customers' columns, last.
    """
    line, orders, customer, part, supplier = (table(spark, sf_dir, t) for t in _TABLES[:5])
    if supplier.count() <= MOST_SENT:
        supplier = F.broadcast(supplier)
    lines = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    return spark.sql(REVIEWS_SQL.split("FROM {lineitem}")[0] + "FROM {joined}", joined=joined)


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review-like rows of the events, dense in time."""
    return spark.sql(EVENTS_SQL, events=table(spark, sf_dir, "events"))


def for_duckdb(sql: str) -> str:
    """A query over r (reviews) and e (event reviews), with both as common table expressions."""
    named = {t: t for t in _TABLES}
    body = f"r AS ({REVIEWS_SQL.format(**named)}), e AS ({EVENTS_SQL.format(**named)})"
    sql = sql.strip()
    if sql[:4].upper() == "WITH":
        rest = sql[4:].lstrip()
        again = rest[:9].upper() == "RECURSIVE"
        return f"WITH {'RECURSIVE ' * again}{body}, {rest[9 * again:].lstrip()}"
    return f"WITH {body} {sql}"
