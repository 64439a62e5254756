"""Spark-native extras: event windows, TPC-H-like reports, cubes and outline recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editions
from ..streaming import events as ev
from .search import table


def events_tumbling(spark, sf_dir):
    return ev.tumbling(table(spark, sf_dir, "events"))


def events_sliding(spark, sf_dir):
    return ev.sliding(table(spark, sf_dir, "events"))


def events_session(spark, sf_dir):
    rows = ev.session_rows(table(spark, sf_dir, "events"))
    return rows.groupBy("user_id").agg(F.max("session_no").cast("long").alias("n_sessions"), F.count("*").alias("n_events"))


def events_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return ev.once(rows.unionByName(rows)).groupBy("event_type").agg(F.count("*").alias("n"))


def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


def top_orders(spark, sf_dir):
    """The ten open orders of one segment with the most revenue."""
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    found = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum("r"), 2).alias("revenue"))
    return found.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def nation_revenue(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("n"))


def status_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def outline_subtree(spark, sf_dir):
    """Transitive closure over a tree made of document ids: each id's parent is its half."""
    docs = table(spark, sf_dir, "documents").where("doc_id > 0")
    nodes = docs.select(F.col("doc_id").cast("string").alias("node_id"), F.floor(F.col("doc_id") / 2).cast("string").alias("parent_id"))
    return editions.subtree(nodes, "3").select("node_id", F.col("depth").cast("long").alias("depth"))


QUERIES = {f.__name__: f for f in (
    events_tumbling, events_sliding, events_session, events_dedup, pricing_summary, top_orders, nation_revenue, status_cube, outline_subtree,
)}

ORACLE_SQL = {
    "events_tumbling": """
        SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
            time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end FROM events GROUP BY ALL""",
    "events_sliding": """
        WITH w AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS window_start FROM events, range(2) r(k))
        SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, window_start, window_start + INTERVAL 1 HOUR AS window_end FROM w GROUP BY ALL""",
    "events_session": """
        WITH g AS (SELECT user_id, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS apart FROM events)
        SELECT user_id, sum((apart IS NULL OR apart >= 1800)::INT)::BIGINT AS n_sessions, count(*)::BIGINT AS n_events FROM g GROUP BY user_id""",
    "events_dedup": "SELECT event_type, count(DISTINCT event_id)::BIGINT AS n FROM events GROUP BY event_type",
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
            round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "top_orders": """
        SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "nation_revenue": """
        SELECT r_name, n_name, round(sum(l_extendedprice), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "status_cube": """
        SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "outline_subtree": """
        WITH RECURSIVE t(node_id, depth) AS (SELECT doc_id, 0 FROM documents WHERE doc_id = 3
            UNION ALL SELECT d.doc_id, depth + 1 FROM documents d JOIN t ON d.doc_id // 2 = t.node_id AND d.doc_id > 0)
        SELECT node_id::VARCHAR AS node_id, depth::BIGINT AS depth FROM t""",
}
