"""Lenses: the test tables as build graphs, histories, manifests, traces and trees.

Each lens is a pair: a function that gives DataFrames, and SQL for the same tables, which
the oracles start from. Money is DECIMAL, ties are broken, and names are strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..shared import table

MONEY = "decimal(12,2)"


def named(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders depend on their customer, customers on their nation, nations on their region."""
    zero = F.lit(0).cast(MONEY).alias("w")
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = [
        region.select(named("R", "r_regionkey").alias("key"), zero),
        nation.select(named("N", "n_nationkey").alias("key"), zero),
        customer.select(named("C", "c_custkey").alias("key"), F.abs("c_acctbal").cast(MONEY).alias("w")),
        orders.select(named("O", "o_orderkey").alias("key"), F.col("o_totalprice").cast(MONEY).alias("w")),
    ]
    edges = [
        nation.select(named("N", "n_nationkey").alias("key"), named("R", "n_regionkey").alias("dep")),
        customer.select(named("C", "c_custkey").alias("key"), named("N", "c_nationkey").alias("dep")),
        orders.select(named("O", "o_orderkey").alias("key"), named("C", "o_custkey").alias("dep")),
    ]
    return nodes[0].union(nodes[1]).union(nodes[2]).union(nodes[3]), edges[0].union(edges[1]).union(edges[2])


FOREST = f"""nodes AS (SELECT 'R' || r_regionkey AS key, CAST(0 AS {MONEY}) AS w FROM region UNION ALL SELECT 'N' || n_nationkey, CAST(0 AS {MONEY}) FROM nation
 UNION ALL SELECT 'C' || c_custkey, CAST(abs(c_acctbal) AS {MONEY}) FROM customer UNION ALL SELECT 'O' || o_orderkey, CAST(o_totalprice AS {MONEY}) FROM orders),
edges AS (SELECT 'N' || n_nationkey AS key, 'R' || n_regionkey AS dep FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
 UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the order of each user: (user_id, n, key, dep, w, event_id, ts, event_type, props)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    key = named("E", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).cast("long").alias("n"), key.alias("key"), F.lag(key).over(order).alias("dep"), F.col("value").cast(MONEY).alias("w"), "event_id", "ts", "event_type", "props")


CHAIN = f"""chain AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, 'E' || event_id AS key,
 lag('E' || event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dep, CAST(value AS {MONEY}) AS w, event_id, ts, event_type, props FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, dep, ordinal, order_only, single_use): orders depend on their distinct parts
    and suppliers, each at its first line."""
    item = table(spark, sf_dir, "lineitem")
    part = item.groupBy(F.col("l_orderkey"), F.col("l_partkey")).agg(F.min("l_linenumber").alias("n"))
    part = part.select(named("O", "l_orderkey").alias("key"), named("P", "l_partkey").alias("dep"), F.col("n"), (F.col("l_partkey") % 7 == 0).alias("order_only"), (F.col("l_partkey") % 5 == 0).alias("single_use"))
    supplier = item.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    supplier = supplier.select(named("O", "l_orderkey").alias("key"), named("S", "l_suppkey").alias("dep"), F.col("n"), F.lit(False).alias("order_only"), F.lit(False).alias("single_use"))
    both = part.union(supplier)
    return both.select("key", "dep", (F.row_number().over(Window.partitionBy("key").orderBy("n", "dep")) - 1).alias("ordinal"), "order_only", "single_use")


LINES = """pairs AS (SELECT 'O' || l_orderkey AS key, 'P' || l_partkey AS dep, min(l_linenumber) AS n, l_partkey % 7 = 0 AS order_only, l_partkey % 5 = 0 AS single_use FROM lineitem GROUP BY l_orderkey, l_partkey
 UNION ALL SELECT 'O' || l_orderkey, 'S' || l_suppkey, min(l_linenumber), false, false FROM lineitem GROUP BY l_orderkey, l_suppkey),
lines AS (SELECT key, dep, CAST(row_number() OVER (PARTITION BY key ORDER BY n, dep) - 1 AS INTEGER) AS ordinal, order_only, single_use FROM pairs)"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, built_at, computed_at) of orders, parts and suppliers."""
    orders, part, supplier = (table(spark, sf_dir, n) for n in ("orders", "part", "supplier"))
    o = orders.select(named("O", "o_orderkey").alias("key"), (F.col("o_orderkey") % 40).cast("long").alias("built_at"))
    p = part.select(named("P", "p_partkey").alias("key"), F.col("p_size").cast("long").alias("built_at"))
    s = supplier.select(named("S", "s_suppkey").alias("key"), (F.col("s_suppkey") % 45).cast("long").alias("built_at"))
    return o.union(p).union(s).withColumn("computed_at", F.col("built_at"))


BUILT = """built AS (SELECT 'O' || o_orderkey AS key, CAST(o_orderkey % 40 AS BIGINT) AS built_at FROM orders UNION ALL SELECT 'P' || p_partkey, CAST(p_size AS BIGINT) FROM part
 UNION ALL SELECT 'S' || s_suppkey, CAST(s_suppkey % 45 AS BIGINT) FROM supplier)"""


def database(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(key_names, rule_results) of a stored history: orders as results."""
    orders = table(spark, sf_dir, "orders")
    names = orders.select(F.col("o_orderkey").alias("id"), named("O", "o_orderkey").alias("key"))
    results = orders.select(F.col("o_orderkey").alias("key_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("signature"), (F.col("o_orderkey") % 40).cast("long").alias("built_at"), (F.col("o_orderkey") % 20).cast("long").alias("computed_at"), F.lit(1.0).alias("start"), F.col("o_totalprice").alias("end"))
    return names, results


DATABASE = """key_names AS (SELECT o_orderkey AS id, 'O' || o_orderkey AS key FROM orders),
rule_results AS (SELECT o_orderkey AS key_id, o_orderstatus AS value, o_orderpriority AS signature, CAST(o_orderkey % 40 AS BIGINT) AS built_at, CAST(o_orderkey % 20 AS BIGINT) AS computed_at, CAST(1.0 AS DOUBLE) AS start, o_totalprice AS "end" FROM orders)"""


def micros(column: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    days = F.date_diff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour(column)) * 60 + F.minute(column)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), F.col(column)) * 1_000_000).cast("long")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trace: (event_id, lane, tag, t)."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("lane"), F.col("event_type").alias("tag"), micros("ts").alias("t"))


TRACE = "trace AS (SELECT event_id, user_id % 4 AS lane, event_type AS tag, epoch_us(ts) AS t FROM events)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, info): pages as files below their hosts."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", "/"), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select(trimmed(bare).alias("path"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("info"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    return rows.groupBy("path").agg(F.max("info").alias("info"), F.max("size").alias("size"))


PAGES = r"""files AS (SELECT path, max(info) AS info, max(size) AS size, regexp_replace(path, '/[^/]*$', '') AS directory, regexp_extract(path, '[^/]*$') AS name
 FROM (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', ''), '/+$', '') AS path, md5(coalesce(html, '')) AS info, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages) GROUP BY path)"""
