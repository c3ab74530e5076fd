"""Queries on the dependency graph and on incremental builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands, export, graph, history, incremental
from . import lenses
from .lenses import BUILT, CHAIN, FOREST, LINES, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


WALK = f"""WITH RECURSIVE {FOREST},
walk AS (SELECT key, CAST(0 AS BIGINT) AS level, CAST(w AS DECIMAL(38,2)) AS total FROM nodes WHERE key NOT IN (SELECT key FROM edges)
 UNION ALL SELECT e.key, walk.level + 1, CAST(walk.total + n.w AS DECIMAL(38,2)) FROM walk JOIN edges e ON e.dep = walk.key JOIN nodes n ON n.key = e.key)"""


@query(f"WITH {FOREST} SELECT key FROM nodes WHERE key NOT IN (SELECT dep FROM edges)")
def graph_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = lenses.forest(spark, sf_dir)
    return graph.roots(nodes, edges).select("key")


@query(f"WITH {FOREST} SELECT key FROM nodes WHERE key NOT IN (SELECT key FROM edges)")
def graph_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = lenses.forest(spark, sf_dir)
    return graph.leaves(nodes, edges).select("key")


@query(f"""WITH {LINES}, keys AS (SELECT key FROM lines UNION SELECT dep FROM lines)
SELECT k.key, (SELECT count(*) FROM lines e WHERE e.key = k.key) AS deps, (SELECT count(*) FROM lines e WHERE e.dep = k.key) AS dependents FROM keys k""")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = lenses.lines(spark, sf_dir)
    nodes = edges.select("key").union(edges.select("dep")).distinct()
    return graph.degrees(nodes, edges)


@query(f"""WITH RECURSIVE {FOREST},
walk AS (SELECT 'O' || o_orderkey AS key, 0 AS depth FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT e.dep, depth + 1 FROM walk JOIN edges e ON e.key = walk.key)
SELECT key, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY key""")
def demand_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = lenses.forest(spark, sf_dir)
    goals = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(lenses.named("O", "o_orderkey").alias("key"))
    return graph.closure(goals, edges)


@query(f"""WITH {LINES}, goals AS (SELECT 'O' || o_orderkey AS key FROM orders WHERE o_orderpriority LIKE '1%')
SELECT key, 0 AS depth FROM goals UNION ALL SELECT DISTINCT dep, 1 FROM lines WHERE key IN (SELECT key FROM goals)""")
def demand_closure_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(lenses.named("O", "o_orderkey").alias("key"))
    return graph.closure(goals, lenses.lines(spark, sf_dir))


@query(f"WITH {CHAIN} SELECT key, CAST(max(n) OVER (PARTITION BY user_id) - n AS INTEGER) AS depth FROM chain")
def closure_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lenses.chain(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max_by("key", "n").alias("key")).select("key")
    return graph.closure(last, rows.where("dep IS NOT NULL").select("key", "dep"))


@query(f"{WALK} SELECT key, max(level) AS level FROM walk GROUP BY key")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(*lenses.forest(spark, sf_dir))


@query(f"{WALK} SELECT key, max(total) AS total FROM walk GROUP BY key")
def critical_path_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_paths(*lenses.forest(spark, sf_dir)).select("key", "total")


PATH = f"""{WALK}, totals AS (SELECT key, max(total) AS total FROM walk GROUP BY key),
path AS (SELECT key, 0 AS up FROM (SELECT key FROM totals ORDER BY total DESC, key LIMIT 1) UNION ALL SELECT e.dep, up + 1 FROM path JOIN edges e ON e.key = path.key)"""


@query(f"{PATH} SELECT CAST((SELECT max(up) FROM path) - up AS INTEGER) AS ordinal, path.key, w, total FROM path JOIN totals ON totals.key = path.key JOIN nodes ON nodes.key = path.key")
def critical_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.critical_path(*lenses.forest(spark, sf_dir))


@query(f"{PATH}, own AS (SELECT key FROM path) SELECT '\"' || e.key || '\" -> \"' || e.dep || '\"' AS value FROM edges e WHERE key IN (SELECT key FROM own) AND dep IN (SELECT key FROM own)")
def critical_path_graphviz(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = lenses.forest(spark, sf_dir)
    return export.critical_graphviz(graph.critical_path(nodes, edges), edges)


@query(f"WITH {CHAIN} SELECT key, n - 1 AS level, CAST(sum(w) OVER (PARTITION BY user_id ORDER BY n) AS DECIMAL(38,2)) AS total FROM chain")
def critical_path_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lenses.chain(spark, sf_dir)
    return graph.longest_paths(rows.select("key", "w"), rows.where("dep IS NOT NULL").select("key", "dep"))


@query(f"""WITH {LINES}, w AS (SELECT 'O' || o_orderkey AS key, CAST(o_totalprice AS DECIMAL(12,2)) AS w FROM orders UNION ALL SELECT 'P' || p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) FROM part
 UNION ALL SELECT 'S' || s_suppkey, CAST(abs(s_acctbal) AS DECIMAL(12,2)) FROM supplier)
SELECT w.key, CAST(w.w + coalesce((SELECT max(d.w) FROM lines e JOIN w d ON d.key = e.dep WHERE e.key = w.key), 0) AS DECIMAL(38,2)) AS total FROM w""")
def critical_path_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.abs(F.col(c)).cast(lenses.MONEY).alias("w")
    named = lambda t, letter, k, w: table(spark, sf_dir, t).select(lenses.named(letter, k).alias("key"), money(w))
    nodes = named("orders", "O", "o_orderkey", "o_totalprice").union(named("part", "P", "p_partkey", "p_retailprice")).union(named("supplier", "S", "s_suppkey", "s_acctbal"))
    return graph.longest_paths(nodes, lenses.lines(spark, sf_dir)).select("key", "total")


@query(f"WITH {CHAIN} SELECT key, n = 1 OR event_id % 10 <> 0 AS ok FROM chain")
def path_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lenses.chain(spark, sf_dir)
    edges = rows.where("dep IS NOT NULL AND event_id % 10 <> 0").select("key", "dep")
    return graph.validate_path(rows.select("user_id", "n", "key"), edges, "n", ["user_id"]).select("key", "ok")


@query("""SELECT 'O' || o_orderkey AS key FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
UNION ALL SELECT 'C' || o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
UNION ALL SELECT 'N' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
UNION ALL SELECT 'R' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)""")
def cycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest with one edge back, from the first order's region to that order."""
    _, edges = lenses.forest(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    home = first.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    back = home.select(lenses.named("R", "n_regionkey").alias("key"), lenses.named("O", "o_orderkey").alias("dep"))
    return graph.on_cycles(edges.union(back))


@query(f"WITH {FOREST} SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM nodes")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = lenses.forest(spark, sf_dir)
    return graph.dense_ids(nodes, "key")


@query("""WITH bad AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'R' || r_regionkey AS key, 'ok' AS state FROM region UNION ALL SELECT 'N' || n_nationkey, 'ok' FROM nation
UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'ok' END FROM customer
UNION ALL SELECT 'O' || o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM bad) THEN 'propagated' ELSE 'ok' END FROM orders""")
def failure_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = lenses.forest(spark, sf_dir)
    failed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(lenses.named("C", "c_custkey").alias("key"))
    return graph.propagate(nodes, edges, failed)


@query("""SELECT 'R' || r_regionkey AS key, 'changed' AS reason FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT 'N' || n_nationkey, 'input-rebuilt' FROM nation WHERE n_regionkey % 2 = 0
UNION ALL SELECT 'C' || c_custkey, 'input-rebuilt' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey % 2 = 0 AND n_nationkey % 3 <> 0
UNION ALL SELECT 'O' || o_orderkey, 'input-rebuilt' FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey % 2 = 0 AND n_nationkey % 3 <> 0""")
def early_cutoff_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even regions change; of the nations those with a key divisible by 3 turn out as before."""
    nodes, edges = lenses.forest(spark, sf_dir)
    changed = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(lenses.named("R", "r_regionkey").alias("key"))
    same = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(lenses.named("N", "n_nationkey").alias("key"))
    return incremental.early_cutoff(nodes, edges.withColumn("order_only", F.lit(False)), changed, same)


@query("""SELECT 'R' || r_regionkey AS key, 'up-to-date' AS reason, CAST(1 AS BIGINT) AS built_at, CAST(1 AS BIGINT) AS computed_at FROM region
UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'signature-changed' ELSE 'up-to-date' END, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END, 1 FROM nation
UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'never-built' WHEN c_acctbal < 0 THEN 'invalid-value' ELSE 'up-to-date' END,
 CASE WHEN c_custkey % 11 = 0 OR c_acctbal < 0 THEN 2 ELSE 1 END, CASE WHEN c_custkey % 11 = 0 OR c_acctbal < 0 THEN 2 ELSE 1 END FROM customer
UNION ALL SELECT 'O' || o_orderkey, CASE WHEN c_custkey % 11 = 0 OR c_acctbal < 0 THEN 'input-rebuilt' ELSE 'up-to-date' END,
 CASE WHEN c_custkey % 11 = 0 OR c_acctbal < 0 THEN 2 ELSE 1 END, CASE WHEN c_custkey % 11 = 0 OR c_acctbal < 0 THEN 2 ELSE 1 END FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'R' || r_regionkey, 'up-to-date', 1, 1 FROM region WHERE false""")
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second build of the forest. Some nations' rules changed, but their values do not;
    some customers are new, others hold no longer. All orders are goals, and whatever is
    demanded is brought up to date."""
    nodes, edges = lenses.forest(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    number = F.substring("key", 2, 20).cast("long")
    changed = F.col("key").startswith("N") & (number % 4 == 0)
    new = F.col("key").startswith("C") & (number % 11 == 0)
    rules = nodes.select("key", F.when(changed, "s2").otherwise("s1").alias("signature"))
    prior = nodes.where(~new).select("key", F.lit("v1").alias("value"), F.lit("s1").alias("signature"), F.lit(1).cast("long").alias("built_at"), F.lit(1).cast("long").alias("computed_at"))
    valid = customer.where("c_acctbal < 0").select(lenses.named("C", "c_custkey").alias("key"), F.lit(False).alias("ok"))
    linked = edges.select("key", F.lit(0).alias("ordinal"), "dep", F.lit(False).alias("order_only"), F.lit(False).alias("single_use"))
    compute = lambda run: run.select("key", F.when(F.col("key").startswith("N"), "v1").otherwise("v2").alias("value"))
    every = incremental.build(nodes.select("key"), rules, prior, linked, valid, compute, epoch=2)
    return every.select("key", "reason", "built_at", "computed_at")


@query(f"""WITH {LINES}, {BUILT} SELECT key, arg_min(dep, ordinal) AS dep FROM (SELECT e.key, e.dep, e.ordinal FROM lines e JOIN built a ON a.key = e.key JOIN built b ON b.key = e.dep WHERE NOT e.order_only AND a.built_at < b.built_at) GROUP BY key""")
def first_offending_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_offending_input(lenses.built(spark, sf_dir), lenses.lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT key, dep, ordinal FROM lines WHERE NOT order_only")
def order_only_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.lines(spark, sf_dir).where("NOT order_only").select("key", "dep", "ordinal")


@query(f"WITH {LINES} SELECT key, dep, ordinal FROM lines WHERE NOT single_use")
def single_use_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.drop_single_use(lenses.lines(spark, sf_dir)).select("key", "dep", "ordinal")


@query(f"""WITH {LINES}, found AS (SELECT key, dep FROM lines WHERE single_use)
SELECT key, dep, CAST(ordinal AS BIGINT) AS ordinal FROM lines
UNION ALL SELECT f.key, f.dep, (SELECT max(ordinal) FROM lines l WHERE l.key = f.key) + row_number() OVER (PARTITION BY f.key ORDER BY f.dep) FROM found f""")
def discovered_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-use edges, found once more behind each key's own."""
    from pyspark.sql import Window

    edges = lenses.lines(spark, sf_dir).select("key", "dep", F.col("ordinal").cast("long").alias("ordinal"), "single_use")
    found = edges.where("single_use").select("key", "dep", (F.row_number().over(Window.partitionBy("key").orderBy("dep")) - 1).cast("long").alias("ordinal"))
    return history.append_discovered(edges.select("key", "dep", "ordinal"), found)


@query(f"WITH {LINES} SELECT key, string_agg(dep, ' ' ORDER BY ordinal) AS deps FROM lines GROUP BY key")
def deps_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.collected(lenses.lines(spark, sf_dir)).select("key", F.array_join("deps", " ").alias("deps"))


@query(f"""WITH {FOREST} SELECT key AS place, CAST(-1 AS INTEGER) AS ordinal, '"' || key || '"' AS value FROM nodes UNION ALL SELECT key, 0, '"' || key || '" -> "' || dep || '"' FROM edges""")
def graphviz_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = lenses.forest(spark, sf_dir)
    return export.graphviz(nodes, edges.withColumn("ordinal", F.lit(0)))


@query(f"""WITH {FOREST}, names AS (SELECT key, CASE WHEN key IN (SELECT key FROM edges) THEN 'N' ELSE 'I' END AS letter FROM nodes),
n AS (SELECT key, letter || row_number() OVER (PARTITION BY letter ORDER BY key) AS name FROM names)
SELECT '1' || a.name AS place, 'build ' || a.name || ': CMD ' || b.name AS value FROM edges e JOIN n a ON a.key = e.key JOIN n b ON b.key = e.dep
UNION ALL SELECT '2' || name, 'default ' || name FROM n WHERE key NOT IN (SELECT dep FROM edges)""")
def ninja_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = lenses.forest(spark, sf_dir)
    return export.ninja(nodes, edges.withColumn("ordinal", F.lit(0)))


# Commands and nodes: suppliers make parts, orders use them


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(lenses.named("S", "l_suppkey").alias("command"), lenses.named("P", "l_partkey").alias("node")).distinct()
    return rows.withColumn("ordinal", F.lit(0))


MADE = "made AS (SELECT DISTINCT 'S' || l_suppkey AS command, 'P' || l_partkey AS node FROM lineitem)"


@query(f"""WITH {MADE}, c AS (SELECT node, count(DISTINCT command) AS n, min(command) AS command FROM made GROUP BY node)
SELECT 'P' || p_partkey AS node, coalesce(n, 0) AS producers, CASE WHEN n = 1 THEN command END AS command FROM part LEFT JOIN c ON c.node = 'P' || p_partkey""")
def multi_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(lenses.named("P", "p_partkey").alias("node"))
    return commands.producers(nodes, _made(spark, sf_dir))


@query("""SELECT DISTINCT 'P' || l_partkey AS node FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%')""")
def default_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    used = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_semi").select(lenses.named("P", "l_partkey").alias("node"))
    return commands.default_targets(_made(spark, sf_dir), used)


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1))
SELECT 'O' || l_orderkey AS target, string_agg('P' || l_partkey, ', ' ORDER BY 'P' || l_partkey) AS missing FROM t GROUP BY l_orderkey""")
def missing_inputs_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "lineitem").select(lenses.named("O", "l_orderkey").alias("target"), lenses.named("P", "l_partkey").alias("node"))
    missing = table(spark, sf_dir, "part").where("p_size = 1").select(lenses.named("P", "p_partkey").alias("node"))
    return commands.missing_by_target(targets, missing)


@query(f"""WITH {MADE} SELECT node, command, CASE WHEN s_acctbal < 0 THEN 'FailedInput' WHEN s_suppkey % 10 = 0 THEN 'SkippedCommand' WHEN p_size = 1 THEN 'MissingOutput' ELSE 'ExistingInput' END AS kind
FROM made JOIN supplier ON command = 'S' || s_suppkey JOIN part ON node = 'P' || p_partkey""")
def produced_node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(lenses.named("S", "s_suppkey").alias("command"), F.when(F.col("s_acctbal") < 0, "FailedCommand").when(F.col("s_suppkey") % 10 == 0, "SkippedCommand").otherwise("SuccessfulCommand").alias("kind"))
    made = _made(spark, sf_dir)
    size = table(spark, sf_dir, "part").select(lenses.named("P", "p_partkey").alias("node"), F.array(F.struct(F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size")).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_s"))).alias("infos"))
    rows = made.join(size, "node")
    return commands.produced_values(rows, supplier).select("node", "command", "kind")


@query(f"""WITH {MADE} SELECT command, node, CAST(row_number() OVER (PARTITION BY command ORDER BY length(node), node) AS INTEGER) AS place FROM made""")
def shortest_outputs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.shortest_first(_made(spark, sf_dir)).select("command", "node", "place")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), j AS (SELECT l_orderkey, string_agg('P' || l_partkey, '&&' ORDER BY l_partkey) AS key, count(*) AS n FROM m GROUP BY l_orderkey)
SELECT key, 'O' || m.l_orderkey AS command, 'P' || l_partkey AS node FROM m JOIN j ON j.l_orderkey = m.l_orderkey WHERE n > 1""")
def composite_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").select(lenses.named("O", "l_orderkey").alias("command"), lenses.named("P", "l_partkey").alias("node"), F.col("l_partkey").alias("ordinal")).distinct()
    return commands.composite(made).select("key", "command", "node")


@query("""WITH f AS (SELECT event_id, event_type = 'error' AS failed, row_number() OVER (ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) AS n FROM events)
SELECT event_id, failed, event_id > coalesce((SELECT event_id FROM f WHERE n = 100 AND failed), 9223372036854775807) AS cancelled FROM f""")
def failure_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("failed"))
    return commands.tolerated(rows, 100, "event_id")
