"""Queries on validity, node values, manifests and dependency files, and on a layered graph
of many parents and many levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, history, incremental, nodes, store, tools, traces, trees, validity
from ..sources import text_files
from . import lenses
from .lenses import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# A layered graph: in each of LAYERS layers one node a customer; a node depends on two of
# the layer below and one of that below it; a fifth of the nodes are leaves

LAYERS = 8


def layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (key, layer, i, w), edges (key, ordinal, dep, order_only, single_use))."""
    customer = table(spark, sf_dir, "customer")
    n = F.lit(customer.count())  # one number
    # a small file is read by few tasks; what it is made into is many times as large
    dealt = customer.select("c_custkey", "c_acctbal").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    each = dealt.select(F.col("c_custkey").alias("i"), F.abs("c_acctbal").cast(lenses.MONEY).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer"))
    name = lambda layer, i: F.concat(F.lit("L"), layer.cast("string"), F.lit("_"), i.cast("string"))
    rows = each.select(name(F.col("layer"), F.col("i")).alias("key"), "layer", "i", "w")
    inner = rows.where("layer > 0 AND (i + layer) % 5 <> 0")
    layer, i = F.col("layer"), F.col("i")
    deps = F.array(name(layer - 1, (i * 7 + layer) % n), name(layer - 1, (i * 3 + 1) % n), F.when(layer > 1, name(layer - 2, (i * 5) % n)))
    deps = inner.select("key", F.array_compact(deps).alias("deps"))
    # of equal dependencies of a key the first
    edges = deps.select("key", "deps", F.posexplode("deps").alias("ordinal", "dep")).where("ordinal = array_position(deps, dep) - 1")
    return rows, edges.select("key", "ordinal", "dep", F.lit(False).alias("order_only"), F.lit(False).alias("single_use"))


LAYERED = f"""n AS (SELECT count(*) AS n FROM customer),
nodes AS (SELECT 'L' || layer || '_' || c_custkey AS key, layer, c_custkey AS i, CAST(abs(c_acctbal) AS {lenses.MONEY}) AS w FROM customer, (SELECT unnest(range({LAYERS})) AS layer)),
edges AS (SELECT key, layer, 'L' || (layer - 1) || '_' || ((i * 7 + layer) % n) AS dep FROM nodes, n WHERE layer > 0 AND (i + layer) % 5 <> 0
 UNION SELECT key, layer, 'L' || (layer - 1) || '_' || ((i * 3 + 1) % n) FROM nodes, n WHERE layer > 0 AND (i + layer) % 5 <> 0
 UNION SELECT key, layer, 'L' || (layer - 2) || '_' || ((i * 5) % n) FROM nodes, n WHERE layer > 1 AND (i + layer) % 5 <> 0)"""


def _by_layer(columns: str, first: str, step: str) -> str:
    """One CTE for each layer, from those below it, and all of them as `done`."""
    parts, below = [f"{LAYERED}, y0 AS ({first})"], "SELECT * FROM y0"
    for k in range(1, LAYERS):
        parts.append(f"y{k} AS ({step.format(k=k, below=f'({below})')})")
        below += f" UNION ALL SELECT * FROM y{k}"
    return f"WITH {', '.join(parts)}, done AS ({below}) SELECT {columns} FROM done"


@query(_by_layer("key, level", "SELECT key, CAST(0 AS BIGINT) AS level FROM nodes WHERE layer = 0", "SELECT n.key, coalesce(max(b.level) + 1, 0) AS level FROM nodes n LEFT JOIN edges e ON e.key = n.key LEFT JOIN {below} b ON b.key = e.dep WHERE n.layer = {k} GROUP BY n.key"))
def layered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(*layered(spark, sf_dir))


TOTALS = _by_layer("key, total", "SELECT key, CAST(w AS DECIMAL(38,2)) AS total FROM nodes WHERE layer = 0", "SELECT n.key, CAST(any_value(n.w) + coalesce(max(b.total), 0) AS DECIMAL(38,2)) AS total FROM nodes n LEFT JOIN edges e ON e.key = n.key LEFT JOIN {below} b ON b.key = e.dep WHERE n.layer = {k} GROUP BY n.key")


@query(TOTALS)
def layered_critical_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_paths(*layered(spark, sf_dir)).select("key", "total")


@query(f"""WITH RECURSIVE {LAYERED}, walk AS (SELECT key, 0 AS depth FROM nodes WHERE layer = {LAYERS - 1} AND i % 97 = 1 UNION SELECT e.dep, depth + 1 FROM walk JOIN edges e ON e.key = walk.key)
SELECT key, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY key""")
def layered_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = layered(spark, sf_dir)
    return graph.closure(rows.where(f"layer = {LAYERS - 1} AND i % 97 = 1").select("key"), edges)


@query(f"""WITH RECURSIVE {LAYERED}, hit AS (SELECT key FROM nodes WHERE layer = 1 AND i % 211 = 3 UNION SELECT e.key FROM hit JOIN edges e ON e.dep = hit.key)
SELECT key, CASE WHEN layer = 1 AND i % 211 = 3 THEN 'failed' WHEN key IN (SELECT key FROM hit) THEN 'propagated' ELSE 'ok' END AS state FROM nodes""")
def layered_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = layered(spark, sf_dir)
    return graph.propagate(rows, edges, rows.where("layer = 1 AND i % 211 = 3").select("key"))


@query(f"""WITH RECURSIVE {LAYERED}, run AS (SELECT key, layer, i FROM nodes WHERE layer = 0 AND i % 101 = 0 UNION SELECT e.key, n.layer, n.i FROM run JOIN edges e ON e.dep = run.key JOIN nodes n ON n.key = e.key WHERE NOT (run.layer > 0 AND run.i % 3 = 0))
SELECT key, CASE WHEN layer = 0 THEN 'changed' ELSE 'input-rebuilt' END AS reason FROM run""")
def layered_early_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some leaves change; above them, every third node turns out as before."""
    rows, edges = layered(spark, sf_dir)
    return incremental.early_cutoff(rows, edges, rows.where("layer = 0 AND i % 101 = 0").select("key"), rows.where("layer > 0 AND i % 3 = 0").select("key"))


_OWN = "CASE WHEN i % 53 = 1 THEN 'never-built' WHEN i % 59 = 2 THEN 'signature-changed' WHEN i % 61 = 3 THEN 'invalid-value' END"


@query(_by_layer("key, reason, built_at, computed_at",
    f"SELECT key, coalesce({_OWN}, 'up-to-date') AS reason, CAST(CASE WHEN {_OWN} IS NULL THEN 1 ELSE 2 END AS BIGINT) AS built_at, CAST(CASE WHEN {_OWN} IS NOT NULL AND (i % 53 = 1 OR i % 3 <> 0) THEN 2 ELSE 1 END AS BIGINT) AS computed_at FROM nodes WHERE layer = 0",
    f"SELECT key, coalesce(own, CASE WHEN late THEN 'input-rebuilt' ELSE 'up-to-date' END) AS reason, CAST(CASE WHEN own IS NULL AND NOT late THEN 1 ELSE 2 END AS BIGINT) AS built_at, CAST(CASE WHEN (own IS NOT NULL OR late) AND (i % 53 = 1 OR i % 3 <> 0) THEN 2 ELSE 1 END AS BIGINT) AS computed_at"
    f" FROM (SELECT n.key, any_value(n.i) AS i, any_value({_OWN.replace('i %', 'n.i %')}) AS own, coalesce(bool_or(b.computed_at > 1), false) AS late FROM nodes n LEFT JOIN edges e ON e.key = n.key LEFT JOIN {{below}} b ON b.key = e.dep WHERE n.layer = {{k}} GROUP BY n.key)"))  # fmt: skip
def layered_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second build of all nodes: some are new, changed or hold no longer; a third of the
    values turn out as before, which nothing above has to run for."""
    rows, edges = layered(spark, sf_dir)
    number = F.element_at(F.split("key", "_"), 2).cast("long")
    rules = rows.select("key", F.when(F.col("i") % 59 == 2, "s2").otherwise("s1").alias("signature"))
    one = F.lit(1).cast("long")
    prior = rows.where("i % 53 <> 1").select("key", F.lit("v1").alias("value"), F.lit("s1").alias("signature"), one.alias("built_at"), one.alias("computed_at"))
    valid = rows.where("i % 61 = 3").select("key", F.lit(False).alias("ok"))
    compute = lambda run: run.select("key", F.when(number % 3 == 0, "v1").otherwise("v2").alias("value"))
    return incremental.build(rows.select("key"), rules, prior, edges, valid, compute, epoch=2).select("key", "reason", "built_at", "computed_at")


@query(f"WITH {LAYERED} SELECT key FROM nodes WHERE layer = 0 AND i IN (7, 8, 9)")
def layered_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph with a ring of three leaves: only these are on a cycle."""
    _, edges = layered(spark, sf_dir)
    ring = spark.createDataFrame([("L0_7", "L0_8"), ("L0_8", "L0_9"), ("L0_9", "L0_7")], "key string, dep string")
    return graph.on_cycles(edges.select("key", "dep").union(ring))


# Validity: each line's file as it was stored and as it is now

_KIND = "CASE l_linenumber % 7 WHEN 0 THEN 'ExistingInput' WHEN 1 THEN 'MissingInput' WHEN 2 THEN 'SuccessfulCommand' WHEN 3 THEN 'DirectoryContents' WHEN 4 THEN 'VirtualInput' WHEN 5 THEN 'FailedInput' ELSE 'SuccessfulCommandWithOutputSignature' END"
_GONE, _CHANGED, _FOLDER = "l_partkey % 11 = 0", "l_suppkey % 7 = 0", "l_partkey % 10 = 0"
_TIME = "l_suppkey + CASE WHEN l_suppkey % 7 = 0 THEN 5 ELSE 0 END"
#: The comparison of both infos, which differ where the file is gone or changed.
_SAME = f"(NOT ({_GONE}) AND NOT ({_CHANGED}))"


def _info(gone: Column, changed: Column) -> Column:
    zero = lambda x, t: F.when(gone, F.lit(0)).otherwise(x).cast(t)
    mode = F.when(F.expr(_FOLDER), 0o040755).otherwise(0o100644)
    more = F.when(changed, 5).otherwise(0)
    parts = [("device", F.lit(1), "decimal(20,0)"), ("inode", F.col("l_orderkey"), "decimal(20,0)"), ("mode", mode, "long"), ("size", F.col("l_partkey"), "long"), ("mtime_s", F.col("l_suppkey") + more, "long"), ("mtime_ns", F.lit(0), "int")]
    return F.struct(*[zero(x, t).alias(n) for n, x, t in parts], F.unhex(F.lit("00" * 32)).alias("checksum"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, stored, now)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_KIND).alias("kind"))
    return rows.withColumn("stored", _info(F.lit(False), F.lit(False))).withColumn("now", _info(F.expr(_GONE), F.expr(_CHANGED)))


def _judged(spark: SparkSession, sf_dir: str, ok: Column) -> DataFrame:
    return files(spark, sf_dir).select("l_orderkey", "l_linenumber", ok.alias("ok"))


def _valid(condition: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, {condition} AS ok FROM (SELECT *, {_KIND} AS kind FROM lineitem)"




@query(_valid("kind IN ('ExistingInput', 'FailedInput')"))
def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.is_kind(F.col("kind"), "ExistingInput", "FailedInput"))


@query(_valid(f"CASE WHEN {_GONE} THEN kind = 'MissingInput' ELSE kind = 'ExistingInput' AND {_SAME} END"))
def valid_file_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.file_input(F.col("kind"), F.col("stored"), F.col("now")))


@query(_valid("kind NOT IN ('FailedInput', 'MissingInput')"))
def valid_produced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.produced_node(F.col("kind")))


@query(_valid("kind = 'VirtualInput'"))
def valid_virtual_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.virtual_input(F.col("kind")))


@query(_valid(f"CASE WHEN {_GONE} THEN kind = 'MissingInput' WHEN NOT ({_FOLDER}) THEN kind = 'ExistingInput' AND {_SAME} ELSE kind = 'DirectoryContents' AND l_suppkey % 3 <> 0 END"))
def valid_directory_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a third of the directories another name is found."""
    names = F.array(F.lit("a"), F.lit("b"))
    found = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("a"))).otherwise(names)
    return _judged(spark, sf_dir, validity.directory_contents(F.col("kind"), names, F.col("stored"), found, F.col("now")))


@query(_valid("false"))
def valid_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.never())


@query(_valid(f"l_orderkey % 9 <> 0 AND kind LIKE 'SuccessfulCommand%' AND (l_suppkey % 2 = 0 OR CASE WHEN l_partkey % 2 = 0 THEN NOT ({_GONE}) ELSE {_SAME} END)"))
def valid_external_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of two outputs, the second virtual; some first ones are changed in place or virtual."""
    outs = lambda c: F.array(F.col(c), F.col("stored"))
    virtual, mutated = F.array(F.col("l_suppkey") % 2 == 0, F.lit(True)), F.array(F.col("l_partkey") % 2 == 0, F.lit(False))
    return _judged(spark, sf_dir, validity.external_command(F.col("kind"), F.col("l_orderkey") % 9 == 0, outs("stored"), outs("now"), virtual, mutated))


@query(_valid(f"kind = 'SuccessfulCommand' AND NOT ({_GONE}) AND {_FOLDER}"))
def valid_made_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.make_directory(F.col("kind"), F.col("now")))


@query(_valid(f"kind = 'SuccessfulCommand' AND {_SAME}"))
def valid_made_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.make_link(F.col("kind"), F.col("stored"), F.col("now")))


@query(_valid(f"kind = 'SuccessfulCommand' AND (l_partkey % 2 = 0 OR l_orderkey % 4 <> 1) AND {_SAME}"))
def valid_ninja_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_now = F.when(F.col("l_orderkey") % 4 == 1, "cc -O3").otherwise("cc -O2")
    return _judged(spark, sf_dir, validity.ninja_command(F.col("kind"), F.lit("cc -O2"), text_now, F.col("l_partkey") % 2 == 0, F.array("stored"), F.array("now")))


@query(_valid(f"kind = 'SuccessfulCommand' AND NOT ({_GONE})"))
def valid_modified_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, validity.modified_outputs_allowed(F.col("kind"), F.array("now", "stored")))


@query(f"SELECT l_orderkey, max(CASE WHEN {_GONE} THEN 0 ELSE {_TIME} END) AS newest FROM lineitem GROUP BY l_orderkey")
def newest_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("now").alias("infos"))
    return rows.select("l_orderkey", validity.newest(F.col("infos"))["s"].alias("newest"))


@query(_valid(f"l_orderkey % 4 <> 1 AND NOT ({_GONE}) AND ({_TIME} > l_partkey % 100 OR (l_linenumber % 2 = 0 AND {_TIME} = l_partkey % 100))"))
def updated_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.struct((F.col("l_partkey") % 100).cast("long").alias("s"), F.lit(0).alias("ns"))
    return _judged(spark, sf_dir, validity.updated_if_newer(F.array("now"), newest, F.col("l_orderkey") % 4 != 1, F.col("l_linenumber") % 2 == 1))


@query(_valid(f"NOT ({_GONE})"))
def same_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infos that compare by content alone: copies with other times are equal."""
    whole = lambda c: validity.checksum_only(F.col(c).withField("mode", F.lit(0).cast("long")), F.unhex(F.when(validity.is_missing(F.col(c)), "00").otherwise("01")))
    return _judged(spark, sf_dir, validity.same_file(whole("stored"), whole("now")))


@query(_valid(f"CASE WHEN {_FOLDER} THEN kind = 'SuccessfulCommand' AND NOT ({_GONE}) ELSE kind LIKE 'SuccessfulCommand%' AND {_SAME} END"))
def tool_results_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories by mkdir, everything else by shell."""
    tool = F.when(F.expr(_FOLDER), "mkdir").otherwise("shell")
    no = F.array(F.lit(False))
    return _judged(spark, sf_dir, tools.holds(tool, F.col("kind"), F.array("stored"), F.array("now"), no, no))


# Values of nodes: parts are files of which some are gone, suppliers make them


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 6 <> 0")
    zero = F.lit(0).cast("decimal(20,0)")
    mode = F.when(F.col("p_partkey") % 4 == 0, 0o040755).otherwise(0o100644).cast("long")
    return part.select(lenses.named("/P", "p_partkey").alias("path"), zero.alias("device"), zero.alias("inode"), mode.alias("mode"), F.col("p_size").cast("long").alias("size"), F.lit(9).cast("long").alias("mtime_s"), F.lit(0).alias("mtime_ns"), F.unhex(F.lit("00" * 32)).alias("checksum"))


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 5 == 0, "virtual").otherwise("plain")
    return table(spark, sf_dir, "part").select(F.concat(lenses.named("/P", "p_partkey"), F.when(F.col("p_partkey") % 4 == 0, "/").otherwise("")).alias("node"), kind.alias("kind"))


_NODE = "'/P' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '/' ELSE '' END AS node"
_VALUE = "CASE WHEN p_partkey % 5 = 0 THEN 'VirtualInput' WHEN p_partkey % 6 = 0 THEN 'MissingInput' ELSE 'ExistingInput' END"


@query(f"SELECT {_NODE}, {_VALUE} AS value, CASE WHEN {_VALUE} = 'ExistingInput' THEN CAST(p_size AS BIGINT) END AS size FROM part")
def input_node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.input_values(_part_nodes(spark, sf_dir), _snapshot(spark, sf_dir))
    return rows.select("node", "value", F.col("info.size").alias("size"))


@query(f"SELECT {_NODE}, CASE WHEN p_partkey % 6 = 0 THEN 'MissingInput' WHEN p_partkey % 4 <> 0 THEN 'ExistingInput' ELSE 'DirectoryContents' END AS value, CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'x y' ELSE '' END END AS names FROM part")
def contents_node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = table(spark, sf_dir, "part").where("p_partkey % 8 = 0")
    listings = full.select(lenses.named("/P", "p_partkey").alias("directory"), F.array(F.lit("x"), F.lit("y")).alias("names"))
    rows = nodes.contents_values(_part_nodes(spark, sf_dir), _snapshot(spark, sf_dir), listings)
    return rows.select("node", "value", F.array_join("names", " ").alias("names"))


_MISSING = "CASE WHEN l_partkey % 5 <> 0 AND l_partkey % 6 = 0 THEN 1 ELSE 0 END"


@query(f"SELECT 'O' || l_orderkey AS target, CASE WHEN sum({_MISSING}) = 0 THEN 'Target' ELSE 'Invalid' END AS value, CAST(sum({_MISSING}) AS BIGINT) AS missing FROM lineitem GROUP BY l_orderkey")
def target_node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = nodes.input_values(_part_nodes(spark, sf_dir), _snapshot(spark, sf_dir))
    node = F.concat(lenses.named("/P", "l_partkey"), F.when(F.col("l_partkey") % 4 == 0, "/").otherwise(""))
    return nodes.target_values(table(spark, sf_dir, "lineitem").select(lenses.named("O", "l_orderkey").alias("target"), node.alias("node")), values)


@query(f"""WITH w AS (SELECT l_orderkey, max({_MISSING}) AS bad FROM lineitem GROUP BY l_orderkey)
SELECT 'O' || l_orderkey AS command, CASE WHEN bad = 1 THEN 'PropagatedFailureCommand' WHEN l_orderkey % 7 = 0 THEN 'FailedCommand' WHEN l_orderkey % 3 = 0 THEN 'SuccessfulCommandWithOutputSignature' ELSE 'SuccessfulCommand' END AS value FROM w""")
def command_node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = nodes.input_values(_part_nodes(spark, sf_dir), _snapshot(spark, sf_dir))
    item = table(spark, sf_dir, "lineitem")
    command = lenses.named("O", "l_orderkey").alias("command")
    inputs = item.select(command, F.concat(lenses.named("/P", "l_partkey"), F.when(F.col("l_partkey") % 4 == 0, "/").otherwise("")).alias("node"))
    runs = item.select("l_orderkey").distinct().select(command, (F.col("l_orderkey") % 7 != 0).alias("ok"), F.when(F.col("l_orderkey") % 3 == 0, "s").alias("signature"))
    return nodes.command_values(runs.select("command"), inputs, values, runs)


@query(f"WITH {lenses.LINES} SELECT 'O1' AS key, (SELECT o_orderstatus FROM orders WHERE o_orderkey = 1) AS value, dep, p_brand AS dep_value FROM (SELECT DISTINCT dep FROM lines WHERE key = 'O1') LEFT JOIN part ON dep = 'P' || p_partkey")
def result_with_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select(lenses.named("O", "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    results = results.union(table(spark, sf_dir, "part").select(lenses.named("P", "p_partkey").alias("key"), "p_brand"))
    return nodes.with_dependencies(results, lenses.lines(spark, sf_dir), "O1")


@query("SELECT 'C' || c_custkey AS key FROM customer WHERE c_custkey % 10 = 0 AND c_acctbal < 0")
def manifests_to_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    results = customer.select(lenses.named("C", "c_custkey").alias("key"), F.when(F.col("c_acctbal") < 0, "input-rebuilt").otherwise("up-to-date").alias("reason"))
    return nodes.regenerated(results, customer.where("c_custkey % 10 = 0").select(lenses.named("C", "c_custkey").alias("key")))


# Manifests, dependency files and traces as text


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer with one build a line, and a variable that changes between builds."""
    item = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    parts = item.groupBy("o_custkey", "l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("$d/p"), x["l_partkey"].cast("string"))), " ").alias("ins"))
    key = F.col("l_orderkey").cast("string")
    build = F.concat(F.lit("d = d"), key, F.lit("\nbuild o"), key, F.lit(": cc "), F.col("ins"), F.lit(" | gen$ h || dirs\n  flags = -g"), key, F.lit("\n"))
    per = parts.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", build.alias("b")))), lambda x: x["b"]), "").alias("builds"))
    head = F.lit("# a file\nflags = -O\nrule cc\n  command = cc $flags -c $in -o $out\n")
    return per.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.concat(head, "builds").alias("content"))


@query("""SELECT 'o' || l_orderkey AS key, CAST(n - 1 AS INTEGER) AS ordinal, dep, n > m + 1 AS order_only FROM
(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, 'd' || l_orderkey || '/p' || l_partkey AS dep, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem
 UNION ALL SELECT l_orderkey, count(*) + 1, 'gen h', count(*) FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey, count(*) + 2, 'dirs', count(*) FROM lineitem GROUP BY l_orderkey)""")
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths have the value that a variable had when their statement was read."""
    return text_files.manifest_edges(text_files.build_statements(text_files.manifest_lines(_manifests(spark, sf_dir))))


@query("SELECT 'o' || l_orderkey AS output, 'cc -g' || l_orderkey || ' -c ' || string_agg('d' || l_orderkey || '/p' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) || ' -o o' || l_orderkey AS command FROM lineitem GROUP BY l_orderkey")
def manifest_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_files.command_lines(text_files.manifest_lines(_manifests(spark, sf_dir)))
    return rows.select(F.element_at("outputs", 1).alias("output"), "command")


@query("SELECT 'o ' || l_orderkey AS rule, 'p$' || l_partkey AS dep, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS ordinal FROM lineitem")
def make_file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("p$$"), x["l_partkey"].cast("string"))), " \\\n  ")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(deps.alias("deps"))
    key = F.col("l_orderkey").cast("string")
    content = F.concat(F.lit("# made\no\\ "), key, F.lit(": "), F.col("deps"), F.lit("\n"))
    return text_files.make_dependencies(rows.select(key.alias("file"), content.alias("content"))).select("rule", "dep", "ordinal")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS file, CAST(0 AS INTEGER) AS ordinal, 'version' AS event, 'v1' AS operand FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER), CASE l_partkey % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'missing' ELSE 'output' END, '/p' || l_partkey FROM lineitem""")
def binary_file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_partkey") % 3 == 0, F.lit("\x10")).when(F.col("l_partkey") % 3 == 1, F.lit("\x11")).otherwise(F.lit("@"))
    one = F.concat(code, lenses.named("/p", "l_partkey"), F.lit("\0"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("r")))), lambda x: x["r"]), "").alias("records"))
    content = F.concat(F.lit("\0v1\0"), F.col("records")).cast("binary")
    return text_files.dependency_info(rows.select(F.col("l_orderkey").cast("string").alias("file"), content.alias("content"))).select("file", "ordinal", "event", "operand")


@query("SELECT event_id AS seq, 'rule-scanning' AS tag, 'R' || user_id AS a1, event_type || '\"x' AS a2, 'user ' || user_id AS key FROM events")
def trace_rules_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace lines, with the keys that the short names of rules stand for."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    line = F.concat(F.lit('  { "rule-scanning", "R'), user, F.lit('", "'), F.col("event_type"), F.lit('\\"x" },'))
    rows = events.select(F.col("event_id").alias("seq"), line.alias("value"))
    names = events.select(user.alias("u")).distinct().select(F.lit(-1).cast("long").alias("seq"), F.concat(F.lit('{ "new-rule", "R'), F.col("u"), F.lit('", "user '), F.col("u"), F.lit('" },')).alias("value"))
    named = text_files.named(text_files.trace_events(rows.unionByName(names)))
    return named.where("tag = 'rule-scanning'").select("seq", "tag", "a1", "a2", "key")


# Texts


@query("SELECT p_partkey, 'a ' || p_partkey || '-' || p_size || '$ ' || p_size AS value FROM part")
def strings_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.create_map(F.lit("k"), F.col("p_partkey").cast("string"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.expand(F.lit("a$ ${k}-${size}$$ $size$none"), scope).alias("value"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS waited FROM orders")
def until_next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by rank, as the lanes of a trace are ranked."""
    rows = graph.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")
    return rows.select("o_orderkey", F.col("rank").cast("long").alias("waited"))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 5 <> 0")
def deleted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return history.without(prior, prior.where("key % 5 = 0"), ["key"])


@query("""WITH o AS (SELECT DISTINCT sha256(text) AS id FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)
SELECT d.id, o.id IS NOT NULL AS found FROM (SELECT DISTINCT sha256(text) AS id FROM documents WHERE text IS NOT NULL) d LEFT JOIN o ON o.id = d.id""")
def cas_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    objects = docs.where("doc_id % 2 = 0").select(F.array().cast("array<string>").alias("refs"), F.col("text").cast("binary").alias("data"))
    stored = store.put(store.identify(objects).select("id", "refs", "data").where("false"), objects)
    return store.contains(stored, docs.select(text.content_id(F.col("text")).alias("id")).distinct()).select("id", "found")


@query(f"WITH {lenses.PAGES} SELECT directory, count(*) AS entries FROM files GROUP BY directory")
def directory_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.listing(trees.with_directories(lenses.pages(spark, sf_dir)).where("NOT is_directory")).select("directory", F.size("names").cast("long").alias("entries"))


@query("SELECT user_id, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS finished, '[' || count(*) FILTER (event_type <> 'error') || '/' || count(*) || '] 100%' AS line FROM events GROUP BY user_id")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("finished"), F.count("*").alias("total"))
    columns = {c: F.col(c) for c in ("finished", "total")}
    return counts.select("user_id", "finished", traces.status_line("[%f/%t] 100%%", columns).alias("line"))
