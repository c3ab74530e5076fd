"""Graphs and paths as text, and random manifests. Each gives rows of lines; write.text()
stores them without passing through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import ranked


def quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def graphviz(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, ordinal, value): the graph's lines, keys in order, each followed by its edges
    in the order of its dependencies."""
    style = F.when(F.coalesce("order_only", F.lit(False)), F.lit(" [style=dashed]")).otherwise(F.lit("")) if "order_only" in edges.columns else F.lit("")
    head = nodes.select(F.col("key").alias("place"), F.lit(-1).alias("ordinal"), quoted(F.col("key")).alias("value"))
    arrow = edges.select(F.col("key").alias("place"), F.col("ordinal").cast("int").alias("ordinal"), F.concat(quoted(F.col("key")), F.lit(" -> "), quoted(F.col("dep")), style).alias("value"))
    return head.unionByName(arrow).orderBy("place", "ordinal")


def graphviz_text(lines: DataFrame) -> DataFrame:
    """The lines with the graph's frame, in the order in which they are to be written."""
    spark = lines.sparkSession
    first = spark.createDataFrame([(0, "digraph build {")], "part int, value string")
    last = spark.createDataFrame([(2, "}")], "part int, value string")
    body = lines.select(F.lit(1).alias("part"), "place", "ordinal", "value")
    frame = first.unionByName(last).select("part", F.lit("").alias("place"), F.lit(0).alias("ordinal"), "value")
    return body.unionByName(frame).orderBy("part", "place", "ordinal").select("value")


def critical_path_json(path: DataFrame) -> DataFrame:
    """One row, value: {path: [ids], mapping: [{id, key, w}]} of a critical path's rows,
    which are as many as the graph is deep."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "key", "w")))
    return path.agg(rows.alias("r")).select(F.to_json(F.struct(F.transform("r", lambda x: x["ordinal"]).alias("path"), F.transform("r", lambda x: F.struct(x["ordinal"].alias("id"), x["key"].alias("key"), x["w"].alias("w"))).alias("mapping"))).alias("value"))


def critical_graphviz(path: DataFrame, edges: DataFrame, every_edge: bool = False) -> DataFrame:
    """(value): the path's own edges, or all edges of its keys; each once."""
    on = path.select("key")
    rows = edges.join(on, "key", "left_semi")
    if not every_edge:
        before = path.select("key", F.lag("key").over(Window.orderBy("ordinal")).alias("dep")).where("dep IS NOT NULL")  # as many rows as the path
        rows = rows.join(before, ["key", "dep"], "left_semi")
    return rows.select(F.concat(quoted(F.col("key")), F.lit(" -> "), quoted(F.col("dep"))).alias("value")).distinct()


def dummy_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, name): leaves I1, I2, ..., others N1, N2, ..., in the order of keys. Numbers
    come from counts by key range, so no task ranks all keys."""
    inner = edges.select("key").distinct().withColumn("__inner", F.lit(True))
    rows = nodes.select("key").distinct().join(inner, "key", "left").select("key", F.when(F.col("__inner"), "N").otherwise("I").alias("letter"))
    return ranked(rows, "letter", "key").select("key", F.concat("letter", F.col("rank").cast("string")).alias("name"))


def ninja(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, value): a manifest of the same shape: one build line for each inner node and
    the roots as defaults."""
    names = dummy_names(nodes, edges)
    deps = edges.select("key", "dep", "ordinal").join(names.select(F.col("key").alias("dep"), F.col("name").alias("input")), "dep")
    lists = deps.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "input"))), lambda x: x["input"]), " ").alias("ins"))
    builds = lists.join(names, "key").select(F.concat(F.lit("1"), "name").alias("place"), F.concat(F.lit("build "), "name", F.lit(": CMD "), "ins").alias("value"))
    roots = names.join(edges.select(F.col("dep").alias("key")), "key", "left_anti")
    return builds.unionByName(roots.select(F.concat(F.lit("2"), "name").alias("place"), F.concat(F.lit("default "), "name").alias("value")))


def manifest_json(commands: DataFrame) -> DataFrame:
    """(name, value): each command as JSON."""
    return commands.select("name", F.to_json(F.struct("name", "tool", "inputs", "outputs", "attrs")).alias("value")).orderBy("name")


def random_manifest(spark: SparkSession, widths: list[int], most_inputs: int, seed: int = 0) -> DataFrame:
    """(key, ordinal, dep): layers of these widths, each node with 1 to most_inputs distinct
    inputs drawn from the layer below by a hash; made in the executors."""
    out = None
    for level, (below, width) in enumerate(zip(widths, widths[1:]), 1):
        pick = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("id"), i), F.lit(below))
        n = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), F.col("id")), F.lit(min(most_inputs, below))) + 1
        picks = F.array_distinct(F.transform(F.sequence(F.lit(1), n.cast("int")), pick))
        rows = spark.range(width).select(F.concat(F.lit(f"L{level}-"), F.col("id").cast("string")).alias("key"), F.posexplode(picks).alias("ordinal", "p"))
        rows = rows.select("key", "ordinal", F.concat(F.lit(f"L{level - 1}-"), F.col("p").cast("string")).alias("dep"))
        out = rows if out is None else out.unionByName(rows)
    return out
