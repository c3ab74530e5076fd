"""What each kind of node is worth in a build: values from snapshots, listings and producers.

nodes: (node, kind), kind being plain, directory, structure or virtual; snapshot:
schema.FILE_INFO of what is there now. All of it is joins on the node's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from . import validity


def infos(nodes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """nodes with `info`, null where nothing is there. Directories go by their bare path."""
    fields = ("device", "inode", "mode", "size", "mtime_s", "mtime_ns", "checksum")
    now = snapshot.select(F.col("path").alias("__path"), F.struct(*fields).alias("info"))
    return nodes.withColumn("__path", trimmed(F.col("node"))).join(now, "__path", "left").drop("__path")


def input_values(nodes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(node, value, info) of nodes that no command makes."""
    rows = infos(nodes, snapshot)
    value = F.when(F.col("kind") == "virtual", "VirtualInput").when(validity.is_missing(F.col("info")), "MissingInput").otherwise("ExistingInput")
    return rows.select("node", value.alias("value"), F.when(value == "ExistingInput", F.col("info")).alias("info"))


def contents_values(nodes: DataFrame, snapshot: DataFrame, listings: DataFrame) -> DataFrame:
    """(node, value, names) of what is asked for its contents: names of a directory, a
    plain file as such, or missing."""
    rows = infos(nodes, snapshot).join(listings.select(F.col("directory").alias("__d"), "names"), trimmed(F.col("node")) == F.col("__d"), "left")
    value = F.when(validity.is_missing(F.col("info")), "MissingInput").when(~validity.is_directory(F.col("info")), "ExistingInput").otherwise("DirectoryContents")
    return rows.select("node", value.alias("value"), F.when(value == "DirectoryContents", F.coalesce("names", F.array().cast("array<string>"))).alias("names"))


def target_values(targets: DataFrame, values: DataFrame) -> DataFrame:
    """(target, value, missing): a target whose nodes are all there, or the number of those
    that are not. targets: (target, node)."""
    rows = targets.join(values.select("node", "value"), "node", "left")
    bad = F.count_if(F.coalesce(F.col("value").isin("MissingInput", "FailedInput", "MissingOutput"), F.lit(True)))
    return rows.groupBy("target").agg(bad.alias("missing")).select("target", F.when(F.col("missing") == 0, "Target").otherwise("Invalid").alias("value"), "missing")


def command_values(commands: DataFrame, inputs: DataFrame, values: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(command, value): a command with a failed input is not run but passes the failure
    on, one with a missing or skipped input is skipped or fails; others are what their run
    made of them. outcomes: (command, ok, signature)."""
    got = inputs.join(values.select("node", "value"), "node", "left")
    worst = got.groupBy("command").agg(F.max(F.when(F.col("value") == "FailedInput", 3).when(F.coalesce("value", F.lit("MissingInput")).isin("MissingInput", "MissingOutput"), 2).when(F.col("value") == "SkippedCommand", 1).otherwise(0)).alias("worst"))
    rows = commands.select("command").join(worst, "command", "left").join(outcomes, "command", "left")
    own = F.when(~F.coalesce("ok", F.lit(False)), "FailedCommand").when(F.col("signature").isNotNull(), "SuccessfulCommandWithOutputSignature").otherwise("SuccessfulCommand")
    value = F.when(F.col("worst") >= 2, "PropagatedFailureCommand").when(F.col("worst") == 1, "SkippedCommand").otherwise(own)
    return rows.select("command", value.alias("value"))


def with_dependencies(results: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, value, dep, dep_value): one result and, by name, those that it depends on."""
    own = results.where(F.col("key") == key).select("key", "value")
    deps = edges.where(F.col("key") == key).select("key", "dep").distinct()
    rows = own.join(deps, "key", "left").join(results.select(F.col("key").alias("dep"), F.col("value").alias("dep_value")), "dep", "left")
    return rows.select("key", "value", "dep", "dep_value").orderBy("dep")


def regenerated(results: DataFrame, manifests: DataFrame) -> DataFrame:
    """(key) of manifests that a first pass rebuilt: they are to be loaded once more."""
    return results.where("reason <> 'up-to-date'").join(manifests.select("key"), "key", "left_semi").select("key")
