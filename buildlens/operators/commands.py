"""Commands and the nodes they read and write.

commands: schema.COMMANDS; links between commands and nodes are exploded, so each
operator is a join or an aggregation by node or command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, node_kind, trimmed, under
from .graph import ranked


def outputs(commands: DataFrame) -> DataFrame:
    """(command, ordinal, node)"""
    return commands.select(F.col("name").alias("command"), F.posexplode("outputs").alias("ordinal", "node"))


def inputs(commands: DataFrame) -> DataFrame:
    return commands.select(F.col("name").alias("command"), F.posexplode("inputs").alias("ordinal", "node"))


def producers(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """(node, producers, command): how many commands make each node, and the one if it
    is one; others are left to the caller to decide."""
    per = made.groupBy("node").agg(F.countDistinct("command").alias("producers"), F.min("command").alias("command"))
    rows = nodes.select("node").join(per, "node", "left").withColumn("producers", F.coalesce("producers", F.lit(0)))
    return rows.withColumn("command", F.when(F.col("producers") == 1, F.col("command")))


def default_targets(made: DataFrame, used: DataFrame) -> DataFrame:
    """Nodes that some command makes and none uses."""
    return made.select("node").distinct().join(used.select("node").distinct(), "node", "left_anti")


def produced_values(made: DataFrame, results: DataFrame) -> DataFrame:
    """(node, command, kind, info): what a command's result means for each of its outputs.
    results: (command, kind, infos), infos in the order of the outputs."""
    rows = made.join(results, "command", "left")
    info = F.get("infos", F.col("ordinal"))
    missing = F.coalesce(info["size"] == 0, F.lit(True)) & F.coalesce(info["mtime_s"] == 0, F.lit(True))
    kind = (
        F.when(F.col("kind").isNull() | F.col("kind").isin("FailedCommand", "PropagatedFailureCommand", "CancelledCommand"), "FailedInput")
        .when(F.col("kind") == "SkippedCommand", "SkippedCommand")
        .when(node_kind(F.col("node")) == "virtual", "VirtualInput")
        .when(missing, "MissingOutput")
        .otherwise("ExistingInput")
    )
    return rows.select("node", "command", kind.alias("kind"), info.alias("info"))


def missing_by_target(targets: DataFrame, missing: DataFrame) -> DataFrame:
    """(target, missing): names, sorted and joined, of what each target lacks. The names
    are reduced to distinct pairs before they meet."""
    rows = targets.select("target", "node").join(missing.select("node"), "node", "left_semi").distinct()
    return rows.groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("missing"))


def composite(made: DataFrame) -> DataFrame:
    """(key, command, node): for a command of several outputs the joint rule's key, `a&&b`,
    and one row for each output that selects from it."""
    joint = made.groupBy("command").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node"))), lambda x: x["node"]), "&&").alias("key"), F.count("*").alias("__n"))
    return made.join(joint.where("__n > 1"), "command").select("key", "command", "node", "ordinal")


def shortest_first(made: DataFrame) -> DataFrame:
    """made with `place`: the rank of an output among its command's, by length, then name."""
    return made.withColumn("place", F.row_number().over(Window.partitionBy("command").orderBy(F.length("node"), "node")))


def owners(made: DataFrame, used: DataFrame) -> DataFrame:
    """(command, directory, owner, node): outputs that lie in a directory that a command
    consumes, and the commands that own them. A prefix join through the outputs'
    ancestors, so both sides shuffle on equality."""
    directories = used.where(F.col("node").endswith("/")).select("command", F.col("node").alias("directory"), trimmed(F.col("node")).alias("__at")).distinct()
    above = made.select(F.col("command").alias("owner"), "node", F.explode(ancestors(F.col("node"))).alias("__at"))
    return directories.join(above, "__at").where("command <> owner").drop("__at")


def conflicts(made: DataFrame) -> DataFrame:
    """(node, owner, inside, by): an output that lies within another command's output."""
    above = made.select(F.col("command").alias("by"), F.col("node").alias("inside"), F.explode(ancestors(F.col("node"))).alias("__at"))
    tops = made.select(F.col("command").alias("owner"), "node", trimmed(F.col("node")).alias("__at"))
    return above.join(tops, "__at").where("owner <> by AND node <> inside").select("node", "owner", "inside", "by").distinct()


def stale(prior: DataFrame, expected: DataFrame) -> DataFrame:
    """(path): what was made once and is no longer expected."""
    return prior.select("path").distinct().join(expected.select("path"), "path", "left_anti")


def removals(prior: DataFrame, expected: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(path, action): remove; or, where roots are given, skip-relative and skip-outside."""
    rows = stale(prior, expected)
    if roots is None:
        return rows.withColumn("action", F.lit("remove"))
    tops = roots.select(trimmed(F.col("root")).alias("__root")).distinct()
    inside = rows.select("path", F.explode(ancestors(F.col("path"))).alias("__root")).join(tops, "__root").select("path").distinct().withColumn("__in", F.lit(True))
    action = F.when(~F.col("path").startswith("/"), "skip-relative").when(F.col("__in"), "remove").otherwise("skip-outside")
    return rows.join(inside, "path", "left").select("path", action.alias("action"))


def within(path: Column, roots: list[str]) -> Column:
    """Whether a path lies below one of a few fixed roots."""
    out = F.lit(False)
    for root in roots:
        out = out | under(path, F.lit(root))
    return out


def tolerated(outcomes: DataFrame, most: int, order: str = "ordinal") -> DataFrame:
    """outcomes with `cancelled`: true beyond the place where `most` failures have been
    seen (0: never). The place is one number, found by a bounded top-k."""
    if most <= 0:
        return outcomes.withColumn("cancelled", F.lit(False))
    place = outcomes.where("failed").select(order).orderBy(order).limit(most).agg(F.count("*").alias("n"), F.max(order).alias("at"))
    n, at = place.first()  # two numbers
    return outcomes.withColumn("cancelled", F.col(order) > at if n == most else F.lit(False))


def queue_order(jobs: DataFrame, by_name: bool = False) -> DataFrame:
    """jobs sorted: the prioritised first, then in order of arrival, or the greatest name
    first."""
    first = F.when(F.col("priority"), 0).otherwise(1)
    return jobs.orderBy(first, F.desc("name") if by_name else F.col("arrival"), "arrival")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `place`, from 1 in this order of ascending values, ranked in ranges in parallel."""
    named = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)])
    return ranked(rows.withColumn("__all", F.lit(0)).withColumn("__order", named), "__all", "__order").drop("__all", "__order").withColumnRenamed("rank", "place")


def action_order(actions: DataFrame) -> DataFrame:
    """Priority, then the earlier build, then the earlier piece of work."""
    return actions.orderBy(F.desc("priority"), "build_id", "work_id")


#: Open files that a build keeps for itself, files of a task, background
#: tasks at most, and these for each lane.
RESERVED_FILES, TASK_FILES, MOST_BACKGROUND, BACKGROUND_PER_LANE = 10, 2, 1024, 64


def lanes(limit: Column, asked: Column) -> Column:
    """STRUCT<lanes, background>: what a limit of open files allows of the lanes asked for,
    and how many background tasks fit beside them."""
    tasks = F.greatest(F.lit(0), F.floor((limit - RESERVED_FILES) / TASK_FILES))
    extra = F.least(F.lit(MOST_BACKGROUND), asked * BACKGROUND_PER_LANE, tasks - asked)
    enough = asked <= tasks
    return F.struct(F.when(enough, asked).otherwise(F.greatest(F.lit(1), tasks)).alias("lanes"), F.when(enough, extra).otherwise(F.lit(0)).alias("background"))


def environment(own: Column, inherited: Column, inherit: Column) -> Column:
    """A command's variables: its own, and, if it inherits, what they do not set."""
    from ..functions.text import merge_first_wins

    return F.when(inherit, merge_first_wins(own, inherited)).otherwise(own)


def command_signature(commands: DataFrame) -> Column:
    """A command's signature: the declared one, else its tool, arguments and attributes in order."""
    from ..functions.text import fold_hash

    attrs = F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    lists = F.array_sort(F.transform(F.map_entries("list_attrs"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], "\0"))))
    parts = F.concat(F.array("tool"), F.col("inputs"), F.array(F.lit("|")), F.col("outputs"), F.array(F.lit("|")), attrs, lists)
    return F.coalesce(F.element_at("attrs", "signature"), fold_hash(parts))
