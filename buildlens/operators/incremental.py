"""Incremental builds over DataFrames: what must run for a goal, why, and what stays.

build() walks the goals' demand closure from its leaves outward. In each round the keys
whose dependencies are all done are judged with one set of joins, those that must run
are computed with one call of the rule function, and an unchanged value keeps its
computed_at, so that nothing above it runs for its sake. Only one round's rows are
shuffled with it, and every round's state is written to the shared folder. Joins are
merged at every size, as in graph.

Old dependencies that a key no longer asks for are brought up to date all the same: the
plan works on sets and looks at all stored edges. build_dynamic() is for rule functions
that decide from values what to ask for next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import graph
from .history import collected, drop_single_use, run_reasons

#: Gets (key, inputs: ARRAY<STRUCT<ordinal, dep, value>>); gives (key, value) and, if it
#: has one, a boolean `force`: the value counts as changed even if it is not.
Compute = Callable[[DataFrame], DataFrame]


class MissingRules(ValueError):
    """keys: the first of the demanded keys that no rule is declared for."""

    def __init__(self, keys: list[str]):
        super().__init__(f"no rule for: {', '.join(keys)}")
        self.keys = keys


class Cycle(ValueError):
    """path: the keys of one cycle, the first repeated at the end."""

    def __init__(self, path: list[str]):
        super().__init__(f"cycle: {' -> '.join(path)}")
        self.path = path


def build(goals: DataFrame, rules: DataFrame, prior: DataFrame, edges: DataFrame, valid: DataFrame, compute: Compute, epoch: int) -> DataFrame:
    """(key, value, signature, built_at, computed_at, reason, round) of each demanded key.
    reason: never-built, signature-changed, invalid-value, input-rebuilt (these ran) or
    up-to-date. A rule of two declarations, a demanded key without a rule (inputs have rules
    too), or a cycle, is an error."""
    if not rules.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("a rule is declared more than once")
    edges = written(drop_single_use(edges))
    wanted = written(graph.closure(goals, edges).select("key"))
    edges = written(edges.join(wanted.hint("merge"), "key", "left_semi"))
    if lost := [r["key"] for r in wanted.join(rules.hint("merge"), "key", "left_anti").select("key").orderBy("key").limit(20).collect()]:
        raise MissingRules(lost)
    reasons = run_reasons(rules.join(wanted.hint("merge"), "key", "left_semi"), prior, valid)
    open_ = edges.groupBy("key").agg(F.count("*").alias("open"))
    before = prior.select("key", F.col("value").alias("old"), F.col("built_at").alias("old_built"), F.col("computed_at").alias("old_computed"))
    waiting = reasons.join(rules.select("key", "signature").hint("merge"), "key").join(before.hint("merge"), "key", "left").join(open_.hint("merge"), "key", "left")
    waiting = written(waiting.withColumn("open", F.coalesce("open", F.lit(0))).withColumn("late", F.lit(False)))
    done, last, turn = None, None, 0
    while True:
        if last is not None:
            fed = edges.join(last.select(F.col("key").alias("dep"), F.col("computed_at").alias("dep_computed")).hint("merge"), "dep").join(waiting.select("key", "old_built").hint("merge"), "key")
            late = ~F.coalesce("order_only", F.lit(False)) & (F.col("old_built") < F.col("dep_computed"))
            fed = fed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.coalesce(late, F.lit(False))).alias("fed_late"))
            waiting = waiting.where("open > 0").join(fed.hint("merge"), "key", "left")
            waiting = waiting.withColumn("open", F.col("open") - F.coalesce("n", F.lit(0))).withColumn("late", F.col("late") | F.coalesce("fed_late", F.lit(False))).drop("n", "fed_late")
            waiting = written(waiting)
        ready = waiting.where("open = 0").withColumn("reason", F.coalesce("reason", F.when(F.col("late"), "input-rebuilt").otherwise("up-to-date")))
        ready = written(ready)
        if ready.isEmpty():
            if not waiting.where("open > 0").isEmpty():
                raise Cycle(graph.cycle_path(edges, goals.agg(F.min("key")).first()[0]))
            return done
        run = ready.where("reason <> 'up-to-date'").select("key")
        got = compute(inputs_of(run, edges, done))
        got = got.select("key", "value", (F.col("force") if "force" in got.columns else F.lit(False)).alias("force"))
        rows = ready.join(got.hint("merge"), "key", "left")
        ran = F.col("reason") != "up-to-date"
        value = F.when(ran, F.col("value")).otherwise(F.col("old"))
        same = ~ran | (F.col("value").eqNullSafe(F.col("old")) & F.col("old_built").isNotNull() & ~F.coalesce("force", F.lit(False)))
        computed = F.when(same, F.col("old_computed")).otherwise(F.lit(epoch).cast("long"))
        built = F.when(ran, F.lit(epoch).cast("long")).otherwise(F.col("old_built"))
        last = written(rows.select("key", value.alias("value"), "signature", built.alias("built_at"), computed.alias("computed_at"), "reason", F.lit(turn).alias("round")))
        done = last if done is None else done.unionByName(last)
        turn += 1


def inputs_of(keys: DataFrame, edges: DataFrame, done: DataFrame | None) -> DataFrame:
    """(key, inputs) with the values of the keys' dependencies, in order."""
    if done is None:
        return keys.withColumn("inputs", F.array().cast("array<struct<ordinal:int,dep:string,value:string>>"))
    own = edges.join(keys.hint("merge"), "key", "left_semi").join(done.select(F.col("key").alias("dep"), "value").hint("merge"), "dep")
    lists = own.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "dep", "value"))).alias("inputs"))
    return keys.join(lists.hint("merge"), "key", "left").withColumn("inputs", F.coalesce("inputs", F.array().cast(lists.schema["inputs"].dataType)))


def persisted(results: DataFrame) -> DataFrame:
    """The rows of build() that ran, as they are stored."""
    return results.where("reason <> 'up-to-date'").select("key", "value", "signature", "built_at", "computed_at")


#: Gets (key, round, inputs: MAP<STRING,STRING>); gives (key, value, asks: ARRAY<STRING>):
#: a value ends the key, else it is asked again once all keys in asks have values.
Step = Callable[[DataFrame], DataFrame]


def build_dynamic(goals: DataFrame, step: Step, most_rounds: int = 10_000) -> DataFrame:
    """(key, value, deps) of all keys that turn out to be needed. Each key is worked on
    once however many ask for it; a key's asks so far come back as its inputs."""
    tasks = written(goals.select("key").distinct().select("key", F.array().cast("array<string>").alias("asks")))
    done = None
    for turn in range(most_rounds):
        wants = tasks.select("key", F.explode("asks").alias("dep"))
        if done is None:
            ready = tasks.select("key", "asks", F.create_map().cast("map<string,string>").alias("inputs"))
        else:
            have = wants.join(done.select(F.col("key").alias("dep"), "value").hint("merge"), "dep").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("dep", "value"))).alias("inputs"))
            ready = tasks.join(have.hint("merge"), "key", "left").where(F.size("asks") == F.coalesce(F.size("inputs"), F.lit(0)))
            ready = ready.withColumn("inputs", F.coalesce("inputs", F.create_map().cast("map<string,string>")))
        ready = written(ready)
        if ready.isEmpty():
            if tasks.isEmpty():
                return done
            raise Cycle(graph.cycle_path(wants.withColumn("ordinal", F.lit(0)), tasks.agg(F.min("key")).first()[0]))
        got = written(step(ready.select("key", F.lit(turn).alias("round"), "inputs")).select("key", "value", "asks"))
        ended = got.where("value IS NOT NULL").join(ready.select("key", F.col("asks").alias("deps")).hint("merge"), "key").select("key", "value", "deps")
        going = got.where("value IS NULL").join(ready.select("key", F.col("asks").alias("__asked")).hint("merge"), "key").select("key", F.array_union("__asked", "asks").alias("asks"))
        done = ended if done is None else done.unionByName(ended)
        done = written(done)
        stay = tasks.join(ready.select("key").hint("merge"), "key", "left_anti").unionByName(going)
        new = going.select(F.explode("asks").alias("key")).distinct().join(tasks.select("key").hint("merge"), "key", "left_anti").join(done.select("key").hint("merge"), "key", "left_anti")
        tasks = written(stay.unionByName(new.select("key", F.array().cast("array<string>").alias("asks"))))
    raise RuntimeError(f"no end after {most_rounds} rounds")


def break_cycle(edges: DataFrame, path: list[str]) -> DataFrame:
    """edges without the one that closes the cycle; the key at its end then goes by its
    prior value."""
    return edges.where(~((F.col("key") == path[-2]) & (F.col("dep") == path[-1])))


def without_phony_self_edges(edges: DataFrame, phony: DataFrame) -> DataFrame:
    """edges without those of phony keys on themselves."""
    own = phony.select(F.col("key").alias("__phony"))
    loops = edges.where("key = dep").join(own, F.col("key") == F.col("__phony"), "left_semi").select("key", "dep").distinct()
    return edges.join(loops, ["key", "dep"], "left_anti")


def early_cutoff(prior: DataFrame, edges: DataFrame, changed: DataFrame, unchanged: DataFrame) -> DataFrame:
    """(key, reason): which keys run when `changed` keys have new values, and those in
    `unchanged` turn out as before. Dependents are followed outward, past the latter no
    further. reason: changed, or input-rebuilt."""
    back = edges.where(~F.coalesce("order_only", F.lit(False))).select("key", "dep")
    stops = unchanged.select("key").distinct()
    found = frontier = written(changed.select("key").distinct())
    out = frontier.withColumn("reason", F.lit("changed"))
    while True:
        open_ = frontier.join(stops.hint("merge"), "key", "left_anti").select(F.col("key").alias("dep"))
        frontier = written(back.join(open_.hint("merge"), "dep", "left_semi").select("key").distinct().join(found.hint("merge"), "key", "left_anti"))
        if frontier.isEmpty():
            return out.join(prior.select("key").hint("merge"), "key", "left_semi")
        found = found.unionByName(frontier)
        out = out.unionByName(frontier.withColumn("reason", F.lit("input-rebuilt")))


def edge_lists(edges: DataFrame) -> DataFrame:
    """(key, deps) as they are stored."""
    return collected(edges)
