"""Operators on the dependency graph: edges (key, dep) say that key depends on dep.

Everything that needs a fix-point is a loop over DataFrames whose frontier is written to
the shared folder each round, so neither lineage nor driver memory grows. Where every
key has at most one dependency (forests, chains), pointer doubling needs only as many
rounds as the depth has binary digits.

Names compress well, so a file's size says little about a table's size in memory: joins
are merged at every size, unless a table's rows have been counted and are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


#: A table of so many rows may be sent whole to every executor.
FEW = 10_000


def sized(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are n, as one side of a join."""
    return rows.hint("broadcast" if n <= FEW else "merge")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys that no other key depends on."""
    return nodes.join(edges.select(F.col("dep").alias("key")).hint("merge"), "key", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys without dependencies."""
    return nodes.join(edges.select("key").hint("merge"), "key", "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, deps, dependents)."""
    ends = edges.select("key", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dep").alias("key"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("key").agg(F.sum("o").alias("deps"), F.sum("i").alias("dependents"))
    return nodes.select("key").join(sums.hint("merge"), "key", "left").na.fill(0, ["deps", "dependents"])


def closure(goals: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys that the goals demand, directly or not, themselves included; with `depth`,
    the least number of edges from a goal. Cycles end the search, not the loop."""
    edges = written(edges.select("key", "dep").distinct())
    if single_parent(edges):
        return upward(goals, edges)
    frontier = written(goals.select("key").distinct())
    found, depth = frontier.withColumn("depth", F.lit(0)), 0
    while not frontier.isEmpty():
        depth += 1
        reached = edges.join(frontier.hint("merge"), "key", "left_semi").select(F.col("dep").alias("key")).distinct()
        frontier = written(reached.join(found.select("key").hint("merge"), "key", "left_anti"))
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return found


def upward(goals: DataFrame, edges: DataFrame) -> DataFrame:
    """closure() where each key has at most one dependency: the k-th round reaches
    2^k edges far, by jumps of that length."""
    found = written(goals.select("key").distinct().withColumn("depth", F.lit(0)))
    jump, length, n = edges.select("key", F.col("dep").alias("up")), 1, found.count()
    while True:
        far = sized(found, n).join(jump, "key").select(F.col("up").alias("key"), (F.col("depth") + length).alias("depth"))
        found = written(found.unionByName(far).groupBy("key").agg(F.min("depth").alias("depth")))
        before, n = n, found.count()
        if n == before:
            return found
        jump = written(jump.join(jump.select(F.col("key").alias("up"), F.col("up").alias("__up")).hint("merge"), "up").select("key", F.col("__up").alias("up")))
        length *= 2


def single_parent(edges: DataFrame) -> bool:
    return edges.groupBy("key").count().where("count > 1").isEmpty()


def doubled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (key, w) with level and total: the number of edges, and the sum of w, along
    the one path of dependencies from each key. Each key has at most one dependency. A
    path longer than there are keys is a cycle, and a ValueError."""
    now = nodes.select("key", "w").join(edges.select("key", F.col("dep").alias("up")).hint("merge"), "key", "left")
    rounds = nodes.count().bit_length() + 1
    now = written(now.select("key", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level"), F.col("w").cast("decimal(38,2)").alias("total")))
    # what has reached its end is kept, but not joined again
    done, going = now.where("up IS NULL"), now.where("up IS NOT NULL")
    while not going.isEmpty():
        if not (rounds := rounds - 1):
            raise ValueError("the graph has cycles")
        above = done.unionByName(going).select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("level").alias("level2"), F.col("total").alias("total2"))
        step = going.join(above.hint("merge"), "up", "left")
        now = written(step.select("key", F.col("up2").alias("up"), (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level"), (F.col("total") + F.coalesce("total2", F.lit(0))).cast("decimal(38,2)").alias("total")))
        done, going = done.unionByName(now.where("up IS NULL")), now.where("up IS NOT NULL")
    return done.select("key", "level", "total")


def acyclic(edges: DataFrame) -> DataFrame:
    """What is left of the edges after removing, again and again, those whose key has no
    dependent and those whose dep has no dependency: empty, unless there are cycles. Where
    each key has at most one dependency, it is the edges of the keys on cycles."""
    left = written(edges.select("key", "dep").distinct())
    if single_parent(left):
        return left.join(turning(left).hint("merge"), "key", "left_semi")
    n, before = left.count(), -1
    while n and n != before:
        before = n
        left = left.join(left.select(F.col("dep").alias("key")).distinct().hint("merge"), "key", "left_semi")
        left = left.join(left.select(F.col("key").alias("dep")).distinct().hint("merge"), "dep", "left_semi").select("key", "dep")
        left = written(left)
        n = left.count()
    return left


def turning(edges: DataFrame) -> DataFrame:
    """(key) on a cycle, where each key has at most one dependency. Jumps go on only from
    keys that jumps end at, and are twice as long in each round; where these are all keys
    that jumps start from, they turn in cycles."""
    jump, n = edges.select("key", F.col("dep").alias("up")), edges.count()
    while True:
        met = written(jump.join(jump.select(F.col("up").alias("key")).distinct().hint("merge"), "key", "left_semi"))
        if (left := met.count()) == n:
            return met.select("key")
        far = sized(met.select(F.col("key").alias("up"), F.col("up").alias("__up")), left)
        jump = written(met.join(far, "up").select("key", F.col("__up").alias("up")))
        n = jump.count()


def on_cycles(edges: DataFrame) -> DataFrame:
    """(key) on a cycle or on a path between cycles."""
    left = acyclic(edges)
    return left.select("key").union(left.select("dep")).distinct()


def cycle_path(edges: DataFrame, start: str) -> list[str]:
    """One cycle that start reaches, in the order of names, its first key repeated last;
    [] if there is none. Only the residue of acyclic() is walked, one edge at a time."""
    left = acyclic(edges)
    inside = closure(left.sparkSession.createDataFrame([(start,)], "key string"), edges).join(left.select("key").distinct().hint("merge"), "key", "left_semi")
    first = inside.agg(F.min("key")).first()[0]
    path: list[str] = []
    while first is not None and first not in path:
        path.append(first)
        first = left.where(F.col("key") == first).agg(F.min("dep")).first()[0]
    return path[path.index(first) :] + [first] if first is not None else []


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, level): 0 without dependencies, else one more than the deepest dependency."""
    return longest_paths(nodes.select("key").withColumn("w", F.lit(0)), edges).select("key", "level")


def longest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, level, total): the greatest sum of w over the key's paths of dependencies.
    Raises ValueError if there is a cycle. A dependency that is no node is a leaf without
    weight: it has no row, but counts as a level of what depends on it.

    In each round the keys whose dependencies are all placed are placed, with the sums
    of only that round's edges shuffled; if none is ready but some wait, there is a cycle."""
    edges = written(edges.select("key", "dep").distinct().join(nodes.select("key").hint("merge"), "key", "left_semi"))
    if single_parent(edges):
        return doubled(nodes, edges)
    inner = nodes.select("key", F.col("w").cast("decimal(38,2)").alias("w"), F.lit(True).alias("inner"))
    outer = edges.select(F.col("dep").alias("key")).distinct().join(nodes.select("key").hint("merge"), "key", "left_anti")
    weights = inner.unionByName(outer.select("key", F.lit(0).cast("decimal(38,2)").alias("w"), F.lit(False).alias("inner")))
    state = written(weights.join(edges.groupBy("key").agg(F.count("*").alias("open")).hint("merge"), "key", "left").select("key", "w", "inner", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).cast("decimal(38,2)").alias("best")))
    placed, level = None, 0
    while True:
        ready = written(state.where("open = 0").select("key", "inner", F.lit(level).cast("long").alias("level"), (F.col("best") + F.col("w")).cast("decimal(38,2)").alias("total")))
        if ready.isEmpty():
            if not state.isEmpty():
                raise ValueError("the graph has cycles")
            return (placed if placed is not None else ready).where("inner").drop("inner")
        placed = ready if placed is None else placed.unionByName(ready)
        fed = edges.join(ready.select(F.col("key").alias("dep"), "total").hint("merge"), "dep").groupBy("key").agg(F.count("*").alias("n"), F.max("total").alias("m"))
        state = state.where("open > 0").join(fed.hint("merge"), "key", "left")
        state = written(state.select("key", "w", "inner", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("best", F.coalesce("m", F.lit(0))).cast("decimal(38,2)").alias("best")))
        level += 1


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ordinal, key, w, total): the chain with the greatest sum of w, dependencies first.
    Equal sums go to the least key."""
    totals = written(longest_paths(nodes, edges))
    below = edges.select("key", "dep").join(totals.select(F.col("key").alias("dep"), "total").hint("merge"), "dep")
    chosen = written(below.groupBy("key").agg(F.min_by("dep", F.struct(-F.col("total"), F.col("dep"))).alias("dep")))
    path = written(upward(totals.orderBy(F.desc("total"), "key").limit(1), chosen))
    deepest, n = path.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count("*")).first()  # two numbers
    rows = sized(sized(path, n).join(totals, "key"), n).join(nodes.select("key", "w"), "key")
    return rows.select((F.lit(deepest) - F.col("depth")).alias("ordinal"), "key", "w", "total")


def validate_path(path: DataFrame, edges: DataFrame, ordinal: str = "ordinal", group: list[str] | None = None) -> DataFrame:
    """path with `ok`: whether each element depends on the one before it."""
    before = F.lag("key").over(Window.partitionBy(*(group or [])).orderBy(ordinal))
    rows = path.withColumn("__before", before)
    known = edges.select(F.col("key").alias("__k"), F.col("dep").alias("__d")).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(known, (F.col("key") == F.col("__k")) & (F.col("__before") == F.col("__d")), "left")
    return out.withColumn("ok", F.col("__before").isNull() | F.coalesce("__hit", F.lit(False))).drop("__before", "__k", "__d", "__hit")


def ranked(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with `rank` from 1 within group by order: ranges are sorted in parallel, and
    each range's first rank follows from the counts of the ranges before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    past = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "__part", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))  # one row a range
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order))
    return dealt.withColumn("__own", own).join(before, [group, "__part"]).withColumn("rank", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def dense_ids(elements: DataFrame, column: str) -> DataFrame:
    """element and its dense id from 0 in the order of elements; equal elements have one id."""
    rows = elements.select(column).distinct().withColumn("__all", F.lit(0))
    return ranked(rows, "__all", column).select(column, (F.col("rank") - 1).alias("id"))


def propagate(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(key, state): 'failed' where listed, 'propagated' where a dependency, near or far,
    failed, else 'ok'. Dependents of failures are followed outward, level by level."""
    back = edges.select(F.col("dep").alias("key"), F.col("key").alias("dep"))
    hit = closure(failed, back).select("key", F.when(F.col("depth") == 0, "failed").otherwise("propagated").alias("state"))
    return nodes.select("key").join(hit.hint("merge"), "key", "left").withColumn("state", F.coalesce("state", F.lit("ok")))
