"""Traces, profiles and processes: pairing of begins and ends, counters, progress, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .graph import ranked

#: What the counters of a build are called, by the tag that they count.
STATUS = {"scanning": "command-scanning", "up_to_date": "command-up-to-date", "started": "command-started", "finished": "command-finished", "failed": "command-failed", "skipped": "command-skipped"}


def intervals(events: DataFrame, lane: str = "lane", order: str = "ts") -> DataFrame:
    """Begin and end rows of a profile (ph = B or E) as (lane, name, begin, end): in one
    lane each end closes the begin just before it. Rows are ranked in ranges of time, so a
    lane is not one task, and a begin meets the next rank of its lane in a join."""
    rows = written(ranked(events.select(lane, "name", "ph", order), lane, order))
    ends = rows.where("ph = 'E'").select(F.col(lane).alias("__lane"), (F.col("rank") - 1).alias("__rank"), F.col(order).alias("end"))
    starts = rows.where("ph = 'B'")
    return starts.join(ends, F.col(lane).eqNullSafe(F.col("__lane")) & (F.col("rank") == F.col("__rank")), "left").select(lane, "name", F.col(order).alias("begin"), "end")


def until_next(events: DataFrame, lane: str, order: str) -> DataFrame:
    """events with `until`, the time of the lane's next event."""
    return events.withColumn("until", F.lead(order).over(Window.partitionBy(lane).orderBy(order)))


def busy(spans: DataFrame, lane: str, begin: str, end: str) -> DataFrame:
    """(lane, spans, busy): of each lane the number of spans and their summed length."""
    return spans.groupBy(lane).agg(F.count("*").alias("spans"), F.sum(F.col(end) - F.col(begin)).alias("busy"))


def counters(events: DataFrame, tags: dict[str, str] = STATUS, by: list[str] | None = None) -> DataFrame:
    """One column for each name in tags: how many events have that tag."""
    return events.groupBy(*(by or [])).agg(*[F.count_if(F.col("tag") == tag).alias(name) for name, tag in tags.items()])


def progress(counts: DataFrame) -> DataFrame:
    """counts (finished, total, elapsed) with the numbers that a status line shows."""
    rate = F.when(F.col("elapsed") > 0, F.col("finished") / F.col("elapsed"))
    left = F.col("total") - F.col("finished")
    return counts.withColumn("percent", F.when(F.col("total") > 0, F.floor(100 * F.col("finished") / F.col("total"))).otherwise(0)).withColumn("rate", rate).withColumn("remaining", left).withColumn("eta", F.when(rate > 0, left / rate))


#: What a status line's letters stand for, by column of progress().
STATUS_LETTERS = {"s": "started", "t": "total", "r": "running", "u": "unstarted", "f": "finished", "o": "rate", "c": "rate", "p": "percent", "e": "elapsed"}


def status_line(template: str, columns: dict[str, Column]) -> Column:
    """The template with %x replaced; %% is a percent sign, unknown letters stay."""
    parts, i = [], 0
    while i < len(template):
        if template[i] == "%" and i + 1 < len(template):
            c = template[i + 1]
            value = F.lit("%") if c == "%" else columns[STATUS_LETTERS[c]].cast("string") if c in STATUS_LETTERS and STATUS_LETTERS[c] in columns else F.lit("%" + c)
            parts.append(F.coalesce(value, F.lit("?")))
            i += 2
        else:
            parts.append(F.lit(template[i]))
            i += 1
    return F.concat(*parts) if parts else F.lit("")


def profile_rows(spans: DataFrame) -> DataFrame:
    """(value): the begin and end events of spans (name, lane, begin_us, end_us) as JSON lines."""
    row = lambda ph, ts: F.to_json(F.struct(F.col("name"), F.lit(ph).alias("ph"), F.lit(0).alias("pid"), F.col("lane").alias("tid"), F.col(ts).alias("ts")))
    both = F.array(F.struct(F.col("begin_us").alias("ts"), row("B", "begin_us").alias("value")), F.struct(F.col("end_us").alias("ts"), row("E", "end_us").alias("value")))
    return spans.select(F.explode(both).alias("e")).select("e.ts", "e.value")


def trace_rows(results: DataFrame) -> DataFrame:
    """schema.TRACE_EVENTS of a build's results (key, reason, round): what was scanned,
    what ran and why, what was kept."""
    ran = F.col("reason") != "up-to-date"
    events = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("n"), F.lit("checking-rule-needs-to-run").alias("tag"), F.col("key").alias("a1"), F.lit(None).cast("string").alias("a2"), F.lit(None).cast("string").alias("a3")),
            F.struct(F.lit(1).alias("n"), F.when(ran, "rule-needs-to-run").otherwise("rule-does-not-need-to-run").alias("tag"), F.col("key").alias("a1"), F.when(ran, F.col("reason")).alias("a2"), F.lit(None).cast("string").alias("a3")),
            F.when(ran, F.struct(F.lit(2).alias("n"), F.lit("finished-task").alias("tag"), F.col("key").alias("a1"), F.lit(None).cast("string").alias("a2"), F.lit(None).cast("string").alias("a3"))),
        )
    )
    rows = results.select("round", "key", F.explode(events).alias("e")).select("round", "key", "e.n", "e.tag", "e.a1", "e.a2", "e.a3")
    # sequence numbers: a round's rows come after those of the rounds before it
    per = rows.groupBy("round").agg(F.count("*").alias("__n"))
    base = per.select("round", F.coalesce(F.sum("__n").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # one row a round
    placed = ranked(rows.withColumn("__order", F.struct("key", "n")), "round", "__order")
    return placed.join(base, "round").select((F.col("__base") + F.col("rank") - 1).alias("seq"), "tag", "a1", "a2", "a3")


def processes(events: DataFrame) -> DataFrame:
    """schema.PROCESSES from log events (pid, event: START or EXIT, parent, name, args,
    time_us, user_us, user_s, sys_s); a pid that is used again is another process. Times
    without their other half are null."""
    w = Window.partitionBy("pid").orderBy("time_us")
    rows = events.withColumn("__life", F.sum((F.col("event") == "START").cast("int")).over(w))
    at = lambda e, c: F.max(F.when(F.col("event") == e, F.col(c)))
    return rows.groupBy("pid", "__life").agg(
        at("START", "parent").alias("parent"), at("START", "name").alias("name"), at("START", "args").alias("args"),
        at("START", "time_us").alias("start_us"), at("EXIT", "time_us").alias("exit_us"),
        at("START", "user_us").alias("user_start_us"), at("EXIT", "user_us").alias("user_exit_us"),
        at("EXIT", "user_s").alias("user_s"), at("EXIT", "sys_s").alias("sys_s"),
    ).drop("__life")


def with_lags(rows: DataFrame) -> DataFrame:
    """processes with wall time and the lags before and after their own code, in seconds."""
    s = lambda a, b: (F.col(a) - F.col(b)) / 1e6
    return rows.withColumn("wall_s", s("exit_us", "start_us")).withColumn("start_lag_s", s("user_start_us", "start_us")).withColumn("exit_lag_s", s("exit_us", "user_exit_us"))


def with_depth(rows: DataFrame) -> DataFrame:
    """processes with `depth`: 0 where the parent is not among them. Level by level."""
    keys = written(rows.select("pid", "parent").distinct())
    level = written(keys.join(keys.select(F.col("pid").alias("parent")).distinct(), "parent", "left_anti").select("pid"))
    depth, n = level.withColumn("depth", F.lit(0)), 0
    while not level.isEmpty():
        n += 1
        below = keys.join(level.select(F.col("pid").alias("parent")), "parent", "left_semi").select("pid").distinct()
        level = written(below.join(depth.select("pid"), "pid", "left_anti"))
        depth = depth.unionByName(level.withColumn("depth", F.lit(n)))
    return rows.join(depth, "pid", "left")


def aggregate(rows: DataFrame) -> DataFrame:
    """(name, depth, n, wall_s, user_s, sys_s, start_lag_s, exit_lag_s), the longest first."""
    sums = [F.sum(c).alias(c) for c in ("wall_s", "user_s", "sys_s", "start_lag_s", "exit_lag_s")]
    return rows.groupBy("name", "depth").agg(F.count("*").alias("n"), *sums).orderBy(F.desc("wall_s"), "name", "depth")


def focus(rows: DataFrame, name: str) -> DataFrame:
    """On each path from a root the first processes of this name, and what lies below them."""
    hits = rows.where(F.col("name") == name).select("pid")
    keys = rows.select("pid", "parent").distinct()
    found = level = written(hits)
    inner = None
    while not level.isEmpty():
        level = written(keys.join(level.select(F.col("pid").alias("parent")), "parent", "left_semi").select("pid").distinct().join(inner.select("pid") if inner is not None else level.select("pid").where("false"), "pid", "left_anti"))
        inner = level if inner is None else inner.unionByName(level)
    tops = found.join(inner, "pid", "left_anti") if inner is not None else found
    return rows.join(found.unionByName(inner).distinct() if inner is not None else found, "pid", "left_semi").join(tops.withColumn("is_top", F.lit(True)), "pid", "left").withColumn("is_top", F.coalesce("is_top", F.lit(False)))


def samples(rows: DataFrame) -> DataFrame:
    """(name, depth, args, n, times): the wall times of equal command lines, sorted."""
    return rows.groupBy("name", "depth", "args").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("wall_s")).alias("times"))
