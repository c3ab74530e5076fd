"""Content-addressed objects, the action cache, requests and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, merge_last_wins, stable_id
from .graph import ranked
from .history import upserted


def identify(objects: DataFrame) -> DataFrame:
    """objects (refs, data) with their id."""
    return objects.withColumn("id", content_id(F.col("data"), F.coalesce("refs", F.array().cast("array<string>"))))


def put(store: DataFrame, objects: DataFrame) -> DataFrame:
    """The store with the objects; equal ones are there once. Ids are compared, the
    content is moved only for what is new."""
    new = identify(objects).select("id", "refs", "data").dropDuplicates(["id"])
    return store.select("id", "refs", "data").unionByName(new.join(store.select("id"), "id", "left_anti"))


def get(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, refs, data, found): an unknown id gives an empty object, no error."""
    rows = wanted.select("id").join(store.select("id", "refs", "data", F.lit(True).alias("found")), "id", "left")
    return rows.select("id", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), F.coalesce("data", F.lit(b"")).alias("data"), F.coalesce("found", F.lit(False)).alias("found"))


def contains(store: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("id").join(store.select("id", F.lit(True).alias("found")).distinct(), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def probe(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """requests with the cached value_id and `hit`; what missed is left to compute."""
    known = cache.select(*keys, "value_id").withColumn("__hit", F.lit(True))
    return requests.join(known, keys, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def remember(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with new entries in place of old ones."""
    return upserted(cache, new, keys)


def transition_keys(tasks: DataFrame) -> DataFrame:
    """tasks (context, signature, inputs: ARRAY<STRING>, pending, cacheable) with the
    memo's key; null where a task may not be memoised."""
    key = stable_id("transition", F.concat_ws("\0", "context", "signature", F.array_join("inputs", "\1")))
    return tasks.withColumn("memo_key", F.when(F.col("cacheable") & (F.col("pending") == 0), key))


def unblocked(waits: DataFrame, done: DataFrame) -> DataFrame:
    """(task): those of waits (task, id) whose ids are all done."""
    left = waits.join(done.select("id").distinct().withColumn("__done", F.lit(True)), "id", "left")
    return left.groupBy("task").agg(F.max(F.col("__done").isNull()).alias("open")).where("NOT open").select("task")


def requests(asked: DataFrame) -> DataFrame:
    """(request_id, label, askers): one request for each label, however many ask for it."""
    return asked.groupBy("label").agg(F.count("*").alias("askers")).select(stable_id("artifact", F.col("label")).alias("request_id"), "label", "askers")


def longest_prefix(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """labels (label, components) with `rule`, that of the longest prefix among rules
    (prefix: components joined by /, rule), or null. A label's prefixes are few, so the
    lookup is an equi-join."""
    prefixes = F.transform(F.sequence(F.lit(0), F.size("components")), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice("components", F.lit(1), F.greatest(n, F.lit(1))), "/")))
    each = labels.select("label", F.posexplode(prefixes).alias("n", "prefix"))
    best = each.join(rules.select("prefix", "rule"), "prefix").groupBy("label").agg(F.max_by("rule", F.struct("n", "rule")).alias("rule"))
    return labels.join(best, "label", "left")


def resolved(labels: DataFrame, active: DataFrame, rules: DataFrame, providers: DataFrame) -> DataFrame:
    """labels with `by` and `how`: an active task comes first, then the label's rule, then
    a provider of its longest prefix; else no-rule. Two rules for one label are ambiguous."""
    one_rule = rules.groupBy("label").agg(F.min("rule").alias("__rule"), F.count("*").alias("__rules"))
    rows = labels.join(active.select("label", F.col("task").alias("__task")), "label", "left").join(one_rule, "label", "left")
    rows = longest_prefix(rows, providers.withColumnRenamed("provider", "rule")).withColumnRenamed("rule", "__provider")
    how = F.when(F.col("__task").isNotNull(), "task").when(F.col("__rules") > 1, "ambiguous").when(F.col("__rules") == 1, "rule").when(F.col("__provider").isNotNull(), "provider").otherwise("no-rule")
    by = F.when(how == "task", F.col("__task")).when(how == "rule", F.col("__rule")).when(how == "provider", F.col("__provider"))
    return rows.select("label", how.alias("how"), by.alias("by"))


def platform(*sources):
    """A platform's properties; later sources win, names are sorted."""
    return merge_last_wins(*sources)


def runs_here(properties, architectures: list[str], platform_name: str):
    """Whether an action needs nothing beyond this machine: at most an architecture that
    it has and its own platform."""
    arch, name = F.element_at(properties, "arch"), F.element_at(properties, "platform")
    rest = F.map_filter(properties, lambda k, v: ~k.isin("arch", "platform"))
    return (F.size(rest) == 0) & F.coalesce(arch.isin(*architectures), F.lit(True)) & F.coalesce(name == platform_name, F.lit(True))


def log_segments(log: DataFrame, length: int = 256, channel: str = "channel", order: str = "seq") -> DataFrame:
    """(channel, segment, id, prev, root, entries): a log cut into segments of `length`
    entries, each with its id, its predecessor's, and the first one's. Entries are ranked
    in parallel; only one row a segment is put in order by channel."""
    cut = ranked(log, channel, order).withColumn("segment", F.floor((F.col("rank") - 1) / length).cast("long"))
    segments = cut.groupBy(channel, "segment").agg(F.count("*").alias("entries"), F.array_sort(F.collect_list(F.struct(F.col(order), F.col("entry")))).alias("__e"))
    segments = segments.select(channel, "segment", "entries", F.sha2(F.array_join(F.transform("__e", lambda e: F.sha2(e["entry"].cast("binary"), 256)), ""), 256).alias("id"))
    chain = Window.partitionBy(channel).orderBy("segment")
    return segments.select(channel, "segment", "id", F.lag("id").over(chain).alias("prev"), F.first("id").over(chain).alias("root"), "entries")
