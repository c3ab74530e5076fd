"""The build history: keys, their results by epoch, and point, join and scan queries.

Results are `PRIOR` rows (key, value, signature, built_at, computed_at); histories have
one row for each key and epoch in which it was built. "Latest" operators reduce with
max_by(), which combines before the shuffle, so a key with very many epochs never meets
in one task unreduced. A stored history is a folder of epoch partitions with a table of
committed epochs, written last: an epoch without its commit is never read, so a failed
or cancelled build leaves the snapshot before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import decode_dependencies


def with_computed_at(history: DataFrame, key: str = "key", epoch: str = "epoch", value: str = "value") -> DataFrame:
    """history with built_at and computed_at: the last epoch in which the value changed."""
    order = Window.partitionBy(key).orderBy(epoch)
    before = F.lag(F.struct(value)).over(order)
    changed = before.isNull() | ~before[value].eqNullSafe(F.col(value))
    return history.withColumn("built_at", F.col(epoch)).withColumn("computed_at", F.max(F.when(changed, F.col(epoch))).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def latest(history: DataFrame, key: str = "key", epoch: str = "epoch") -> DataFrame:
    """Of each key the row of its greatest epoch."""
    rest = [c for c in history.columns if c != key]
    best = history.groupBy(key).agg(F.max_by(F.struct(*rest), epoch).alias("__best"))
    return best.select(key, *[F.col(f"__best.{c}").alias(c) for c in rest])


def upserted(prior: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """prior with new's rows in place of those with equal keys."""
    rest = [c for c in prior.columns if c not in keys]
    both = prior.select(*prior.columns, F.lit(0).alias("__turn")).unionByName(new.select(*prior.columns, F.lit(1).alias("__turn")))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__turn").alias("__best"))
    return best.select(*[c if c in keys else F.col(f"__best.{c}").alias(c) for c in prior.columns])


def without(prior: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """prior without the rows of deleted keys."""
    return prior.join(gone.select(*keys).distinct(), keys, "left_anti")


def keys_with_result(key_names: DataFrame, rule_results: DataFrame) -> DataFrame:
    """Every stored key with its result."""
    return rule_results.join(key_names, F.col("key_id") == F.col("id")).drop("id")


def lookup_by_key(key_names: DataFrame, rule_results: DataFrame, key) -> DataFrame:
    """The result of one key; the filter reaches the scan of the names."""
    return rule_results.join(key_names.where(F.col("key") == F.lit(key)), F.col("key_id") == F.col("id")).drop("id")


def lookup_by_id(rule_results: DataFrame, key_id: int) -> DataFrame:
    """The result of one id, without a join."""
    return rule_results.where(F.col("key_id") == key_id)


def id_of(key_names: DataFrame, key) -> DataFrame:
    return key_names.where(F.col("key") == F.lit(key)).select("id")


def key_of(key_names: DataFrame, key_id: int) -> DataFrame:
    return key_names.where(F.col("id") == key_id).select("key")


def dump(key_names: DataFrame, rule_results: DataFrame) -> DataFrame:
    """(id, key, built_at, computed_at, duration)"""
    rows = keys_with_result(key_names, rule_results)
    return rows.select(F.col("key_id").alias("id"), "key", "built_at", "computed_at", (F.col("end") - F.col("start")).alias("duration"))


def dependencies(rule_results: DataFrame) -> DataFrame:
    """(key_id, ordinal, dep_key_id, order_only, single_use) of the stored blobs, in order."""
    rows = rule_results.select("key_id", F.posexplode(decode_dependencies(F.col("dependencies"))).alias("ordinal", "dep"))
    return rows.select("key_id", "ordinal", F.col("dep.key_id").alias("dep_key_id"), "dep.order_only", "dep.single_use")


def broken_dependencies(rule_results: DataFrame) -> DataFrame:
    """Rows whose blob is not a whole number of words."""
    return rule_results.where(F.octet_length("dependencies") % 8 != 0)


def resolved(edges: DataFrame, key_names: DataFrame) -> DataFrame:
    """edges with the dependency's key; those of unknown ids have none."""
    return edges.join(key_names.select(F.col("id").alias("dep_key_id"), F.col("key").alias("dep")), "dep_key_id", "left")


def collected(edges: DataFrame, key: str = "key", dep: str = "dep") -> DataFrame:
    """(key, deps): each key's dependencies in order; a key's own list, so bounded by one rule."""
    lists = F.array_sort(F.collect_list(F.struct("ordinal", dep)))
    return edges.groupBy(key).agg(F.transform(lists, lambda e: e[dep]).alias("deps"))


def drop_single_use(edges: DataFrame) -> DataFrame:
    """Edges without those that were valid for one build."""
    return edges.where(~F.coalesce("single_use", F.lit(False)))


def append_discovered(edges: DataFrame, discovered: DataFrame, key: str = "key") -> DataFrame:
    """edges and, behind each key's own, the discovered ones; repeated ones are kept."""
    last = edges.groupBy(key).agg((F.max("ordinal") + 1).alias("__next"))
    after = discovered.join(last, key, "left").withColumn("ordinal", (F.col("ordinal") + F.coalesce("__next", F.lit(0))).cast(edges.schema["ordinal"].dataType)).drop("__next")
    return edges.unionByName(after.select(*edges.columns))


def duplicates(rules: DataFrame, key: str = "key") -> DataFrame:
    """(key, n) of rules that are declared more than once."""
    return rules.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def run_reasons(rules: DataFrame, prior: DataFrame, valid: DataFrame) -> DataFrame:
    """(key, reason) before dependencies are looked at: never-built, signature-changed,
    invalid-value, or null. rules: (key, signature); valid: (key, ok), missing means ok.
    The joins are merged at every size, as in graph."""
    rows = rules.select("key", "signature").join(prior.select("key", F.col("signature").alias("__before"), "built_at").hint("merge"), "key", "left").join(valid.select("key", "ok").hint("merge"), "key", "left")
    reason = F.when(F.coalesce("built_at", F.lit(0)) == 0, "never-built").when(~F.col("signature").eqNullSafe(F.col("__before")), "signature-changed").when(~F.coalesce("ok", F.lit(True)), "invalid-value")
    return rows.select("key", reason.alias("reason"))


def first_offending_input(prior: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, dep): of each key the first dependency that was computed after the key was
    built. Order-only dependencies never count."""
    built, computed = prior.select("key", "built_at"), prior.select(F.col("key").alias("dep"), F.col("computed_at").alias("__dep_computed"))
    late = edges.where(~F.coalesce("order_only", F.lit(False))).join(built, "key").join(computed, "dep").where(F.col("built_at") < F.col("__dep_computed"))
    return late.groupBy("key").agg(F.min_by("dep", "ordinal").alias("dep"))


class BuildHistory:
    """A history below a folder that every executor sees."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def epochs(self) -> DataFrame:
        """(epoch, client_version) of the committed builds."""
        return self._read("commits", "epoch long, client_version long")

    def iteration(self) -> int:
        return self.epochs().agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]

    def commit(self, results: DataFrame, client_version: int = 0) -> int:
        """Stores the rows that ran in a new epoch; returns its number."""
        epoch = self.iteration() + 1
        results.write.mode("overwrite").parquet(f"{self.folder}/results/epoch={epoch}")
        self.spark.createDataFrame([(epoch, client_version)], "epoch long, client_version long").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return epoch

    def results(self, schema: str = "key string, value string, signature string, built_at long, computed_at long") -> DataFrame:
        """Each key's latest committed result."""
        rows = self._read("results", f"{schema}, epoch long")
        kept = rows.withColumn("epoch", F.col("epoch").cast("long")).join(self.epochs().select("epoch"), "epoch", "left_semi")
        return latest(kept).drop("epoch")

    def clear(self) -> None:
        """Forgets all epochs: their results are no longer read."""
        self.spark.createDataFrame([], "epoch long, client_version long").write.mode("overwrite").parquet(f"{self.folder}/commits")
