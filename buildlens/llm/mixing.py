"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

Targets: the sources, in code-point order with null last, weigh 5, 2, 1, 5, 2, 1, ...;
together they get 150 % of all words, none more than twice its own, and what a full
source leaves is shared among the others by weight. With the sources ordered by
(twice their words / weight), a source is full exactly while the level that the rest
would reach lies above that ratio, so running sums give the targets at once.

Stream: a source's documents in the order of md5(doc_id), laid end to end and, for a
second pass, once more. Its first `target` words are cut into blocks of BLOCK words.

Schedule: slot t of the mix lies at the golden-ratio point frac((t + 1/2) * PHI) of
[0, 1), which the sources divide in proportion to their blocks; the slots of a source,
ranked, take its blocks in turn. Points spread evenly, so that every stretch of the
mix holds the sources in nearly the target proportions. A source that the points give
too few slots gets the rest at the end; slots beyond its blocks stay unused.

Ranks and running sums are taken within (source, stretch) and then over a source's
stretches, of which there are at most STRETCHES, so no source is dealt to one task.

The mix is the blocks by slot: op6 gives each document's first slot, and the pipeline's
stage writes its documents in that order, a text's start within a block breaking ties.

Null text: size 0, nothing taken, no slot. Null source: the last source. Null or repeated
doc_id: each row counts; ties in a source's order go by size and then by the text, so
that only equal rows are interchangeable. Very long texts lie in as many blocks as they
fill. Other columns are kept by the stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, table, with_row_ids, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 256
PHI = 0.6180339887498949
STRETCHES = 4096
#: Cells of [0, 1) by which slots meet the sources' intervals in an equi-join.
CELLS = 1024


def targets(sizes: DataFrame) -> DataFrame:
    """(source, k, source_size, target, quota): one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS)) + 1)
    per = per.withColumn("k", F.row_number().over(by_name) - 1).withColumn("w", weight)
    per = per.withColumn("ratio", MOST * F.col("source_size") / F.col("w").cast("double"))
    up_to = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "k").rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(all_rows) - F.coalesce(F.sum(MOST * F.col("source_size")).over(up_to), F.lit(0))
    per = per.withColumn("level", left / F.sum("w").over(onward))
    per = per.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(all_rows))
    per = per.withColumn("target", F.when(F.col("ratio") < F.col("level"), MOST * F.col("source_size").cast("double")).otherwise(F.col("level") * F.col("w")))
    per = per.withColumn("words", F.floor("target")).withColumn("quota", F.ceil(F.col("words") / BLOCK))
    return per.select("source", "k", "source_size", "target", "words", "quota")


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes without `tie`, with its source's columns and `start`, the words before it in its stream."""
    rows = sizes.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("stretch", F.substring("order", 1, 3))
    before = running(rows, ["source", "stretch"], F.sum("size"), "before")
    own = Window.partitionBy("source", "stretch").orderBy("order", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = null_safe(null_safe(rows, before, ["source", "stretch"]), sources, ["source"])
    return rows.withColumn("start", F.col("before") + F.col("own")).drop("order", "stretch", "before", "own", "tie")


def running(rows: DataFrame, keys: list[str], what, name: str) -> DataFrame:
    """keys and the sum of `what` over the groups with equal first key and a smaller second."""
    past = Window.partitionBy(keys[0]).orderBy(keys[1]).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*keys).agg(what.alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(past), F.lit(0)).alias(name))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"__{k}" for k in keys])


def schedule(sources: DataFrame) -> DataFrame:
    """(k, rank, slot): the slot of each block of each source."""
    spark = sources.sparkSession
    slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]  # one number
    past = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("quota").over(past), F.lit(0))
    parts = sources.where("quota > 0").select("k", "quota", (low / F.lit(float(max(1, slots)))).alias("low"), ((low + F.col("quota")) / F.lit(float(max(1, slots)))).alias("high"))
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", ((F.col("slot") + 0.5) * PHI) % 1.0).withColumn("cell", F.floor(F.col("x") * CELLS))
    dealt = points.join(cells, "cell").where("x >= low AND x < high").select("k", "quota", "slot", F.floor(F.col("slot") / max(1, -(-slots // STRETCHES))).alias("stretch"))
    before = running(dealt, ["k", "stretch"], F.count("*"), "before")
    own = Window.partitionBy("k", "stretch").orderBy("slot")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(before, ["k", "stretch"])
    ranked = written(ranked.select("k", "quota", (F.col("before") + F.col("own")).alias("rank"), "slot"))
    got = ranked.groupBy("k").agg(F.count("*").alias("got"))
    short = parts.join(got, "k", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    short = short.withColumn("offset", F.coalesce(F.sum(F.col("quota") - F.col("got")).over(past), F.lit(0)))
    late = short.select("k", "got", "offset", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    late = late.select("k", "rank", (F.lit(slots) + F.col("offset") + F.col("rank") - F.col("got")).alias("slot"))
    return ranked.where("rank < quota").select("k", "rank", "slot").unionByName(late)


def mix(sizes: DataFrame) -> DataFrame:
    """sizes (a row id, doc_id, source, size, tie) without tie, with source_size, target, and
    for each pass 0 or 1 the words that the mix takes, always the document's first, their
    place in the source's stream, and the first slot that holds them (null if none)."""
    sources = written(targets(sizes))
    rows = placed(sizes, sources).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), "words"))
    ranks = F.when(F.col("b") > F.col("a"), F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK)))
    pieces = rows.withColumn("rank", F.explode_outer(ranks))
    taken = F.least("b", (F.col("rank") + 1) * BLOCK) - F.greatest("a", F.col("rank") * BLOCK)
    joined = pieces.withColumn("piece", taken).join(schedule(sources), ["k", "rank"], "left")
    keys = [*(c for c in sizes.columns if c != "tie"), "source_size", "target", "pass"]
    return joined.groupBy(*keys).agg(F.min("a").alias("place"), F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("piece"))), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"))


def size_of(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tie_of(text) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), tie_of(F.col("text")).alias("tie")), with_row_id="row")
    got = mix(sizes).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, in the order of the
    slots; where the mix ends within a document, its last copy is cut there."""
    row, size, taken, slot, place = fresh(docs, "__row", "__size", "__taken", "__slot", "__place")
    rows = with_row_ids(docs, row)
    sizes = rows.select(F.col(row).alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), tie_of(F.col("text")).alias("tie"))
    got = mix(written(sizes)).where("taken > 0").select(*[F.col(x).alias(y) for x, y in (("row", row), ("size", size), ("taken", taken), ("first_slot", slot), ("place", place))])
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(taken).cast("int"))
    gaps = F.slice(F.split("text", WORD, -1), F.lit(1), F.col(taken).cast("int"))
    part = F.col(taken) < F.col(size)
    cut = F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, w)), "")
    out = rows.join(written(got), row).withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(part, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.repartitionByRange(slot).sortWithinPartitions(slot, place).select(*docs.columns)


def oracle() -> str:
    """The same in DuckDB: words by one running sum per source, slots by a range join."""
    return rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w FROM s),
r AS (SELECT *, {MOST} * source_size / CAST(w AS DOUBLE) AS ratio FROM w),
l AS (SELECT *, ({SHARE} * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum({MOST} * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
 / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
v AS (SELECT min(level) FILTER (level <= ratio) AS top FROM (SELECT *, row_number() OVER (ORDER BY level <= ratio DESC, ratio, source NULLS LAST) AS n FROM l) WHERE n = 1),
t AS (SELECT source, k, source_size, CASE WHEN ratio < top THEN CAST({MOST} * source_size AS DOUBLE) ELSE top * w END AS target FROM l, v),
q AS (SELECT k, quota, CAST(sum(quota) OVER (ORDER BY k) - quota AS BIGINT) AS low, CAST(sum(quota) OVER () AS BIGINT) AS n FROM (SELECT k, CAST(ceil(floor(target) / {BLOCK}) AS BIGINT) AS quota FROM t)),
x AS (SELECT slot, (slot + 0.5::DOUBLE) * {PHI}::DOUBLE - floor((slot + 0.5::DOUBLE) * {PHI}::DOUBLE) AS x FROM (SELECT unnest(range(max(n))) AS slot FROM q)),
g AS (SELECT k, quota, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM x JOIN q ON quota > 0 AND x >= low / CAST(n AS DOUBLE) AND x < (low + quota) / CAST(n AS DOUBLE)),
h AS (SELECT k, quota, n, got, CAST(coalesce(sum(quota - got) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past
 FROM (SELECT q.k, q.quota, n, (SELECT count(*) FROM g WHERE g.k = q.k) AS got FROM q) WHERE got < quota),
b AS (SELECT k, rank, slot FROM g WHERE rank < quota UNION ALL SELECT k, got + i, n + past + i FROM (SELECT *, unnest(range(quota - got)) AS i FROM h)),
p AS (SELECT d.*, t.k, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, d.size, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(a + size, floor(target)) - a) + greatest(0, least(a + source_size + size, floor(target)) - a - source_size) AS BIGINT) AS taken,
CASE WHEN size > 0 AND a < floor(target) THEN b.slot END AS first_slot FROM p LEFT JOIN b ON b.k = p.k AND b.rank = CAST(p.a AS BIGINT) // {BLOCK}"""
