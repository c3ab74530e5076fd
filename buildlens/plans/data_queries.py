"""Queries on histories, trees, stores, traces and stale files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.text import content_id, parse_label
from ..operators import commands, history, store, traces, trees
from . import lenses
from .lenses import CHAIN, DATABASE, LINES, PAGES, TRACE, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# The stored history


@query(f"WITH {DATABASE} SELECT r.*, k.key FROM rule_results r JOIN key_names k ON k.id = r.key_id WHERE k.key = 'O7'")
def lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lookup_by_key(*lenses.database(spark, sf_dir), "O7")


@query(f"WITH {DATABASE} SELECT * FROM rule_results WHERE key_id = 7")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lookup_by_id(lenses.database(spark, sf_dir)[1], 7)


@query(f"WITH {DATABASE} SELECT r.*, k.key FROM rule_results r, key_names k WHERE k.id = r.key_id")
def keys_with_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.keys_with_result(*lenses.database(spark, sf_dir))


@query(f'WITH {DATABASE} SELECT k.id, k.key, built_at, computed_at, "end" - start AS duration FROM key_names k JOIN rule_results ON key_id = k.id')
def db_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dump(*lenses.database(spark, sf_dir))


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lenses.lines(spark, sf_dir).select(F.substring("key", 2, 20).cast("long").alias("key_id"), "ordinal", F.substring("dep", 2, 20).cast("long").alias("id"), "order_only", "single_use")
    lists = rows.groupBy("key_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("id").alias("key_id"), "order_only", "single_use"))), lambda e: F.struct(e["key_id"].alias("key_id"), e["order_only"].alias("order_only"), e["single_use"].alias("single_use"))).alias("e"))
    return lists.select("key_id", codec.encode_dependencies(F.col("e")).alias("dependencies"))


@query(f"WITH {LINES} SELECT CAST(key[2:] AS BIGINT) AS key_id, ordinal, CAST(dep[2:] AS BIGINT) AS dep_key_id, order_only, single_use FROM lines")
def dep_blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies packed into stored words and taken apart again."""
    return history.dependencies(_blobs(spark, sf_dir))


@query(f"""WITH {LINES} SELECT CAST(key[2:] AS BIGINT) AS key_id, upper(string_agg(printf('%02x%02x%02x%02x00000000', w & 255, (w >> 8) & 255, (w >> 16) & 255, (w >> 24) & 255), '' ORDER BY ordinal)) AS words
FROM (SELECT key, ordinal, (CAST(dep[2:] AS BIGINT) << 2) | (CAST(single_use AS BIGINT) << 1) | CAST(order_only AS BIGINT) AS w FROM lines) GROUP BY key""")
def dep_blob_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir).select("key_id", F.hex("dependencies").alias("words"))


@query(f"WITH {LINES} SELECT CAST(substr(key, 2) AS BIGINT) AS key_id, ordinal, dep, CAST(p_size AS BIGINT) AS dep_built_at FROM lines LEFT JOIN part ON dep = 'P' || p_partkey")
def deps_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies with the results of those that are parts."""
    edges = lenses.lines(spark, sf_dir).select(F.substring("key", 2, 20).cast("long").alias("key_id"), "ordinal", "dep")
    parts = table(spark, sf_dir, "part").select(lenses.named("P", "p_partkey").alias("dep"), F.col("p_size").cast("long").alias("dep_built_at"))
    return edges.join(parts, "dep", "left")


@query(f"""WITH {CHAIN} SELECT user_id, n AS built_at, max(CASE WHEN changed THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS computed_at
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY n) IS DISTINCT FROM event_type AS changed FROM chain)""")
def computed_built_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_computed_at(lenses.chain(spark, sf_dir), "user_id", "n", "event_type").select("user_id", "built_at", "computed_at")


@query(f"WITH {CHAIN} SELECT user_id, n, key, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM chain) WHERE r = 1")
def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(lenses.chain(spark, sf_dir).select("user_id", "n", "key", "event_type"), "user_id", "n")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS built_at FROM orders
UNION ALL SELECT -1 - o_orderkey, 'new', 2 FROM orders WHERE o_orderkey % 3 = 0""")
def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    prior = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"), F.lit(1).alias("built_at"))
    third = orders.where("o_orderkey % 3 = 0")
    new = third.select(F.col("o_orderkey").alias("id")).union(third.select(-1 - F.col("o_orderkey"))).select("id", F.lit("new").alias("value"), F.lit(2).alias("built_at"))
    return history.upserted(prior, new, ["id"])


@query(f"""WITH {CHAIN}, last AS (SELECT user_id, max(n) AS n FROM chain GROUP BY user_id)
SELECT 'U' || l.user_id AS key, CASE WHEN b.n IS NULL THEN 'never-built' WHEN b.event_type <> a.event_type THEN 'signature-changed' WHEN a.w >= 50 THEN 'invalid-value' END AS reason
FROM last l JOIN chain a ON a.user_id = l.user_id AND a.n = l.n LEFT JOIN chain b ON b.user_id = l.user_id AND b.n = l.n - 1""")
def run_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last event is its rule, the one before it the stored result."""
    rows = lenses.chain(spark, sf_dir).withColumn("key", lenses.named("U", "user_id"))
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n")))
    rows = rows.withColumn("__back", back)
    rules = rows.where("__back = 1").select("key", F.col("event_type").alias("signature"))
    prior = rows.where("__back = 2").select("key", F.col("event_type").alias("signature"), F.col("n").alias("built_at"))
    valid = rows.where("__back = 1").select("key", (F.col("w") < 50).alias("ok"))
    return history.run_reasons(rules, prior, valid)


@query("SELECT l_orderkey || '-' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicates(table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")))


# Trees


@query(f"""WITH {PAGES}, d AS (SELECT directory, name FROM files UNION SELECT regexp_replace(directory, '/[^/]*$', ''), regexp_extract(directory, '[^/]*$') FROM files UNION SELECT '/', regexp_extract(regexp_replace(directory, '/[^/]*$', ''), '[^/]*$') FROM files)
SELECT directory, string_agg(name, ' ' ORDER BY name) AS names FROM d GROUP BY directory""")
def dir_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = trees.with_directories(lenses.pages(spark, sf_dir))
    return trees.listing(entries).select("directory", F.array_join("names", " ").alias("names"))


@query(f"WITH {PAGES} SELECT directory, string_agg(name, ' ' ORDER BY name) AS names FROM files WHERE name NOT LIKE '%.html' AND NOT regexp_matches(name, '^1.5$') GROUP BY directory")
def dir_listing_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.filtered_listing(lenses.pages(spark, sf_dir), ["*.html", "1?5"]).select("directory", F.array_join("names", " ").alias("names"))


def _unrolled(own: str, top: str) -> str:
    """A tree of three levels below the top, folded level by level in SQL."""
    fold = f"list_reduce(list(name || '=' || signature ORDER BY name), lambda a, v: md5(concat_ws('|', a, CAST(length(v) AS VARCHAR), v)), md5(concat_ws('|', md5(''), '{len(top)}', '{top}')))"
    up = lambda s, t: f"{t} AS (SELECT directory AS path, {fold} AS signature, regexp_replace(directory, '/[^/]*$', '') AS up, regexp_extract(directory, '[^/]*$') AS name FROM (SELECT {'directory' if s == 'l3' else 'up AS directory'}, name, signature FROM {s}) GROUP BY directory)"
    return f"""WITH {PAGES}, l3 AS (SELECT path, md5({own}) AS signature, directory, name FROM files), {up('l3', 'l2')}, {up('l2', 'l1')}, {up('l1', 'l0')}
SELECT path, false AS is_directory, signature FROM l3 UNION ALL SELECT path, true, signature FROM l2 UNION ALL SELECT path, true, signature FROM l1 UNION ALL SELECT '/', true, signature FROM l0"""


@query(_unrolled("info", ""))
def tree_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_signature(trees.with_directories(lenses.pages(spark, sf_dir)))


@query(_unrolled("'f'", "d"))
def structure_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.structure_signature(trees.with_directories(lenses.pages(spark, sf_dir)))


@query(f"""WITH {PAGES}, a AS (SELECT directory AS path, size FROM files UNION ALL SELECT regexp_replace(directory, '/[^/]*$', ''), size FROM files UNION ALL SELECT '/', size FROM files)
SELECT path, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM a GROUP BY path""")
def total_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.total_sizes(lenses.pages(spark, sf_dir))


@query(f"""WITH {PAGES}, tops AS (SELECT DISTINCT 'host' || regexp_extract(path, '^/([^/]*)', 1) AS owner, '/' || regexp_extract(path, '^/([^/]*)', 1) AS node FROM files)
SELECT t.node, t.owner, f.path AS inside, 'page' AS by FROM files f JOIN tops t ON starts_with(f.path, t.node || '/')""")
def ownership_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages lie within hosts that other commands made."""
    files = lenses.pages(spark, sf_dir).select("path")
    host = F.regexp_extract("path", "^/([^/]*)", 1)
    tops = files.select(F.concat(F.lit("host"), host).alias("command"), F.concat(F.lit("/"), host).alias("node")).distinct()
    return commands.conflicts(tops.unionByName(files.select(F.lit("page").alias("command"), F.col("path").alias("node"))))


# Stale files: parts shipped in one year, and expected in the next


def _shipped(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year)
    path = F.when(F.col("l_partkey") % 13 == 0, lenses.named("p", "l_partkey")).otherwise(F.concat(F.lit("/"), F.col("l_returnflag"), F.lit("/p"), F.col("l_partkey").cast("string")))
    return rows.select(path.alias("path"))


def _shipped_sql(year: int) -> str:
    return f"SELECT CASE WHEN l_partkey % 13 = 0 THEN 'p' || l_partkey ELSE '/' || l_returnflag || '/p' || l_partkey END AS path FROM lineitem WHERE year(l_shipdate) = {year}"


STALE = f"stale AS ({_shipped_sql(1998)} EXCEPT {_shipped_sql(1999)})"


@query(f"WITH {STALE} SELECT path FROM stale")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.stale(_shipped(spark, sf_dir, 1998), _shipped(spark, sf_dir, 1999))


@query(f"WITH {STALE} SELECT path, CASE WHEN path NOT LIKE '/%' THEN 'skip-relative' WHEN path LIKE '/A/%' THEN 'remove' ELSE 'skip-outside' END AS action FROM stale")
def stale_with_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.removals(_shipped(spark, sf_dir, 1998), _shipped(spark, sf_dir, 1999), spark.createDataFrame([("/A/",)], "root string"))


# Stores and caches


@query("SELECT sha256(coalesce(text, '')) AS id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id", content_id(F.coalesce("text", F.lit(""))).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""WITH s AS (SELECT DISTINCT sha256(text) AS id, text AS data FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL), w AS (SELECT DISTINCT sha256(text) AS id FROM documents WHERE text IS NOT NULL)
SELECT w.id, CAST(coalesce(strlen(data), 0) AS INTEGER) AS bytes, data IS NOT NULL AS found FROM w LEFT JOIN s ON s.id = w.id""")
def cas_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of even documents; all documents' are asked for."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    objects = docs.where("doc_id % 2 = 0").select(F.array().cast("array<string>").alias("refs"), F.col("text").cast("binary").alias("data"))
    empty = store.identify(objects).select("id", "refs", "data").where("false")
    wanted = docs.select(content_id(F.col("text")).alias("id")).distinct()
    return store.get(store.put(empty, objects), wanted).select("id", F.octet_length("data").alias("bytes"), "found")


@query("""WITH c AS (SELECT lang, source, md5(text) AS data, max(doc_id) AS value_id FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL GROUP BY ALL)
SELECT d.doc_id, value_id, value_id IS NOT NULL AS hit FROM documents d LEFT JOIN c ON c.lang = d.lang AND c.source = d.source AND c.data = md5(d.text)""")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("data"))
    keys = ["lang", "source", "data"]
    cache = docs.where("doc_id % 3 = 0 AND data IS NOT NULL").groupBy(*keys).agg(F.max("doc_id").alias("value_id"))
    return store.probe(docs, cache, keys).select("doc_id", "value_id", "hit")


@query("""SELECT 'O' || l_orderkey AS task FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40))""")
def unblocked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = table(spark, sf_dir, "lineitem").select(lenses.named("O", "l_orderkey").alias("task"), F.col("l_partkey").alias("id"))
    return store.unblocked(waits, table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("id")))


@query("SELECT substr(sha256('artifact' || chr(0) || 'P' || l_partkey), 1, 16) AS request_id, 'P' || l_partkey AS label, count(*) AS askers FROM lineitem GROUP BY l_partkey")
def request_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.requests(table(spark, sf_dir, "lineitem").select(lenses.named("P", "l_partkey").alias("label")))


@query(f"""WITH {PAGES}, p AS (SELECT path, string_split(path[2:], '/') AS c FROM files)
SELECT '/' || path AS label, CASE WHEN c[2] IN ('en', 'de') AND ends_with(c[1], '.com') THEN c[1] || '/' || c[2] WHEN ends_with(c[1], '.com') OR ends_with(c[1], '.net') THEN c[1] END AS rule FROM p""")
def label_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = lenses.pages(spark, sf_dir).select(F.concat(F.lit("/"), "path").alias("label"))
    labels = files.select("label", parse_label(F.col("label"))["components"].alias("components"))
    host, lang = F.get("components", F.lit(0)), F.get("components", F.lit(1))
    wide = labels.where(host.endswith(".com") | host.endswith(".net")).select(host.alias("prefix"))
    deep = labels.where(host.endswith(".com") & lang.isin("en", "de")).select(F.concat_ws("/", host, lang).alias("prefix"))
    rules = wide.union(deep).distinct().select("prefix", F.col("prefix").alias("rule"))
    return store.longest_prefix(labels, rules).select("label", "rule")


@query(f"""WITH {CHAIN}, s AS (SELECT user_id, (n - 1) // 16 AS segment, count(*) AS entries, sha256(string_agg(sha256(event_type), '' ORDER BY n)) AS id FROM chain GROUP BY 1, 2)
SELECT user_id, segment, id, lag(id) OVER (PARTITION BY user_id ORDER BY segment) AS prev, first(id) OVER (PARTITION BY user_id ORDER BY segment) AS root, entries FROM s""")
def log_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lenses.chain(spark, sf_dir).select("user_id", "n", F.col("event_type").alias("entry"))
    return store.log_segments(rows, 16, "user_id", "n")


# Traces and processes

TAGS = {"views": "view", "clicks": "click", "errors": "error", "purchases": "purchase", "signups": "signup"}


@query("SELECT " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {n}" for n, t in TAGS.items()) + ", user_id FROM events GROUP BY user_id")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.counters(table(spark, sf_dir, "events").withColumnRenamed("event_type", "tag"), TAGS, ["user_id"])


@query(f"WITH {TRACE} SELECT lane, " + ", ".join(f"count(*) FILTER (tag = '{t}') AS {n}" for n, t in TAGS.items()) + " FROM trace GROUP BY lane")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.counters(lenses.trace(spark, sf_dir), TAGS, ["lane"])


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS finished, count(*) AS total, CAST(max(epoch_us(ts)) - min(epoch_us(ts)) AS BIGINT) AS elapsed FROM events GROUP BY user_id)
SELECT user_id, finished, total, CAST(100 * finished // total AS BIGINT) AS percent, total - finished AS remaining FROM c""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("finished"), F.count("*").alias("total"), (F.max(lenses.micros("ts")) - F.min(lenses.micros("ts"))).alias("elapsed"))
    return traces.progress(counts).select("user_id", "finished", "total", F.col("percent").cast("long").alias("percent"), "remaining")


PAIRS = f"""WITH {TRACE}, p AS (SELECT *, event_id % 2 = 0 AS b, lead(event_id % 2 = 1) OVER w AS e, lead(t) OVER w AS later FROM trace WINDOW w AS (PARTITION BY lane ORDER BY t)),
spans AS (SELECT lane, tag AS name, t AS begin, CASE WHEN e THEN later END AS "end" FROM p WHERE b)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lenses.trace(spark, sf_dir).select("lane", F.col("tag").alias("name"), F.when(F.col("event_id") % 2 == 0, "B").otherwise("E").alias("ph"), "t")
    return traces.intervals(events, "lane", "t")


@query(f'{PAIRS} SELECT lane, name, begin, "end" FROM spans')
def profile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query(f'{PAIRS} SELECT lane, count(*) AS spans, CAST(sum("end" - begin) AS BIGINT) AS busy FROM spans WHERE "end" IS NOT NULL GROUP BY lane')
def lane_busy_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.busy(_spans(spark, sf_dir).where("end IS NOT NULL"), "lane", "begin", "end")


@query("""SELECT event_type AS name, CAST(user_id % 3 AS INTEGER) AS depth, count(*) AS n, sum(floor(value)) AS wall_s, sum(floor(value / 2)) AS user_s, sum(floor(value / 4)) AS sys_s, sum(floor(value / 8)) AS start_lag_s, sum(0.0::DOUBLE) AS exit_lag_s FROM events GROUP BY 1, 2""")
def process_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda d: F.floor(F.col("value") / d).cast("double")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).cast("int").alias("depth"), whole(1).alias("wall_s"), whole(2).alias("user_s"), whole(4).alias("sys_s"), whole(8).alias("start_lag_s"), F.lit(0.0).alias("exit_lag_s"))
    return traces.aggregate(rows)


@query("""SELECT CAST(row_number() OVER (ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_orderkey) AS INTEGER) AS place, 'O' || o_orderkey AS name FROM orders""")
def ready_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's place in the queue."""
    jobs = table(spark, sf_dir, "orders").select(lenses.named("O", "o_orderkey").alias("name"), F.col("o_orderpriority").startswith("1").alias("priority"), F.col("o_orderkey").alias("arrival"))
    return commands.placed(jobs, F.when(F.col("priority"), 0).otherwise(1), F.col("arrival")).select(F.col("place").cast("int").alias("place"), "name")


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderpriority DESC, o_custkey, o_orderkey) AS INTEGER) AS place, o_orderkey AS work_id FROM orders""")
def action_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each action's place; priorities are told apart by their first digit."""
    actions = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_custkey").alias("build_id"), F.col("o_orderkey").alias("work_id"))
    return commands.placed(actions, -F.col("priority"), F.col("build_id"), F.col("work_id")).select(F.col("place").cast("int").alias("place"), "work_id")
