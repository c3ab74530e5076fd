"""Near-duplicate documents by min-max hashing.

A text's set is its distinct shingles of a few words (ASCII capitals as small letters);
with fewer words, the whole sequence is one. Each of PERMUTATIONS hash functions is
evaluated once per shingle and gives two values, the least and the greatest, hence
2 * PERMUTATIONS signature values at half the cost, whose estimate of the similarity
is unbiased and varies less. BANDS bands of ROWS values make the bucket keys: at a
similarity of 0.8 all bands miss with probability (1 - 0.8^4)^32 < 1e-7.

1. Documents with equal sets form one class; only its least row goes on.
2. Each bucket's pivot is its least member, found by min() and thus combined before the
   shuffle; each member is paired with its pivots. That is one row a member and bucket
   at most, never all pairs.
3. Pairs are confirmed on the full sets, and the links give components.
4. Two members of a bucket that are both paired with its pivot, but lie in different
   components, may still be linked with each other. Such members are dealt in blocks of
   BLOCK_ROWS: those outside the pivot group's largest component against each other and
   against the rest. A block pair is compared by signatures first, then on full sets.
   So no bucket is capped, and no task gets more than two blocks.

Null or empty text, or no word: size 0, linked with nothing, its own component. Null
doc_id: takes part, but names no component as long as a member has an id. Repeated
rows: one class. Ties do not arise; the least row and the least doc_id are unique.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, limit_batches, table, with_python, with_row_ids, written
from .components import components

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
SIMILAR = 80  # per cent
#: Signatures that agree in fewer values are not compared in full in step 4: five
#: standard deviations below the expectation at a similarity of 0.8.
LEAST_AGREE = int(2 * PERMUTATIONS * (0.8 - 5 * (0.16 / (2 * PERMUTATIONS)) ** 0.5))
BLOCK_ROWS = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@cache
def _factors():
    import numpy as np

    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x):
    import numpy as np

    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes | None, words: int):
    """The sorted 64-bit hashes of a UTF-8 text's distinct shingles."""
    import numpy as np

    parts = (data or b"").translate(_LOWER).split()  # splits at space and 09-0D
    if not parts:
        return np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    letters = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64) + np.uint64(1)
    word = _mixed(np.add.reduceat(letters * power[place], starts))
    k = min(words, len(parts))
    total = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        total = _mixed(total * np.uint64(0xD6E8FEB86659FD93) + word[i : len(parts) - k + 1 + i])
    return np.unique(total)


def signature(shingles):
    """The least value of each hash function, then the greatest."""
    import numpy as np

    least, most = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        values = np.multiply.outer(_factors(), shingles[at : at + 4096])
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(most, values.max(axis=1), out=most)
    return least, most


def band_keys(least, most):
    """One 64-bit key a band: the two values of ROWS / 2 hash functions each."""
    import numpy as np

    rows = np.concatenate([least.reshape(BANDS, ROWS // 2), most.reshape(BANDS, ROWS // 2)], axis=1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, i])
    return key.view(np.int64)


def _sketch(words: int):
    def make(data):
        shingles = shingle_set(data, words)
        if not len(shingles):
            return 0, None, []
        return len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), band_keys(*signature(shingles)).tolist()

    return make


def similar(a, b) -> bool:
    """Whether 100 * |a & b| >= SIMILAR * |a | b|, for two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < SIMILAR * len(b):
        return False
    at = b.searchsorted(a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, confirmed on full texts."""
    rows = pairs.join(texts.select(F.col("node").alias("b"), F.col("data").alias("data_b")), "b")
    rows = rows.join(texts.select(F.col("node").alias("a"), F.col("data").alias("data_a")), "a").select("a", "b", "data_a", "data_b")
    limit_batches(pairs.sparkSession)

    def run(batches):
        import pyarrow as pa

        last, kept = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, kept = a[i], shingle_set(batch.column(2)[i].as_py(), words)
                if similar(kept, shingle_set(batch.column(3)[i].as_py(), words)):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in found], pa.int64()) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _crossing(pairs: DataFrame, roots: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Links between members of one pivot's group that lie in different components."""
    root = roots.select(F.col("node").alias("b"), "root")
    members = pairs.select(F.col("a").alias("pivot"), "b").join(root, "b", "left").withColumn("root", F.coalesce("root", "b"))
    members = written(members)
    sizes = members.groupBy("pivot", "root").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("pivot").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    groups = groups.select("pivot", F.col("main.root").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("all") - F.col("main.n")).alias("others"))
    rows = members.join(groups, "pivot").withColumn("hash", F.abs(F.xxhash64("b") % (1 << 40)))
    own = F.when(F.col("root") == F.col("main"), F.col("hash") % F.col("mains")).otherwise(F.col("hash") % F.col("others")).cast("int")
    rows = rows.withColumn("own", own)
    each = lambda n: F.sequence(F.lit(0), n - 1)
    key = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    with_main = F.transform(each(F.col("others")), lambda i: key(i, -1 - F.col("own"), 1))
    as_other = F.concat(F.transform(each(F.col("others")), lambda j: key(F.least(j, F.col("own")), F.greatest(j, F.col("own")), 0)), F.transform(each(F.col("mains")), lambda j: key(F.col("own"), -1 - j, 0)))
    dealt = rows.select("pivot", F.col("b").alias("node"), "root", F.explode(F.when(F.col("root") == F.col("main"), with_main).otherwise(as_other)).alias("key"))
    dealt = dealt.select("pivot", "key.i", "key.j", "key.side", "node", "root").join(texts, "node")

    def compare(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("node").reset_index(drop=True)
        sets = [shingle_set(x, words) for x in pdf.data]
        signs = np.array([np.concatenate(signature(s)) for s in sets])
        sizes, up = np.array([len(s) for s in sets]), {}

        def top(x):
            while x in up:
                x = up[x]
            return x

        root, side, split, found = pdf.root.to_numpy(), pdf.side.to_numpy(), pdf.j.iloc[0] < 0, []
        for x in range(len(sets)):
            near = (signs[x + 1 :] == signs[x]).sum(axis=1) >= LEAST_AGREE
            near &= (root[x + 1 :] != root[x]) & (100 * np.minimum(sizes[x + 1 :], sizes[x]) >= SIMILAR * np.maximum(sizes[x + 1 :], sizes[x]))
            if split:
                near &= side[x + 1 :] != side[x]
            for y in np.flatnonzero(near) + x + 1:
                a, b = top(root[x]), top(root[y])
                if a != b and similar(sets[x], sets[y]):
                    up[max(a, b)] = min(a, b)
                    found.append((root[x], root[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("pivot", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, row_id: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept
    (and row_id, if named, with the component's least row as __group)."""
    ids = [row_id] if row_id else []
    text = F.coalesce("text", F.lit("")).cast("binary")
    source = docs.select("doc_id", *ids, F.md5(text).alias("text_md5"), text.alias("__data"))
    sketches = written(with_python(source, "__data", _sketch(words), [("n_shingles", "long"), ("set_id", "binary"), ("bands", "array<long>")]), with_row_id="row")
    classes = written(sketches.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    first = sketches.join(classes.select(F.col("node").alias("row")), "row", "left_semi")

    keys = first.select(F.col("row").alias("b"), F.explode("bands").alias("key"))
    pivots = keys.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = written(keys.join(pivots, "key").where("a <> b").select("a", "b").distinct())

    nodes = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = written(sketches.join(nodes, "row", "left_semi").select("row", "doc_id", "text_md5", "n_shingles"))
    asked = wanted.select(F.col("row").alias("node"), F.col("doc_id").alias("__id"), "text_md5")
    # both sides are shuffled at every size: the texts asked for grow with the corpus
    texts = docs.select("doc_id", text.alias("data")).join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.md5("data") == F.col("text_md5"))).select("node", "data")
    texts = written(texts.dropDuplicates(["node"]))

    size = lambda name: wanted.select(F.col("row").alias(name), F.col("n_shingles").alias(f"n_{name}"))
    alike = pairs.join(size("a"), "a").join(size("b"), "b").where(f"100 * least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b)").select("a", "b")
    roots = written(components(_confirmed(alike, texts, words)))
    more = written(components(_crossing(pairs, roots, texts, words)))

    # roots of roots, and each component's least doc_id
    joined = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("top"))
    tops = joined.unionByName(more.withColumnRenamed("root", "top")).dropDuplicates(["node"])
    tops = written(tops.unionByName(tops.select(F.col("top").alias("node"), "top").distinct()).dropDuplicates(["node"]))
    placed = tops.join(classes.select("node", "set_id", "least"), "node")
    least = placed.groupBy("top").agg(F.min("least").alias("component"))
    linked = placed.join(least, "top").select("set_id", "component", "top")
    known = written(classes.join(linked, "set_id", "left").select("set_id", F.coalesce("component", "least").alias("component"), F.coalesce("top", "node").alias("__group")))
    out = sketches.select("doc_id", "n_shingles", "set_id", "row", *ids).join(known, "set_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *ids, *[F.coalesce("__group", "row").alias("__group") for _ in ids])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row, the first of those with the least id (null last).

    Rows are told apart by a row id of their own, as ids may be null or repeated."""
    (own,) = fresh(docs, "__own")
    rows = with_row_ids(docs, own)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", own)).alias("first")
    kept = near_duplicates(rows, row_id=own).groupBy("__group").agg(first).select(F.col(f"first.{own}").alias(own))
    return rows.join(kept, own, "left_semi").select(*docs.columns)


def oracle() -> str:
    """All pairs that share a shingle, and components by repeated labelling, in DuckDB."""
    return r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i+3]) END)) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id"""
