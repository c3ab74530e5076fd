from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from conftest_llm import changed, words

from buildlens.llm import near_dedup
from buildlens.llm.components import components


def brute(rows, k: int):
    """(doc_id, n_shingles, component_id) of each row, by all pairs."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_against_all_pairs(spark, tables, hostile):
    rows = list(hostile)
    for g in range(6):  # groups whose members are similar in part only
        text = words(80 + 40 * g, 100 + g)
        for m in range(7):
            rows.append((100 + 10 * g + m, changed(text, 25 + 6 * m + g), "en", "a"))
    got = near_dedup.op1_near_dedup(spark, tables(rows))
    assert key((r[0], r[1], r[2]) for r in got.collect()) == key(brute(rows, 4))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_links_beside_the_pivot(spark, tables):
    """x and y are similar with each other, but neither with the least member of their bucket."""
    base = words(400, 7).split(" ")
    rows = [(1, " ".join(base[:300] + words(100, 8).split(" ")), "en", "a")]
    rows += [(10 + i, " ".join(base[:290] + words(130, 9 + i // 3).split(" ") + [f"end{i}"]), "en", "a") for i in range(9)]
    assert key((r[0], r[1], r[2]) for r in near_dedup.near_duplicates(spark.read.parquet(tables(rows) + "/documents.parquet"), 4).collect()) == key(brute(rows, 4))


def test_empty_table(spark, tables):
    assert near_dedup.op1_near_dedup(spark, tables()).collect() == []


def test_oracle(same, small):
    same(near_dedup.op1_near_dedup, near_dedup.oracle(), small)


def test_signature_is_unbiased_and_min_max():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(1, 1 << 62, 900, np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(1, 1 << 62, 100, np.uint64)]))
    x, y = np.concatenate(near_dedup.signature(a)), np.concatenate(near_dedup.signature(b))
    assert len(x) == 2 * near_dedup.PERMUTATIONS
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(float((x == y).mean()) - true) < 0.15
    assert near_dedup.similar(a, a) and not near_dedup.similar(a, b[:300])


def test_stage_keeps_one_of_each_group(spark, tables, hostile):
    docs = spark.read.parquet(tables(hostile) + "/documents.parquet")
    left = near_dedup.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6, 7, 11, 12, 13} <= set(ids) and not {2, 8} & set(ids)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}


def test_stage_tells_rows_with_one_id_apart(spark, tables):
    """Null and repeated ids: a row goes only if it is like another one that stays."""
    a, b, c, d, e = (words(90, 40 + i) for i in range(5))
    rows = [(None, a), (None, b), (1, b), (2, c), (2, d), (None, changed(c, 70)), (None, e), (None, e)]
    docs = spark.read.parquet(tables([(i, t, "en", "a") for i, t in rows]) + "/documents.parquet")
    left = near_dedup.drop_near_duplicates(spark, docs, "").collect()
    assert key((r["doc_id"], r["text"]) for r in left) == key([(None, a), (1, b), (2, c), (2, d), (None, e)])
