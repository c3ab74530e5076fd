from __future__ import annotations

import re
from collections import defaultdict

from buildlens.llm import mixing


def sizes_and_targets(rows):
    """Targets by raising full sources one after another."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = defaultdict(int)
    for _, text, _, source in rows:
        own[source] += size(text)
    names = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in own if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(own.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * own[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * own[s] for s in full}
        open_ -= full
    return own, target


def check(got, rows):
    own, target = sizes_and_targets(rows)
    source = {(i, s) for i, _, _, s in rows}
    taken = defaultdict(int)
    by_id = {i: s for i, s in source}
    for r in got:
        if r["doc_id"] is not None:
            s = by_id[r["doc_id"]]
            assert r["source_size"] == own[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[round(r["target"], 6)] += r["taken"]
    for t, n in taken.items():
        same = sum(abs(round(x, 6) - t) < 1e-9 for x in target.values())
        assert same * t - same <= n <= same * t + 1e-6
    assert abs(sum(taken.values()) - 1.5 * sum(own.values())) <= len(own)


def test_hostile_rows(spark, tables, hostile):
    got = mixing.op6_mixing(spark, tables(hostile)).collect()
    assert len(got) == len(hostile)
    check(got, hostile)


def test_whole_table_and_reruns(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    first, again = (sorted(map(tuple, mixing.op6_mixing(spark, small).collect())) for _ in range(2))
    assert first == again
    check(mixing.op6_mixing(spark, small).collect(), rows)


def test_oracle(same, small):
    same(mixing.op6_mixing, mixing.oracle(), small)


def test_empty_tables(spark, tables):
    assert mixing.op6_mixing(spark, tables()).collect() == []
    rows = mixing.op6_mixing(spark, tables([(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in rows) == [(1, 0, 0), (2, 0, 0)]


def test_schedule_is_even(spark):
    """Any stretch of the mix holds the sources in about their shares."""
    quota = {0: 500, 1: 200, 2: 100}
    sources = spark.createDataFrame([(k, n) for k, n in quota.items()], "k int, quota long")
    rows = sorted((r["slot"], r["k"], r["rank"]) for r in mixing.schedule(sources).collect())
    assert len({s for s, *_ in rows}) == len(rows) == 800
    for k, n in quota.items():
        assert sorted(r for _, x, r in rows if x == k) == list(range(n))
    for at in range(0, 700, 100):
        counts = [sum(k == x for _, k, _ in rows[at : at + 100]) for x in quota]
        assert all(abs(c - n / 8) <= 4 for c, n in zip(counts, quota.values()))


def test_stage_writes_what_was_taken(spark, tables, hostile):
    folder = tables(hostile)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = mixing.mix_documents(spark, docs, folder)
    assert mixed.columns == docs.columns
    count, texts = defaultdict(int), dict((i, t or "") for i, t, *_ in hostile)
    for r in mixed.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        count[r["doc_id"]] += n
        assert r["doc_id"] is None or texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    want = defaultdict(int)
    for r in mixing.op6_mixing(spark, folder).collect():
        want[r["doc_id"]] += r["taken"]
    assert count == {k: v for k, v in want.items() if v}


def test_slots_order_the_mix(spark, small):
    """Slots are used by one block each; the documents of any stretch of the mix have the sources' shares."""
    got = [r for r in mixing.op6_mixing(spark, small).collect() if r["taken"]]
    assert all(r["first_slot"] is not None for r in got)
    rows = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    share, halves = defaultdict(float), [defaultdict(float), defaultdict(float)]
    last = max(r["first_slot"] for r in got)
    for r in got:
        share[rows[r["doc_id"]]] = r["target"]
        halves[2 * r["first_slot"] > last][rows[r["doc_id"]]] += min(r["taken"], r["size"])
    total = sum(share.values())
    for half in halves:
        n = sum(half.values())
        assert all(abs(half[s] / n - w / total) < 0.35 for s, w in share.items())


def test_stage_keeps_the_order_of_slots(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    slot = {r["doc_id"]: r["first_slot"] for r in mixing.op6_mixing(spark, small).collect()}
    seen, at = set(), []
    for r in mixing.mix_documents(spark, docs, small).collect():
        if r["doc_id"] not in seen:  # the first copy
            seen.add(r["doc_id"])
            at.append(slot[r["doc_id"]])
    assert at == sorted(at) and len(at) > 100
