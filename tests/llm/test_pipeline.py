from __future__ import annotations

import inspect
import re
from collections import defaultdict

from conftest_llm import words
from test_mixing import sizes_and_targets
from test_near_dedup import brute as near_brute
from test_packing import check as packs
from test_quality_rules import brute as measures
from test_secret_scan import brute as secrets

import corpus_pipeline
from buildlens.llm import secret_scan


def written(spark, stage, docs, folder, path):
    stage(spark, docs, folder).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages_against_brute_force(spark, tables, tmp_path, hostile):
    """Without labels no cutoff is certified, so that each stage has one right result."""
    rows = [*hostile, *[(200 + i, words(90 + 30 * i, 300 + i // 2), "en", "abc"[i % 3]) for i in range(12)], (300, words(60, 301) + " token=abcdefghijklmnop", "fr", "b")]
    folder = tables(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    state, last = [tuple(r) for r in docs.collect()], None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = written(spark, stage, docs, folder, tmp_path / f"stage{n}")
        got = docs.collect()
        if n < 4:
            assert docs.columns == columns
        pairs = sorted(((r["doc_id"], r["text"]) for r in got), key=repr) if n < 4 else None
        before = [(r[0], r[1]) for r in state]
        if n == 0:
            want = [(i, t) for i, t in before if measures(t)[0] >= 50 and 100 * measures(t)[4] <= 50 * measures(t)[0]]
            assert pairs == sorted(want, key=repr)
        elif n == 1:
            parts = near_brute([(r[0], r[1]) for r in state], 5)
            assert {i for i, _ in pairs} == {c if c is not None else i for i, _, c in parts} and len(pairs) == len({i for i, _ in pairs})
        elif n == 2:
            assert [i for i, _ in pairs] == sorted((i for i, _ in before), key=repr)
            texts = dict(before)
            for i, t in pairs:
                assert not secrets(t) and (t == texts[i]) == (not secrets(texts[i])) and (t == texts[i] or secret_scan.MASK in t)
        elif n == 3:
            _, target = sizes_and_targets([(r[0], r[1], r[2], r[3]) for r in state])
            taken = defaultdict(int)
            for r in got:
                taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
        else:
            assert packs(got, before) == 0
        state = [tuple(r) for r in got]


def test_run_equals_its_stages(spark, small):
    first = corpus_pipeline.run(spark, small)
    assert first.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert pieces(first) == pieces(corpus_pipeline.run(spark, small)) and first.count() > 100
