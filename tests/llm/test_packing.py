from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from conftest_llm import words
from tokenizers import Tokenizer

from buildlens.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, documents):
    """The contract: exact ids, each in one piece, sequences gapless and padded alike. Returns the padding."""
    slow = Tokenizer.from_file(TOKENIZER)
    want = defaultdict(int)
    ids = {}
    for doc_id, text, *_ in documents:
        want[doc_id] += 1
        ids.setdefault(doc_id, []).append([*slow.encode(text or "", add_special_tokens=False).ids, 0])
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert set(by_doc) == set(want)
    for doc_id, pieces in by_doc.items():
        for own in ids[doc_id]:  # rows of one id tile it once each
            crc = lambda s, n: zlib.crc32(np.array(own[s : s + n], "<u4").tobytes())
            mine = [p for p in pieces if p[3] == len(own) and crc(p[0], p[1]) == p[2]]
            assert sum(p[1] for p in mine) >= len(own)
        assert sum(p[1] for p in pieces) == sum(map(len, ids[doc_id]))
        if want[doc_id] == 1:
            end = 0
            for start, length, *_ in sorted(pieces):
                assert start == end
                end += length
    return padding


def test_hostile_rows(spark, tables, hostile):
    rows = packing.op2_packing(spark, tables(hostile)).collect()
    check(rows, hostile)


def test_whole_table_with_no_padding(spark, small):
    documents = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert check(packing.op2_packing(spark, small).collect(), documents) == 0


def test_empty_table(spark, tables):
    assert packing.op2_packing(spark, tables()).collect() == []


def test_encoder_equals_the_file():
    slow, fast = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    assert fast.fast is not None
    for text in ("", " ", "a\n\n b", "<|endoftext|> x", "é😀 ünï", "1234 5678", " " * 3000 + "x", "\t\r\n" * 50, words(500, 1), "x" * 5000, "it's I'LL"):
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


def test_repeats_never_exceed_the_histogram():
    rng = np.random.default_rng(1)
    histogram = {int(r): int(n) for r, n in zip(rng.choice(1023, 300, replace=False) + 1, rng.integers(1, 500, 300))}
    used = defaultdict(int)
    total = 0
    for combo, n in packing.repeats(histogram):
        assert sum(combo) == packing.WINDOW
        total += n
        for r in combo:
            used[r] += n
    assert total > 0 and all(used[r] <= histogram[r] for r in used)


def test_places_cover_every_rank_once():
    histogram = {1: 5, 1023: 4, 512: 7, 300: 9, 700: 2}
    rows, _ = packing.places(histogram)
    for r, n in histogram.items():
        spans = sorted((low, high) for x, low, high, *_ in rows if x == r)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_greedy_rests_tile_windows():
    """Rests packed greedily: every token in one place, full windows, then powers of two."""
    rng = np.random.default_rng(2)
    for trial in range(60):
        lengths = rng.choice(1023, int(rng.integers(1, 40)), replace=False) + 1
        histogram = {int(r): int(n) for r, n in zip(lengths, rng.integers(1, [3, 40, 2000][trial % 3], len(lengths)))}
        rows, windows = packing.places(histogram)
        filled, tokens = defaultdict(list), defaultdict(list)
        for rest, low, high, pieces in rows:
            for rank in range(low, high):
                for start, length, window, offset in pieces:
                    filled[window + rank - low].append((offset, length))
                    tokens[rest, rank].append((start, length))
        assert sorted(tokens) == sorted((r, i) for r, n in histogram.items() for i in range(n)) and sorted(filled) == list(range(windows))
        for (rest, _), own in tokens.items():
            assert sum(n for _, n in own) == rest and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))
        sizes = []
        for _, own in sorted(filled.items()):
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and min(own)[0] == 0
            sizes.append(sum(n for _, n in own))
        left = sum(r * n for r, n in histogram.items()) % 1024
        assert sizes == [1024] * (sum(r * n for r, n in histogram.items()) // 1024) + [1 << b for b in reversed(range(10)) if left & 1 << b]


def test_special_tokens_in_texts(spark, tables):
    documents = [(1, "a <|endoftext|> b<|endoftext|>", "en", "a"), (2, "<|endoftext|>", "en", "a"), (3, "plain", "en", "b")]
    rows = packing.op2_packing(spark, tables(documents)).collect()
    check(rows, documents)
    slow = Tokenizer.from_file(TOKENIZER)
    assert 50256 in slow.encode(documents[0][1], add_special_tokens=False).ids
