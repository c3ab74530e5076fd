from __future__ import annotations

import zlib

import numpy as np
from conftest_llm import words

from buildlens.llm import quality_cnn as cnn


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    good, bad = scores[labels == 1], scores[labels == 0]
    return float(((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2))


def test_gradient_against_differences():
    model = {k: v.astype(np.float64) for k, v in cnn.start().items()}
    data = words(200, 3).encode()
    grad = {k: np.zeros_like(v) for k, v in model.items()}
    cnn.gradient(model, data, 1, grad)

    def loss():
        return -np.log(cnn.score(data, model))

    rng = np.random.default_rng(1)
    for name, value in model.items():
        flat, g = value.reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 1e-3 * max(1, abs(g[i])), (name, i)


def test_whole_texts_in_pieces(monkeypatch):
    model, data = cnn.start(), words(20_000, 4).encode()
    whole = cnn.score(data, model)
    monkeypatch.setattr(cnn, "PIECE", 4 * cnn.BLOCK)
    assert abs(cnn.score(data, model) - whole) < 1e-6
    assert abs(cnn.score(data[: len(data) // 2], model) - whole) > 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in cnn.op8_quality_cnn(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if i in rows and rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert auc([rows[i]["score"] for i in held], [labels[i] for i in held]) > 0.9


def test_hostile_rows(spark, tables, hostile):
    rows = cnn.op8_quality_cnn(spark, tables(hostile, [(1, 1, 0), (3, 0, 0), (7, 1, 0), (9, 0, 0), (9, 1, 0), (None, 1, 0), (2, 1, None), (12, None, 0)])).collect()
    assert len(rows) == len(hostile)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] is not None for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] == score[2] and score[4] == score[5]


def test_empty_tables(spark, tables, hostile):
    assert cnn.op8_quality_cnn(spark, tables()).collect() == []
    assert all(r["score"] == 0.5 for r in cnn.op8_quality_cnn(spark, tables(hostile)).collect())


def test_score_against_the_plain_definition():
    """Every stride's window of bytes through every filter, chunk by chunk, in plain loops."""
    model = cnn.start()
    for data in (b"", b"a", words(90, 8).encode(), b"x" * 700):
        text = list(data) + [cnn.BLANK] * (max(1, -(-len(data) // cnn.BLOCK)) * cnn.BLOCK - len(data)) + [cnn.BLANK] * cnn.STRIDE
        acts = []
        for at in range(0, len(text) - cnn.STRIDE, cnn.STRIDE):
            window = np.concatenate([model["embed"][b] for b in text[at : at + cnn.WIDTH]])
            acts.append(np.maximum(window @ model["filter"] + model["bias"], 0))
        per = cnn.BLOCK // cnn.STRIDE
        n = len(acts) // per
        spans = [(i * per, (i + 2) * per) for i in range(n - 1)] or [(0, per)]
        hidden = [np.maximum(np.mean(acts[a:b], axis=0) @ model["chunk"] + model["chunk_bias"], 0) for a, b in spans]
        z = np.max(hidden, axis=0) @ model["out"] + model["out_bias"][0]
        assert abs(cnn.score(data, model) - 1 / (1 + np.exp(-z))) < 1e-5
