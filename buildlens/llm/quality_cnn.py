"""A byte-level convolutional network for text quality, in numpy.

A whole text's bytes are embedded and convolved with learned filters; the filters'
activations are averaged over chunks of 2 * BLOCK bytes that overlap by half and cover
the whole text. A small layer turns each chunk into features, which are pooled over the
chunks by their maximum and combined into one probability.

It is fitted on at most SAMPLE labelled texts of each class, those with the least
md5(doc_id), of at most LONGEST bytes each, from the rows whose crc32(doc_id) mod 3 is
not 1; this bound is a parameter, and the rest of the work covers all texts. Classes
are drawn alike, and the last term is set for their true shares. Only the text enters
a score. Texts are scored one by one, very long ones in pieces of bounded size.

Null or empty text: scored as a text without bytes. Null doc_id: not held out, and
never a training row. Contradicting labels of one doc_id: not used. Of several texts under
one labelled doc_id the one with the least md5 is learned from. Repeated rows and equal
texts score alike; other columns are not read. A table with labels
of fewer than two classes gives every text the share of the only class, or 1/2.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_python

SAMPLE, LONGEST = 2000, 1 << 15
BLOCK, STRIDE, WIDTH, EMBED, FILTERS, HIDDEN = 256, 4, 8, 8, 24, 24
EPOCHS, BATCH, RATE, DECAY = 7, 16, 0.004, 1e-5
#: Bytes scored at once, a multiple of BLOCK.
PIECE = 1 << 18
BLANK = 256


def start():
    import numpy as np

    rng = np.random.default_rng(7)
    normal = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
    return {
        "embed": normal(257, EMBED, by=0.5),
        "filter": normal(WIDTH * EMBED, FILTERS, by=0.15),
        "bias": np.zeros(FILTERS, np.float32),
        "chunk": normal(FILTERS, HIDDEN, by=0.3),
        "chunk_bias": np.full(HIDDEN, 0.05, np.float32),
        "out": normal(HIDDEN, by=0.2),
        "out_bias": np.zeros(1, np.float32),
    }


def padded(data: bytes):
    import numpy as np

    out = np.full(max(1, -(-len(data) // BLOCK)) * BLOCK, BLANK, np.uint16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def activations(model, data, after):
    """Filters' activations at each stride. data is a whole number of blocks; after is what follows it."""
    import numpy as np

    steps = model["embed"][np.concatenate([data, after])].reshape(-1, STRIDE * EMBED)
    half = STRIDE * EMBED
    raw = steps[:-1] @ model["filter"][:half] + steps[1:] @ model["filter"][half:] + model["bias"]
    return steps, raw


def blocks(model, data: bytes):
    """Each block's mean activations."""
    import numpy as np

    text, per = padded(data), BLOCK // STRIDE
    blank, pooled = np.full(STRIDE, BLANK, np.uint16), []
    for at in range(0, len(text), PIECE):
        part = text[at : at + PIECE]
        follow = text[at + PIECE : at + PIECE + STRIDE]
        _, raw = activations(model, part, follow if len(follow) else blank)
        pooled.append(np.maximum(raw, 0).reshape(-1, per, FILTERS).mean(axis=1))
    return np.concatenate(pooled)


def chunks(per_block):
    """Means of neighbouring blocks: chunks that overlap by half."""
    return (per_block[1:] + per_block[:-1]) / 2 if len(per_block) > 1 else per_block


def score(data: bytes | None, model) -> float:
    import numpy as np

    hidden = np.maximum(chunks(blocks(model, data or b"")) @ model["chunk"] + model["chunk_bias"], 0)
    z = float(hidden.max(axis=0) @ model["out"] + model["out_bias"][0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def gradient(model, data: bytes, label: int, into) -> None:
    """Adds one text's gradient of the log loss."""
    import numpy as np

    text, per = padded(data), BLOCK // STRIDE
    steps, raw = activations(model, text, np.full(STRIDE, BLANK, np.uint16))
    on = raw > 0
    mean = np.where(on, raw, 0).reshape(-1, per, FILTERS).mean(axis=1)
    c = chunks(mean)
    before = c @ model["chunk"] + model["chunk_bias"]
    hidden = np.maximum(before, 0)
    top = hidden.argmax(axis=0)
    pooled = hidden.max(axis=0)
    z = pooled @ model["out"] + model["out_bias"][0]
    d = np.float32(1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
    into["out"] += d * pooled
    into["out_bias"] += d
    d_hidden = np.zeros_like(hidden)
    d_hidden[top, np.arange(HIDDEN)] = d * model["out"]
    d_hidden *= before > 0
    into["chunk"] += c.T @ d_hidden
    into["chunk_bias"] += d_hidden.sum(axis=0)
    d_chunk = d_hidden @ model["chunk"].T
    d_block = np.zeros_like(mean)
    if len(mean) > 1:
        d_block[1:] += d_chunk / 2
        d_block[:-1] += d_chunk / 2
    else:
        d_block += d_chunk
    d_raw = np.repeat(d_block / per, per, axis=0) * on
    half = STRIDE * EMBED
    into["filter"][:half] += steps[:-1].T @ d_raw
    into["filter"][half:] += steps[1:].T @ d_raw
    into["bias"] += d_raw.sum(axis=0)
    d_steps = np.zeros_like(steps)
    d_steps[:-1] += d_raw @ model["filter"][:half].T
    d_steps[1:] += d_raw @ model["filter"][half:].T
    d_bytes = d_steps.reshape(-1, EMBED)[: len(text)]
    for k in range(EMBED):
        into["embed"][:, k] += np.bincount(text, d_bytes[:, k], 257)


def fit(sample: list[tuple[bytes, int]]):
    """Adam over shuffled batches; the seed is fixed, so equal samples give equal models."""
    import numpy as np

    model, rng = start(), np.random.default_rng(11)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step, total = 0, EPOCHS * -(-len(sample) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), BATCH):
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            batch = order[at : at + BATCH]
            for i in batch:
                gradient(model, *sample[i], grad)
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k in model:
                g = grad[k] / len(batch) + DECAY * model[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return model


def remainder(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame):
    """The model, fitted on a bounded sample of the labelled rows that are not held out."""
    import numpy as np

    marked = labels.where(F.col("quality").isin(0, 1) & (remainder() != 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("__most")).where("label = __most").select("doc_id", "label")
    texts = docs.where(F.octet_length("text") <= LONGEST).select("doc_id", F.col("text").cast("binary").alias("data"))
    both = texts.select("doc_id").distinct().join(marked, "doc_id")
    shares = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(shares) < 2:
        model = start()
        share = 0.5 if not shares else float(next(iter(shares)))
        model["out"][:] = 0
        model["out_bias"][0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return model
    drawn = [both.where(F.col("label") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE) for k in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("data", "label"), F.md5("data")).alias("one")).select("doc_id", "one.data", "one.label")  # at most 2 * SAMPLE ids, hence rows
    rows = sorted(((r["doc_id"], bytes(r["data"]), int(r["label"])) for r in sample.toLocalIterator()), key=lambda r: r[0])
    model = fit([(x, y) for _, x, y in rows])
    drawn_share = {k: sum(y == k for _, _, y in rows) for k in (0, 1)}
    model["out_bias"] += np.float32(np.log(shares[1] / shares[0]) - np.log(drawn_share[1] / drawn_share[0]))
    return model


def scored(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """`columns` of docs and the score of its whole text."""
    packed = pickle.dumps(model)
    data = docs.select(*columns, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("__data"))
    return with_python(data, "__data", lambda x, m: (score(x, m),), [("score", "double")], setup=lambda: pickle.loads(packed))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = scored(docs, train(docs, labels), ["doc_id"])
    held = F.coalesce(remainder() == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
