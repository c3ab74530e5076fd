"""Media columns: texts as 8-bit sound, and audio features read from it.

store() lays a text's UTF-8 bytes, filled with bytes 0 up to a positive multiple of
64, into a WAV file of unsigned 8-bit mono samples, losslessly. features() reads the
stored samples back and gives

* the log-mel energies of the sound, resampled by a polyphase filter (3/4 of the
  rate) and cut into overlapped windows, as tensors of the fixed shape
  FRAMES x BANDS with their time spans (the last one filled with SILENCE), in steps of
  STEP, and
* its active time spans by hysteresis: a span begins where a window's energy exceeds
  the higher threshold and reaches as far as the lower one is exceeded.

These are stored in turn, and summaries() reads the tensors back as Arrow's fixed-shape
tensors: the number of windows, of active spans and their milliseconds, and each band's
mean energy.

Every document is worked on alone, so equal texts give equal values. A sound is
resampled and transformed in pieces of BLOCK windows; besides them a text costs its own
bytes and its tensors, about half as many. Null or empty text: 64 bytes 0. Null or
repeated doc_id, repeated rows: each row is worked on. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_batches, table, with_python, written

UNIT = 64
RATE = 8000
UP, DOWN, TAPS = 3, 4, 12  # taps of each phase
WINDOW, HOP, BANDS, FRAMES = 256, 128, 20, 32
SILENCE = -10.0
#: Windows worked on at once, a multiple of FRAMES whose samples are whole numbers at both rates.
BLOCK = 3072
#: Stored energies are multiples of this, in decades: a sixth of a decibel.
STEP = 1 / 64


def wav(data: bytes | None) -> bytes:
    """A WAV file of the bytes as samples, filled to a positive multiple of UNIT."""
    data = data or b""
    data += b"\0" * (-len(data) % UNIT or (0 if data else UNIT))
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(data), b"WAVE") + form + struct.pack("<4sI", b"data", len(data)) + data


def samples(media: bytes) -> bytes:
    """The samples of a WAV file of 8-bit mono sound."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


@cache
def tables():
    """The filter's phases, the window and the mel filterbank."""
    import numpy as np

    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    low = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    phases = (low * UP / low.sum()).reshape(TAPS, UP).T[:, ::-1].astype(np.float32)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hertz = np.linspace(0, RATE * UP / DOWN / 2, WINDOW // 2 + 1)
    edges = 700 * (10 ** (np.linspace(0, mel(hertz[-1]), BANDS + 2) / 2595) - 1)
    bank = np.maximum(0, np.minimum((hertz[:, None] - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - hertz[:, None]) / np.diff(edges)[1:]))
    return phases, np.hanning(WINDOW).astype(np.float32), bank.astype(np.float32)


def resampled(x):
    """x at UP/DOWN of its rate: each output sample is one phase of the filter at its place."""
    import numpy as np

    phases, _, _ = tables()
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    n = -(-len(x) * UP // DOWN)
    out = np.empty(n, np.float32)
    for r in range(UP):
        place = slice(r * DOWN // UP, None, DOWN)
        out[r::UP] = (views[place] @ phases[r * DOWN % UP])[: len(out[r::UP])]
    return out


def log_mel(y):
    """Log energies, one row of BANDS for each window of y."""
    import numpy as np

    _, window, bank = tables()
    y = np.concatenate([y, np.zeros(max(0, WINDOW - len(y)) or -(len(y) - WINDOW) % HOP, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    out = np.empty((len(views), BANDS), np.float32)
    for at in range(0, len(views), BLOCK):
        power = np.abs(np.fft.rfft(views[at : at + BLOCK] * window)) ** 2
        out[at : at + BLOCK] = np.log10(power.astype(np.float32) @ bank + 10**SILENCE)
    return out


def active(energy) -> list[tuple[int, int]]:
    """Spans [first, end) of windows: runs above the lower threshold that somewhere
    exceed the higher one. The thresholds lie 1/4 and 1/2 of the way from the least
    energy to the greatest."""
    import numpy as np

    least, most = float(energy.min()), float(energy.max())
    on = np.concatenate([[False], energy > least + (most - least) / 4, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    high = np.concatenate([[0], np.cumsum(energy > least + (most - least) / 2)])
    return [(int(a), int(b)) for a, b in edge if high[b] > high[a]]


def milliseconds(window: int) -> int:
    return window * HOP * DOWN * 1000 // (UP * RATE)


def energies(data: bytes):
    """log_mel() of the whole sound, made in pieces: each is resampled with the samples
    around it that its filter and its last window reach."""
    import numpy as np

    margin = 4 * DOWN  # at least TAPS - 1
    size, length = BLOCK * HOP * DOWN // UP, WINDOW * DOWN // UP + 2 * margin
    out, n = [], -(-len(data) * UP // DOWN)
    windows = 1 + max(0, -(-(n - WINDOW) // HOP))
    for first in range(0, windows, BLOCK):
        at = first // BLOCK * size
        before = min(at, margin)
        part = np.frombuffer(data, np.uint8, count=min(len(data), at + size + length) - at + before, offset=at - before)
        y = resampled((part.astype(np.float32) - 128) / 128)[before * UP // DOWN :]
        count = min(BLOCK, windows - first)
        out.append(log_mel(y[: (count - 1) * HOP + WINDOW])[:count])
    return np.concatenate(out)


def describe(media: bytes) -> tuple:
    import numpy as np

    data = samples(media)
    mel = energies(data)
    spans = active(mel.max(axis=1))
    full = np.full((-(-len(mel) // FRAMES) * FRAMES, BANDS), SILENCE, np.float32)
    full[: len(mel)] = np.round(mel / STEP) * STEP
    tensors = [(milliseconds(i), milliseconds(min(i + FRAMES, len(mel))), full[i : i + FRAMES].ravel()) for i in range(0, len(mel), FRAMES)]
    times = [(milliseconds(a), milliseconds(b)) for a, b in spans]
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(mel), times, [{"start_ms": a, "end_ms": b, "values": v} for a, b, v in tensors]


FEATURES = [
    ("payload_bytes", "long"),
    ("payload_sha256", "string"),
    ("tail_crc32", "long"),
    ("windows", "long"),
    ("spans", "array<struct<start_ms:long,end_ms:long>>"),
    ("tensors", "array<struct<start_ms:long,end_ms:long,values:array<float>>>"),
]


def store(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of docs, n_bytes, and the text's sound as media."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return with_python(docs.select(*columns, F.octet_length(data).cast("long").alias("n_bytes"), data.alias("__data")), "__data", lambda x: (wav(x),), [("media", "binary")])


def features(media: DataFrame) -> DataFrame:
    """media without its column media, with what describe() finds there: tensors and spans."""
    return with_python(media, "media", describe_row, FEATURES)


def describe_row(media: bytes) -> tuple:
    size, sha, crc, windows, spans, tensors = describe(media)
    return size, sha, crc, windows, [{"start_ms": a, "end_ms": b} for a, b in spans], tensors


def as_tensors(column):
    """The values of `tensors`, as Arrow's fixed-shape tensors of FRAMES x BANDS."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))
    flat = pa.FixedSizeListArray.from_arrays(column.flatten().field("values").flatten().cast(pa.float32()), FRAMES * BANDS)
    return pa.ExtensionArray.from_storage(kind, flat)


def summaries(stored: DataFrame) -> DataFrame:
    """stored features with `feature`, read from their tensors and spans, in place of these."""
    kept = [c for c in stored.columns if c not in ("windows", "spans", "tensors")]
    busy = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_ms"] - s["start_ms"])
    rows = stored.select(*kept, F.concat_ws(":", "windows", F.size("spans"), busy).alias("__head"), "windows", "tensors")
    schema = T.StructType([*(stored.schema[c] for c in kept), T.StructField("feature", T.StringType())])
    limit_batches(stored.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(len(kept) + 2)
            frames = as_tensors(column).to_numpy_ndarray().reshape(-1, BANDS)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * FRAMES
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            made = []
            for head, n, at in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), starts.tolist()):
                made.append(f"{head}:" + ",".join(f"{x:.2f}" for x in frames[at : at + n].mean(axis=0, dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))] + [pa.array(made, pa.string())], schema=arrow)

    return rows.mapInArrow(run, schema)


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store(table(spark, sf_dir, "documents"), ["doc_id"]))
    media = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    rows = summaries(written(features(media)))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
