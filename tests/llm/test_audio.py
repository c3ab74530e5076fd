from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from buildlens.llm import audio


def test_hostile_rows(spark, tables, hostile):
    texts = {}
    for i, t, *_ in hostile:
        texts.setdefault(i, set()).add(t)
    rows = audio.op7_audio(spark, tables(hostile)).collect()
    assert len(rows) == len(hostile)
    for r in rows:
        if r["doc_id"] is None:
            continue
        (text,) = texts[r["doc_id"]]
        data = (text or "").encode()
        payload = data + b"\0" * (64 if not data else -len(data) % 64)
        media = audio.wav(data)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    feature = {r["doc_id"]: r["feature"] for r in rows}
    assert feature[1] == feature[2] and feature[4] == feature[5]


def test_empty_table(spark, tables):
    assert audio.op7_audio(spark, tables()).collect() == []


def test_the_file_is_a_wave_file():
    data = bytes(range(256)) + b"odd"
    with wave.open(io.BytesIO(audio.wav(data))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, audio.RATE)
        assert w.readframes(w.getnframes()) == audio.samples(audio.wav(data))
    with pytest.raises(ValueError):
        audio.samples(b"RIFF")


@pytest.mark.parametrize("n", [64, 100, 1027])
def test_resampling_against_the_plain_definition(n):
    """Zeros put in, one long filter, every DOWN-th sample kept."""
    x = np.random.default_rng(n).normal(size=n).astype(np.float32)
    phases, _, _ = audio.tables()
    full = np.empty(audio.UP * audio.TAPS)
    for p in range(audio.UP):
        full[p :: audio.UP] = phases[p][::-1]
    up = np.zeros(n * audio.UP)
    up[:: audio.UP] = x
    want = np.convolve(np.concatenate([up, np.zeros(audio.DOWN * audio.UP)]), full)[:: audio.DOWN][: -(-n * audio.UP // audio.DOWN)]
    assert np.allclose(audio.resampled(x), want, atol=1e-4)


def test_log_mel_against_the_plain_definition():
    y = np.random.default_rng(1).normal(size=700).astype(np.float32)
    _, window, bank = audio.tables()
    got = audio.log_mel(y)
    full = np.concatenate([y, np.zeros(len(got) * audio.HOP + audio.WINDOW)])
    for i, row in enumerate(got):
        part = full[i * audio.HOP : i * audio.HOP + audio.WINDOW] * window
        k = np.arange(audio.WINDOW)
        dft = np.array([abs((part * np.exp(-2j * np.pi * f * k / audio.WINDOW)).sum()) ** 2 for f in range(audio.WINDOW // 2 + 1)])
        assert np.allclose(row, np.log10(dft @ bank + 1e-10), atol=1e-3)


def test_hysteresis():
    energy = np.array([0, 5, 1, 9, 4, 4, 1, 4, 4, 0, 9.0])
    assert audio.active(energy) == [(1, 2), (3, 6), (10, 11)]


def test_tensors_have_one_shape_and_spans(spark, tables):
    folder = tables([(1, "word " * 5000, "en", "a"), (2, "x", "en", "a")])
    rows = audio.features(audio.store(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])).toArrow()
    assert rows.num_rows == 2
    for column in rows.column("tensors").chunks:
        tensors = audio.as_tensors(column)
        assert tuple(tensors.type.shape) == (audio.FRAMES, audio.BANDS)
    for tensors in rows.column("tensors").to_pylist():
        assert all(len(t["values"]) == audio.FRAMES * audio.BANDS for t in tensors)
        assert all(a["end_ms"] == b["start_ms"] for a, b in zip(tensors, tensors[1:]))


@pytest.mark.parametrize("n", [64, 320, 41024, 64 * 30011])
def test_pieces_against_the_whole(monkeypatch, n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    whole = audio.log_mel(audio.resampled((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128))
    monkeypatch.setattr(audio, "BLOCK", 96)
    got = audio.energies(data)
    assert got.shape == whole.shape and np.allclose(got, whole, atol=1e-3)


def test_feature_is_read_from_stored_tensors(spark, tables):
    """Against plain definitions: every band's mean, and the spans, of the whole sound."""
    texts = {1: "word " * 9000, 2: "x", 3: None, 4: "Grüße! " * 300 + "." * 4000}
    rows = audio.op7_audio(spark, tables([(i, t, "en", "a") for i, t in texts.items()])).collect()
    for r in rows:
        data = audio.samples(audio.wav((texts[r["doc_id"]] or "").encode()))
        mel = audio.log_mel(audio.resampled((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128))
        windows, spans, busy, means = r["feature"].split(":")
        own = audio.active(mel.max(axis=1))
        assert (int(windows), int(spans)) == (len(mel), len(own))
        assert int(busy) == sum(audio.milliseconds(b) - audio.milliseconds(a) for a, b in own)
        assert np.allclose([float(x) for x in means.split(",")], mel.mean(axis=0), atol=audio.STEP / 2 + 0.006)
