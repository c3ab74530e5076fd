from __future__ import annotations

import io
import random

import pytest

from buildlens.llm import warc

LONG = "<html>" + "y" * 1200 + "</html>"
PAGES = [
    (1, "http://a/1", LONG),
    (2, "http://a/2", LONG),
    (3, None, LONG),
    (3, None, LONG),
    (4, "http://a/4", "short"),
    (5, "http://a/5", "short"),
    (6, "http://a/6", None),
    (7, "http://a/7", ""),
    (None, "http://a/n", LONG),
    (None, None, None),
    (8, "http://a/ b\r\nX: y", "é" * 600),
    (9, "http://a/9", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
]


def test_hostile_pages(spark, tables):
    got = {}
    for r in warc.op3_warc(spark, tables(pages=PAGES)).collect():
        got.setdefault(r["page_id"], []).append((r["payload_bytes"], r["record_type"], r["refers_to"]))
    n = len(LONG)
    assert got[1] == got[2] == [(n, "revisit", 3)] and got[3] == [(n, "response", None)] * 2
    assert got[4] == got[5] == [(5, "response", None)] and got[6] == got[7] == [(0, "response", None)]
    assert sorted(got[None]) == [(0, "response", None), (n, "revisit", 3)]
    assert got[8] == [(1200, "response", None)] and got[9] == [(1600, "response", None)]


def test_content_comes_back(spark, tables, tmp_path):
    pages = spark.read.parquet(tables(pages=PAGES) + "/pages.parquet")
    folder = f"file://{tmp_path}/archives"
    rows = warc.read_archives(warc.write_archives(pages, folder), folder, content=True).collect()
    html = {p: h or "" for p, _, h in PAGES}
    assert len(rows) == len(PAGES)
    for r in rows:
        assert r["payload"] is None if r["record_type"] == "revisit" else r["page_id"] is None or bytes(r["payload"]).decode() == html[r["page_id"]]


def test_empty_table(spark, tables):
    assert warc.op3_warc(spark, tables()).collect() == []


def test_oracle(same, small):
    same(warc.op3_warc, warc.oracle(), small)


class Dribble(io.BytesIO):
    """A stream that gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_frames_incrementally():
    rng = random.Random(4)
    payloads = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 1000, 70_000)]
    data = b"".join(warc.record(i, f"http://x/{i}", p, None, False, "1970-01-01T00:00:00Z") for i, p in enumerate(payloads))
    for stream in (io.BytesIO(data), Dribble(data)):
        assert [bytes(r[-1]) for r in warc.records(stream, True)] == payloads


@pytest.mark.parametrize("harm", ["payload", "cut"])
def test_reader_refuses_damage(harm):
    good = warc.record(1, "http://x", b"abc" * 100, None, False, "1970-01-01T00:00:00Z")
    if harm == "cut":
        bad = good[:-20]
    else:
        import gzip

        bad = gzip.compress(gzip.decompress(good).replace(b"abcabc", b"abcabd", 1))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(bad), False))
