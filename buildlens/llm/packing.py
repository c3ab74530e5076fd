"""Packing token sequences into windows by non-negative least squares.

A document's tokens (and one end token) are cut into full windows and a rest. The
rests are packed by their lengths' histogram alone, which has at most WINDOW - 1
entries however large the corpus is: combinations of two or three lengths that fill a
window are enumerated, how often each is used is solved for by non-negative least
squares against the histogram and rounded down. What no combination takes is packed
greedily by length: a window gets the longest rest that is left and then, again and
again, the longest that fits; a gap that none fits is filled from the shortest one, whose
remainder waits as a rest of its own. As many windows are filled alike as the histogram
allows, so the work depends on the lengths, not on the corpus. What is left in the end is
less than a window and is cut into powers of two, which need no padding. So each rest's
places follow from its length and its rank among the rests of that length, and the rank
from its place in its partition and the counts of the partitions before.

Null or empty text: the end token alone. Repeated rows: each is packed. Null doc_id:
packed as any other. Very long texts are cut at windows. Ties go to the order of rows in
their partition. Columns of docs other than those asked for are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_batches, table, with_python, written

WINDOW = 1024
END = 0
#: First lengths of the combinations of three.
FIRST = (32, 64, 128, 192, 256, 320)
SWEEPS = 60


class Encoder:
    """Ids of a byte-level BPE vocabulary in a tokenizers file. The ids come from
    tiktoken over that file's own vocabulary, several times as fast and equal; texts
    that it refuses (very long runs of blanks), and files whose ids are not in the
    order of their merges, are left to tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special: dict[str, int] = {}
        self.fast = self._fast(path)

    def _fast(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        added = spec.get("added_tokens", [])
        special = {x["content"]: x["id"] for x in added}
        if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if [vocab["".join(p)] for p in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.special = special
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                if any(x in text for x in self.special):
                    return self.fast.encode(text, allowed_special="all")
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the regex engine's limit reaches Python as a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def tokens(docs: DataFrame, columns: list[str], tokenizer: str) -> DataFrame:
    """`columns`, doc_tokens, ids (unsigned 32-bit, or 16-bit where the vocabulary allows
    it, in `width` bytes each), and the counts that give ranks: full windows, and rests
    of the same length, earlier in the partition `part`."""
    fields = [("doc_tokens", "long"), ("width", "int"), ("ids", "binary"), ("part", "int"), ("full_before", "long"), ("rest", "int"), ("rest_before", "long")]
    source = docs.select(*columns, "text")
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    limit_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        encode, arrow, part = Encoder(tokenizer), to_arrow_schema(schema), TaskContext.get().partitionId()
        width = 2 if encode.slow.get_vocab_size() <= 1 << 16 else 4
        full, seen = 0, Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece, rows = batch.slice(at, 128), []
                for text in piece.column(len(columns)).to_pylist():
                    ids = np.array([*encode(text or ""), END], f"<u{width}")
                    rest = len(ids) % WINDOW
                    rows.append((len(ids), width, ids.tobytes(), part, full, rest, seen[rest]))
                    full += len(ids) // WINDOW
                    seen[rest] += 1
                made = [pa.array(c, arrow.field(len(columns) + i).type) for i, c in enumerate(map(list, zip(*rows)))]
                yield pa.RecordBatch.from_arrays([piece.column(i).cast(arrow.field(i).type) for i in range(len(columns))] + made, schema=arrow)

    return source.mapInArrow(run, schema)


def combinations() -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill a window."""
    pairs = [(a, WINDOW - a) for a in range(1, WINDOW // 2 + 1)]
    threes = {tuple(sorted((a, b, WINDOW - a - b))) for a in FIRST for b in range(1, WINDOW - a)}
    return pairs + sorted(threes)


def repeats(histogram: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used: least squares over non-negative numbers by
    coordinate descent, rounded down, and held to what the histogram still has."""
    combos = [c for c in combinations() if all(histogram.get(x) for x in c)]
    need = [0.0] * WINDOW
    for r, n in histogram.items():
        need[r] = float(n)
    short, x = list(need), [0.0] * len(combos)
    weight = [float(sum(c.count(r) ** 2 for r in set(c))) for c in combos]
    for _ in range(SWEEPS):
        for i, c in enumerate(combos):
            new = max(0.0, x[i] + sum(short[r] for r in c) / weight[i])
            if (d := new - x[i]) != 0:
                x[i] = new
                for r in c:
                    short[r] -= d
    left, out = dict(histogram), []
    for i in sorted(range(len(combos)), key=lambda i: (-x[i], combos[i])):
        c = combos[i]
        if n := min(int(x[i]), *(left[r] // c.count(r) for r in c)):
            for r in c:
                left[r] -= n
            out.append((c, n))
    return out


class Rests:
    """What is left to pack, by length: runs (rest, low, high, from) of equally long pieces,
    the ones from `from` on of the rests of length `rest` with ranks low <= rank < high."""

    def __init__(self):
        self.runs: dict[int, list] = {}
        self.count: dict[int, int] = {}
        self.placed: list[tuple] = []

    def add(self, length: int, rest: int, low: int, high: int, start: int) -> None:
        self.runs.setdefault(length, []).append((rest, low, high, start))
        self.count[length] = self.count.get(length, 0) + high - low

    def take(self, length: int, n: int, window: int, offset: int, used: int) -> None:
        """The first `used` tokens of n pieces of this length go to n windows from `window`
        on, at this offset; what is left of the pieces is added."""
        if n == self.count[length]:
            del self.count[length]
        else:
            self.count[length] -= n
        while n:
            rest, low, high, start = self.runs[length].pop()
            k = min(n, high - low)
            if k < high - low:
                self.runs[length].append((rest, low + k, high, start))
            self.placed.append((rest, low, low + k, start, used, window, offset))
            if used < length:
                self.add(length - used, rest, low, low + k, start + used)
            n, window = n - k, window + k

    def rows(self) -> list[tuple]:
        """(rest, low, high, [(from, length, window, offset)]), each rank of a rest in one
        row; a rank's window is `window` and as many more as it is above low."""
        by_rest: dict[int, list] = {}
        for rest, *piece in self.placed:
            by_rest.setdefault(rest, []).append(piece)
        out = []
        for rest, pieces in by_rest.items():
            borders = sorted({x for p in pieces for x in p[:2]})
            parts: dict[int, list] = {low: [] for low in borders}
            at = {x: i for i, x in enumerate(borders)}
            for low, high, start, length, window, offset in pieces:
                for i in range(at[low], at[high]):
                    parts[borders[i]].append((start, length, window + borders[i] - low, offset))
            out += [(rest, low, high, sorted(parts[low])) for low, high in zip(borders, borders[1:]) if parts[low]]
        return out


def places(histogram: dict[int, int]) -> tuple[list[tuple], int]:
    """Rests.rows() of all rests, and how many windows they take."""
    used, left, window = dict.fromkeys(histogram, 0), Rests(), 0
    for combo, n in repeats(histogram):
        offset = 0
        for r in combo:
            left.placed.append((r, used[r], used[r] + n, 0, r, window, offset))
            used[r] += n
            offset += r
        window += n
    for r, n in histogram.items():
        if n > used[r]:
            left.add(r, r, used[r], n, 0)
    while sum(length * n for length, n in left.count.items()) >= WINDOW:
        lengths, chosen, gap = sorted(left.count, reverse=True), Counter(), WINDOW
        for length in lengths:
            if fits := min(gap // length, left.count[length]):
                chosen[length] = fits
                gap -= fits * length
        cut = next(x for x in reversed(lengths) if left.count[x] > chosen[x]) if gap else None
        n = min(left.count[x] // (k + (x == cut)) for x, k in (chosen | ({cut: chosen[cut]} if cut else {})).items())
        offset = 0
        for length, k in chosen.items():
            for _ in range(k):
                left.take(length, n, window, offset, length)
                offset += length
        if cut:
            left.take(cut, n, window, offset, gap)
        window += n
    size = sum(length * n for length, n in left.count.items())
    for bit in reversed(range(WINDOW.bit_length() - 1)):
        offset = 0
        while size & 1 << bit and offset < 1 << bit:
            length = min(left.count)
            part = min(length, (1 << bit) - offset)
            left.take(length, 1, window, offset, part)
            offset += part
        window += bool(size & 1 << bit)
    return left.rows(), window


def pack(docs: DataFrame, columns: list[str], tokenizer: str) -> DataFrame:
    """One row for each piece: `columns`, start, length, ids (with `width`), doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    read = written(tokens(docs, columns, tokenizer))
    counts = written(read.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / WINDOW)).alias("full")))
    past = lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most WINDOW - 1 rows
    rows, windows = places(histogram)

    # counts by partition grow with the corpus, so they are not broadcast
    by_part = counts.groupBy("part").agg(F.sum("full").alias("n")).select("part", F.coalesce(F.sum("n").over(past()), F.lit(0)).alias("base"))
    full = read.where(F.col("doc_tokens") >= WINDOW).join(written(by_part).hint("merge"), "part")
    full = full.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("doc_tokens") / WINDOW).cast("int") - 1)))
    piece = lambda start, length: F.substring(F.col("ids"), (start * F.col("width") + 1).cast("int"), (length * F.col("width")).cast("int"))
    start = F.col("k").cast("long") * WINDOW
    full = full.select(*columns, start.alias("start"), F.lit(WINDOW).cast("long").alias("length"), piece(start, F.lit(WINDOW)).alias("ids"), "width", "doc_tokens", (F.lit(windows) + F.col("base") + F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    by_rest = counts.where("rest > 0").select("part", "rest", F.coalesce(F.sum("n").over(past("rest")), F.lit(0)).alias("rank"))
    table_ = spark.createDataFrame(rows, "rest int, low long, high long, pieces array<struct<from:long,length:long,window:long,offset:long>>")  # by lengths alone
    begin = F.col("doc_tokens") - F.col("rest")
    rest = read.where("rest > 0").withColumn("ids", piece(begin, F.col("rest"))).join(written(by_rest).hint("merge"), ["part", "rest"])
    rest = rest.withColumn("rank", F.col("rank") + F.col("rest_before")).join(F.broadcast(table_), "rest").where("low <= rank AND rank < high")
    rest = rest.withColumn("p", F.explode("pieces")).select("*", "p.from", "p.length", "p.window", "p.offset")
    rest = rest.select(*columns, (begin + F.col("from")).alias("start"), "length", piece(F.col("from"), F.col("length")).alias("ids"), "width", "doc_tokens", (F.col("window") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
    return full.unionByName(rest)


def ids_of(data: bytes, width: int = 2):
    import numpy as np

    return np.frombuffer(data, f"<u{width}")


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of ids."""
    both = pieces.withColumn("__ids", F.concat(F.chr("width").cast("binary"), F.col("ids"))).drop("ids", "width")
    return with_python(both, "__ids", _crc32, [("ids_crc32", "long")])


def _crc32(data: bytes) -> tuple[int]:
    return (zlib.crc32(ids_of(data[1:], data[0]).astype("<u4").tobytes()),)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _packed(docs: DataFrame) -> DataFrame:
    got = digest(pack(docs, ["doc_id"], default_tokenizer()))
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents; ids_crc32 stands for their ids."""
    return _packed(docs)
