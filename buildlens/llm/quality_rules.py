"""Quality rules with risk-controlled thresholds.

Every text gets exact measures. Each rule rejects texts whose measure lies above a
cutoff. A cutoff is proposed on one part of the labelled rows and certified on the
other: the exact binomial test must show, at the corrected level, that the rule
rejects at most its part of MAX_FALSE_REJECTION of the good texts of that stratum, so
that all rules together reject no more than the whole of it. Cutoffs are
tried from lenient to strict, so the steps within one (stratum, rule) need no further
correction; Bonferroni corrects over all strata and rules. A stratum with too few
labels to certify anything gets no cutoff, hence loses nothing beyond the base rule.

Null or empty text: all measures 0, base_failed. Null stratum: a stratum of its own,
which has cutoffs only if its labels certify them. Repeated rows: each is judged. Very
long texts are measured whole. Labels of one doc_id that contradict each other, or have no
doc_id, are not used. Other columns are kept by the stage, whatever they are called.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, table, with_python, with_row_ids, written

RULES = ("symbols", "capitals", "duplicate_lines", "repeated_words", "marks", "digits")
MEASURES = [(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("bins", "array<int>")]
#: Shares are counted in steps of 1/GRID.
GRID = 200
MIN_WORDS = 50
#: Of a stratum's good texts, at most this share may be rejected by all rules together;
#: each rule is certified for an equal part of it, as a text fails if any rule rejects it.
MAX_FALSE_REJECTION = 0.06
#: Probability that any certified cutoff breaks its promise.
DELTA = 0.05
#: A cutoff must catch this many bad texts for each good text that it costs.
WORTH = 20

_word = re.compile(WORD)
_symbols = b"#*$%&|<>"
_marks = b"!?*#$%&|<>=+~^_{}[]\\@"


def measure(text: str | None) -> tuple:
    """The exact measures of one whole text, and its rules' shares as grid steps."""
    text = text or ""
    words = _word.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, _symbols.decode()))
    lines, seen, again = 0, set(), 0
    for line in text.split("\n"):
        if _word.search(line):
            lines += 1
            again += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    data = text.encode("utf-8", "surrogatepass")
    capitals, letters = _counts(data)
    size = max(1, len(data))
    marks = sum(map(data.count, [bytes([c]) for c in _marks]))
    digits = sum(map(data.count, [b"%d" % i for i in range(10)]))
    shares = (symbols / max(1, chars), capitals / max(1, letters), again / max(1, lines), repeated / max(1, n), marks / size, digits / size)
    return n, chars, symbols, again, repeated, [math.ceil(min(1.0, x) * GRID) for x in shares]


def _counts(data: bytes) -> tuple[int, int]:
    """ASCII capitals, and all bytes of letters (ASCII, or of a longer character)."""
    import numpy as np

    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    capitals = int(n[65:91].sum())
    return capitals, capitals + int(n[97:123].sum()) + int(n[128:].sum())


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    once, twice = set(), set()
    for w in windows:
        (twice if w in once else once).add(w)
    if not twice:
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of docs, and the measures of its text."""
    return with_python(docs.select(*columns, "text"), "text", measure, MEASURES)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n draws with probability p, exactly summed."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def choose(counts: dict, level: float, risk: float) -> int | None:
    """counts: {(part, good): {bin: n}}. The certified cutoff: bins above it fail."""
    above = lambda part, good, cut: sum(n for b, n in counts.get((part, good), {}).items() if b > cut)
    gain = {cut: above("tune", 0, cut) - WORTH * above("tune", 1, cut) for cut in range(GRID)}
    best = max(gain, key=lambda c: (gain[c], c))
    if gain[best] <= 0:
        return None
    n, found = sum(counts.get(("hold", 1), {}).values()), None
    for cut in range(GRID - 1, best - 1, -1):
        if binomial_tail(above("hold", 1, cut), n, risk) > level:
            break
        found = cut
    return found


def cutoffs(measures: DataFrame, labels: DataFrame, stratum: str, risk: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from all labelled rows. measures: doc_id, stratum, bins.

    Only counts by stratum, rule and grid step reach the tasks that choose; they are
    at most 4 * rules * (GRID + 1) rows a stratum, whatever the corpus holds."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__low"), F.min("quality").alias("__good"))
    marked = marked.where("__low = __good").select("doc_id", F.col("__good").cast("int").alias("good"))
    part = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, "tune").otherwise("hold").alias("part")
    rows = measures.select("doc_id", F.col(stratum).alias("stratum"), "bins").join(marked, "doc_id").select("stratum", part, "good", F.posexplode("bins").alias("rule", "bin"))
    counts = written(rows.groupBy("stratum", "part", "good", "rule", "bin").count())
    tests = max(1, counts.select("stratum", "rule").distinct().count())

    def certify(key, pdf):
        import pandas as pd

        got: dict = {}
        for r in pdf.itertuples():
            got.setdefault((r.part, r.good), {})[r.bin] = r.count_
        cut = choose(got, delta / tests, risk / len(RULES))
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": [cut]}, dtype=object)

    return counts.withColumnRenamed("count", "count_").groupBy("stratum", "rule").applyInPandas(certify, "stratum string, rule int, cutoff int").where("cutoff IS NOT NULL")


def judge(measures: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """measures with base_failed and kept."""
    per = written(cuts.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cuts")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.exists(F.map_entries("__cuts"), lambda e: F.get("bins", e["key"]) > e["value"])
    joined = measures.join(per, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(failed, F.lit(False))).drop("__cuts", "__stratum")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", row_id: str | None = None) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept (and row_id, if named)."""
    columns = ["doc_id", stratum] + ([row_id] if row_id else [])
    measures = written(measured(docs, columns))
    return judge(measures, cutoffs(measures, labels, stratum), stratum)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass the rules, with their columns."""
    (row,) = fresh(docs, "__row")
    rows = with_row_ids(docs, row)
    good = quality(rows, table(spark, sf_dir, "labels"), row_id=row).where("kept").select(row)
    return rows.join(good, row, "left_semi").select(*docs.columns)
