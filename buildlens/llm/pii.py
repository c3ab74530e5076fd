"""Personal data by bootstrapped contextual extraction.

1. Exact base matches of four kinds in every whole text are the seed entities.
2. Mentions: the seeds, and what looks like an identifier outside of them: a word with an
   @ or at least DIGITS digits, and runs of up to MOST_PIECES neighbouring words of digits
   and signs ("+1 (555) 123-4567"). A mention's lexical patterns are the words around it
   (two to the left, one on each side, two to the right; digits as #) and its own form:
   its first character, and digits as # and letters as a.
3. Spark scores the graph of patterns and instances in ROUNDS rounds: a pattern's
   confidence in a kind is the sum of its instances' scores over their number plus one;
   an instance's score is that at least one of its patterns is right. Patterns with
   less than SUPPORT of scores, or less confidence than LEAST_CONFIDENCE, say nothing.
4. Mentions of instances that score at least LEAST_SCORE and may be of that kind (enough
   digits, checksums right, numbers in range) become spans too, of overlapping ones the
   leftmost and of these the longest. So an identifier that the base rules lose, as
   another number stands beside it or it is written differently, is still found.

Edges are aggregated before each shuffle and joined on plain equality, so a pattern or
instance that very many texts share can be split. Spans `[start, end)` are code points.

Null or empty text: no spans. Null or repeated doc_id: each row is worked on alone.
Ties between kinds go to the kind listed first. Very long texts are searched whole, and
patterns hold whole words (long ones by their hash). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, with_python, written

KINDS = ("email", "ip", "card", "phone")
DIGITS, SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE, ROUNDS = 4, 2.5, 0.5, 0.8, 3
MOST_PIECES, RUN_DIGITS = 4, 8

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_digits = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_word = re.compile(WORD)
_signs = re.compile(r"[0-9@]")
_piece = re.compile(r"[+(]?[0-9][0-9().+/-]*")
_edge = "\"'.,;:!?()[]{}<>"


def emails(text: str):
    """For each @, the run of address characters before it and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def addresses(text: str):
    """Four parts each of a run of dotted numbers."""
    for m in _dotted.finditer(text):
        parts = list(re.finditer("[0-9]+", m[0]))
        for i in range(0, len(parts) - 3, 4):
            if all(len(p := x[0].lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[i : i + 4]):
                yield m.start() + parts[i].start(), m.start() + parts[i + 3].end()


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str):
    for m in _digits.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _phone.finditer(text):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, by kind and start."""
    out = []
    for k, find in enumerate((emails, addresses, cards, phones)):
        out += [(k, a, b) for a, b in find(text)]
    return out


def _plain(word: str) -> str:
    """A word as it stands in patterns; long ones by their hash, so that none is cut."""
    plain = re.sub("[0-9]", "#", word.strip(_edge).lower())
    return plain if len(plain) <= 40 else hashlib.md5(plain.encode("utf-8", "surrogatepass")).hexdigest()


def _form(instance: str) -> str:
    return instance[:1] + re.sub("[A-Za-z]", "a", re.sub("[0-9]", "#", instance[1:]))


def may_be(kind: int, text: str) -> bool:
    """Whether a text can be an identifier of a kind, in whatever form it is written."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == 0:
        return text.count("@") == 1 and 0 < text.index("@") < len(text) - 1
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """A word without the signs around it; an opening + or ( of a number stays."""
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a < b and not text[a].isalnum() and not (text[a] in "+(" and a + 1 < b and text[a + 1] in "0123456789"):
        a += 1
    return a, b


def _runs(text: str, words) -> list[tuple[int, int]]:
    """Runs of 2 to MOST_PIECES neighbouring words of digits and signs, with one blank between."""
    pieces = [bool(_piece.fullmatch(text[a:b])) for a, b in words]
    out = []
    for i in range(len(words)):
        if not pieces[i]:
            continue
        for j in range(i + 1, min(i + MOST_PIECES, len(words))):
            if not pieces[j] or words[j][0] - words[j - 1][1] != 1:
                break
            a, b = _core(text, words[i][0], words[j][1])
            if sum(map(text[a:b].count, "0123456789")) >= RUN_DIGITS:
                out.append((a, b))
    return out


def mentions(text: str, spans) -> list[dict]:
    """Seeds and what looks like an identifier, each with its instance, its lexical patterns
    and the kinds that it may be of."""
    words = [m.span() for m in _word.finditer(text)]
    starts = [a for a, _ in words]
    found = [(a, b, k) for k, a, b in spans]
    likely = []
    for a, b in words:
        if _signs.search(text, a, b):
            a, b = _core(text, a, b)
            core = text[a:b]
            if len(core) >= 5 and ("@" in core or sum(map(core.count, "0123456789")) >= DIGITS):
                likely.append((a, b))
    taken = sorted((a, b) for _, a, b in spans)
    begins, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    for a, b in dict.fromkeys([*likely, *_runs(text, words)]):
        before = bisect_left(begins, b)
        if not before or reach[before - 1] <= a:  # outside of all seeds
            found.append((a, b, -1))
    out = []
    for a, b, k in found:
        left = bisect_left(starts, a + 1) - 1  # the word that holds the mention's start
        right = bisect_left(starts, b)
        before = [_plain(text[x:y]) for x, y in words[max(0, left - 2) : left]]
        after = [_plain(text[x:y]) for x, y in words[right : right + 2]]
        patterns = ["F " + _form(text[a:b])] if b - a <= 80 else []
        if len(before) == 2:
            patterns.append("L " + " ".join(before))
        if before and after:
            patterns.append(f"B {before[-1]} _ {after[0]}")
        if len(after) == 2:
            patterns.append("R " + " ".join(after))
        kinds = [i for i in range(len(KINDS)) if k < 0 and may_be(i, text[a:b])]
        if k >= 0 or kinds:
            out.append({"start": a, "end": b, "kind": k, "instance": text[a:b], "patterns": patterns, "kinds": kinds})
    return out


def _extract(text: str | None) -> tuple:
    text = text or ""
    if not _signs.search(text):
        return [], []
    spans = base_spans(text)
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans], mentions(text, spans)


FIELDS = [
    ("base", "array<struct<kind:int,start:int,end:int>>"),
    ("mentions", "array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>,kinds:array<int>>>"),
]


def discovered(rows: DataFrame) -> DataFrame:
    """(instance, kind) of what the patterns discover beyond the seeds."""
    each = rows.select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    edges = written(each.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    instances = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("seed >= 0").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0))
    scores = seeds
    open_edges = edges.join(seeds.select("instance"), "instance", "left_anti").select("pattern", "instance")
    for _ in range(ROUNDS):
        votes = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("votes"))
        sure = votes.join(instances, "pattern").withColumn("sure", F.col("votes") / (F.col("n") + 1)).where((F.col("votes") >= SUPPORT) & (F.col("sure") >= LEAST_CONFIDENCE))
        found = open_edges.join(sure.select("pattern", "kind", "sure"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("sure"))))).alias("score"))
        found = written(found)
        scores = seeds.unionByName(found)
    best = found.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
    return best.where(F.col("best.score") >= LEAST_SCORE).select("instance", (-F.col("best.kind")).alias("kind"))


def extract(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of docs, base and spans: arrays of (kind, start, end), by kind and start."""
    rows = written(with_python(docs.select(*columns, "text"), "text", _extract, FIELDS), with_row_id="__row")
    open_mentions = rows.select("__row", F.explode(F.filter("mentions", lambda m: m["kind"] < 0)).alias("m")).select("__row", "m.start", "m.end", "m.instance", "m.kinds")
    known = open_mentions.join(discovered(rows), "instance").where("array_contains(kinds, kind)")
    added = known.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("last"), "kind"))).alias("added"))
    out = rows.join(added, "__row", "left")
    none = F.array().cast(FIELDS[0][1])

    def leftmost(acc, x):
        """A span that begins at or after the end of those kept so far is kept."""
        span = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["last"]).alias("end"))
        return F.when(x["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.concat(acc, F.array(span))).otherwise(acc).cast(FIELDS[0][1])

    kept = F.when(F.col("added").isNotNull(), F.aggregate("added", none, leftmost)).otherwise(none)
    return out.select(*columns, "base", F.array_sort(F.concat("base", kept)).alias("spans"))


def said(spans):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *map(count, range(len(KINDS))), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
