"""Secret scans by a trigram inverted index, in DataFrame functions alone.

Each rule is a regex. From its syntax tree comes a Boolean query over trigrams that
every match must contain. Postings (trigram, document) of the trigrams that the rules
ask for are read from the texts once; a rule's candidates are the documents whose
postings satisfy its query; only candidates are verified with the regex itself. A rule
without a mandatory trigram scans every document.

Matches are leftmost and do not overlap within a rule; `[start, end)` are code points.
Null or empty text: no spans. Null or repeated doc_id: such rows share their candidate
flags, and each row's own text decides. Equal rows give equal results.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int
    least: int  # characters of that group; shorter matches are dropped


#: The contract's rules come first; their matches are the base spans.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are taken whole, so shorter ones can be left out at once
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35),
)
N_BASE = 3
MASK = "[SECRET]"
#: A run of syntax that stands for more strings than this is not spelled out.
MOST_STRINGS = 64


def strings(node) -> set[str] | None:
    """All strings (in lower case) that a syntax node stands for, or None if they are many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 8:
        return {chr(x[1]).lower() for x in arg}
    if op is sre.SUBPATTERN:
        return joined(arg[3])
    if op is sre.BRANCH:
        parts = [joined(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] <= 1 and (inner := joined(arg[2])) is not None:
        return inner | {""} if arg[0] == 0 else inner
    return None


def joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What each match contains: for every clause, all trigrams of at least one set.
    No clause: the pattern has no mandatory trigram."""
    clauses, run = [], {""}

    def close():
        if run and all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))

    for node in re._parser.parse(pattern):
        more = strings(node)
        if more is None or len(run) * len(more) > MOST_STRINGS:
            close()
            run = more if more is not None and len(more) <= MOST_STRINGS else {""}
        else:
            run = {a + b for a, b in product(run, more)}
    close()
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for each of these trigrams and each text that contains it, in any case."""
    low = docs.select("doc_id", F.lower("text").alias("__low"))
    return low.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("__low"), t))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): positions of the rules whose trigram query the document satisfies."""
    asked = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in asked.values() for clause in q for s in clause for t in s})
    if not trigrams:
        return docs.select("doc_id", F.array().cast("array<int>").alias("rules")).where("false")
    found = postings(docs, trigrams).groupBy("doc_id").agg(F.collect_set("trigram").alias("has"))  # at most len(trigrams) a document

    def holds(query) -> Column:
        every = F.lit(True)
        for clause in query:
            any_of = F.lit(False)
            for s in clause:
                any_of |= F.size(F.array_except(F.array(*map(F.lit, sorted(s))), "has")) == 0
            every &= any_of
        return every

    flags = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in asked.items()]))
    return found.select("doc_id", flags.alias("rules")).where(F.size("rules") > 0)


def matches(text: Column, rank: int, rule: Rule) -> Column:
    """The rule's spans in a text. What splits the text at the matches gives their places."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    spans = "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).cast(spans).alias("spans"))

    pieces = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(pieces, hits, lambda b, h: F.struct(b.alias("before"), h.alias("hit")))
    found = F.filter(F.aggregate(pairs, start, step)["spans"], lambda s: F.length(F.regexp_extract(s["hit"], rule.pattern, rule.group)) >= rule.least)
    return F.when(text.rlike(rule.pattern), found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, spans: str = "__spans") -> DataFrame:
    """docs with a column `spans`, sorted by start and then by the rules' order."""
    own, asked = fresh(docs, "__id", "__rules")
    ids = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    flagged = written(candidates(ids, rules).select(F.col("doc_id").alias(own), F.col("rules").alias(asked)))
    rows = docs.join(flagged, F.col("doc_id").eqNullSafe(F.col(own)), "left")
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")
    found = []
    for k, rule in enumerate(rules):
        hits = matches(text, k, rule)
        if trigram_query(rule.pattern):
            hits = F.when(F.array_contains(asked, k), hits)
        found.append(F.coalesce(hits, none))
    bare = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.withColumn(spans, bare).drop(own, asked)


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__spans")
    count = lambda k: F.size(F.filter("__spans", lambda s: s["rank"] == k)).cast("long")
    base = said(F.filter("__spans", lambda s: s["rank"] < N_BASE))
    return rows.select("doc_id", *[count(k).alias(f"n_{RULES[k].kind}") for k in range(N_BASE)], F.sha2(base, 256).alias("base_sha256"), said(F.col("__spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(before, F.lit(MASK)))).otherwise(acc["parts"]).cast("array<string>").alias("parts"),
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, their secrets masked."""
    (spans,) = fresh(docs, "__spans")
    rows = scan(docs, spans=spans)
    rows = rows.withColumn("text", F.when(F.size(spans) > 0, masked(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


_LIST = "list_filter(list_transform(range(1, len(m) + 1), lambda i: {'k': K, 's': len(array_to_string(p[1:i], '')) + len(array_to_string(m[1:i-1], '')), 'h': m[i], 'n': 'KIND'}), lambda x: len(COND) >= LEAST)"


def oracle() -> str:
    """The same spans in DuckDB: the text split at the matches gives their places."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''").replace("(?i:(password|passwd|secret|token|api_?key))", "((?i)password|passwd|secret|token|api_?key)")
        if k == 0:
            pattern = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
            value = r"""regexp_extract(x.h, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)"""
        else:
            value = "x.h"
        inner = _LIST.replace("KIND", rule.kind).replace("COND", value).replace("LEAST", str(rule.least)).replace("'k': K", f"'k': {k}")
        parts.append(f"SELECT doc_id, unnest({inner}, recursive := true) FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}'))")
    spans = " UNION ALL ".join(parts)
    said = "concat(n, ':', s, ':', s + len(h))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({spans}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
coalesce(string_agg({said}, ',' ORDER BY s, k) FILTER (k < {N_BASE}), '') AS base, string_agg({said}, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
