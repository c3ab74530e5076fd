from __future__ import annotations

import hashlib
import random
import re

from conftest_llm import words

from buildlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits) if digits else False, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_finders_against_the_patterns():
    rng = random.Random(2)
    alphabet = "a1.@+-_ ()25%é4"
    for n in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute(text), text


def held(spark, folder, documents):
    want = {i: brute(t) for i, t, *_ in documents}
    rows = pii.op4_pii(spark, folder).collect()
    assert len(rows) == len(documents)
    for r in rows:
        if r["doc_id"] is None:
            continue
        spans = want[r["doc_id"]]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        found = r["spans"].split(",") if r["spans"] else []
        assert set(base.split(",")) - {""} <= set(found)
        parts = [(list(PATTERNS).index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in found)]
        assert parts == sorted(parts)
    return {r["doc_id"]: r["spans"] for r in rows}


def test_hostile_rows(spark, tables, hostile):
    held(spark, tables(hostile), hostile)


def test_whole_table(spark, small):
    held(spark, small, [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()])


def test_patterns_discover_what_the_base_misses(spark, tables):
    """A number of another form in the same contexts as known phone numbers."""
    docs = [(i, f"{words(30, i)} please call me at +1 555 123 {4000 + i} after nine today {words(20, 50 + i)}", "en", "a") for i in range(12)]
    docs.append((90, f"{words(30, 90)} please call me at 0555/123-9999 after nine today {words(20, 91)}", "en", "a"))
    docs.append((91, f"{words(30, 92)} the order 0555/777-1111 was shipped {words(20, 93)}", "en", "a"))
    spans = held(spark, tables(docs), docs)
    at = docs[12][1].index("0555/123-9999")
    assert spans[90] == f"phone:{at}:{at + 13}" and spans[91] == ""


def test_empty_table(spark, tables):
    assert pii.op4_pii(spark, tables()).collect() == []


def scored_by_brute_force(texts: list[str]) -> list[str]:
    """The whole method in plain Python: patterns, three rounds of scores, spans."""
    found = [pii.mentions(t, pii.base_spans(t)) for t in texts]
    seed, by_pattern = {}, {}
    for m in (m for each in found for m in each):
        for p in m["patterns"]:
            by_pattern.setdefault(p, set()).add(m["instance"])
            if m["kind"] >= 0:
                seed[m["instance"]] = max(seed.get(m["instance"], -1), m["kind"])
    scores = {(i, k): 1.0 for i, k in seed.items()}
    for _ in range(pii.ROUNDS):
        wrong: dict = {}
        for instances in by_pattern.values():
            for k in range(4):
                votes = sum(scores.get((i, k), 0.0) for i in instances)
                sure = votes / (len(instances) + 1)
                if votes >= pii.SUPPORT and sure >= pii.LEAST_CONFIDENCE:
                    for i in instances - set(seed):
                        wrong[i, k] = wrong.get((i, k), 1.0) * (1 - sure)
        scores = {(i, k): 1.0 for i, k in seed.items()} | {x: 1 - w for x, w in wrong.items()}
    best: dict = {}
    for (i, k), s in scores.items():
        if i not in seed and s >= pii.LEAST_SCORE:
            best[i] = max(best.get(i, (0.0, 0)), (s, -k))
    out = []
    for t, each in zip(texts, found):
        added, end = [], 0
        for a, last, k in sorted((m["start"], -m["end"], -best[m["instance"]][1]) for m in each if m["kind"] < 0 and m["instance"] in best and -best[m["instance"]][1] in m["kinds"]):
            if a >= end:
                added.append((k, a, -last))
                end = -last
        out.append(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(pii.base_spans(t) + added)))
    return out


def test_scores_against_brute_force(spark, tables):
    """Identifiers that stand side by side, where the base rules lose one of them; decoys."""
    rng, texts = random.Random(3), []
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choices("0123456789", k=15)), "") if pii.luhn(c))
    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    for i in range(60):
        parts = [words(5, 3 * i), rng.choice([card, ip, phone])(), words(4, 3 * i + 1)]
        if i % 10 == 0:
            parts[1] = f"{ip()} {card()}" if i % 20 else f"{phone()} {ip()}"
        if i % 10 == 5:
            parts[1] = "".join(rng.choices("0123456789", k=16))  # hardly ever a card
        texts.append(" ".join(parts))
    want = scored_by_brute_force(texts)
    got = {r["doc_id"]: r["spans"] for r in pii.op4_pii(spark, tables([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want
    beside = [i for i in range(0, 60, 10)]
    assert all(len(want[i].split(",")) == 2 for i in beside) and sum(len(brute(texts[i])) for i in beside) < 12


def test_clean_texts_stay_clean(spark, tables):
    docs = [(i, f"{words(40, i)} chapter {1000 + i} of {words(20, 100 + i)} room 40{i % 10}-12 {words(9, 7)}", "en", "a") for i in range(30)]
    assert {r["spans"] for r in pii.op4_pii(spark, tables(docs)).collect()} == {""}
