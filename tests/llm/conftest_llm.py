"""Helpers that the tests of the corpus operators import."""

from __future__ import annotations

import random


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


def changed(text: str, every: int) -> str:
    """text with each `every`-th word replaced."""
    return " ".join(f"other{i}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))
