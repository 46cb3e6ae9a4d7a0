"""The operators' definitions in plain Python, for comparison."""

from __future__ import annotations

import hashlib
import math
import re


def hash52(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def grams(text: str, n: int = 4) -> list[str]:
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 0))]


def distinct(text: str, n: int = 4) -> float:
    g = grams(text, n)
    return len(set(g)) / len(g) if g else 1.0


def rank(values: list[float]) -> list[int]:
    """Ordinal ranks, equal values in list order."""
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    ranks = [0] * len(values)
    for place, i in enumerate(order):
        ranks[i] = place
    return ranks


def spearman(x: list[float], y: list[float]) -> float:
    n = len(x)
    if n == 1:
        return 0.0
    gaps = sum((a - b) ** 2 for a, b in zip(rank(x), rank(y)))
    return 1 - 6 * gaps / (n * (n * n - 1))


def kl(p: list[float], q: list[float]) -> float:
    norm = lambda v: math.log(sum(math.exp(x - max(v)) for x in v)) + max(v)
    a, b = norm(p), norm(q)
    return sum(math.exp(x - a) * ((x - a) - (y - b)) for x, y in zip(p, q))
