"""Traits, votes and posteriors of the quality rules, and terms and projection of the classifier, against plain re-implementations."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from revcast.llm import common as C
from revcast.llm import quality_knn, weak_quality
from tests.llm import fixtures as X

SYMBOLS = "#*$%&|<>"
#: trait -> (votes good, votes bad)
PLAIN_RULES = {
    "symbols_a_word": (lambda x: x <= 0.02, lambda x: x >= 0.25),
    "repeated_share": (lambda x: False, lambda x: x >= 0.35),
    "dup_line_share": (lambda x: False, lambda x: x >= 0.3),
    "chars_a_word": (lambda x: False, lambda x: x >= 14.0 or x <= 2.2),
    "capital_share": (lambda x: x <= 0.2, lambda x: x >= 0.4),
    "distinct_share": (lambda x: x >= 0.35, lambda x: x <= 0.15),
    "stutter_share": (lambda x: False, lambda x: x >= 0.2),
    "odd_end_share": (lambda x: x <= 0.05, lambda x: x >= 0.3),
}


def texts() -> list[str]:
    rnd = np.random.default_rng(5)
    out = [t or "" for _, t in X.texts()]
    for i in range(300):
        w = X.prose(i, int(rnd.integers(1, 120)))
        for _ in range(int(rnd.integers(0, 40)) if i % 3 else 0):
            k = int(rnd.integers(len(w)))
            w[k] = [w[k].upper(), w[k] + "!", w[k - 1], "#$%", "x" * 30, "a"][rnd.integers(6)]
        text = "".join(x + str(rnd.choice([" ", " ", "\n", "  ", "\n\n"])) for x in w)
        out.append(text * int(rnd.integers(1, 4)) if i % 5 == 0 else text)
    return [*out, "", " \n ", "!", "A", "é!\né!", "a\tb\rc\x0bd"]


def as_words(rows: list[str], kind=C.NOT_SPACE) -> C.Words:
    data = [t.encode() for t in rows]
    return C.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), kind)


def plain_traits(t: str) -> dict[str, float]:
    w = X.WORD.findall(t)
    total = max(len(w), 1)
    lines = [line for line in t.split("\n") if X.WORD.search(line)]
    letters = re.findall("[A-Za-z]", t)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + d for k in range(len(w) - 2) for d in range(3) if windows[tuple(w[k : k + 3])] > 1}
    return {
        "symbols_a_word": sum(c in SYMBOLS for c in t) / total, "repeated_share": len(again) / total,
        "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "chars_a_word": sum(map(len, w)) / total,
        "capital_share": sum(c.isupper() for c in letters) / max(len(letters), 1), "distinct_share": len(set(w)) / total,
        "stutter_share": sum(a == b for a, b in zip(w, w[1:])) / total, "odd_end_share": sum(x[-1] in "!" + SYMBOLS for x in w) / total,
    }


def plain_votes(shares: dict[str, float]) -> tuple[int, ...]:
    return tuple(-1 if bad(shares[k]) else 1 if good(shares[k]) else 0 for k, (good, bad) in PLAIN_RULES.items())


def test_traits_and_votes():
    rows = texts()
    _, got = weak_quality.traits(as_words(rows))
    votes = np.array(weak_quality.votes(got)).T
    assert {trait for _, trait, *_ in weak_quality.RULES} == set(PLAIN_RULES)
    for i, t in enumerate(rows):
        want = plain_traits(t)
        assert {k: got[k][i] for k in want} == pytest.approx(want), t
        assert tuple(votes[i]) == plain_votes(want), t
    assert all({-1} <= set(v) for v in votes.T)


def plain_posteriors(votes: list[tuple[int, ...]]) -> list[float]:
    """Expectation-maximisation over texts, one by one."""
    first = {0: {-1: 0.5, 0: 0.3, 1: 0.2}, 1: {-1: 0.1, 0: 0.3, 1: 0.6}}
    chance = [{c: dict(first[c]) for c in (0, 1)} for _ in range(len(votes[0]))]
    share, before, good = 0.7, -math.inf, []
    for _ in range(weak_quality.ROUNDS):
        good, likely = [], 0.0
        for v in votes:
            joint = [(1 - share, share)[c] * math.prod(chance[r][c][x] for r, x in enumerate(v)) for c in (0, 1)]
            good.append(joint[1] / sum(joint))
            likely += math.log(sum(joint))
        if likely / len(votes) - before < weak_quality.ENOUGH:
            break
        before = likely / len(votes)
        share = min(max(sum(good) / len(votes), 0.01), 0.99)
        for r in range(len(votes[0])):
            for c in (0, 1):
                seen = {x: 0.5 * first[c][x] for x in (-1, 0, 1)}
                for v, g in zip(votes, good):
                    seen[v[r]] += g if c else 1 - g
                chance[r][c] = {x: n / sum(seen.values()) for x, n in seen.items()}
    return good


def test_posterior_and_verdict(spark):
    rows = texts()
    got = {r.doc_id: r for r in weak_quality.judge(X.documents(spark, list(enumerate(rows)))).collect()}
    want = plain_posteriors([plain_votes(plain_traits(t)) for t in rows])
    assert len(got) == len(rows)
    for i, quality in enumerate(want):
        assert got[i].quality == pytest.approx(quality, abs=1e-6)
        assert abs(quality - weak_quality.KEEP_FROM) > 1e-6
        assert got[i].kept == (not got[i].base_failed and quality >= weak_quality.KEEP_FROM)
    assert 0 < sum(r.kept for r in got.values()) < sum(not r.base_failed for r in got.values())


def plain_class(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 42 + b % 6
    if c.islower():
        return ord(c) - 96
    for names, cls in ((" \t", 29), ("\n\r", 30), (".,", 39), ("!?", 40)):
        if c in names:
            return cls
    return 27 if c.isupper() else 28 if c.isdigit() else 31 + SYMBOLS.index(c) if c in SYMBOLS else 41


def plain_terms(t: str) -> np.ndarray:
    out = np.zeros(quality_knn.TERMS)
    cls = [plain_class(b) for b in t.encode()]
    if not cls:
        return out
    pairs = Counter(zip(cls, cls[1:]))
    most = max(len(cls) - 1, 1)
    for (a, b), n in pairs.items():
        out[a * 48 + b] = n / most
    w, lines = X.WORD.findall(t), [line for line in t.split("\n") if line]
    total = max(len(w), 1)
    share = lambda wanted: sum(map(wanted, cls)) / len(cls)
    shapes = [share(lambda c: c == 27), share(lambda c: 31 <= c < 39), share(lambda c: c == 28), share(lambda c: c == 40), (len(w) - len(set(w))) / total,
              sum(a == b for a, b in zip(w, w[1:])) / total, (len(lines) - len(set(lines))) / max(len(lines), 1), 4 * max(pairs.values(), default=0) / most,
              sum(len(x.encode()) for x in w) / total / 16, math.log2(1 + len(w)) / 16]
    for i, x in enumerate(shapes):
        x = min(math.sqrt(x), 1) * 7
        low = min(int(x), 6)
        out[48 * 48 + 8 * i + low] += 0.15 * (low + 1 - x)
        out[48 * 48 + 8 * i + low + 1] += 0.15 * (x - low)
    return np.sqrt(out)


def test_terms():
    rows = texts()
    got = quality_knn.term_weights(as_words(rows))
    for x, t in zip(got, rows):
        assert np.allclose(x, plain_terms(t), atol=2e-4), t


def test_projection():
    """Leading singular directions as good as the exact ones; vectors of length 1, the same for a text alone."""
    weights = quality_knn.term_weights(as_words([t for t in texts() if t.strip()]))
    labels = (np.arange(len(weights)) % 2).astype(np.float32)
    model = quality_knn.fit(weights, labels)
    idf = np.log((1 + len(weights)) / (1 + (weights > 0).sum(0))) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5)
    x = weights.astype(float) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.linalg.svd(x, compute_uv=False)[: quality_knn.RANK]
    assert np.allclose(model.basis.T @ model.basis, np.eye(quality_knn.RANK), atol=1e-4)
    assert ((x @ model.basis) ** 2).sum() > 0.999 * (exact**2).sum()
    want = x @ model.basis
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(model.vectors, want, atol=1e-3)
    assert np.allclose(model.project(weights[5:6]), model.vectors[5:6], atol=1e-5)
