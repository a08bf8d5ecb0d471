"""Whitening, minimum bin slack packing and hard negatives, against plain re-implementations."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revcast.llm import bpe, hard_negatives, slack_packing, whitening
from revcast.llm import common as C
from tests.llm import fixtures as X

VECTORS = "vec_id long, embedding array<float>, label int, component string, n string, x int, tile string, v double"


def table(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(*r, "own", "own", 1, "own", 0.5) for r in rows], schema).repartition(3)


def awkward(seed, n=150, d=6):
    rnd = np.random.default_rng(seed)
    rows = [(i, (rnd.standard_normal(d) * np.arange(1, d + 1)).astype(np.float32).tolist(), int(rnd.integers(0, 4))) for i in range(n)]
    rows += [(3, rows[3][1], rows[3][2]), (500, rows[3][1], rows[3][2]), (501, rows[3][1], 3), (500, rows[3][1], rows[3][2])]  # repeated rows and ties
    rows += [(None, rows[5][1], 1), (600, None, 1), (601, [], 2), (602, [1.0] * (d - 1), 2), (603, [float("nan")] + [1.0] * (d - 1), 1)]
    rows += [(604, [None] + [1.0] * (d - 1), 1), (605, [float("-inf")] * d, 1), (606, rows[6][1], None), (607, [3e38] * d, 1)]
    return rows


# ------------------------------------------------------------------ whitening
def symmetric(kind, n, rnd):
    q = np.linalg.qr(rnd.standard_normal((n, n)))[0]
    if kind == "equal":
        return np.eye(n) * 3
    if kind == "ones":
        return np.ones((n, n))
    values = {"random": rnd.random(n), "repeated": np.repeat([5.0, 1e-3, 0.0, 2.0], n)[:n], "graded": 10.0 ** -np.linspace(0, 14, n), "pair": np.r_[np.ones(n - 1), 1 + 1e-13]}[kind]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("kind", ["equal", "ones", "random", "repeated", "graded", "pair"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen_by_polar_splits(kind, n):
    v = symmetric(kind, n, np.random.default_rng(n))
    v = (v + v.T) / 2
    values, vectors = whitening.eigen(v)
    size = np.linalg.norm(v)
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-13 * size
    assert np.linalg.norm(vectors.T @ vectors - np.eye(n)) < 1e-12
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13 * size and (np.diff(values) <= 0).all()


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((30, 30))
    u, _, w = np.linalg.svd(a)
    assert np.abs(whitening.polar_factor(a) - u @ w).max() < 1e-12


def test_square_sums():
    d = np.random.default_rng(1).integers(-(2**62), 2**62, (40, 9))
    want = [sum(e * e for e in row) for row in d.tolist()]
    assert whitening.square_sums(d) == want == whitening.square_sums(d.astype(object))


def whitened(df, components=32):
    rows, length = whitening.vectors_of(df)
    model = whitening.fit(rows, length, components)
    return model, [] if model is None else whitening.transform(rows, model).collect(), rows


def plain_rows(rows, d):
    """(id, x) of the rows that take part."""
    fine = [(i, v) for i, v, _ in rows if v and len(v) == d and all(c is not None and math.isfinite(c) and abs(c) < 2**56 for c in v)]
    return [i for i, _ in fine], np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in fine], dtype=object)


def test_whitening(spark):
    rows = awkward(4)
    model, got, part = whitened(table(spark, rows), components=5)
    ids, x = plain_rows(rows, 6)
    n, sums = len(x), x.sum(0)
    d = x * n - sums
    z = (d / n).astype(float)
    v = z.T @ z / n
    e, w = np.linalg.eigh(v)
    want = z @ w[:, ::-1][:, :5] / np.sqrt(e[::-1][:5])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    ours = sorted(((r.vec_id, r.deviation, tuple(r.whitened), r.n) for r in got), key=key)
    theirs = sorted(((i, int((row * row).sum()), tuple(y)) for i, row, y in zip(ids, d, want)), key=key)
    assert [r[:2] for r in ours] == [r[:2] for r in theirs] and {r[3] for r in ours} == {n}
    a, b = np.array([r[2] for r in ours]), np.array([r[2] for r in theirs])
    assert np.abs(a * np.sign((a * b).sum(0)) - b).max() < 1e-10
    assert np.allclose(model.values / model.trace, e[::-1][:5] / np.trace(v), rtol=1e-12)
    assert whitening.identity_error(part, model) < 1e-10


def test_whitening_centres_before_it_multiplies(spark):
    """A spread of one part in a million of the offset, and integers whose products exceed a long."""
    rnd = np.random.default_rng(8)
    for wide in (False, True):
        rows = [(i, (rnd.integers(-(2**55), 2**55, 4) if wide else 1000 + rnd.integers(-8, 8, 4) / 64).astype(float).tolist(), 0) for i in range(60)]
        schema = VECTORS.replace("array<float>", "array<double>")
        part, length = whitening.vectors_of(table(spark, rows, schema))
        model = whitening.fit(part, length)
        assert model.centre.wide == wide and len(model.values) == 4
        assert whitening.identity_error(part, model) < 1e-9
        _, x = plain_rows(rows, 4)
        d = x * 60 - x.sum(0)
        want = {i: sum(e * e for e in row.tolist()) for i, row in zip(range(60), d)}
        got = {r.vec_id: r.deviation for r in whitening.transform(part, model).collect()}
        assert got == {i: s if s < 1 << 63 else None for i, s in want.items()}


def test_whitening_with_few_components(spark):
    assert whitened(table(spark, []))[0] is None
    assert len(whitened(table(spark, [(1, [1.0, 2.0], 0)]))[0].values) == 0
    assert len(whitened(table(spark, [(1, [1.0, 2.0], 0)] * 9))[0].values) == 0
    model, got, part = whitened(table(spark, [(i, [float(i % 5), 7.0, float(i % 5), 0.0], 0) for i in range(50)]))
    assert len(model.values) == 1 and all(len(r.whitened) == 1 for r in got) and whitening.identity_error(part, model) < 1e-12


def test_op11(spark):
    got = whitening.op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    n = len(set(got.vec_id))
    assert len(got) == 32 * n and set(got.component) == set(range(1, 33)) and (got.n == n).all() and (got.identity_error < 1e-10).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(wide.T @ wide / n - np.eye(32)).max() < 1e-10
    share = got.groupby("component").explained.agg(["min", "max"])
    assert (share["min"] == share["max"]).all() and (np.diff(share["min"]) <= 0).all()


# ------------------------------------------------------------------ minimum bin slack
def best_sum(lengths, capacity):
    """The sum closest to the capacity that holds the longest length that fits."""
    fits = sorted(x for x in lengths if x <= capacity)
    if not fits:
        return 0
    sums = {fits.pop()}
    for x in fits:
        sums |= {s + x for s in sums if s + x <= capacity}
    return max(sums)


@given(st.lists(st.integers(1, 40), max_size=14), st.integers(1, 64))
@settings(max_examples=150, deadline=None)
def test_closest_sum(lengths, capacity):
    waiting = slack_packing.Waiting()
    for i, x in enumerate(lengths):
        waiting.add(x, (i, 0))
    counts = slack_packing.closest(waiting, capacity)
    have = Counter(lengths)
    assert all(0 < c <= have[x] for x, c in counts.items())
    assert sum(x * c for x, c in counts.items()) == best_sum(lengths, capacity)


@given(st.lists(st.integers(1, 63), max_size=60), st.integers(0, 300))
@settings(max_examples=100, deadline=None)
def test_windows_hold_everything_once(lengths, keep):
    waiting = slack_packing.Waiting()
    for i, x in enumerate(lengths):
        waiting.add(x, (i, 0))
    filled = list(slack_packing.windows(waiting, 64, keep))
    assert waiting.total <= max(keep, 63 if keep else 0)
    filled += slack_packing.windows(waiting, 64, 0)
    assert waiting.total == 0 and not waiting.lengths
    seen = Counter((i, p) for w in filled for i, start, n in w for p in range(start, start + n))
    assert seen == Counter((i, p) for i, x in enumerate(lengths) for p in range(x))
    sizes = [sum(n for _, _, n in w) for w in filled]
    assert all(s & (s - 1) == 0 and s <= 64 for s in sizes)
    assert len([s for s in sizes if s < 64]) <= 6


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding()
    t.no_truncation()
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_piece_ids_equal_the_library():
    rnd = random.Random(5)
    signs = [*"abcXYZ 0123.,'#$<|>\t\n\r\x0b\x1c\x00\x7f", "é", "É", "ß", "×", "÷", "Ø", "ÿ", "Ÿ", "İ", "Σ", "ς", "́", "é", "\xa0", "\x85", " ", "中", "😀", "½", "ª", "ſ", "K", "ﬁ",
             "<|endoftext|>", "'s", "'S", "'ll", "Ñ", "​", "Ж", "ि"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 24))) for _ in range(4000)] + ["", " ", "É" * 3000, "x1" * 5000]
    want = library()(texts)
    for known in (bpe.PIECES, 300):  # also with pieces forgotten all the time
        with mock.patch.object(bpe, "PIECES", known):
            pieces = bpe.PieceIds(bpe.vocabulary_text(bpe.default_vocabulary()))
            for lo in range(0, len(texts), 500):
                ids, at = pieces.of_texts(*C.text_bytes(pa.array(texts[lo : lo + 500])), 2)
                assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [[*w, 2] for w in want[lo : lo + 500]]


def test_slack_packing(spark):
    rows = X.texts()
    docs = X.documents(spark, rows)
    ids = dict(zip({t or "" for _, t in rows}, library()([*{t or "" for _, t in rows}])))
    want = Counter((i, tuple([*ids[t or ""], 2])) for i, t in rows)
    with mock.patch.object(slack_packing, "KEPT", 4), mock.patch.object(slack_packing, "GATHERED", 8):
        sequences = slack_packing.pack(docs, capacity=128).collect()
    unique = {i for i, _ in rows if sum(j == i for j, _ in rows) == 1} - {None}
    whole, tokens = defaultdict(dict), 0
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    for s in sequences:
        line = np.frombuffer(s.ids, "<u4").tolist()
        assert len(line) == s.n_tokens == sum(p.length for p in s.pieces) and s.n_tokens <= 128 and s.n_tokens & (s.n_tokens - 1) == 0
        assert [p.offset for p in s.pieces] == [sum(q.length for q in s.pieces[:k]) for k in range(len(s.pieces))]
        tokens += s.n_tokens
        for p in s.pieces:
            whole[p.doc_id].setdefault(p.start, (line[p.offset : p.offset + p.length], p.doc_tokens))
    assert tokens == sum(len(x) * c for (_, x), c in want.items())
    for i, x in want:
        if i in unique:
            got = [whole[i][a] for a in sorted(whole[i])]
            assert [t for part, _ in got for t in part] == list(x) and {n for _, n in got} == {len(x)}
    assert slack_packing.pack(X.documents(spark, [])).count() == 0


def test_op12(spark):
    got = slack_packing.op12_slack_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = dict(zip(docs, ([*x, 2] for x in library()(list(docs.values())))))
    by_doc = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
    assert by_doc.keys() == docs.keys()
    for i, parts in by_doc.items():
        assert [a for a, _ in sorted(parts)] == list(itertools.accumulate((n for _, n in sorted(parts)[:-1]), initial=0)) and sum(n for _, n in parts) == len(ids[i])


# ------------------------------------------------------------------ hard negatives
def mined(rows, every=5, positives=5, negatives=3, d=6):
    """The contract by all pairs; rows are (id, x, label)."""
    fine = [(i, [math.floor(256 * c) for c in v], b) for i, v, b in rows if b is not None and v and len(v) == d and all(c is not None and math.isfinite(c) and abs(c) < 2**20 for c in v)]
    place = lambda i: (i is None, i or 0)
    out = Counter()
    for a, (i, x, b) in enumerate(fine):
        if i is None or i % every:
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), j, c) for j, y, c in fine]
        near = sorted((s for k, s in enumerate(scores) if k != a and s[2] == b), key=lambda s: (-s[0], place(s[1])))[:positives]
        for score, j, _ in near:
            hard = sorted((s for s in scores if s[2] != b and 50 * score <= 100 * s[0] <= 95 * score), key=lambda s: (-s[0], place(s[1])))[:negatives]
            out.update((i, j, rank, s[1], score, s[0]) for rank, s in enumerate(hard, 1))
    return out


def ours(df, every=5):
    rows, length = hard_negatives.rows_of(df)
    return Counter(tuple(r) for r in hard_negatives.mine(rows, length, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("leaf, fan", [(64, 16), (4, 2)])
def test_hard_negatives(spark, leaf, fan):
    rows = awkward(9)
    with mock.patch.object(hard_negatives, "LEAF", leaf), mock.patch.object(hard_negatives, "FAN", fan):
        got = ours(table(spark, rows))
    assert got == mined(rows) and got


def test_hard_negatives_with_many_ties(spark):
    """A vector that a third of all rows hold, in several labels, and one label with a single row."""
    rnd = random.Random(3)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [rnd.randint(0, 4) / 4 for _ in range(3)], rnd.randint(0, 2)) for i in range(240)] + [(1000, [1.0, 1.0, 1.0], 9)]
    assert ours(table(spark, rows), 10) == mined(rows, 10, d=3)


def test_hard_negatives_of_little(spark):
    assert not ours(table(spark, []))
    assert not ours(table(spark, [(5, [1.0, 2.0], 1)]))
    assert not ours(table(spark, [(5, [1.0, 2.0], 1), (6, [1.0, 2.0], None), (7, [1.0, 1.0], 2)]))
    assert not ours(table(spark, [(i, [-1.0, 0.0] if i % 2 else [1.0, 0.0], 1) for i in range(0, 12)]))


def test_exact_beyond_doubles(spark):
    """Scores above 2**53 that differ by one."""
    big = float(2**19)
    rows = [(0, [big, big + 1 / 256], 0), (1, [big, big], 0), (2, [big, big - 1 / 256], 1), (3, [big * 0.75, big * 0.75], 1), (4, [big * 0.75, big * 0.75 + 1 / 256], 1)]
    schema = VECTORS.replace("array<float>", "array<double>")
    assert ours(table(spark, rows, schema)) == mined(rows, d=2)


@given(st.integers(0, 10_000), st.integers(1, 90), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_boxes_bound_their_rows(seed, n, d):
    rnd = np.random.default_rng(seed)
    x, q = rnd.integers(-50, 50, (n, d)).astype(float), rnd.integers(-50, 50, d).astype(float)
    with mock.patch.object(hard_negatives, "LEAF", 4), mock.patch.object(hard_negatives, "FAN", 3):
        tree = hard_negatives.RTree(rnd.permutation(n), x)
        assert sorted(tree.ids.tolist()) == list(range(n))
        scores, per = tree.x @ q, 4
        for level, (_, _, least) in enumerate(tree.levels):
            low, high, _ = tree.bounds(level, slice(0, len(least)), np.maximum(q, 0), np.minimum(q, 0))
            for i in range(len(least)):
                inside = slice(i * per, (i + 1) * per)
                assert low[i] <= scores[inside].min() and scores[inside].max() <= high[i] and least[i] == tree.ids[inside].min()
            per *= 3
        s = hard_negatives.Search(-np.inf, 900.0, 4)
        hard_negatives.search([tree], q, [s])
    want = sorted((-v, i) for v, i in zip(scores.tolist(), tree.ids.tolist()) if v <= 900)[:4]
    assert s.best == want
