import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revcast.llm import bpe, chat_format, decontaminate, license_scan, ngram_join, packing, quality_knn, sharding, substring_dedup, weak_quality
from revcast.llm import common as C
from revcast.llm.components import components
from tests.llm import fixtures as X

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return X.texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return X.documents(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return X.documents(spark, [])


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 200, 300)} == {100} and {got[1000 + i] for i in range(200)} == {1000}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_packing(spark, rows, docs, none):
    assert packing.pack(none).count() == 0
    encode, end = packing.byte_bpe(open(packing.default_ranks(), "rb").read())
    packed = packing.pack(docs, row_length=128, block=5000).cache()
    unique = {i: t for i, t in rows if i is not None and sum(j == i for j, _ in rows) == 1}
    got = {r.doc_id: list(r.ids) for r in packing.unpack_ids(packed, 128).collect()}
    assert got == {i: [*encode(t or "").tolist(), end] for i, t in unique.items()}
    seen = Counter()
    for r in packed.collect():
        line = np.frombuffer(r.ids, "<u2")
        assert len(line) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        assert list(r.position_resets) == list(r.cu_seqlens[:-1]) and len(r.doc_ids) == r.n_segments
        assert set(line[r.n_tokens :].tolist()) <= {end}
        seen.update((d, p, b - a) for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]))
    want = Counter((i, at, n) for i, t in rows for at, n in packing.split_text(len(encode(t or "")) + 1, 128))
    assert seen == want
    # repeated ids whose pieces can't be told apart are left out of unpack_ids only
    assert sum(n * c for (_, _, n), c in seen.items()) == sum(r.n_tokens for r in packed.select("n_tokens").collect())


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit(lengths):
    lengths = np.array(lengths, np.int64)
    rows = packing.pack_segments(lengths, 64)
    room: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        best = min((r for r in room if r >= n), default=None)
        if best is None:
            room.append(64 - n)
        else:
            room[room.index(best)] -= n
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(room)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


def test_sharding(spark, docs, none):
    names = sharding.shard_names(16)
    table = sharding.lookup_table(names, 2003)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    # a shard that goes gives its slots away; few others change hands
    less = sharding.lookup_table(names[:5] + names[6:], 2003)
    assert sum(a != b for a, b in zip(table, less) if a != names[5]) < 0.2 * 2003
    heavy = Counter(sharding.lookup_table(names, 2003, {names[0]: 3}))
    assert 2 < heavy[names[0]] / heavy[names[1]] < 4
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 8)
    out = sharding.assign_shards(docs, ["doc_id", "text"], names, 2003)
    assert out.count() == docs.count() and out.columns.count("slot") == 1
    assert all(table[r.slot] == r.shard for r in out.select("slot", "shard").collect())
    assert out.groupBy("doc_id", "text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    assert sharding.assign_shards(none, ["doc_id"], names, 2003).count() == 0
    plain = spark.read.parquet(f"{SF0001}/documents.parquet")
    plan = sharding.assign_shards(plain, ["doc_id"], names)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan


def test_license(spark, rows, docs, none):
    assert license_scan.scan(none).count() == 0
    got = Counter(tuple(r) for r in license_scan.scan(docs).collect())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets = [(set(t.split()), -(-100 * len(t.split()) // license_scan.PERCENT), label) for t, label in license_scan.TEMPLATES]
    want = Counter()
    for i, t in rows:
        w = word.findall(X.lower(t))
        places = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        parts = [(len(s & set(w[k : k + run])) / len(s), label) for s, run, label in sets for k in range(len(w))]
        parts = [(p, label) for p, label in parts if p >= license_scan.PERCENT / 100]
        at = [k for k, _ in places]
        want[(i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})),
              ",".join(sorted({x for _, x in places + parts})), 1.0 if places else max([0.0, *(p for p, _ in parts)]))] += 1
    assert got == want
    assert any(r[6] == "cc-by-nc,gpl" and not r[5] for r in got)


def test_license_across_lines(spark):
    """Hard-wrapped notices, and words too far apart or in different texts."""
    bsd = "Redistribution and use in source and binary forms, with or without\n{}modification, are permitted"
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0."
    mit = "Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this\n * software and so on"
    far = " ".join(X.prose(5, 20))
    texts = [bsd.format(""), f"{far}\n{bsd.format('// ')}\n{far}", mpl, mit, bsd.format(far), bsd.split("\n")[0], "modification, are permitted", mpl.replace("\n# ", " ")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(X.documents(spark, list(enumerate(texts)))).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("bsd", 1.0), 2: ("mpl", 1.0), 3: ("mit", 1.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("mpl", 1.0)}


def test_license_inside_long_lines(spark):
    """A notice within a long line is found; a template's words scattered over one are not."""
    words = "this is free and unencumbered software released into the public domain".split()
    prose = X.prose(7, 150)
    scattered = " ".join(" ".join([w, *prose]) for w in words[:-1])
    inside = " ".join([*prose, *words, *prose])
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(X.documents(spark, [(1, scattered), (2, inside), (3, " ".join(words[1:]))])).collect()}
    assert got == {1: ("", 0.0), 2: ("unlicense", 1.0), 3: ("unlicense", 10 / 11)}


def test_license_templates_as_a_table(spark, docs, monkeypatch):
    table = spark.createDataFrame([("All Rights-Reserved by\nthe Übung guild", "guild"), (None, "none"), ("... !", "signs"), ("words of one notice without label", None),
                                   ("All Rights-Reserved by\nthe Übung guild", "guild")], "text string, label string")
    texts = X.documents(spark, [(1, "so (c) all rights reserved, by the Übung GUILD."), (2, "all rights reserved"), (3, "words of one notice without label"), (4, "MIT license"), (5, None)])
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in license_scan.scan(texts, templates=table).collect()}
    assert got == {1: ("", "guild", 1.0), 2: ("", "", 0.0), 3: ("", "", 1.0), 4: ("mit", "mit", 1.0), 5: ("", "", 0.0)}
    none = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(texts, templates=table.limit(0)).collect()}
    assert none == {1: ("", 0.0), 2: ("", 0.0), 3: ("", 0.0), 4: ("mit", 1.0), 5: ("", 0.0)}
    monkeypatch.setattr(license_scan, "TEMPLATE_CHARS", 100)
    with pytest.raises(ValueError, match="characters"):
        license_scan.scan(texts, templates=table)


def test_license_runs_like_all_runs():
    """The filters lose no run: against every run of every text, whatever the order of the words."""
    rnd = np.random.default_rng(4)
    for _ in range(20):
        plain = license_scan.Templates()
        templates = license_scan.Templates(frequency={int(h): int(rnd.integers(5)) for h in plain.hashes.view(np.int64)})
        texts = []
        for _ in range(12):
            w = license_scan.TEMPLATES[rnd.integers(len(license_scan.TEMPLATES))][0].split()
            for _ in range(rnd.integers(0, 4)):
                w.insert(rnd.integers(len(w)), rnd.choice(["the", "of", "x", "license", "is"]))
            w = X.prose(int(rnd.integers(99)), 6) + w + ["a"] * int(rnd.integers(3)) + (w[::-1] if rnd.random() < 0.3 else [])
            texts.append("".join(x + rnd.choice([" ", " ", "\n"]) for x in w).lower())
        data = [t.encode() for t in texts]
        words = C.Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), C.ALNUM_ANY_CASE, lower=True)
        want = {}
        for x, text in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
            for t, (template, _) in enumerate(license_scan.TEMPLATES):
                own = set(template.split())
                common = max(len(own & set(w[k : k + templates.run[t]])) for k in range(len(w)))
                if common >= templates.need[t]:
                    want[x, t] = common / len(own)
        assert license_scan.matches(words, templates) == want and want


def test_weak_quality(spark, rows, docs, none):
    assert weak_quality.judge(none).count() == 0
    out = weak_quality.judge(docs)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        w, seen, dup = X.WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if X.WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + d for k in range(len(w) - 2) for d in range(3) if windows[tuple(w[k : k + 3])] > 1}
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))] += 1
    assert got == want
    assert all(not (r.kept and r.base_failed) and 0 <= r.quality <= 1 for r in out.collect())


def test_expectation_maximisation_finds_the_classes():
    """Votes drawn from a known model: the posterior orders the texts as the true chances do."""
    rnd = np.random.default_rng(3)
    n, rules = 20_000, len(weak_quality.RULES)
    good = rnd.random(n) < 0.8
    right = rnd.uniform(0.65, 0.95, rules)
    vote = np.where(rnd.random((n, rules)) < 0.3, 0, np.where(rnd.random((n, rules)) < right, 1, -1) * np.where(good, 1, -1)[:, None])
    pattern = ((vote + 1) * 3 ** np.arange(rules - 1, -1, -1)).sum(1)
    kinds, at, count = np.unique(pattern, return_inverse=True, return_counts=True)
    assert (weak_quality.pattern_votes(kinds)[at] == vote).all()
    guess = weak_quality.posteriors(kinds, count.astype(float))[at] >= 0.5
    plain = vote.sum(1) >= 0
    assert (guess == good).mean() > 0.93 and (guess == good).mean() >= (plain == good).mean()


def test_weak_quality_on_labels(spark):
    d = spark.read.parquet(f"{SF0001}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF0001}/../sf0.01/labels.parquet")
    r = weak_quality.judge(d).drop("quality").join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    share = dict(map(tuple, r))
    assert share[1] > 0.99 and share[0] < 0.1


def test_ngram_join(spark, rows, docs, none):
    assert ngram_join.near_duplicates(none).count() == 0
    want = X.components(rows)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(X.shingle_set(t))) for i, t in rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None), r
    assert {r.doc_id: r.class_id for r in got}[12] == 10
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))  # also of repeated rows one
    assert sorted(r.text or "" for r in kept if r.doc_id is None) == sorted(t or "" for i, t in rows if i is None)


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join_random_families(spark, seed, monkeypatch):
    """Families around the threshold, hot ones too, against all pairs."""
    import random

    rnd = random.Random(seed)
    rows, shared = [], X.prose(999, 30)
    for family in range(12):
        base = X.prose(1000 * seed + family, rnd.choice([5, 7, 12, 30, 60, 130]))
        for _ in range(rnd.choice([2, 3, 40])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + (shared if rnd.random() < 0.4 else []))))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(X.documents(spark, rows)).collect()}
    assert got == X.components(rows)


def test_ngram_join_across_flushes(spark):
    """x and y, in different flushes, share hot signatures only; x is linked with y alone."""
    base = X.prose(77, 260)

    def copy(places, tag):
        return " ".join(f"{tag}{i}" if i in places else w for i, w in enumerate(base))

    # each partition is a flush; other copies change a word of their own in the front half, x seven in the other
    other = lambda i: (i, copy({5 + 2 * i}, f"own{i}_"))
    x, y = (98, copy({140 + 15 * k for k in range(7)}, "x")), (99, " ".join(base))
    parts = [[other(i) for i in range(20)], [other(i) for i in range(20, 40)] + [x], [other(i) for i in range(40, 60)] + [y]]
    rows = [r for part in parts for r in part]
    links = [i for i, t in rows if i != x[0] and len(X.shingle_set(t) & X.shingle_set(x[1])) >= 0.75 * len(X.shingle_set(t) | X.shingle_set(x[1]))]
    assert links == [y[0]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(list), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == X.components(rows) and got[x[0]] == 0


def test_signatures_share():
    """Sets within the threshold share at least `need` signatures."""
    rnd = np.random.default_rng(5)
    for size in [1, 2, 3, 4, 5, 6, 8, 13, 27, 60, 64, 65, 100, 251, 513]:
        for _ in range(12):
            a = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
            cut = rnd.integers(0, len(a) // 7 + 1)
            b = np.unique(np.concatenate([a[cut:], rnd.integers(0, 2**63, rnd.integers(0, cut + 1)).astype(np.uint64)]))
            if not len(b) or 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            sig = [{(int(s)): int(n) for _, ss, _, ns in ngram_join.signatures(np.zeros(len(x), np.int64), np.sort(x)) for s, n in zip(ss, ns)} for x in (a, b)]
            assert len(sig[0].keys() & sig[1].keys()) >= max(min(sig[0].values()), min(sig[1].values()))


MARKS = ["<|", "|>", "</turn>", "\\", "\n", "<", "/turn>", "<\\/turn>", "a", "é", "<|user|>\n"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a|>b"]), st.lists(st.sampled_from(MARKS), max_size=8).map("".join)), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None)
def test_chat_round_trip(spark, turns):
    rows = [(1, n, r, t) for n, (r, t) in enumerate(turns)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = chat_format.read_back(chats).first()
    assert [(x.role, x.text) for x in r.turns] == turns
    assert list(r.loss_texts) == [t for role, t in turns if role == "assistant"]
    assert r.formatted == "".join(s.text for s in r.segments)


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, valid int, segments string"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", "x"), (3, 0, "system", None), (3, 1, "user", ""), (4, 0, "user", "a"), (4, 0, "user", "a"),
            (None, 0, "user", "z"), (5, None, None, "q"), (6, 0, "user", "y" * 100_000), (6, 1, "assistant", "<|" * 50_000)]
    d = spark.createDataFrame([(*r, 1, "s") for r in rows], schema)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(d)).collect()}
    assert {k: v.valid for k, v in got.items()} == {1: True, 2: False, 3: True, 4: False, None: True, 5: False, 6: True}
    assert got[1].turns_sha256 == X.sha("user\na\nassistant\nb\n") and got[1].loss_sha256 == X.sha("b") and got[1].loss_chars == 1
    assert got[6].loss_chars == 100_000 and got[6].loss_sha256 == X.sha("<|" * 50_000)
    assert got[3].n_turns == 2 and got[3].turns_sha256 == X.sha("system\n\nuser\n\n")
    assert chat_format.format_chats(d.limit(0)).count() == 0
    assert {r.conv_id: r.refused_turn for r in chat_format.format_chats(d).collect()}[4] == 1


def test_substring_dedup(spark, rows, docs, none):
    assert substring_dedup.removal_digests(none).count() == 0
    want = X.kept_words(rows)
    got = substring_dedup.removal_digests(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            words, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), len(words) - len(kept), X.sha(" ".join(kept))), r.doc_id
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        if r.doc_id is not None:
            assert X.WORD.findall(r.text or "") == want[r.doc_id][1] and r.n_chars == (None if r.text is None else len(r.text))


ODD = ["", " ", "Hello  World's  <|endoftext|> ΑΣ abc123 İ \x1c a\u0085b", "don't!!! ab<|startoftext|>CD <|ENDOFTEXT|>", "  é é  x", "aaaaaaaaaaaaaa " + "a" * 501,
       "ﬁ Å 가각 😀👍🏽 ½ ٣ x‍y", " a　b﻿c", "\x00\x7f\x1f", "ǅ ß ẞ ŉ"]


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    return Tokenizer.from_file(path), bpe.TrieBpe(bpe.vocabulary_text(path))


@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), max_size=60) | st.text("aeiouthnrs' \n!?.,<|>019éß", max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_like_the_library(encoders, text):
    library, trie = encoders
    ids = library.encode(text, add_special_tokens=False).ids
    assert trie.encode(text) == ids and trie.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe(spark, encoders, rows, none):
    assert bpe.encoding_digests(none).count() == 0 and bpe.encode(none).count() == 0
    library = encoders[0]
    rows = rows + [(500 + i, t) for i, t in enumerate(ODD)]
    got = Counter(tuple(r) for r in bpe.encoding_digests(X.documents(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), X.sha(" ".join(map(str, ids))), X.sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    few = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(X.documents(spark, rows[-5:])).collect()}
    assert few[rows[-1][0]][0] == library.encode(rows[-1][1], add_special_tokens=False).ids


def test_bpe_pieces_forgotten(encoders, monkeypatch):
    """The ids don't depend on what is remembered."""
    texts = [" ".join(X.prose(i, 30)) for i in range(40)] * 2 + ["", "  ", "Ünder <|endoftext|> 'S"]
    pieces = bpe.PieceIds(bpe.vocabulary_text(bpe.default_vocabulary()))
    for known in (bpe.PIECES, 5):
        monkeypatch.setattr(bpe, "PIECES", known)
        for lo in range(0, len(texts), 7):
            ids, at = pieces.of_texts(*C.text_bytes(pa.array(texts[lo : lo + 7])))
            assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [pieces.encoder.encode(t) for t in texts[lo : lo + 7]]


def test_quality(spark, rows, docs, none):
    d = spark.read.parquet(f"{SF0001}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF0001}/../sf0.01/labels.parquet")
    model = quality_knn.train(d, labels)
    assert quality_knn.scored(none, model).count() == 0
    out = quality_knn.classify(d, labels).join(labels, "doc_id")
    test = [(r.score, r.quality, r.predicted) for r in out.filter("held_out").collect()]
    good, bad = [s for s, q, _ in test if q == 1], [s for s, q, _ in test if q == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97
    assert np.mean([p == q for _, q, p in test]) > 0.95
    got = quality_knn.scored(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {model.prior}
    clash = quality_knn.scored(docs, model, "quality_score")
    assert clash.columns == [*docs.columns, "quality_score"]
    assert quality_knn.scored(docs, quality_knn.train(docs, labels.limit(0))).select("doc_id").count() == len(rows)
    # exact cosines: blocks don't change the neighbours
    weights = np.abs(np.random.default_rng(1).standard_normal((9, quality_knn.TERMS))).astype(np.float32)
    near = model.project(weights) @ model.vectors.T
    top = np.argsort(-near, 1)[:, : quality_knn.NEIGHBOURS]
    w = np.maximum(np.take_along_axis(near, top, 1), 0).astype(float) ** quality_knn.SHARPNESS
    assert np.allclose(model.score(weights), (w * model.labels[top]).sum(1) / w.sum(1), atol=1e-5)


def test_decontamination(spark, rows, docs, none):
    items = [(1, " ".join(X.prose(2, 64)[5:45])), (2, " ".join(X.prose(55, 30))), (3, None), (4, "a b c"), (None, "spam! " * 20), (5, "spam! " * 20), (6, " ".join(X.prose(1, 240)[:90])),
             (7, " ".join(X.prose(2, 64)[5:45])), (8, " ".join(X.prose(1, 240)))]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, similarity string, size int")
    want = X.contaminated(rows, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 40
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    kept = [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()]
    hit = {i for i, _ in want}
    assert Counter(kept) == Counter(i for i, _ in rows if i not in hit)


def test_decontamination_of_runs(spark):
    """Windows with a run of a repeated word, similar by 0.75 and a little more."""
    rows, items = [], []
    for k, n in enumerate([30, 100, 200, 200, 300]):
        item = X.prose(700 + k, n)
        items.append((k, " ".join(item)))
        run = (n - 4) // 7 - 1
        rows.append((10 * k, " ".join(X.prose(800 + k, 20) + item[: n - run] + ["-"] * (run + 20))))  # at the end
        rows.append((10 * k + 1, " ".join(item[:-run] + ["|"] * run)))  # the whole text
        rows.append((10 * k + 2, " ".join(item[: n // 2] + ["0"] * (run - 4) + item[n // 2 + run - 4 :] + X.prose(900 + k, 9))))  # amid
        rows.append((10 * k + 3, " ".join(item[: n // 2] + ["0"] * (n // 4) + item[n // 2 + n // 4 :])))  # too long a run
    items.append((90, " ".join(["pad"] * 40 + X.prose(950, 160))))  # a run of the item's own
    rows += [(90, " ".join(["pad"] * 22 + X.prose(950, 160) + X.prose(951, 40))), (91, " ".join(["pad"] * 60 + X.prose(950, 160)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = X.contaminated(rows, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(X.documents(spark, rows), bench).collect()}
    assert got == want and {(10 * k + j, k) for k in range(1, 5) for j in (0, 1, 2)} <= want.keys() and (13, 1) not in want


@pytest.mark.parametrize("low, high, least", [(0.75, 0.8, 0.97), (0.8, 1.0, 0.998)])
def test_recall_of_fingerprints(spark, low, high, least):
    """Pairs found by fingerprints alone, of all pairs in a range of similarity: items of 40 to 120 words with some words changed."""
    rnd = np.random.default_rng(int(100 * low))
    items, texts = [], []
    for i in range(60):
        words = X.prose(5000 + i, int(rnd.integers(40, 120)))
        items.append((i, " ".join(words)))
        for k in range(25):
            copy = list(words)
            for at in rnd.integers(0, len(words), max(1, int(len(words) * rnd.random() * 0.05))):
                copy[at] = f"z{k}y{at}"
            texts.append((1000 * i + k, " ".join(copy)))
    docs, benchmark = X.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda df: {(r.doc_id, r.item_id) for r in df.filter(f"similarity >= {low} and similarity < {high}").collect()}
    every = pairs(decontaminate.contaminated(docs, benchmark, exact=True))
    found = pairs(decontaminate.contaminated(docs, benchmark))
    assert len(every) > 80 and found <= every and len(found) >= least * len(every), (len(found), len(every))


def test_fingerprint(spark):
    rnd = np.random.default_rng(2)
    arrays = [rnd.integers(-(2**63), 2**63, n).tolist() for n in (1, 2, 3, 36, 55, 501)]
    got = spark.createDataFrame([(a,) for a in arrays], "h array<bigint>").select(decontaminate.fingerprint(F.col("h"))).collect()
    for a, (bits,) in zip(arrays, got):
        assert [(bits >> b) & 1 for b in range(64)] == [int(2 * sum((x >> b) & 1 for x in a) > len(a)) for b in range(64)]


def test_pipeline(spark):
    import corpus_pipeline as P

    out = P.run(spark, SF0001)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    d = spark.read.parquet(f"{SF0001}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        before, d = d, stage(spark, d, SF0001)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = [(r.doc_id, r.text) for r in before.collect()]
        left = {r.doc_id: r.text for r in d.collect()}
        if name == "near_duplicates":
            assert set(left) == set(X.components(rows).values())
        if name == "repeated_passages":
            want = X.kept_words(rows)
            assert {i: X.WORD.findall(t) for i, t in left.items()} == {i: k for i, (_, k) in want.items()}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(left) == {i for i, _ in rows} - {i for i, _ in X.contaminated(rows, items)}
        d = spark.createDataFrame(d.collect(), d.schema)
    assert {r.doc_id for r in out.collect()} == set(left)


def near_copies(n, words=200, changed=4, seed=1):
    """Copies of one text with some random words changed each: most pairs just miss the threshold."""
    base, rnd = X.prose(77, words), np.random.default_rng(seed)
    rows = []
    for i in range(n):
        copy = list(base)
        for at in rnd.choice(words, changed, replace=False):
            copy[at] = f"w{i}x{at}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("n, block", [(400, ngram_join.HEAVY_BLOCK), (150, 60_000)])
def test_large_group_of_near_copies(spark, monkeypatch, n, block):
    """The links that heavy sets are joined by are fewer than the sets for each pair of blocks, and lose nothing."""
    counts = []
    heavy = ngram_join.heavy_links
    monkeypatch.setattr(ngram_join, "heavy_links", lambda docs, around, percent: [counts.append((around.count(), out := heavy(docs, around, percent), out.count())), out][1])
    monkeypatch.setattr(ngram_join, "HEAVY_BLOCK", block)
    rows = near_copies(n)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(X.documents(spark, rows)).collect()}
    assert got == X.components(rows)
    (sets, _, links), = counts
    assert n // 2 < sets <= n and links < sets * (1 if n == 400 else 10)


@given(st.integers(0, 10_000), st.sampled_from([75, 80, 90]), st.booleans())
@settings(max_examples=60, deadline=None)
def test_spanning_links_join_what_all_links_join(seed, percent, two_sides):
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(0, 60), replace=False), rnd.integers(0, 2**63, rnd.integers(0, 6)).astype(np.uint64)])) for _ in range(25)]
    maps = ngram_join.bit_maps(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            assert np.bitwise_count(maps[i] ^ maps[j]).sum() <= len(np.setxor1d(a, sets[j]))
    component, side = rnd.integers(0, 15, 25), (rnd.integers(0, 2, 25) > 0) if two_sides else np.zeros(25, bool)
    order = np.argsort(component, kind="stable")
    component, side = component[order], side[order]
    across = side.any() and not side.all()

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return len(sets[i]) and len(sets[j]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    def closed(pairs):
        root = component.copy()
        for i, j in pairs:
            root[root == root[j]] = root[i]
        return [tuple(root == r) for r in root]

    every = [(i, j) for j in range(25) for i in range(j) if linked(i, j) and (side[i] != side[j] or not across)]
    got = ngram_join.spanning_links(sets, component, side, percent)
    assert set(got) <= set(every) and closed(got) == closed(every) and len(got) < 25
