"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, for each template as long as the template with room for
100 - PERCENT % of other words, wherever lines break (a shorter text is one block). So a wrapped notice
and one inside a long line are found, and words scattered over a long line are not. Blocks count as sets
of words (A-Z lowered; letters, digits and all beyond ASCII). A template is found where a block holds
at least PERCENT of the template's words.

Join. The template words are ordered by how often they stand in all texts (first pass; only the counts
of template words leave it). In that global order:

* prefix filter: a block that meets the threshold holds one of the template's rarest
  size - need + 1 words, so only those words' places lead to candidates;
* length filter: the block has at least `need` words;
* positional filter: where a prefix word is the block's rarest, the words that count are those from it
  on in the order; around its place there must still be enough of them;

and the blocks that are left, each beginning with a template word, are counted exactly. Literal phrases
(the base) are found beside it as consecutive words of the whole text.

Templates are rows (text, label): the list below, another one, or a table of a checked size
(``templates_of``).

Nulls and edge cases: a null or empty text has no words and no labels (empty strings, score 0,
first_word and last_word null); rows stay as they are (a null id is kept, repeated rows are scanned
each); an empty table gives an empty result; other columns are ignored. A template without words
(or a null one) is never found, one without a label adds none; an empty table of templates leaves the
phrases.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm import common as C

#: Share of a template's words that a block must hold.
PERCENT = 86

#: Phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Wording of common license notices, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
)

#: The largest table of templates that is brought to all tasks, in characters of its texts and labels.
TEMPLATE_CHARS = 8_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str | None) -> list[str]:
    """A template's words, as those of texts are taken."""
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def templates_of(table: DataFrame) -> list[tuple[str, str]]:
    """The rows (text, label) of a table of templates; one over TEMPLATE_CHARS raises."""
    rows = table.select(F.col("text").cast("string"), F.col("label").cast("string"))
    size = rows.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in rows.columns), F.lit(0)))).first()[0] or 0
    if size > TEMPLATE_CHARS:
        raise ValueError(f"templates of {size} characters; scan them in parts of at most {TEMPLATE_CHARS}")
    return [(r.text, r.label) for r in rows.orderBy("label", "text").collect()]


def _hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, as C.Words gives them."""
    data = " ".join(words).encode()
    return C.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), C.ALNUM_ANY_CASE, lower=True).hash


class Templates:
    """Templates as sets of word numbers, in a given order of the words."""

    def __init__(self, templates=TEMPLATES, percent: int = PERCENT, frequency: dict[int, int] | None = None):
        split = [(template_words(text), label) for text, label in templates]
        split = [(parts, label) for parts, label in split if parts]
        words = sorted({w for parts, _ in split for w in parts})
        hashes = _hashes(words)
        # word numbers are ranks: rarest first (ties by the hash)
        order = sorted(range(len(words)), key=lambda i: ((frequency or {}).get(int(hashes[i].view(np.int64)), 0), int(hashes[i])))
        rank = {words[i]: r for r, i in enumerate(order)}
        by_hash = np.argsort(hashes)
        self.hashes, self.ranks = hashes[by_hash], np.argsort(order)[by_hash]
        self.labels = [label for _, label in split]
        self.sets = [np.array(sorted({rank[w] for w in parts})) for parts, _ in split]
        self.need = [-(-percent * len(s) // 100) for s in self.sets]
        #: words of a block
        self.run = [-(-100 * len(parts) // percent) for parts, _ in split]
        #: rank -> (template, the word's place in its order)
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (ranks, need) in enumerate(zip(self.sets, self.need)):
            for i, r in enumerate(ranks[: len(ranks) - need + 1].tolist()):
                self.prefix.setdefault(r, []).append((t, i))

    def word_ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for words of no template."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], -1)


class Places:
    """Where the template words stand in a run of texts, by rank."""

    def __init__(self, words: C.Words, templates: Templates):
        rank = templates.word_ranks(words.hash)
        at = np.flatnonzero(rank >= 0)
        order = np.argsort(rank[at], kind="stable")
        self.at = at[order]
        self.edge = np.searchsorted(rank[at][order], np.arange(len(templates.hashes) + 1))

    def of(self, rank: int) -> np.ndarray:
        return self.at[self.edge[rank] : self.edge[rank + 1]]

    def of_all(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of these words, ascending, and for each the index in them of the word's last place before (or -1)."""
        each = [self.of(r) for r in ranks.tolist()]
        at = np.concatenate(each)
        order = np.argsort(at)
        index = np.empty(len(at), np.int64)
        index[order] = np.arange(len(at))
        before = np.empty(len(at), np.int64)
        before[1:] = index[:-1]
        before[np.cumsum([0, *(len(e) for e in each if len(e))])[:-1]] = -1
        return at[order], before[order]


def matches(words: C.Words, templates: Templates) -> dict[tuple[int, int], float]:
    """{(text, template): largest containment} of the blocks that meet the threshold."""
    places = Places(words, templates)
    best: dict[tuple[int, int], float] = {}
    for r in np.flatnonzero(np.diff(places.edge)).tolist():
        for t, i in templates.prefix.get(r, ()):
            ranks, need, run = templates.sets[t], templates.need[t], templates.run[t]
            p = places.of(r)
            text = np.searchsorted(words.first, p, "right") - 1
            long = words.count[text] >= need
            p, text = p[long], text[long]
            at, before = places.of_all(ranks[i:])
            # the words of all blocks around p: first to end in at
            first = np.searchsorted(at, np.maximum(p - run + 1, words.first[text]))
            end = np.searchsorted(at, np.minimum(p + run, words.first[text + 1]))
            enough = end - first >= need
            edge = np.zeros(len(at) + 1, np.int64)
            np.add.at(edge, first[enough], 1)
            np.add.at(edge, np.searchsorted(at, p[enough], "right"), -1)
            start = np.flatnonzero(np.cumsum(edge[:-1]))
            owner = np.searchsorted(words.first, at[start], "right") - 1
            stop = np.searchsorted(at, np.minimum(at[start] + run, words.first[owner + 1]))
            wide = stop - start >= need
            start, stop, owner = start[wide], stop[wide], owner[wide]
            common = np.zeros(len(start), np.int64)
            for k in range(int((stop - start).max(initial=0))):
                at_k = np.minimum(start + k, stop - 1)
                common += (start + k < stop) & (before[at_k] < start)
            for x, c in zip(owner[common >= need].tolist(), common[common >= need].tolist()):
                best[x, t] = max(best.get((x, t), 0.0), c / len(ranks))
    return best


def phrase_places(words: C.Words, phrases=PHRASES) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """(texts, word numbers in them, label) of each phrase's places."""
    text = np.repeat(np.arange(len(words.count)), words.count)
    out = []
    for phrase, label in phrases:
        parts = _hashes(phrase.split())
        at = np.flatnonzero(words.hash == parts[-1]) - len(parts) + 1
        at = at[at >= 0]
        for k, h in enumerate(parts[:-1]):
            at = at[words.hash[at + k] == h]
        at = at[text[at] == text[at + len(parts) - 1]]
        out.append((text[at], at - words.first[text[at]], label))
    return out


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """How often each template word (by its hash) stands in all texts."""

    def run(batches):
        plain = Templates(templates)
        by_rank = plain.hashes[np.argsort(plain.ranks)].view(np.int64)
        total = np.zeros(len(by_rank), np.int64)
        for batch in batches:
            for _, _, words in C.word_chunks(batch, "text", C.ALNUM_ANY_CASE, lower=True):
                rank = plain.word_ranks(words.hash)
                total += np.bincount(rank[rank >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(by_rank), pa.array(total)], names=["h", "n"])

    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()  # one for each template word
    return {r["h"]: r["n"] for r in rows}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``.

    ``templates``: rows (text, label), or a DataFrame of them.
    score: 1 for a text with a phrase, else the largest containment found, else 0.
    """
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    frequency = word_frequencies(C.small_batches(docs), templates)

    def run(batches):
        ordered = Templates(templates, percent, frequency)
        for batch in batches:
            for lo, hi, words in C.word_chunks(batch, "text", C.ALNUM_ANY_CASE, lower=True):
                n = hi - lo
                base: list[set] = [set() for _ in range(n)]
                labels: list[set] = [set() for _ in range(n)]
                places: list[list] = [[] for _ in range(n)]
                score = np.zeros(n)
                for texts, at, label in phrase_places(words, phrases):
                    for t, a in zip(texts.tolist(), at.tolist()):
                        base[t].add(label)
                        labels[t].add(label)
                        places[t].append(a)
                        score[t] = 1.0
                for (t, template), part in matches(words, ordered).items():
                    if ordered.labels[template]:
                        labels[t].add(ordered.labels[template])
                    score[t] = max(score[t], part)
                join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array(words.count.astype(np.int64)), pa.array([len(p) for p in places], pa.int64()),
                     pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                     join(base), join(labels), pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"({t}, '{text}', '{label}')" for t, (text, label) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{text}', '{label}')" for text, label in PHRASES)
    return rf"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
phrase(p, label) AS (SELECT string_split(t, ' '), l FROM (VALUES {phrases}) v(t, l)),
places AS (
  SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE list_contains(w, 'license')) s, phrase
  WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1),
template AS (
  SELECT t, label, len(list_distinct(w)) AS n, (100 * len(w) + {PERCENT} - 1) // {PERCENT} AS run, unnest(list_distinct(w)) AS word
  FROM (SELECT t, label, string_split(x, ' ') AS w FROM (VALUES {values}) v(t, x, label))),
held AS (
  SELECT doc_id, t, label, n, run, i, word
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words) JOIN template USING (word)
  QUALIFY 100 * count(DISTINCT word) OVER (PARTITION BY doc_id, t) >= {PERCENT} * n),
run AS (SELECT a.doc_id, a.t, a.label, a.n, a.i, count(DISTINCT b.word) AS c FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.run GROUP BY ALL),
alike AS (SELECT doc_id, label, max(c) / n AS part FROM run WHERE 100 * c >= {PERCENT} * n GROUP BY doc_id, label, n),
every AS (SELECT doc_id, label, 1.0::DOUBLE AS part FROM places UNION ALL SELECT * FROM alike),
found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score FROM every GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.b AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0)::DOUBLE AS score
FROM words w LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


SQL = _sql()
