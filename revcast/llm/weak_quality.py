"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule looks at one trait of a text and votes good (1), bad (-1) or abstains (0). The votes' joint
patterns are counted over all texts (at most 3 ** 8 patterns, however many texts), and a
latent-class model is fitted to the counts: the share of good texts, and each rule's chances of
each vote on good and on bad texts. A text's quality is the posterior probability of its pattern.
It is kept from KEEP_FROM on, unless it fails the base rules (under 50 words; or over half of the
words in repeated three-word windows).

The traits are computed once, in one pass over the texts, and checkpointed; only the pattern counts
reach the driver.

Nulls and edge cases: a null or empty text has no words and fails the base rules; rows stay as they
are (a null id is kept, repeated rows are voted on each); an empty table gives an empty result;
other columns are ignored. With one pattern only, the votes' first weights decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm import common as C

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP_FROM = 0.5
#: Rounds of expectation-maximisation at most, and the change of the log-likelihood (per text) that ends them.
ROUNDS, ENOUGH = 200, 1e-9

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True

#: (name, trait, bad from or None, bad up to or None, good from, good up to or None): a rule for a kind
#: of junk abstains where it doesn't see it; a rule for prose votes both ways.
RULES = (
    ("symbols", "symbols_a_word", 0.25, None, 0.0, 0.02),
    ("repeats", "repeated_share", 0.35, None, None, None),
    ("lines", "dup_line_share", 0.3, None, None, None),
    ("word_length", "chars_a_word", 14.0, 2.2, None, None),
    ("capitals", "capital_share", 0.4, None, 0.0, 0.2),
    ("variety", "distinct_share", None, 0.15, 0.35, 1.0),
    ("stutter", "stutter_share", 0.2, None, None, None),
    ("shouts", "odd_end_share", 0.3, None, 0.0, 0.05),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def traits(words: C.Words) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The contract's counts, and the rules' traits, of each text."""
    data, offsets = words.data, words.offsets
    n, count = len(words.count), words.count
    _, text = words.text_of()
    total = np.maximum(count, 1)
    per_text = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
    of_words = lambda mask: np.bincount(text[mask], minlength=n)

    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.bincount(text, points[words.ends] - points[words.starts], minlength=n).astype(np.int64)
    symbols = per_text(_SYMBOLS[data])

    lines = C.Words(data, offsets, _LINE)
    filled = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    _, owner = lines.text_of()
    value, owner = lines.hash[filled], owner[filled]
    order = C.by_text_and_value(value, owner)
    same = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    dup_lines = np.bincount(owner[order][1:][same], minlength=n)

    at, window_text = words.text_of(3)
    value = words.windows(at, 3)
    order = C.by_text_and_value(value, window_text)
    same = (value[order][1:] == value[order][:-1]) & (window_text[order][1:] == window_text[order][:-1])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.bincount(at[again], minlength=len(text) + 1) - np.bincount(at[again] + 3, minlength=len(text) + 1)[: len(text) + 1]
    repeated = of_words(np.cumsum(edge[:-1]) > 0)

    order = C.by_text_and_value(words.hash, text)
    same = (words.hash[order][1:] == words.hash[order][:-1]) & (text[order][1:] == text[order][:-1])
    copies = np.bincount(text[order][1:][same], minlength=n)
    stutter = np.zeros(len(text), bool)
    stutter[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    last = data[words.ends - 1] if len(words.ends) else data[:0]
    counts = dict(zip(COUNTS, (count, chars, symbols, dup_lines, repeated)))
    shares = {
        "symbols_a_word": symbols / total,
        "repeated_share": repeated / total,
        "dup_line_share": dup_lines / np.maximum(np.bincount(owner, minlength=n), 1),
        "chars_a_word": chars / total,
        "capital_share": per_text(_UPPER[data]) / np.maximum(per_text(_LETTER[data]), 1),
        "distinct_share": (count - copies) / total,
        "stutter_share": of_words(stutter) / total,
        "odd_end_share": of_words((last == 0x21) | _SYMBOLS[last]) / total,
    }
    return counts, shares


def votes(shares: dict[str, np.ndarray]) -> list[np.ndarray]:
    """1 good, -1 bad, 0 abstains, by rule."""
    out = []
    for _, trait, bad_from, bad_to, good_from, good_to in RULES:
        x = shares[trait]
        vote = np.zeros(len(x), np.int64)
        if good_from is not None:
            vote[(x >= good_from) & (x <= good_to)] = 1
        if bad_from is not None:
            vote[x >= bad_from] = -1
        if bad_to is not None:
            vote[x <= bad_to] = -1
        out.append(vote)
    return out


def _trait_rows(batches):
    for batch in batches:
        for lo, hi, words in C.word_chunks(batch, "text"):
            counts, shares = traits(words)
            pattern = np.zeros(hi - lo, np.int64)
            for vote in votes(shares):
                pattern = pattern * 3 + vote + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(pattern)],
                                             names=["doc_id", *COUNTS, "pattern"])


def pattern_votes(pattern: np.ndarray) -> np.ndarray:
    """The votes (-1, 0, 1) of pattern numbers, a column for each rule."""
    return pattern[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1) % 3 - 1


def posteriors(pattern: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probability of a good text for each pattern, given how often each occurs.

    First weights: 0.7 good texts, and a rule that votes is right four times in five. Each round
    counts half a vote of each kind more (in proportion to the first weights), so that no chance is
    ever zero.
    """
    vote = pattern_votes(pattern) + 1
    first = np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])  # of bad, of none, of good; on bad and on good texts
    chance = np.repeat(first[:, None, :], vote.shape[1], axis=1)
    share, before = 0.7, -np.inf
    for _ in range(ROUNDS):
        log = np.log([1 - share, share])[:, None] + np.log(chance[:, np.arange(vote.shape[1]), vote]).sum(2)
        top = log.max(0)
        joint = np.exp(log - top)
        good = joint[1] / joint.sum(0)
        likely = float((weight * (top + np.log(joint.sum(0)))).sum() / max(weight.sum(), 1))
        if likely - before < ENOUGH:
            break
        before = likely
        share = float(np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99))
        for c, part in enumerate((1 - good, good)):
            for r in range(vote.shape[1]):
                seen = np.bincount(vote[:, r], weight * part, minlength=3) + 0.5 * first[c]
                chance[c, r] = seen / seen.sum()
    return good


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior), kept for each row of ``docs`` (doc_id, text)."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", pattern long"
    rows = C.checkpointed(C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_trait_rows, schema))
    counted = rows.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** len(RULES)
    pattern, weight = (np.array([r[i] for r in counted], np.int64) for i in (0, 1))
    quality = posteriors(pattern, weight.astype(float)).tolist() if counted else []
    table = docs.sparkSession.createDataFrame(list(zip(pattern.tolist(), quality)), "pattern long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return rows.select("doc_id", *COUNTS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).alias("kept"))


def op4_weak_quality(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"))
