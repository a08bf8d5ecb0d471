"""BPE encoding and decoding by a prefix-sharing trie.

Texts are cut at white space; the chunks' words (the tokenizer's pre-tokens, as byte symbols, the
last one with the end-of-word mark) are inserted into a trie whose depth-first order is the sorted
order of the words. Each trie node keeps one state: the last token of the encoding of its prefix.
It is the only token that (a) ends the prefix, (b) stands for itself when encoded alone, and (c)
does not merge across its left border with the last token of what is before it. So a node takes a
few dictionary lookups, prefixes shared by words are computed once, and a word's ids are read back
along the states. The work is linear in the text's length, also for one endless word.

Nulls and edge cases: a null or empty text, or one of white space, has no ids and decodes to the
empty text; the tokenizer's special strings in a text give their ids; a null id is kept; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm import common as C

#: White space as the tokenizers' regular expressions have it.
_WHITE = r"\t-\r \x85\p{Z}"
_SPLIT_WHITE = regex.compile(f"[{_WHITE}]+")
#: Fixed value: the word pattern of word_bpe_49k.json.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: Controls that Python's str.split takes for white space and the tokenizer does not.
_ODD = regex.compile("[\x1c-\x1f]")
#: Distinct pieces whose ids a worker keeps; then it begins anew.
PIECES = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class TrieBpe:
    """Encoder for a tokenizers JSON file with byte symbols and an end-of-word mark."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {self.vocab[a + b]: (self.vocab[a], self.vocab[b], r) for r, (a, b) in enumerate(pairs)}
        self.symbols = dict(enumerate(byte_symbols()))
        self._never = len(pairs)
        self._spines: tuple[dict, dict] = ({}, {})
        self._joins: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self._suffixes()

    # ---- which tokens may stand side by side
    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one border (0 left, 1 right) while ``token`` is built, with the rank at which each is merged away."""
        known = self._spines[side].get(token)
        if known is None:
            known, t, until = [], token, self._never
            while True:
                known.append((t, until))
                if t not in self.parts:
                    break
                until = self.parts[t][2]
                t = self.parts[t][side]
            self._spines[side][token] = known
        return known

    def _crossed(self, left: int, right: int, but: int) -> bool:
        """Whether a merge ranked below ``but`` takes place across the border of two tokens under way.

        Of equal ranks the leftmost goes first: a left part's own merge before one across the
        border, that one before a right part's.
        """
        rank = self.rank.get
        for r, r_until in self._spine(left, 1):
            for l, l_until in self._spine(right, 0):
                q = rank((r, l))
                if q is not None and q < but and q < r_until and q <= l_until:
                    return True
        return False

    def joins(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are, side by side."""
        if len(self._joins) > 2_000_000:
            self._joins.clear()
        known = self._joins[left << 20 | right] = not self._crossed(left, right, self._never)
        return known

    def alone(self, token: int) -> bool:
        """Whether the token's own characters encode to it."""
        known = self._alone.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                a, b, r = self.parts[token]
                known = self.alone(a) and self.alone(b) and not self._crossed(a, b, r)
            self._alone[token] = known
        return known

    # ---- which tokens end a prefix
    def _suffixes(self) -> None:
        """An automaton over the tokens' characters: after a prefix, its state names the tokens that
        end it, longest first. A character that ends a word is one of its own."""
        self._next: list[dict[str, int]] = [{}]
        self._ends: list[tuple[tuple[int, int], ...]] = [()]
        own: dict[int, tuple[int, int]] = {}
        for token, i in self.vocab.items():
            whole = bool(self.end) and token.endswith(self.end)
            if not self.alone(i):
                continue
            state, path = 0, self.ended(token[: -len(self.end)]) if whole else token
            for c in path:
                if c not in self._next[state]:
                    self._next[state][c] = len(self._next)
                    self._next.append({})
                    self._ends.append(())
                state = self._next[state][c]
            own[state] = (i, len(path))
        self._back, level = [0] * len(self._next), [0]
        children = [dict(d) for d in self._next]
        while level:  # by depth: the state of the longest shorter ending
            below = []
            for state in level:
                self._ends[state] = ((own[state],) if state in own else ()) + self._ends[self._back[state]]
                for c, child in children[state].items():
                    if state:
                        self._back[child] = self._step(self._back[state], c)
                    below.append(child)
            level = below

    def _step(self, state: int, c: str) -> int:
        """The state after one more character (kept once it is known)."""
        to = self._next[state].get(c)
        if to is None:
            to = self._next[state][c] = self._step(self._back[state], c) if state else 0
        return to

    @staticmethod
    def ended(word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + 0x1000)

    # ---- the trie
    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words (strings of byte symbols), in one depth-first pass over their trie."""
        found: dict[str, list[int]] = {}
        steps, ends, joins = self._next, self._ends, self._joins
        path, deep = "", 256
        # of the node at each depth of the path: automaton state, last token, its length
        state, last, size = [0] * deep, [-1] * deep, [0] * deep
        for word in sorted(words):
            n = len(word)
            if n >= deep:
                state, last, size = (x + [0] * (n + 1 - deep) for x in (state, last, size))
                deep = n + 1
            shared, top = 0, min(len(path), n - 1)
            while shared < top and path[shared] == word[shared]:
                shared += 1
            at = state[shared]
            marked = word if not self.end else self.ended(word)
            for depth in range(shared, n):
                c = marked[depth]
                to = steps[at].get(c)
                at = self._step(at, c) if to is None else to
                for token, length in ends[at]:
                    start = depth + 1 - length
                    if start:
                        ok = joins.get(last[start] << 20 | token)
                        if not (self.joins(last[start], token) if ok is None else ok):
                            continue
                    break
                else:
                    raise ValueError(f"no token ends {word[: depth + 1]!r}")
                state[depth + 1], last[depth + 1], size[depth + 1] = at, token, length
            path = word[:-1] if self.end else word
            ids = []
            while n:
                ids.append(last[n])
                n -= size[n]
            ids.reverse()
            found[word] = ids
        return found

    # ---- texts
    def chunks(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [c for c in _SPLIT_WHITE.split(text) if c]
        return text.split()

    def _symbols_of(self, part: str) -> list[str]:
        if part.isascii():
            if part.isalpha():
                return [part.lower()]
            if part[-1] in ".,!?" and part[:-1].isalpha():
                return [part[:-1].lower(), part[-1]]
            words = _PIECES.findall(part.lower())
            return words if part.isprintable() else [w.translate(self.symbols) for w in words]
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        if part.isalpha():
            return [part.encode().decode("latin-1").translate(self.symbols)]
        return [p.encode().decode("latin-1").translate(self.symbols) for p in _PIECES.findall(part)]

    def words_of(self, chunk: str) -> list[str | int]:
        """A chunk's words as byte symbols; a special string as its id."""
        if not self.special or "<" not in chunk or not self._special.search(chunk):
            return self._symbols_of(chunk)
        parts = self._special.split(chunk)
        return [w for p in parts if p for w in ([self.special[p]] if p in self.special else self._symbols_of(p))]

    def encode(self, text: str | None) -> list[int]:
        words = [w for c in self.chunks(text or "") for w in self.words_of(c)]
        ids = self.encode_words({w for w in words if isinstance(w, str)})
        return [i for w in words for i in (ids[w] if isinstance(w, str) else (w,))]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings, joined by one space (the file names no decoder)."""
        return " ".join([self.token[i] for i in ids])


_ENCODERS: dict[int, TrieBpe] = {}


def encoder_of(spec: str) -> TrieBpe:
    """This process's encoder of a vocabulary."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieBpe(spec)
    return _ENCODERS[key]


# ------------------------------------------------------------------ texts as flat arrays
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
#: An apostrophe may begin a piece of its own kind, and < a special string: left to the encoder.
_CLASS[[0x27, 0x3C]] = _OTHER


class PieceIds:
    """Ids of texts in flat arrays. Distinct pieces are encoded once while they are remembered."""

    def __init__(self, spec: str):
        self.encoder = encoder_of(spec)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes, and of each the place and number of its ids
        self.place = np.zeros((0, 2), np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hash, plain) of all pieces: runs of letters, runs of signs, digits each; a word
        with anything else is one piece, not plain."""
        kind, low = _CLASS[data], C._LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, but for the two signs among them
        tail = data[lead + 1]
        lead, tail = lead[(tail != 0x97) & (tail != 0xB7)], tail[(tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        capital = tail < 0x9F
        low[lead[capital] + 1] += 0x20
        words = C.Words(data, offsets)
        odd = np.zeros(len(words.starts), bool)
        strange = np.flatnonzero(kind == _OTHER)
        odd[np.searchsorted(words.starts, strange, "right") - 1] = True
        length = words.ends - words.starts
        inside = np.repeat(odd, length)  # by byte of all words
        at = np.flatnonzero(kind != _SPACE)
        starts = np.zeros(len(data), bool)
        of = kind[at]
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (of[1:] == _DIGIT)
        new &= ~inside
        starts[at[new]] = True
        starts[words.starts] = True
        starts = np.flatnonzero(starts)
        word = np.searchsorted(words.starts, starts, "right") - 1
        ends = words.ends[word]
        ends[:-1] = np.minimum(ends[:-1], starts[1:])
        plain = ~odd[word]
        raw = np.repeat(odd, length)
        values = C._BYTE_VALUE[low]
        values[at[raw]] = C._BYTE_VALUE[data[at[raw]]]
        hashes = C.range_hash(values, starts, ends)
        hashes[~plain] ^= np.uint64(1 << 63)
        return starts, ends, hashes, plain

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, hashes: np.ndarray) -> None:
        """Remembers new pieces; ``hashes`` rise."""
        whole, symbols, words = data.tobytes(), self.encoder.symbols, []
        for a, b, p in zip(starts.tolist(), ends.tolist(), plain.tolist()):
            piece = whole[a:b]
            if p:
                words.append([(piece.lower() if piece.isascii() else piece.decode().lower().encode()).decode("latin-1").translate(symbols)])
            else:
                words.append([w for c in self.encoder.chunks(piece.decode()) for w in self.encoder.words_of(c)])
        ids = self.encoder.encode_words({w for ws in words for w in ws if isinstance(w, str)})
        runs = [ids[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else [i for w in ws for i in (ids[w] if isinstance(w, str) else (w,))] for ws in words]
        count = np.fromiter(map(len, runs), np.int64, len(runs))
        place = np.column_stack([self.used + np.cumsum(count) - count, count])
        total = int(count.sum())
        if self.used + total >= len(self.ids):  # one more than used is always there, for the end id
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + total, np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(runs), np.uint32, total)
        self.used += total
        at = np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, at, hashes), np.insert(self.place, at, place, 0)

    def of_texts(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts given as bytes and offsets; ``end`` closes each, if given."""
        n = len(offsets) - 1
        if not len(data):
            return (np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)) if end is None else (np.full(n, end, np.uint32), np.arange(n + 1))
        starts, ends, hashes, plain = self._pieces(data, offsets)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > PIECES:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            self._learn(data, starts[first[new]], ends[first[new]], plain[first[new]], distinct[new])
        place = self.place[np.searchsorted(self.known, distinct)]
        place = place[which]
        bound = np.searchsorted(starts, offsets[1:])  # pieces before each text's end
        if end is not None:  # one more piece after each text's, of the place after the last
            self.ids[self.used] = end
            place = np.insert(place, bound, (self.used, 1), 0)
            bound = bound + np.arange(1, n + 1)
        count = place[:, 1]
        upto = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(place[:, 0] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, np.concatenate(([0], upto[bound]))


_PIECE_IDS: dict[int, PieceIds] = {}


def piece_ids_of(spec: str) -> PieceIds:
    """This process's piece ids of a vocabulary."""
    key = hash(spec)
    if key not in _PIECE_IDS:
        _PIECE_IDS[key] = PieceIds(spec)
    return _PIECE_IDS[key]


def releasing(batches: Iterable[pa.RecordBatch], spec: str) -> Iterable[pa.RecordBatch]:
    """``batches``; at their end the pieces are dropped, as the worker may serve other stages next."""
    yield from batches
    _PIECE_IDS.pop(hash(spec), None)
    C.give_back()


def id_runs(column: pa.Array, pieces: PieceIds) -> Iterable[tuple[int, list[np.ndarray]]]:
    """(first row, each text's ids) of runs of about C.CHUNK_BYTES."""
    data, offsets = C.text_bytes(column)
    for lo, hi in C.chunks(offsets):
        ids, at = pieces.of_texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, [ids[i:j] for i, j in zip(at[:-1], at[1:])]


def vocabulary_text(path: str) -> str:
    """The vocabulary file, read by the driver and broadcast (its size does not follow the input)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded for each row of ``docs`` (doc_id, text)."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary or default_vocabulary()))

    def run(batches):
        pieces = piece_ids_of(spec.value)
        for batch in releasing(batches, spec.value):
            for lo, ids in id_runs(batch.column("text"), pieces):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(ids)), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([pieces.encoder.decode(x.tolist()) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text)."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary or default_vocabulary()))

    def run(batches):
        pieces = piece_ids_of(spec.value)
        token = pieces.encoder.token
        number = {i: str(i) for i in token}
        for batch in releasing(batches, spec.value):
            for lo, texts in id_runs(batch.column("text"), pieces):
                one, two = [], []
                for ids in texts:
                    each = ids.tolist()
                    one.append(hashlib.sha256(" ".join(map(number.__getitem__, each)).encode()).hexdigest())
                    two.append(hashlib.sha256(" ".join(map(token.__getitem__, each)).encode()).hexdigest())
                count = pa.array([len(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), count, pa.array(one, pa.string()), pa.array(two, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(C.table(spark, sf_dir, "documents"))
