"""Exact n-gram Jaccard join by PartEnum signatures.

A text's set holds its distinct shingles (five consecutive words; a shorter text is one shingle).
Two sets a, b are linked when |a & b| / |a | b| >= 3/4, that is when their Hamming distance is at
most (|a| + |b|) / 7.

Signatures. Sets fall into size bands (the powers of two). A pair is looked for in the band of its
larger set, so a set signs for its own band and, when a partner may be larger than that, for the
next. In a band of at most R shingles the shingle domain is cut into about 0.35 R partitions, and
each partition that holds shingles of the set gives one signature: the hash of (band, partition,
the shingles in it). A partition in which two sets differ costs at least one unit of distance, so
sets within distance k agree on all but k partitions; a set with more than k occupied partitions
shares a signature with each of its partners. A set with no more than k (a rare case of small
sets) signs its empty partitions too, so that two such sets still meet. No link is lost.

Candidates. A signature of at most HOT sets gives its pairs; pairs are counted over all signatures, and
linked sets share at least `need` = occupied partitions - k of them, so most chance pairs end there.
A signature of more sets is hot: its members are only counted, and paired with the smallest of
them (in a map task's flush already, so a third of all rows under one signature sends a few rows). A
set with fewer hot signatures than `need` is light: it meets each partner at a signature that isn't hot.
Only pairs of two heavy sets can have nothing but hot signatures in common. They are linked through
the smallest members; where such pairs fail, `heavy_links` takes the sets they join and compares them
in blocks, by bit maps whose differences never exceed the sets', and exactly where those are near; a
block gives fewer links than it has sets. All other candidates are compared exactly, by their texts, and
the links are closed to components.

Nulls and edge cases: a null or empty text (or one of white space) has no shingles and is linked
with nothing; a null id is kept, as a row of its own that links with nothing; equal texts are one
class; repeated ids are one text for each different content and carry the smallest component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm import common as C
from revcast.llm.components import components

WIDTH = 5
#: A signature of more sets than this is hot.
HOT = 12
_SET_SALT = np.uint64(0x5851F42D4C957F2D)
_EMPTY_SALT = np.uint64(0x14057B7EF767814F)


# ------------------------------------------------------------------ sets and signatures (numpy, one pass)
def shingle_sets(words: C.Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all distinct shingles, by text and hash."""
    at, text = words.text_of(width)
    value = words.windows(at, width)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        value = np.concatenate([value, C.range_hash(words.hash, words.first[short], words.first[short] + words.count[short])])
        text = np.concatenate([text, short])
    order = C.by_text_and_value(value, text)
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[new], value[new]


def sums_of(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums (mod 2**64) of the runs that begin at ``first``."""
    return np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64)


def band_of(size: np.ndarray) -> np.ndarray:
    """Smallest e with 2**e >= size."""
    return np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)


def signatures(text: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, signature, band, need) for each band in turn.

    ``need``: signatures that a linked set shares at least with this one (1 for a set that also
    signs empty partitions).
    """
    size = np.bincount(text, minlength=int(text[-1]) + 1 if len(text) else 0)
    mixed = C.mix(value ^ _SET_SALT)
    own = band_of(size)
    larger = size * 4 // 3 > (1 << own)
    for up in (0, 1):
        used = (size > 0) & (larger if up else True)
        keep = used[text]
        t, v, m = text[keep], value[keep], mixed[keep]
        if not len(t):
            continue
        band = own + up
        parts = (0.35 * (1 << band)).astype(np.int64) + 3
        part = ((v >> np.uint64(32)) * parts[t].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (part[1:] != part[:-1]))))
        ft, fp = t[first], part[first]
        tag = C.mix((band[ft].astype(np.uint64) << np.uint64(40)) + fp.astype(np.uint64))
        sig = C.mix(sums_of(m, first) + tag)
        occupied = np.bincount(ft, minlength=len(size))
        away = (size + np.minimum(1 << band, size * 4 // 3)) // 7
        few = used & (occupied <= away)
        need = np.where(few, 1, occupied - away)
        yield ft, sig, band[ft], need[ft]
        for x in np.flatnonzero(few):
            empty = np.setdiff1d(np.arange(parts[x]), fp[ft == x])
            tag = C.mix((np.uint64(band[x]) << np.uint64(40)) + empty.astype(np.uint64))
            yield np.full(len(empty), x), C.mix(tag ^ _EMPTY_SALT), np.full(len(empty), band[x]), np.ones(len(empty), np.int64)


def _set_rows(batches):
    """doc_id, n_shingles, a 128-bit hash of each text's set, and the least `need` of its bands."""
    for batch in batches:
        n = batch.num_rows
        size, one, two, need = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, 1 << 40)
        for lo, hi, words in C.word_chunks(batch, "text", lower=True):
            text, value = shingle_sets(words)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            size[lo:hi] = np.bincount(text, minlength=hi - lo)
            one[lo + text[first]] = sums_of(C.mix(value ^ _SET_SALT), first)
            two[lo + text[first]] = sums_of(C.mix(value ^ _EMPTY_SALT), first)
            for t, _, _, least in signatures(text, value):
                np.minimum.at(need, lo + t, least)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(need)],
                                         names=["doc_id", "n_shingles", "h1", "h2", "need"])


#: Rows of the reduced signatures: pairs (x, y) with the number of shared signatures, x and the
#: smallest member y of a hot signature, and the number of hot signatures of x.
PAIR, HOT_PAIR, HOT_COUNT = 0, 1, 2
_REDUCED = "kind int, x long, y long, n long"


class Tally:
    """Adds up (kind, x, y, n)."""

    def __init__(self):
        self.parts, self.held, self.most = [], 0, 2 * C.FLUSH

    def add(self, kind: int | np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray | int = 1) -> None:
        if len(x):
            self.parts.append((np.full(len(x), kind), x, y, np.broadcast_to(n, len(x))))
            self.held += len(x)
            if self.held > self.most:
                self.parts = [self.summed()]
                self.held = len(self.parts[0][0])
                self.most = 2 * C.FLUSH + 2 * self.held

    def summed(self):
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        kind, x, y, n = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((y, x, kind))
        kind, x, y, n = kind[order], x[order], y[order], n[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (kind[1:] != kind[:-1])
        first = np.flatnonzero(new)
        return kind[first], x[first], y[first], np.add.reduceat(n, first)


def _members(sig, doc, flag):
    """Distinct (sig, doc) in order, the runs of equal sig, and whether each is hot."""
    order = np.lexsort((doc, sig))
    sig, doc, flag = sig[order], doc[order], flag[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
    start, length = C.runs_of(sig[new])
    hot = (length > HOT) | (np.maximum.reduceat(flag, np.flatnonzero(new)[start]) > 0)
    return sig[new], doc[new], start, length, hot


def _hot_members(doc, start, length, hot, tally: Tally) -> None:
    """Counts the members of hot signatures and pairs them with the smallest."""
    in_hot = np.repeat(hot, length)
    center = np.repeat(doc[start], length)[in_hot]
    member = doc[in_hot]
    tally.add(HOT_COUNT, member, np.zeros(len(member), np.int64))
    other = member != center
    tally.add(HOT_PAIR, member[other], center[other])


def _map_signatures(buckets: int):
    """Packed (signature, doc); a signature that is hot in a flush already sends its smallest member
    (marked), and its members' counts and pairs (kinds 1 to 4) in place of them."""

    def flush(sigs, docs):
        sig = np.concatenate(sigs)
        sig, doc, start, length, hot = _members(sig, np.concatenate(docs), np.zeros(len(sig), np.int32))
        tally = Tally()
        _hot_members(doc, start, length, hot, tally)
        kind, x, y, n = tally.summed()
        in_hot = np.repeat(hot, length)
        yield from C.pack(sig[~in_hot], doc[~in_hot], np.zeros(int((~in_hot).sum()), np.int32), buckets)
        yield from C.pack(sig[start[hot]], doc[start[hot]], np.ones(int(hot.sum()), np.int32), buckets)
        for k in (HOT_PAIR, HOT_COUNT):
            pick = kind == k
            # the smallest member counts where its signature is reduced
            yield from C.pack(C.mix(x[pick].astype(np.uint64)), x[pick], n[pick], buckets, k, y[pick])
        own = doc[start[hot]]
        yield from C.pack(C.mix(own.astype(np.uint64)), own, np.full(len(own), -1), buckets, HOT_COUNT, np.zeros(len(own), np.int64))

    def run(batches):
        sigs, docs, held, seen = [], [], 0, set()
        for batch in batches:
            ids = C.int_column(batch.column("doc_id"))
            for lo, _, words in C.word_chunks(batch, "text", lower=True):
                text, value = shingle_sets(words)
                first = np.flatnonzero(np.diff(text, prepend=-1))
                new = np.zeros(len(words.count), bool)
                for x, h in zip(text[first].tolist(), sums_of(C.mix(value ^ _SET_SALT), first).tolist()):
                    if h not in seen:  # equal sets of a flush sign once
                        seen.add(h)
                        new[x] = True
                keep = new[text]
                for t, sig, _, _ in signatures(text[keep], value[keep]):
                    sigs.append(sig)
                    docs.append(ids[lo + t])
                    held += len(sig)
                if held >= C.FLUSH:
                    yield from flush(sigs, docs)
                    sigs, docs, held, seen = [], [], 0, set()
        if held:
            yield from flush(sigs, docs)

    return run


def _reduce_signatures(buckets: int):
    """Packed sums of (kind, x, y, n) over a task's signatures, by x."""

    def run(batches):
        tally = Tally()
        for kinds in C.unpack(batches):
            for k in (HOT_PAIR, HOT_COUNT):
                if k in kinds:
                    _, x, n, y = kinds[k]
                    tally.add(k, x, y, n.astype(np.int64))
            if PAIR not in kinds:
                continue
            _, doc, start, length, hot = _members(*kinds[PAIR][:3])
            _hot_members(doc, start, length, hot, tally)
            for m in range(2, HOT + 1):
                at = start[~hot & (length == m)]
                if len(at):
                    one, two = np.triu_indices(m, 1)
                    tally.add(PAIR, doc[(at[:, None] + two).ravel()], doc[(at[:, None] + one).ravel()])
        kind, x, y, n = tally.summed()
        for k in (PAIR, HOT_PAIR, HOT_COUNT):
            pick = kind == k
            yield from C.pack(C.mix(x[pick].astype(np.uint64)), x[pick], n[pick], buckets, k, y[pick])

    return run


def _sum_reduced(batches):
    """Rows of _REDUCED, summed over all tasks."""
    for kinds in C.unpack(batches):
        tally = Tally()
        for k, (_, x, n, y) in kinds.items():
            tally.add(k, x, y, n.astype(np.int64))
        kind, x, y, n = tally.summed()
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(x), pa.array(y), pa.array(n)], names=["kind", "x", "y", "n"])


# ------------------------------------------------------------------ verification
def _verify(percent: int):
    """Keeps the pairs whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = [C.text_bytes(batch.column(c)) for c in ("tx", "ty")]
            for lo, hi in C.chunks(sides[0][1] + sides[1][1]):
                sets = [shingle_sets(C.Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)) for data, at in sides]
                size = [np.bincount(t, minlength=hi - lo) for t, _ in sets]
                text, value = (np.concatenate([sets[0][i], sets[1][i]]) for i in (0, 1))
                order = C.by_text_and_value(value, text)
                text, value = text[order], value[order]
                both = np.flatnonzero((text[1:] == text[:-1]) & (value[1:] == value[:-1]))
                common = np.bincount(text[both], minlength=hi - lo)
                keep[lo:hi] = 100 * common >= percent * (size[0] + size[1] - common)
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    return run


def verified(docs: DataFrame, pairs: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (x, y) of ids whose texts are linked. Only texts of ids in a pair are shuffled."""
    nodes = pairs.select(F.col("x").alias("doc_id")).unionAll(pairs.select(F.col("y").alias("doc_id"))).distinct()
    maybe = C.may_match(nodes, "doc_id")
    texts = docs.select("doc_id", "text").filter(maybe(F.col("doc_id")))
    one = pairs.join(texts.toDF("x", "tx"), "x")
    two = one.join(texts.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")
    return two.mapInArrow(_verify(percent), "x long, y long").distinct()


# ------------------------------------------------------------------ heavy sets among themselves
#: Classes of exact copies with over a HOT_CLASSES-th of all rows, and over CLASS_ROWS, join apart from the others.
HOT_CLASSES, CLASS_ROWS = 1024, 64
#: Bytes of shingle hashes in a block of heavy sets.
HEAVY_BLOCK = 8 << 20
#: Bits of a set's bit map for each shingle of a mean set.
MAP_BITS = 16
_HEAVY = "doc_id long, component long, hub long, blocks int, block int, shingles binary"


def _heavy_sets(batches):
    """The texts' sets, as sorted hashes."""
    for batch in batches:
        held = []
        for lo, hi, words in C.word_chunks(batch, "text", lower=True):
            text, value = shingle_sets(words)
            first = np.searchsorted(text, np.arange(hi - lo + 1))
            held += [value[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "component", "hub", "blocks", "block")), pa.array(held, pa.binary())],
                                         names=["doc_id", "component", "hub", "blocks", "block", "shingles"])


def bit_maps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set, each shingle turning one bit: two rows differ in no more bits
    than the sets in shingles."""
    bits = max(64, 1 << (MAP_BITS * sum(map(len, sets)) // max(1, len(sets))).bit_length())
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        at = s & np.uint64(bits - 1)
        np.bitwise_xor.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def spanning_links(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components (two sides: only across), as few as join what the links
    join. Pairs are told apart by their bit maps, and compared exactly where those are near enough."""
    root = np.unique(component, return_inverse=True)[1].reshape(-1)
    size = np.array([len(s) for s in sets], np.int64)
    across = bool(side.any()) and not side.all()
    maps, links = bit_maps(sets), []
    for i in range(len(sets) - 1):
        if not size[i]:
            continue
        rest = np.arange(i + 1, len(sets))
        rest = rest[(root[rest] != root[i]) & (side[rest] != side[i] if across else True)]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        away = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j in rest[(100 + percent) * away <= (100 - percent) * (size[rest] + size[i])].tolist():
            if root[j] != root[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    links.append((i, j))
                    root[root == root[j]] = root[i]
    return links


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        ids, component, block = (table.column(c).to_numpy() for c in ("doc_id", "component", "block"))
        order = np.argsort(component, kind="stable")
        links = spanning_links([sets[k] for k in order], component[order], block[order] != block.min(), percent)
        x, y = (ids[order[[link[k] for link in links]]] if links else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def heavy_links(docs: DataFrame, around: DataFrame, percent: int = 75) -> DataFrame:
    """Links (x, y) that join the components of ``around`` (doc_id, component, hub, n_shingles) as far as
    links between its sets, of one hub each, do.

    A hub's sets fall into blocks by a hash, of about HEAVY_BLOCK bytes whatever the hub's size, and each
    pair of blocks is one group: what a task holds is bounded, and it gives fewer links than it has sets.
    """
    blocks = around.groupBy("hub").agg(F.ceil(F.sum("n_shingles") * 8 / HEAVY_BLOCK).cast("int").alias("blocks"))
    dealt = around.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    maybe = C.may_match(around, "doc_id")
    texts = docs.select("doc_id", "text").filter(maybe(F.col("doc_id"))).distinct().join(dealt.select("doc_id", "component", "hub", "blocks", "block"), "doc_id")
    sets = texts.mapInArrow(_heavy_sets, _HEAVY)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = sets.select("doc_id", "component", "hub", "block", "shingles", other)
    paired = paired.select("doc_id", "component", "hub", "block", "shingles", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    return paired.groupBy("hub", "one", "two").applyInArrow(_block_links(percent), "x long, y long")


# ------------------------------------------------------------------ the operator
def label_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components (an end without a label is its own)."""
    for c in ("x", "y"):
        pairs = pairs.join(labels.toDF(c, f"c{c}"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return pairs.filter("cx != cy").select("x", "y", "cx", "cy")


def large_classes(reps: DataFrame) -> DataFrame | None:
    """h1, h2, class_id of the classes of exact copies with over a HOT_CLASSES-th of all rows (so there are fewer
    than HOT_CLASSES), or None."""
    total = reps.agg(F.sum("n")).first()[0] or 0
    rows = reps.filter(F.col("n") > max(total // HOT_CLASSES, CLASS_ROWS)).select("h1", "h2", "class_id").collect()
    return reps.sparkSession.createDataFrame(rows, "h1 long, h2 long, class_id long") if rows else None


def join_split(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row for each key); rows with one of the few keys in ``hot`` stay where they are."""
    if hot is None:
        return rows.join(table, keys, "left")
    hot = F.broadcast(hot.select(*keys))
    few = F.broadcast(table.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_anti").join(table, keys, "left").unionByName(rows.join(hot, keys, "left_semi").join(few, keys, "left"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for each row of ``docs`` (doc_id, text).

    class_id: smallest id with the same set. ``percent`` is 75 or more.
    """
    spark = docs.sparkSession
    docs = C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = C.checkpointed(docs.mapInArrow(_set_rows, "doc_id long, n_shingles long, h1 long, h2 long, need long"))
    some = sets.filter("n_shingles > 0 and doc_id is not null")
    # equal sets: one representative each (a group-by with map-side minimum, so a huge class is no hot key)
    counted = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    reps, large = counted.drop("n"), large_classes(counted)
    member = join_split(some, reps, ["h1", "h2"], large).select("doc_id", "class_id", "n_shingles", "need").distinct()

    buckets = C.bucket_count(spark)
    packed = docs.filter("doc_id is not null").mapInArrow(_map_signatures(buckets), C.PACKED)
    reduced = C.meet(packed).mapInArrow(_reduce_signatures(buckets), C.PACKED)
    met = C.checkpointed(C.meet(reduced).mapInArrow(_sum_reduced, _REDUCED))
    hots = met.filter(F.col("kind") == HOT_COUNT).select(F.col("x").alias("doc_id"), F.col("n").alias("hots"))
    member = C.checkpointed(member.join(hots, "doc_id", "left").withColumn("cold", F.col("need") - F.coalesce("hots", F.lit(0))))

    # linked sets share as many signatures that are not hot as either lacks to be heavy
    def ends(pairs: DataFrame) -> DataFrame:
        for c in ("x", "y"):
            pairs = pairs.join(member.select(F.col("doc_id").alias(c), F.col("class_id").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"), F.col("cold").alias(f"cold_{c}")), c)
        return pairs.filter("rx != ry")

    pairs = ends(met.filter(F.col("kind") != HOT_COUNT))
    hot = C.checkpointed(pairs.filter(F.col("kind") == HOT_PAIR).select(F.col("rx").alias("x"), F.col("ry").alias("y"), "nx", "ny", "cold_x", "cold_y").distinct())
    alike = F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    near = pairs.filter((F.col("kind") == PAIR) & (F.col("n") >= F.greatest("cold_x", "cold_y"))).filter(alike).select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    near = near.unionByName(hot.filter("cold_x <= 0 and cold_y <= 0").filter(alike).select("x", "y"))
    near = C.checkpointed(near.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())

    # ids that stand in several rows with different texts hold their classes together
    several = member.groupBy("doc_id").agg(F.min("class_id").alias("y"), F.max("class_id").alias("z")).filter("y != z")
    edges = member.join(several, "doc_id").select(F.col("class_id").alias("x"), "y").filter("x != y")
    edges = C.checkpointed(edges.unionByName(verified(docs, near, percent)))
    labels = C.checkpointed(components(edges))

    # heavy sets may be linked through hot signatures only: a way over hot pairs leaves a component by
    # failed ones, so the components that those join are a hub, and its heavy sets meet among themselves
    failed = C.checkpointed(label_pairs(hot.select("x", "y"), labels).select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct())
    if not failed.isEmpty():
        hubs = components(failed)
        heavy = member.filter("cold <= 0").groupBy("class_id").agg(F.max("n_shingles").alias("n_shingles"))
        heavy = heavy.join(labels.toDF("class_id", "component"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        around = C.checkpointed(heavy.join(hubs.toDF("component", "hub"), "component").select(F.col("class_id").alias("doc_id"), "component", "hub", "n_shingles"))
        found = C.checkpointed(heavy_links(docs, around, percent))
        if not found.isEmpty():
            labels = components(edges.unionByName(found))

    label = join_split(member, labels.toDF("class_id", "component"), ["class_id"], large)
    label = label.groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    out = join_split(some, reps, ["h1", "h2"], large).join(label, "doc_id").select("doc_id", "n_shingles", "component_id", "class_id")
    # without words or an id a row stands for itself, and meets no other
    alone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id's.

    A row without an id goes by its text, behind all rows with one. Of rows that repeat an id and text one
    stays; different texts of one id stay both.
    """
    key, role = C.free_name(docs, "__key"), C.free_name(docs, "__role")
    keyed = docs.withColumn(key, C.id_or_text(F.col("doc_id"), F.col("text")))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent)
    roles = found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    gone = F.col("least") != F.col("doc_id")
    roles = C.checkpointed(roles.filter(gone | (F.col("n") > 1)).select(F.col("doc_id").alias(key), F.when(gone, "gone").otherwise("repeated").alias(role)))
    rows = keyed.join(roles, key, "left")
    kept = rows.filter(F.col(role).isNull()).select(*docs.columns)
    return kept.unionByName(rows.filter(F.col(role) == "repeated").dropDuplicates([key, "text"]).select(*docs.columns))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))


#: Components by repeated minimum over the links (DuckDB).
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id WHERE reach.r < l.b)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, k.c AS class_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m USING (doc_id)
JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN k IS NULL THEN CAST(doc_id AS VARCHAR) ELSE k END) AS c
      FROM documents LEFT JOIN (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS k FROM shingles GROUP BY 1) USING (doc_id)) k USING (doc_id)
"""
