"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check (native).

Words are runs of other than white space, A-Z lowered; shingles are five words. A text is
contaminated by a benchmark item when a window of as many words as the item has (the whole text,
if that is shorter) has a weighted shingle similarity of 0.75 or more to it: the sum of the smaller
over the sum of the larger counts of each shingle.

1. Seeds. A similar window holds no more than a seventh of foreign shingles, so it has an item's
   shingle at one of its probed positions (every fourth, for items of 15 words or more). Texts
   without one are done after this pass.
2. Windows. Moving a window to the right until it begins with a shingle of an item of its size loses
   none, so only windows that begin with one (and the last window of the text) are looked at, and of
   them only those in which the shingles of such items suffice for the similarity.
3. SimHash. Each window gets a 64-bit fingerprint of its shingles, each numbered by its occurrence in
   the window: repeats are members of a set of their own and don't weigh on the same bits. Bits are
   counted sixteen at a time, in the four 16-bit lanes of one long.
4. Blocks. Fingerprints within RADIUS = 17 bits agree to 2 bits in one of six blocks of 10 or 11
   bits. The index holds, for each item and block, all values within 2 bits (380 rows an item), so an
   equality join on (size, block, value) guarantees every pair within the radius. Windows of similarity
   0.75 differ in 11 bits in the mean, with a deviation of 3, so the radius loses about one in seventy of
   those that just meet the threshold, and next to none above 0.8 (measured in the tests).
5. With ``exact``, also pairs by held shingles: a similar window lacks the item's shingles at `spare`
   positions at most, so one of its first spare + 1 positions holds one. No pair depends on its
   fingerprint then.
6. Check. The pairs are compared shingle by shingle.

Equal windows are one row from step 3 on, so a passage that a third of all texts hold is compared
once. Nothing is broadcast by hint; the planner takes the benchmark's side while it is small.

Nulls and edge cases: a null or empty text has no words and matches nothing; texts and items of
fewer than five words have no shingle and match nothing; items of over 16,383 words are found by
step 5, which they always take; rows without doc_id or item_id are not reported; rows that repeat an
id count as texts of that id; equal items each have their own pairs; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import checkpointed, free_name, id_or_text, may_match, table

WIDTH = 5
PERCENT = 75
RADIUS = 17
#: (first bit, bits) of each block; RADIUS // 6 = 2 bits may differ in one of them.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
SLACK = RADIUS // len(BLOCKS)
LANES = 16
_LANE_ONES = 0x0001000100010001
_LANE_OVER = 0x4000400040004000
#: Shingles that a lane can count.
LONGEST = 0x3FFF

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered."""
    bare = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingles(column: str, step: int = 1) -> Column:
    """Hashes of the five-word shingles at every ``step``-th position of an array of words."""
    at = F.sequence(F.lit(1), F.size(column) - WIDTH + 1, F.lit(step))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(column, i, WIDTH)))
    return F.when(F.size(column) >= WIDTH, hashes).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def numbered(hashes: Column) -> Column:
    """Different hashes for the occurrences of each hash: the first one's is the hash itself."""

    def number(ordered):
        n = F.size(ordered) - 1
        again = F.filter(F.zip_with(F.slice(ordered, 1, n), F.slice(ordered, 2, n), lambda x, y: F.when(x == y, y)), lambda x: x.isNotNull())
        return F.concat(F.array_distinct(ordered), _let(again, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, i - F.array_position(a, x)))))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(_let(F.sort_array(hashes), number))


def _lane_counts(hashes: Column, k: int) -> Column:
    """How many of the hashes have bit k, 16 + k, 32 + k and 48 + k, in the lanes of a long."""
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANE_ONES)))


def fingerprint(hashes: Column) -> Column:
    """SimHash of an array of hashes: bit b is set when more than half of them have it."""
    half = F.floor(F.size(hashes) / 2).cast("bigint")
    bits = F.lit(0).cast("bigint")
    for k in range(LANES):
        over = (_lane_counts(hashes, k) + (F.lit(LONGEST) - half) * F.lit(_LANE_ONES)).bitwiseAND(F.lit(_LANE_OVER))
        bits = bits.bitwiseOR(F.shiftrightunsigned(over, 14 - k) if k <= 14 else F.shiftleft(over, 1))
    return bits


def block_values(bits: Column) -> list[Column]:
    return [F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << size) - 1)).cast("int") for first, size in BLOCKS]


def _near_masks(size: int) -> list[int]:
    return [sum(1 << b for b in chosen) for n in range(SLACK + 1) for chosen in combinations(range(size), n)]


def _near(block: int, size: int, value: Column) -> Column:
    """(block, value) for all values within SLACK bits."""
    masks = F.array(*map(F.lit, _near_masks(size)))
    return F.transform(masks, lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))


def overlap(one: str, two: str) -> Column:
    """Sum of the smaller counts of the values of two arrays."""
    common = F.array_intersect(one, two)
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    plain = (F.size(F.array_distinct(one)) == F.size(one)) | (F.size(F.array_distinct(two)) == F.size(two))
    counted = F.aggregate(common, F.lit(0), lambda a, x: a + F.least(times(one, x), times(two, x)))
    return F.when(plain, F.size(common)).otherwise(counted)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, size (words), hashes, bits of the items that have a shingle."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.select("item_id", F.size("w").alias("size"), shingles("w").alias("hashes")).filter(F.size("hashes") > 0)
    return items.withColumn("set", numbered(F.col("hashes"))).withColumn("bits", fingerprint(F.col("set"))).drop("set")


def _least_held(span: Column, size: Column) -> Column:
    """Positions of a window of ``span`` shingles that hold a shingle of an item of ``size`` words, if they are similar."""
    return F.ceil(PERCENT * (span + size - WIDTH + 1) / (100 + PERCENT)).cast("int")


def _holding(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows and items that share one of the window's first shingles, whatever their fingerprints."""
    spare = F.size("window") - _least_held(F.size("window"), F.col("size"))
    first = windows.select("size", "content", F.explode(F.array_distinct(F.slice("window", F.lit(1), spare + 1))).alias("h"))
    return first.join(items.select("item_id", "size", F.explode(F.array_distinct("hashes")).alias("h")), ["size", "h"]).select("size", "content", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) for each contaminated text and item: the best
    window's similarity and its start (words from 0; the first of equal ones that begin with an item's shingle).
    ``exact``: also the pairs whose fingerprints differ in more than RADIUS bits (step 5)."""
    items = checkpointed(benchmark_items(benchmark))
    known = items.select("size", F.explode("hashes").alias("h")).distinct()
    least = items.agg(F.min("size")).first()[0] or WIDTH
    shortest = -(-3 * (least - WIDTH + 1) // 4)  # shingles of the smallest window that can be similar
    step = 4 if shortest >= 8 else 3 if shortest >= 3 else 1

    split = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    probes = split.select("doc_id", F.explode(shingles("w", step)).alias("h"))
    seeded = checkpointed(probes.join(known.select("h").distinct(), "h", "left_semi").select("doc_id").distinct())

    # all hits of the seeded texts, as starts of windows of the hit items' sizes
    maybe = may_match(seeded, "doc_id")
    texts = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(maybe(F.col("doc_id"))).join(seeded, "doc_id", "left_semi")
                         .select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
                         .select("row", "doc_id", shingles("w").alias("hashes")))
    hits = texts.select("row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h")).join(known, "h")
    span = F.least(F.col("size") - WIDTH + 1, F.col("n"))  # shingles of the window
    spots = (hits.groupBy("row", "size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("pos")).alias("at"))
             .withColumn("span", span).withColumn("last", F.col("n") - F.col("span")).withColumn("held", _least_held(F.col("span"), F.col("size"))))
    # sorted positions: the window from the i-th one holds enough when it reaches the one `held` - 1 further on
    enough = lambda p, i: F.when(p <= F.col("last"), F.get("at", i + F.col("held") - 1) < p + F.col("span")).otherwise(
        F.get("at", F.size("at") - F.col("held")) >= F.col("last"))
    begins = F.array_distinct(F.filter(F.transform("at", lambda p, i: F.when(enough(p, i), F.least(p, F.col("last")))), lambda p: p.isNotNull()))
    starts = spots.select("row", "span", "size", F.explode(begins).alias("start"))
    windows = (starts.groupBy("row").agg(F.collect_list(F.struct("size", "span", "start")).alias("at")).join(texts, "row")
               .select("doc_id", "hashes", F.explode("at").alias("at"))
               .select("doc_id", "at.size", "at.start", F.slice("hashes", F.col("at.start") + 1, F.col("at.span")).alias("window"))
               .withColumn("content", F.xxhash64("window")))
    windows = checkpointed(windows)

    # fingerprints of the different windows against the items' blocks
    different = windows.select("size", "content", "window").distinct().withColumn("set", numbered(F.col("window"))).withColumn("bits", fingerprint(F.col("set"))).drop("set")
    values = F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(block_values(F.col("bits")))])
    near = F.concat(*[_near(i, size, v) for i, ((_, size), v) in enumerate(zip(BLOCKS, block_values(F.col("bits"))))])
    fits = F.col("size") <= LONGEST
    index = items.filter(fits).select("item_id", "size", F.col("bits").alias("item_bits"), F.inline(near))
    probe = different.filter(fits).select("size", "content", "bits", F.inline(values))
    met = (probe.join(index, ["size", "block", "value"]).filter(F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))) <= RADIUS)
           .select("size", "content", "item_id").distinct())

    by_shingles = items if exact else items.filter(~fits)
    met = met.unionByName(_holding(different, by_shingles)).distinct()
    pairs = met.join(different.select("size", "content", "window"), ["size", "content"]).join(items.select("item_id", "hashes"), "item_id")
    pairs = pairs.withColumn("common", overlap("window", "hashes")).withColumn("all", F.size("window") + F.size("hashes") - F.col("common"))
    alike = pairs.filter(100 * F.col("common") >= PERCENT * F.col("all")).select("size", "content", "item_id", (F.col("common") / F.col("all")).alias("similarity"))
    best = windows.select("doc_id", "size", "content", "start").join(alike, ["size", "content"])
    return (best.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
            .select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).cast("long").alias("first_word")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated; a row without an id is judged by its text."""
    key = free_name(docs, "__key")
    keyed = docs.withColumn(key, id_or_text(F.col("doc_id"), F.col("text")))
    found = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All windows that hold a shingle of the item are compared here, wherever they begin.
SQL = r"""
WITH words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark)),
shingles AS (
  SELECT kind, id, len(w) AS n, i, array_to_string(w[i+1:i+5], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(0, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
item AS (SELECT id AS item_id, n - 4 AS m, s, count(*) AS c FROM shingles WHERE kind = 'item' GROUP BY 1, 2, 3),
hits AS (SELECT d.id AS doc_id, item_id, m, d.n - 4 AS n, i, d.s, c FROM shingles d JOIN item USING (s) WHERE d.kind = 'doc'),
windows AS (
  SELECT DISTINCT doc_id, item_id, least(m, n) AS span, m, unnest(range(greatest(0, i - least(m, n) + 1), least(i, n - least(m, n)) + 1)) AS start FROM hits),
counts AS (
  SELECT w.doc_id, w.item_id, w.span, w.m, w.start, h.s, least(count(*), any_value(h.c)) AS c
  FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.i BETWEEN w.start AND w.start + w.span - 1 GROUP BY ALL),
alike AS (SELECT doc_id, item_id, start, any_value(m) AS m, any_value(span) AS span, sum(c) AS o, any_value(span + m) - sum(c) AS a FROM counts GROUP BY 1, 2, 3),
begins AS (SELECT DISTINCT doc_id, m, least(i, n - least(m, n)) AS start FROM hits),
best AS (SELECT doc_id, item_id, max(o / a) AS similarity FROM alike WHERE 100 * o >= 75 * a GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(min(start) AS BIGINT) AS first_word
FROM best JOIN alike USING (doc_id, item_id) JOIN begins USING (doc_id, m, start) WHERE o / a = similarity GROUP BY 1, 2, 3
"""
