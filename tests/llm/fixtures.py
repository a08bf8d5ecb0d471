"""Small tables with the awkward cases, and plain re-implementations of what the operators promise."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, slot int, row string, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rnd = random.Random(seed)
    syllables = ["tha", "on", "er", "ré", "ß", "lin", "mo", "da", "Ki", "su", "pe", "ö", "vat", "ne"]
    return [("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))) for _ in range(n)]


def texts():
    """(id, text) pairs: nulls, empties, ties, repeated rows, copies, near copies, shared passages, a long text."""
    base = prose(1, 240)
    passage = prose(2, 64)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "A b c D"), (None, "no id but words here"), (None, None)]
    rows += [(10, " ".join(base)), (11, " ".join(base)), (12, "\n".join(base)), (13, " ".join(base[:235] + prose(3, 5)))]
    for i in range(8):  # near copies with more and more changes
        words = list(base)
        rnd = random.Random(i)
        for _ in range(2 * i):
            words[rnd.randrange(len(words))] = f"x{rnd.random()}"
        rows.append((20 + i, " ".join(words)))
    for i in range(30):  # a passage that many hold, in front, amid and at the end
        own = prose(100 + i, 40 + 5 * i)
        cut = (i * 7) % (len(own) + 1)
        rows.append((40 + i, " ".join(own[:cut] + passage + own[cut:])))
    rows.append((80, " ".join(passage[:49])))
    rows.append((81, " ".join(passage[3:53])))
    rows.append((90, "SPAM! " * 300))
    rows.append((91, "spam! " * 299))
    rows.append((92, "###&&& a$$$ b%%% " * 60))
    rows.append((93, " ".join(prose(7, 30_000))))
    rows.append((94, "x" * 70_000))
    rows.append((95, "Released under the MIT\nLicense. mit license, Apache-License; the GNU General Public License"))
    rows.append((96, "line one here\nline one here\n\nline two\nline one here"))
    rows.append((97, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General, version 3 Public."))
    rows.append((98, "This work is licensed under the GNU Public License, version 3."))
    rows += [(10, " ".join(base)), (4, "one")]  # repeated rows
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", f"src{(i or 0) % 2}", None if t is None else len(t), 0.5, 7, "r", True) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(5, F.xxhash64("text"))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(rows):
    """{id: smallest id reachable} by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {i: top(i) for i in up}


def kept_words(rows):
    """{id: (words, kept words)} by all windows."""
    words = {i: WORD.findall(t or "") for i, t in rows if i is not None}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s : s + 50]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        out[i] = (w, [x for p, x in enumerate(w) if p not in gone])
    return out


def contaminated(rows, items):
    """{(id, item): best similarity} over all item-sized windows."""
    out = {}
    bags = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        if item is not None and len(w) >= 5:
            bags[item] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for i, text in rows:
        w = WORD.findall(lower(text))
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for item, bag in bags.items():
            m = sum(bag.values())
            near = {k for k, g in enumerate(grams) if g in bag}
            for s in {min(max(k - d, 0), max(len(grams) - m, 0)) for k in near for d in range(m)}:
                window = Counter(grams[s : s + m])
                common = sum((window & bag).values())
                total = sum((window | bag).values())
                if i is not None and 100 * common >= 75 * total:
                    out[i, item] = max(out.get((i, item), 0), common / total)
    return out
