"""Quantile metrics: exact grouped quantiles, pinball loss (M5), coverage (M6),
and the constant-quantile baseline evaluated over CV folds.

The baseline's quantiles are selected by histogram refinement over prefixes of the index.
``exact_quantiles`` follows the linear-interpolation definition
(``percentile`` / ``quantile_cont``) but needs no per-group value buffer: rows
are globally sorted by (group, value) and indexed, and only the two order
statistics around each requested position are joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.operators.splits import cv_fold_bounds, ordered_index


def exact_quantiles(df: DataFrame, group_cols: list[str], value: str, qs=K.QUANTILES) -> DataFrame:
    """(group..., quantile, value) with linear interpolation between order statistics."""
    # the random tie-breaker lets the range partitioner split a value shared by
    # a huge number of rows (equal values are interchangeable for quantiles)
    vals = (df.select(*group_cols, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
              .withColumn("_tie", F.rand(7)))
    ix = ordered_index(vals, [*group_cols, "_v", "_tie"], "_gidx")
    bounds = ix.groupBy(*group_cols).agg(F.min("_gidx").alias("_start"), F.count(F.lit(1)).alias("_n"))
    targets = (bounds.select(*group_cols, "_start", "_n",
                             F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("quantile"))
                     .withColumn("_pos", (F.col("_n") - 1) * F.col("quantile"))
                     .withColumn("_lo", F.col("_start") + F.floor("_pos").cast("bigint"))
                     .withColumn("_hi", F.col("_start") + F.ceil("_pos").cast("bigint"))
                     .withColumn("_frac", F.col("_pos") - F.floor("_pos")))
    picks = ix.select("_gidx", "_v")
    lo = picks.withColumnsRenamed({"_gidx": "_lo", "_v": "_vlo"})
    hi = picks.withColumnsRenamed({"_gidx": "_hi", "_v": "_vhi"})
    out = targets.join(lo, "_lo").join(hi, "_hi")
    return out.select(*group_cols, "quantile",
                      (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(value))


def pinball(y: Column, yhat: Column, q: Column) -> Column:
    e = y - yhat
    return F.when(e >= 0, q * e).otherwise((q - 1) * e)


def covered(y: Column, yhat: Column) -> Column:
    return (y <= yhat).cast("double")


def evaluate(pred: DataFrame, y: str = "y", yhat: str = "yhat", q: str = "quantile",
             group_cols: tuple = ()) -> DataFrame:
    """Mean pinball loss and coverage per (group, quantile)."""
    return pred.groupBy(*group_cols, q).agg(
        F.avg(pinball(F.col(y), F.col(yhat), F.col(q))).alias("pinball_loss"),
        F.avg(covered(F.col(y), F.col(yhat))).alias("coverage"))


#: Bins of an interval in a pass of ``prefix_quantiles``.
BINS = 1024
#: Above minus the logarithm of the least positive double.
_LOG = 745.2


def _log(v: float) -> float:
    return math.copysign(math.log(abs(v)) + _LOG, v) if v else 0.0


def _bin(v: Column, t: Column) -> Column:
    """The bin of v in an interval: equal widths, of the logarithms where the interval spans magnitudes
    (so that eight passes or so tell any doubles apart), or the least value and the rest."""
    logs = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.abs(v)) + _LOG))
    plain = (v / 2 - t["lo"] / 2) / t["width"] * 2
    at = F.when(t["kind"] == "log", (logs - t["from"]) / t["width"]).when(t["kind"] == "plain", plain).otherwise((v > t["lo"]).cast("double"))
    return F.greatest(F.least(F.floor(at), F.lit(BINS - 1)), F.lit(0)).cast("int")


def _interval(lo: float, hi: float, stuck: bool) -> tuple[str, float, float]:
    """(kind, from, width) of the bins of an interval."""
    if not stuck and (0 < lo and hi <= 4 * lo or hi < 0 and lo >= 4 * hi):
        width = hi / BINS - lo / BINS
        if width > 0:
            return "plain", lo, width
    elif not stuck:
        return "log", _log(lo), (_log(hi) - _log(lo)) / BINS
    return "rest", lo, 1.0


def prefix_order_statistics(indexed: DataFrame, value: str, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """For each wanted (start, rank): the rank-th smallest (from 0) non-null value of the rows with idx < start.

    Histogram refinement: each pass counts the values of every interval still open in BINS bins, with the
    least and the greatest of each bin, and goes on in the bin that holds the rank, until a bin holds one
    value.  Prefixes are counted together (a row knows the first prefix that holds it), so a pass reads
    the table once and brings back BINS counts an interval, whatever its size.
    """
    starts = sorted({s for s, _ in wanted})
    # the number of prefixes that do not hold the row
    outside = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("idx")))
    rows = indexed.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), outside.alias("outside")).where(F.col("outside") < len(starts))
    ends = rows.agg(F.min("v"), F.max("v")).first()
    found: dict[tuple[int, int], float] = {}
    if ends[0] is None:
        return found
    open_: dict[tuple[int, int], tuple[float, float, int]] = {w: (ends[0], ends[1], w[1]) for w in wanted}
    stuck: set[tuple[float, float]] = set()
    while open_:
        intervals = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        entry = lambda i, lo, hi, kind, start, width: F.struct(
            F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(kind).alias("kind"), F.lit(start).alias("from"), F.lit(width).alias("width"))
        table = F.array(*[entry(i, lo, hi, *_interval(lo, hi, (lo, hi) in stuck)) for i, (lo, hi) in enumerate(intervals)])
        inside = F.filter(table, lambda t: (t["lo"] <= F.col("v")) & (F.col("v") <= t["hi"]))
        bins = (rows.select("v", "outside", F.explode(inside).alias("t"))
                .groupBy(F.col("t.i").alias("i"), _bin(F.col("v"), F.col("t")).alias("bin"), "outside")
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        held: dict[int, dict[int, list]] = {}
        for r in bins:
            held.setdefault(r["i"], {}).setdefault(r["bin"], []).append(r)
        for (start, rank), (lo, hi, left) in list(open_.items()):
            for _, parts in sorted(held.get(intervals.index((lo, hi)), {}).items()):
                n = sum(r["n"] for r in parts if r["outside"] <= starts.index(start))
                if left < n:
                    low, high = min(r["lo"] for r in parts), max(r["hi"] for r in parts)
                    if low == high:
                        found[start, rank] = low
                        del open_[start, rank]
                    else:
                        if (low, high) == (lo, hi):
                            stuck.add((lo, hi))
                        open_[start, rank] = (low, high, left)
                    break
                left -= n
            else:  # the prefix has fewer values
                del open_[start, rank]
    return found


def prefix_quantiles(indexed: DataFrame, starts: list[int], value: str = K.TARGET, qs=K.QUANTILES) -> dict[tuple[int, float], float]:
    """{(start, quantile): value} of the rows with idx < start, with linear interpolation between order statistics."""
    counts = indexed.agg(*[F.count(F.when(F.col("idx") < s, F.col(value))) for s in starts]).first()
    position = {(s, q): (n - 1) * float(q) for s, n in zip(starts, counts) if n for q in qs}
    got = prefix_order_statistics(indexed, value, sorted({(s, int(p) + up) for (s, _), p in position.items() for up in ((0, 1) if p > int(p) else (0,))}))
    return {k: got[k[0], int(p)] + (got[k[0], int(p) + (p > int(p))] - got[k[0], int(p)]) * (p - int(p)) for k, p in position.items()}


def constant_quantile_cv(indexed: DataFrame, target: str = K.TARGET, qs=K.QUANTILES) -> DataFrame:
    """Per fold and quantile: the train rows' exact quantile scored on the fold's test rows.

    Train sets are prefixes of the index and test sets are disjoint, so no row is copied by fold."""
    bounds = cv_fold_bounds(indexed.count())
    qhat = prefix_quantiles(indexed, sorted({s for _, s, _ in bounds}), target, qs)
    guesses = [F.struct(F.lit(fold).alias("fold"), F.lit(s).cast("bigint").alias("start"), F.lit(e).cast("bigint").alias("end"), F.lit(float(q)).alias("quantile"), F.lit(qhat[s, q]).alias("yhat"))
                        for fold, s, e in bounds for q in qs if (s, q) in qhat]
    if not qhat:
        return indexed.sparkSession.createDataFrame([], "fold int, quantile double, pinball_loss double, coverage double")
    own = F.filter(F.array(*guesses), lambda g: (g["start"] <= F.col("idx")) & (F.col("idx") < g["end"]))
    return evaluate(indexed.select(F.col(target).alias("y"), F.explode(own).alias("g")).select("y", "g.fold", "g.quantile", "g.yhat"), group_cols=("fold",))
