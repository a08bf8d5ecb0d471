"""N daily increments equal the full run, row for row."""

import datetime as dt
import random

import pytest

from pyspark.errors import PySparkException

from revcast.operators.clean import clean
from revcast.operators.features import engineer_features
from revcast.operators.incremental import TAIL, increment, no_state, with_patches
from revcast.plans.daily import materialize

SCHEMA = ("date date, channel string, campaign_type string, campaign_name string, campaign_id string, revenue double, spend double, "
          "clicks long, impressions long, conversions double, daily_budget double")
START = dt.date(2024, 1, 1)


def days(n=48):
    """Series that begin late, pause, have zero rows, no budget at first, one late, or none ever, and several ids a day."""
    rnd, rows = random.Random(4), []
    for name, first, gap, budget in (("early", 0, 0, 0), ("late", 20, 0, 3), ("gaps", 0, 3, 30), ("never", 5, 2, 999), ("zero first", 0, 0, 10), ("many", 2, 0, 25)):
        for d in range(first, n):
            if gap and d % (gap + 1) == 0:
                continue
            for cid in range(4 if name == "many" else 1):
                zero = d < 6 if name == "zero first" else rnd.random() < 0.15
                rows.append((START + dt.timedelta(days=d), "google", "SEARCH" if cid % 2 else "VIDEO", name, f"{name}{cid}", 0.0 if zero else rnd.random() * 90, 0.0 if zero else rnd.random() * 9,
                             rnd.randint(0, 5), rnd.randint(1, 50), None if d % 4 else 2.0, None if d < first + budget or rnd.random() < 0.4 else float(rnd.randint(1, 9))))
    return rows


@pytest.mark.parametrize("step", [1, 7])
def test_increments_equal_the_full_run(spark, step):
    rows = days(12 if step == 1 else 48)
    last = max(r[0] for r in rows)
    full = {(r["campaign_id"], r["date"]): r for r in engineer_features(clean(spark.createDataFrame(rows, SCHEMA))).collect()}
    state, features, patches = no_state(spark), None, None
    day = START
    while day <= last:
        part = [r for r in rows if day <= r[0] < day + dt.timedelta(days=step)]
        done = increment(state, spark.createDataFrame(part, SCHEMA))
        new, change, state = materialize(done.features, "t"), materialize(done.patches, "t"), materialize(done.state, "t")
        features = new if features is None else features.unionByName(new)
        patches = change if patches is None else patches.unionByName(change)
        day += dt.timedelta(days=step)
    got = with_patches(features, patches).collect()
    assert len(got) == len(full) and patches.count() > 0
    for r in got:
        want = full[r["campaign_id"], r["date"]]
        for c, v in want.asDict().items():
            assert r[c] == v or (isinstance(v, float) and r[c] == pytest.approx(v, rel=1e-12)), (r["campaign_name"], r["date"], c, r[c], v)
    kept = state.collect()
    assert len(kept) == len({r[3] for r in rows}) and all(len(s["tail"]) <= TAIL for s in kept)
    assert {s["campaign_name"]: s["carried"] is None for s in kept}["never"]


def test_a_closed_day_is_an_error(spark):
    rows = [r for r in days(4) if r[3] == "early"]
    first = increment(no_state(spark), spark.createDataFrame(rows, SCHEMA))
    state = materialize(first.state, "t")
    with pytest.raises(PySparkException):
        increment(state, spark.createDataFrame(rows[-1:], SCHEMA)).features.collect()
    later = increment(state, spark.createDataFrame([(rows[-1][0] + dt.timedelta(days=1), *rows[-1][1:])], SCHEMA))
    assert later.features.count() <= 1 and later.patches.count() == 0


def test_nothing_new(spark):
    state = materialize(increment(no_state(spark), spark.createDataFrame(days(5), SCHEMA)).state, "t")
    idle = increment(state, spark.createDataFrame([], SCHEMA))
    assert idle.features.count() == 0 and idle.patches.count() == 0
    assert sorted(map(str, idle.state.collect())) == sorted(map(str, state.collect()))
