"""Awkward rows through the pipeline's stages, and shards against a plain recomputation."""

import hashlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from revcast.llm import common as C
from revcast.llm import ngram_join, sharding
from revcast.session import ensure_checkpoint_dir
from tests.llm import fixtures as X

SF0001 = "/root/testdata/sf0.001"


def awkward(spark):
    """The fixtures' rows and real documents, some twice, some without an id, one with a benchmark's text and no id;
    with columns named as those that the stages work with."""
    real = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").limit(60).collect()]
    item = max((r.text for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()), key=len)
    rows = X.texts() + real + real[:20] + [(None, t) for _, t in real[:5]] + [(None, item), (None, item), (7, item)]
    docs = X.documents(spark, rows)
    for name in ("quality_score", "__key", "__role", "Quality_Score_", "component_id", "item_id", "h", "n", "spots"):
        docs = docs.withColumn(name, F.lit("own"))
    return rows, item, docs


@pytest.fixture(scope="module")
def table(spark):
    rows, item, docs = awkward(spark)
    return rows, item, docs.cache()


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stage_takes_awkward_tables(spark, table, name, stage):
    rows, item, docs = table
    out = stage(spark, docs, SF0001)
    got = out.collect()
    none = stage(spark, docs.limit(0), SF0001)
    assert none.columns == out.columns and none.count() == 0
    if name == "encoding":
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        return
    assert out.columns == docs.columns and {r.__getitem__("__key") for r in got} == {"own"}
    left = Counter((r.doc_id, r.text) for r in got)
    if name == "repeated_passages":
        assert Counter(i for i, _ in left.elements()) == Counter(i for i, _ in rows)
    else:
        assert not left - Counter(rows)
    if name == "near_duplicates":
        components = X.components(rows)
        with_id = [i for i, _ in left.elements() if i is not None]
        assert sorted(with_id) == sorted({c for c in components.values()})
        texts = {t: i for i, t in rows if i is not None}
        assert [t for i, t in left.elements() if i is None and t in texts and X.shingle_set(t)] == []  # copies of rows with ids
        assert max(left.values()) == 1
    if name == "decontamination":
        items = [tuple(r) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").select("item_id", "text").collect()]
        keyed = [(k, t) for k, (_, t) in enumerate(rows)]
        bad = {k for k, _ in X.contaminated(keyed, items)}
        ids = {rows[k][0] for k in bad} - {None}
        want = Counter(r for k, r in enumerate(rows) if k not in bad and r[0] not in ids)
        assert left == want and not any(t == item for _, t in left)


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF0001}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


# ------------------------------------------------------------------ intermediate folders
def folders(spark):
    """All folders of checkpoints and stages in the shared folder."""
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return {str(p) for p in root.glob("*/rdd-*")} | {str(p) for p in root.glob("pipeline-*/*")}


def test_run_leaves_its_result_only(spark):
    before = folders(spark)
    out = P.run(spark, SF0001)
    left = folders(spark) - before
    assert len(left) == 1 and left.pop().endswith("/encoding") and out.count() > 0


def test_consumed_and_released(spark):
    before = folders(spark)
    with C.consumed(spark):
        a = C.checkpointed(spark.range(5))
        with C.consumed(spark):
            b = C.checkpointed(a.filter("id > 1"))
            assert b.count() == 3 and len(folders(spark) - before) == 2
        assert a.count() == 5 and len(folders(spark) - before) == 1
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), C.consumed(spark):
        C.checkpointed(spark.range(5))
        1 / 0
    c = C.checkpointed(spark.range(5))
    assert len(folders(spark) - before) == 1
    C.release(c)
    assert folders(spark) == before


@pytest.mark.parametrize("classes, least", [(1024, 0), (4, 0), (2, 3)])
def test_large_classes_join_apart(spark, monkeypatch, classes, least):
    rows = [*X.texts(), *((5000 + i, X.prose(9, 80)) for i in range(40)), *((5100 + i, X.prose(10, 60)) for i in range(9)), (5000, X.prose(10, 60)), (5000, ""), (None, X.prose(9, 80))]
    docs = X.documents(spark, rows)
    want = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    monkeypatch.setattr(ngram_join, "HOT_CLASSES", classes)
    monkeypatch.setattr(ngram_join, "CLASS_ROWS", least)
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect()) == want
    assert {r[2] for r in want if r[0] and r[0] >= 5000 and r[1]} == {5000}


# ------------------------------------------------------------------ shards
def slots_by_turns(names, size):
    """Each shard's whole preference list, and the shards taking turns at their next free one."""
    number = lambda n, salt: int.from_bytes(hashlib.md5(f"{salt}:{n}".encode()).digest()[:8], "big")
    lists = {n: [(number(n, "offset") + k * (number(n, "skip") % (size - 1) + 1)) % size for k in range(size)] for n in names}
    assert all(len(set(x)) == size for x in lists.values())
    taken, at = {}, dict.fromkeys(names, 0)
    while len(taken) < size:
        for n in names:
            if len(taken) == size:
                break
            while lists[n][at[n]] in taken:
                at[n] += 1
            taken[lists[n][at[n]]] = n
    return [taken[k] for k in range(size)]


@pytest.mark.parametrize("count, size", [(1, 2), (5, 11), (16, 211), (64, 1009)])
def test_lookup_table(count, size):
    names = sharding.shard_names(count)
    assert sharding.lookup_table(names, size) == slots_by_turns(names, size)


def test_op2_by_recomputation(spark):
    shard = sharding.lookup_table(sharding.shard_names())
    rows = sharding.op2_sharding(spark, SF0001).collect()
    assert len(rows) == spark.read.parquet(f"{SF0001}/documents.parquet").count()
    for r in rows:
        slot = int(hashlib.md5(f"v:{r.doc_id}".encode()).hexdigest()[:15], 16) % sharding.SIZE
        assert (r.slot, r.shard) == (slot, shard[slot])


def test_shards_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "doc_id long, __slot string, __slot_ string")
    out = sharding.assign_shards(df, ["doc_id"], ["x", "y"], 11)
    assert sorted((r.doc_id, r.__getitem__("__slot"), r.__getitem__("__slot_")) for r in out.collect()) == [(1, "a", "b"), (2, None, "c")]
