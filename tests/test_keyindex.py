"""The index of a store's keys: nothing is lost, and files that cannot hold a key stay closed."""

import os
import random
import shutil

import numpy as np
import pytest

from tallyworks.operators import keyindex, store


def frame(spark, names, day=1):
    return spark.createDataFrame([(n, i, f"d{day}") for i, n in enumerate(names)], "id string, v int, day string")


def put(spark, path, names, day=1, **options):
    return store.insert_new(frame(spark, names, day), path, "id", ["v"], ["day"], index_from=0, **options)


def test_batches_in_any_order(spark, tmp_path):
    path, rng, seen = str(tmp_path / "t"), random.Random(1), set()
    for batch in range(6):
        names = [f"k{rng.randrange(300)}" for _ in range(60)]
        new = set(names) - seen
        assert put(spark, path, names, batch) == {"inserted": len(new), "duplicates": 60 - len(new)}
        seen |= new
    got = [r.id for r in spark.read.parquet(path).collect()]
    assert sorted(got) == sorted(seen)


def test_a_crash_between_store_and_index_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, ["a", "b"])
    # a writer that never came to the index, and a run that was cut short
    frame(spark, ["c"], 2).write.mode("append").partitionBy("day").parquet(path)
    assert put(spark, path, ["b", "c", "d"]) == {"inserted": 1, "duplicates": 2}
    (run,) = [r for r in keyindex.runs(spark, path)][-1:]
    shutil.rmtree(f"{keyindex.folder(path)}/{run.name}/meta")
    assert put(spark, path, ["a", "b", "c", "d", "e"]) == {"inserted": 1, "duplicates": 4}
    # keys of files that are gone are new again
    shutil.rmtree(f"{path}/day=d2")
    assert put(spark, path, ["a", "c"]) == {"inserted": 1, "duplicates": 1}
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d", "e"]


def test_only_files_that_may_hold_a_key_are_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    names = [f"key-{i}" for i in range(5000)]
    frame(spark, names).write.partitionBy("day").parquet(path)
    known = keyindex.refresh(spark, path, "id", keyindex.store_files(spark, path), keys_per_file=100)
    assert (known[0].bits, known[0].n) == (6, 5000)
    asked = lambda keys: keyindex.candidates(spark, path, spark.createDataFrame([(k,) for k in keys], "key string"), known)
    all_files = [f for f in os.listdir(f"{keyindex.folder(path)}/{known[0].name}/keys") if f.startswith("part=")]
    assert len(all_files) == 64
    # new keys open (nearly) nothing, a stored one its own file
    assert len(asked([f"new-{i}" for i in range(200)])) <= 6
    for k in ("key-0", "key-4999"):
        (found,) = asked([k])
        assert k in {r.key for r in spark.read.parquet(found).collect()}
    assert len(asked(names)) == 64
    # a later batch reads only the files that came since
    put(spark, path, ["x", "key-7"], 2)
    opened = []
    read = spark.read.schema(keyindex.KEYS).parquet(*asked(["key-7"]))
    opened = read.inputFiles()
    assert 1 <= len(opened) <= 2


def test_runs_are_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(7):
        frame(spark, [f"a{i}", f"b{i}"], i).write.mode("append").partitionBy("day").parquet(path)
        if i == 4:
            shutil.rmtree(f"{path}/day=d0")
        known = keyindex.refresh(spark, path, "id", keyindex.store_files(spark, path), keys_per_file=4, most_runs=3)
        assert len(known) <= 3 and {r.name for r in known} == {r.name for r in keyindex.runs(spark, path)}
    assert put(spark, path, [f"{x}{i}" for x in "abc" for i in range(7)], 9) == {"inserted": 9, "duplicates": 12}


def test_replacing_by_the_index(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k string, v int, at int, p string")
    add = lambda rows: store.insert_or_replace(df(rows), path, "k", ["at"], ["p"], index_from=0)
    assert add([("a", 1, 1, "x"), ("b", 1, 1, None), ("b", 2, 2, None)]) == {"inserted": 2, "replaced": 0, "duplicates": 1}
    assert add([("a", 5, 3, "y"), ("b", 2, 9, None), ("c", 1, 1, "y")]) == {"inserted": 1, "replaced": 1, "duplicates": 1}
    assert add([("a", 5, 4, "y"), ("d", 2, 9, None)]) == {"inserted": 1, "replaced": 0, "duplicates": 1}
    assert sorted(tuple(r[c] for c in "kv") for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2), ("c", 1), ("d", 2)]


def test_keys_of_other_types_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda ids: spark.createDataFrame([(i, 1) for i in ids], "id long, v int")
    add = lambda ids: store.insert_new(df(ids), path, "id", ["v"], index_from=0)
    assert add([1, 2, None]) == {"inserted": 3, "duplicates": 0}
    assert add([2, 3]) == {"inserted": 1, "duplicates": 1}
    assert sorted(r.id for r in spark.read.parquet(path).filter("id is not null").collect()) == [1, 2, 3]


@pytest.mark.parametrize("bits,blocks,n", [(0, 0, 10), (0, 3, 250), (4, 2, 100), (8, 5, 1000)])
def test_filters_let_every_key_through(bits, blocks, n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) >> np.uint64(bits)
    f = keyindex.make_filter(h, bits, blocks)
    assert len(f) == 64 << blocks and keyindex.may_hold(f, 0, h, bits, blocks).all()
    # a slice of the filter serves the keys of its blocks
    at = keyindex._block(h, bits, blocks)
    half = (1 << blocks) // 2
    assert keyindex.may_hold(f[64 * half :], half, h[at >= half], bits, blocks).all()
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)
    assert keyindex.may_hold(f, 0, other, bits, blocks).mean() < 0.1


def test_first_and_last_of_each_key(spark):
    rows = [("a", 2, "x"), ("a", None, "y"), ("b", 1, "z"), (None, 1, "n"), ("a", 3, "w")]
    df = spark.createDataFrame(rows, "`k.1` string, at int, v string")
    pick = lambda out: {r[0]: r.v for r in out.collect()}
    assert pick(store.first_write_wins(df, "k.1", ["at"])) == {"a": "y", "b": "z", None: "n"}
    assert pick(store.latest_of_each(df, ["k.1"], ["at"])) == {"a": "w", "b": "z", None: "n"}
    first = store.first_write_wins(df, "k.1", ["at"])
    assert first.columns == df.columns and "Partial" in first._jdf.queryExecution().executedPlan().toString()  # one row for a key and task is shuffled
