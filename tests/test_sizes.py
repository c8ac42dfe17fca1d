"""Faults that show only on larger tables, on inputs small enough for a test."""

import time

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_runs_of_letters_in_linear_time(spark):
    from tallyworks.operators.directory import _grams

    df = spark.createDataFrame([("ab😀cd",), ("ab",), (None,), ("abcabc\n",)], "t string")
    assert [r[0] for r in df.select(_grams(F.col("t"), 3)).collect()] == [["ab😀", "b😀c", "😀cd"], [], None, ["abc", "bca", "cab", "bc\n"]]
    long = spark.range(1).select(F.concat(*[F.lit("xyz-" * 2500), F.col("id").cast("string"), F.lit("🙂" * 10000)]).alias("t"))
    start = time.time()
    assert long.select(F.size(_grams(F.col("t"), 3))).first()[0] == 8
    assert time.time() - start < 20


def test_lines_are_parsed_once(spark):
    from tallyworks.operators import extract

    rows = [("f", "2024-01-01", 0, i, x) for i, x in enumerate(['{"token_usage":{"output":3},"usage":{"output":0}}', '{"scope":"session","usage":{"output":4}}', '{"payload":{"usage":{"scope":"session","output":5}},"data":{"output":6}}', "{usage", '{"usage":{}}'])]
    lines = spark.createDataFrame(rows, "file string, modified string, block int, seq int, line string").withColumn("modified", F.to_timestamp("modified"))
    records = extract.turn_records(lines, "kimi")
    assert plan(records).count("from_json(") == 1 and plan(extract.message_usage(lines, "claude", b"k")).count("from_json(") == 1
    assert sorted(r.total_tokens for r in records.collect()) == [3, 6]


def test_tables_of_a_row_for_each_event_are_not_broadcast(spark):
    from tallyworks.plans.catalog import QUERIES

    assert "Broadcast" not in plan(QUERIES["unusable_numbers"](spark, SF), "executedPlan")


def test_numbers_of_any_size_are_written_exactly(spark):
    from tallyworks.functions import text

    df = spark.sql("select explode(array(13552325512859223BD, 1005000000000005BD, 1664500000001BD, 72900000000000000000123BD, -13552325512859223BD, 1250BD, 7BD)) as n")
    got = [tuple(r) for r in df.select(text.compact_number(F.col("n")), text.full_number(F.col("n"))).collect()]
    assert got == [("13552.33T", "13,552,325,512,859,223"), ("1005.00T", "1,005,000,000,000,005"), ("1.66T", "1,664,500,000,001"), ("72900000000.00T", "72,900,000,000,000,000,000,123"), ("-13552.33T", "-13,552,325,512,859,223"), ("1.3K", "1,250"), ("7", "7")]
    longs = spark.sql("select explode(array(9223372036854775807, 999999, 1005)) as n")
    assert [tuple(r) for r in longs.select(text.compact_number(F.col("n")), text.full_number(F.col("n"))).collect()] == [("9223372.04T", "9,223,372,036,854,775,807"), ("1000.0K", "999,999"), ("1.0K", "1,005")]
    doubles = spark.sql("select explode(array(1049.9999D, -2.5D, 1e17D, cast(null as double))) as n")
    assert [r[0] for r in doubles.select(text.full_number(F.col("n"))).collect()] == ["1,050", "-2", "100,000,000,000,000,000", "—"]


def test_imported_numbers_are_read_once(spark):
    from tallyworks.plans.catalog import QUERIES

    text = plan(QUERIES["import_events"](spark, SF))
    assert not [line for line in text.splitlines() if "Filter" in line and "regexp" in line.lower()]


def test_folders_of_one_text_are_indexed_once(spark):
    from pathlib import Path

    from tallyworks.operators import directory

    folders = spark.range(200).select(F.concat(F.lit("d"), "id").alias("dir"), F.lit("alpha").alias("base"), F.lit("").alias("package"), F.lit("alpha x").alias("evidence"), F.array(F.lit("x")).alias("files"))
    projects = spark.createDataFrame([("p", ["alpha"], [])], "name string, aliases array<string>, domains array<string>")
    place = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(place.glob("folder-runs-*"))
    got = directory.score_folders(projects, folders)
    assert got.count() == 12 and {r.score for r in got.collect()} == {395}
    (runs,) = set(place.glob("folder-runs-*")) - before
    assert spark.read.parquet(str(runs)).count() == 6  # alp, lph, pha in each of two texts


def test_imports_keep_only_records_of_a_document():
    import tracemalloc

    from tallyworks.sources.records import ImportRecords

    one = '{"Usage_Date":"1998-02-02","tool":"T","promptTokens":%d,"completionTokens":"5","note":{"a":[1,2],"b":"text"}}'
    document = '{"x":{"items":[' + ",".join(one % i for i in range(20_000)) + "]}}"
    tracemalloc.start()
    n = sum(1 for _ in ImportRecords().eval(document))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 2 * len(document)
    nested = '{"date":"d1","total":1,"date2":{"day":"d2","tokens":2},"list":[[{"time":"d3","input":3}],{"a":{"day":null,"total":{"day":"d5","total":5}}}]}'
    assert [(r[0], r[1], r[-1]) for r in ImportRecords().eval(nested)] == [(0, "d1", "1"), (1, "d2", "2"), (2, "d3", None), (3, None, None), (4, "d5", "5")]
    assert [*ImportRecords().eval("{"), *ImportRecords().eval(None), *ImportRecords().eval("[1]")] == []


def test_long_work_is_spread_over_cores(spark):
    from pathlib import Path

    from tallyworks.plans.catalog import QUERIES

    assert QUERIES["published_blocks"](spark, SF).rdd.getNumPartitions() >= 4
    place = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(place.glob("logs-*"))
    QUERIES["log_files"](spark, SF)
    (logs,) = set(place.glob("logs-*")) - before
    assert len({f.name.split("-")[1] for f in logs.rglob("part-*.txt")}) > 1


def _files(path):
    from pathlib import Path

    return sorted(f.parent.name for f in Path(path).rglob("*.parquet"))


def test_a_write_adds_a_file_to_each_folder_and_not_one_of_each_task(spark, tmp_path):
    from tallyworks.operators import store

    path = str(tmp_path / "store")
    rows = lambda low, high, at: spark.range(low, high, 1, 8).select(F.col("id").cast("string").alias("k"), F.lit(at).alias("at"), (F.col("id") % 5).alias("day"))
    days = [f"day={i}" for i in range(5)]
    assert store.insert_new(rows(0, 4000, 0), path, "k", ["at"], ["day"]) == {"inserted": 4000, "duplicates": 0}
    assert _files(path) == days
    assert store.insert_new(rows(2000, 6000, 0), path, "k", ["at"], ["day"]) == {"inserted": 2000, "duplicates": 2000}
    assert _files(path) == sorted(days * 2)
    changed = rows(5000, 8000, 1).withColumn("v", F.col("k") + 0)
    assert store.insert_or_replace(changed, path, "k", ["at"], ["day"]) == {"inserted": 2000, "replaced": 1000, "duplicates": 0}
    assert _files(path) == days
    assert store.insert_or_replace(changed, f"{path}2", "k", ["at"], ["day"])["inserted"] == 3000 and _files(f"{path}2") == days
    assert spark.read.parquet(path).count() == 8000


def test_rows_that_differ_are_told_apart(spark):
    from tallyworks.operators import store

    same = "named_struct('s', 'x', 'i', cast(null as int), 'd', 0.0D, 't', timestamp'2024-01-01 00:00:00.000001', 'a', array(1, null), 'm', map('a', 1))"
    others = [same.replace(a, b) for a, b in (("'x'", "''"), ("cast(null as int)", "0"), ("0.0D", "-0.0D"), ("0.0D", "cast(null as double)"), ("000001", "000002"), ("null)", "0)"), ("map('a', 1)", "map('a', 2)"))]
    df = spark.sql(f"select x.* from (select explode(array({', '.join([same, same, *others])})) as x)")
    hashes = [r[0] for r in df.select(store.contents(df, df.columns)).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == len(others) + 1


def test_a_large_part_of_the_index_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from tallyworks.operators import keyindex

    monkeypatch.setattr(keyindex, "KEYS_PER_TASK", 100, raising=False)
    path = str(tmp_path / "t")
    keys = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    keys.write.parquet(path)
    (run,) = keyindex.refresh(spark, path, "id", keyindex.store_files(spark, path))
    files = _files(f"{keyindex.folder(path)}/{run.name}/keys")
    assert run.bits == 0 and len(files) > 4
    assert keyindex.where(keys.union(spark.createDataFrame([("new",)], "id string")), path, "id").select("id").distinct().count() == 1000


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    from tallyworks.sources import lines

    for i in range(60):
        (tmp_path / f"user{i}").mkdir()
        (tmp_path / f"user{i}" / "a.jsonl").write_text(f"{i}\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, sc = spark.conf.get(key), spark.sparkContext
    for i, read in enumerate((lines.list_files, lines.read_lines)):
        sc.setJobGroup(f"listing-{i}", "")
        df = read(spark, str(tmp_path))
        sc.setJobGroup("other", "")
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"listing-{i}")]
        tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
        assert tasks and max(tasks) <= 3 * sc.defaultParallelism
        assert df.count() == 60
    sc._jsc.clearJobGroup()
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.sources.ignoreDataLocality") == "false"


def test_files_of_folders_are_written_by_tasks(spark, tmp_path):
    from tallyworks.sources import lines

    keys = [None, "", "__HIVE_DEFAULT_PARTITION__", "a/b=c", "e %", "x"]
    rows = [(k, i % 2, None if i == 3 else f"é{i}") for i, k in enumerate(keys * 20)]
    df = spark.createDataFrame(rows, "k string, n int, line string")
    for _ in range(2):
        lines.write_lines(df.repartition(3, "n"), str(tmp_path / "ours"), ["k", "n"])
        theirs = df.withColumn("k", F.expr("nullif(k, '__HIVE_DEFAULT_PARTITION__')"))  # Spark's writer fails where both stand
        theirs.repartition(3, "n").withColumnRenamed("line", "value").write.mode("append").partitionBy("k", "n").text(str(tmp_path / "theirs"))
    tree = lambda name: sorted(str(f.parent.relative_to(tmp_path / name)) for f in (tmp_path / name).rglob("*.txt") if not f.name.startswith("."))
    back = lambda name: sorted(map(tuple, spark.read.text(str(tmp_path / name)).collect()), key=repr)
    assert set(tree("ours")) == set(tree("theirs")) and back("ours") == back("theirs") and len(back("ours")) == 240
    assert len(tree("ours")) == 2 * len(set(tree("ours")))  # a file of each call
    assert not [f for f in (tmp_path / "ours").rglob("*") if f.is_file() and not f.name.startswith("part-")]


def test_log_files_are_written_without_checksums_and_listed_once_for_their_lines(spark, monkeypatch):
    from pathlib import Path

    from tallyworks.plans.catalog import QUERIES
    from tallyworks.sources import lines

    place, read, roots = Path(spark.conf.get("spark.checkpoint.dir")), lines.read_lines, []
    before = set(place.glob("logs-*"))
    monkeypatch.setattr(lines, "read_lines", lambda spark, root, *a, **k: (roots.append(root.rpartition("/")[2]), read(spark, root, *a, **k))[1])
    df = QUERIES["log_files"](spark, SF)
    (logs,) = set(place.glob("logs-*")) - before
    assert roots == ["kind=even0", "kind=even1"]
    files = [f for f in logs.rglob("*") if f.is_file()]
    assert len(files) == df.first()["files"] and all(f.suffix == ".txt" for f in files)  # Hadoop's local files have a .crc each
