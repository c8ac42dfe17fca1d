"""Totals that follow a store equal those of all its rows, whatever was written in which order."""

import random
import shutil

from pyspark.sql import functions as F

from tallyworks.operators import partials, store


def test_totals_follow_inserts_replacements_and_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partials, "MOST_RUNS", 2)
    path, rng = str(tmp_path / "store"), random.Random(2)
    frame = lambda n: spark.createDataFrame([(f"e{rng.randrange(60)}", rng.choice(["a", "b", None]), rng.choice(["d1", "d2", "d3"]), rng.randrange(100), rng.choice(["local", "imported"]), n) for _ in range(25)], "id string, provider string, day string, tokens long, origin string, at int")
    totals = partials.Totals(spark, path, str(tmp_path / "totals"), ["day", "provider"], ["tokens"], F.col("origin") == "local")

    def same():
        rows = spark.read.schema("id string, provider string, tokens long, origin string, at int, day string").parquet(path)
        want = rows.filter("origin = 'local'").groupBy("day", "provider").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
        columns = ["day", "provider", "tokens", "rows"]
        assert sorted(totals.current().select(columns).collect(), key=repr) == sorted(want.select(columns).collect(), key=repr)

    for n in range(4):
        store.insert_new(frame(n), path, "id", ["at", "tokens"], ["day"])
        same()
        assert totals.refresh() == 0  # what has been summed is not read again
    store.insert_or_replace(frame(9), path, "id", ["at", "tokens"], ["day"])
    same()
    shutil.rmtree(f"{path}/day=d2")
    same()
    # a run cut short before its files were told, and one told twice
    runs = totals.runs()
    shutil.rmtree(f"{tmp_path}/totals/{runs[0]}/files")
    shutil.copytree(f"{tmp_path}/totals/{runs[-1]}", f"{tmp_path}/totals/copy") if len(runs) > 1 else None
    same()
    assert len(totals.runs()) <= 3
