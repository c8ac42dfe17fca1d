"""Tables that grow: idempotent inserts, versions, keyed upserts, deletes, writes only on change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import handle
from ..functions.values import fnv1a_base36
from . import keyindex

#: Files of a store from which its keys are found through an index; fewer are scanned. The rows are the same.
INDEX_FROM = 64
#: Types whose values are equal just when their hashes' inputs are.
PLAIN = (T.BooleanType, T.IntegralType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _one_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark keeps one for a key in each task before the shuffle (its window group limit), so that a key of any number of copies is no load."""
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_write_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a total order: arrival does not matter."""
    return _one_of_each(df, [key], [F.asc(o) for o in order])


def not_stored(df: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key is not stored yet, however long ago it may have been."""
    return df.join(stored.select(key), key, "left_anti")


def stored_among(stored: DataFrame, keys: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Of keys those that are stored.

    The store is the large side: up to ``most`` keys are sent to it, so that it is scanned for its key column
    and neither shuffled nor sorted.
    """
    small = keys.count() <= most  # a limit would bring that many keys of each task to one
    return stored.select(key).join(F.broadcast(keys) if small else keys, key, "left_semi").distinct()


def stored_keys(keys: DataFrame, path: str, key: str, index_from: int = INDEX_FROM) -> DataFrame:
    """Of keys (one column) those that the store at path holds."""
    spark = keys.sparkSession
    files = keyindex.store_files(spark, path).persist()
    try:
        if files.count() < index_from:
            return stored_among(spark.read.parquet(path), keys, key)
        return keyindex.where(keys, path, key, files).select(key).distinct()
    finally:
        files.unpersist()


def contents(df: DataFrame, columns: list[str]) -> Column:
    """A hash of a row's columns. Nulls count, zeros keep their sign; only floating and nested columns are written out for it."""
    parts = []
    for c in columns:
        kind = df.schema[c].dataType
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`") if isinstance(kind, PLAIN) else F.to_json(F.struct(F.col(f"`{c}`").alias("c")))]
    return F.xxhash64(*parts)


def by_folder(df: DataFrame, partition_by: list[str] | None) -> DataFrame:
    """Rows of one folder together, large folders in several files: else each task adds a small file to each folder, and all that lists or reads the store later takes as long as there are files."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def insert_new(df: DataFrame, path: str, key: str, order: list[str], partition_by: list[str] | None = None, index_from: int = INDEX_FROM) -> dict[str, int]:
    """Append rows of new keys to the table at path; says how many were inserted and how many were duplicates.

    :param index_from: files from which the index of the store's keys is used and kept (see keyindex): a batch
        then opens only index files that may hold its keys. With fewer files the store's key column is scanned.
    """
    spark = df.sparkSession
    first = first_write_wins(df, key, order).persist()
    new = first
    if exists(spark, path):
        recover(spark, path)
        new = first.join(stored_keys(first.select(key), path, key, index_from), key, "left_anti")
    new = new.persist()
    try:
        seen, kept = df.count(), new.count()
        if kept:
            w = by_folder(new, partition_by).write.mode("append")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        return {"inserted": kept, "duplicates": seen - kept}
    finally:
        new.unpersist()
        first.unpersist()


def _folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Folders ``depth`` levels below path, as paths from there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [""]
    for _ in range(depth):
        below = []
        for f in found:
            for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{f}" if f else path)):
                name = status.getPath().getName()
                if status.isDirectory() and not name.startswith(("_", ".")):
                    below.append(f"{f}/{name}" if f else name)
        found = below
    return found


def _move(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(target).getParent())
    if not fs.rename(hadoop.Path(source), hadoop.Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def recover(spark: SparkSession, path: str, depth: int | None = None) -> None:
    """After a swap that was cut short: folders set aside go back where none has taken their place."""
    aside = f"{path.rstrip('/')}.aside"
    if not exists(spark, aside):
        return
    if depth is None:
        depth = next((d for d in range(8) if not _folders(spark, aside, d + 1)), 0)
    for f in _folders(spark, aside, depth):
        if not exists(spark, f"{path}/{f}"):
            _move(spark, f"{aside}/{f}", f"{path}/{f}")
    gone = spark._jvm.org.apache.hadoop.fs.Path(aside)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def insert_or_replace(df: DataFrame, path: str, key: str, order: list[str], partition_by: list[str], index_from: int = INDEX_FROM) -> dict[str, int]:
    """Insert rows; one of a stored key takes its place if it differs. Says inserted, replaced and duplicates (the rest).

    Of rows of one key the last in ``order`` counts; what only ``order`` says does not make a row differ. Only
    partitions that gain or lose rows are rewritten: the new folders are made beside the table and take the
    place of the old ones by renames, and a run cut short in between is mended by the next one.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    last = latest_of_each(df, [key], order).persist()
    try:
        seen = df.count()
        if not exists(spark, path):
            n = last.count()
            if n:
                by_folder(last, partition_by).write.partitionBy(*partition_by).parquet(path)
            return {"inserted": n, "replaced": 0, "duplicates": seen - n}
        recover(spark, path, len(partition_by))
        old = spark.read.schema(df.schema).parquet(path)
        files = keyindex.store_files(spark, path)
        if files.count() >= index_from:
            # only files that hold one of the keys are read for what is stored of them
            names = [r["path"] for r in files.join(keyindex.where(last.select(key), path, key, files).select("file").distinct(), "file", "left_semi").select("path").collect()]
            holding = spark.read.schema(df.schema).option("basePath", path).parquet(*names) if names else old.limit(0)
        else:
            holding = old
        same = [c for c in df.columns if c not in order]
        mine = lambda d: d.select(key, F.struct(*partition_by).alias("_place"), contents(df, same).alias("_h"))
        stored = mine(holding).join(F.broadcast(last.select(key)) if last.count() <= 1_000_000 else last.select(key), key, "left_semi")
        stored = stored.select(key, F.col("_place").alias("_old"), F.col("_h").alias("_old_h"))
        both = mine(last).join(stored, key, "left").persist()
        new = both.filter("_old_h is null or _old_h <> _h")
        fresh, replaced = new.filter("_old_h is null").count(), new.filter("_old_h is not null").select(key).distinct().count()
        if fresh + replaced:
            # a folder for each partition that gains or loses a row
            touched = new.select("_place").union(new.filter("_old is not null").select("_old")).distinct().select("_place.*")
            ids = new.select(key).distinct()
            on = None
            for c in partition_by:
                e = F.col(c).eqNullSafe(F.col(f"_{c}"))
                on = e if on is None else on & e
            stay = old.join(F.broadcast(touched.select(*[F.col(c).alias(f"_{c}") for c in partition_by])), on, "left_semi").join(ids, key, "left_anti")
            whole = stay.unionByName(last.join(ids, key, "left_semi").select(*df.columns))
            beside = f"{path}.next"
            by_folder(whole, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(beside)
            made = set(_folders(spark, beside, len(partition_by)))
            count = touched.count()
            emptied = set()
            if count > len(made):  # partitions that have lost their last row
                names = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in partition_by])
                emptied = {r[0] for r in touched.select(names).collect()} - made
            for f in sorted(made | emptied):
                if exists(spark, f"{path}/{f}"):
                    _move(spark, f"{path}/{f}", f"{path}.aside/{f}")
                if f in made:
                    _move(spark, f"{beside}/{f}", f"{path}/{f}")
            hadoop = spark._jvm.org.apache.hadoop.fs
            for p in (f"{path}.aside", beside):
                hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop.Path(p), True)
        both.unpersist()
        return {"inserted": fresh, "replaced": replaced, "duplicates": seen - fresh - replaced}
    finally:
        last.unpersist()


def latest_of_each(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert as a view: the last update of each key."""
    return _one_of_each(updates, keys, [F.desc(o) for o in order])


def write_if_changed(df: DataFrame, path: str, order: list[str]) -> str:
    """Replace the table at path only if its contents differ: 'empty' (never written), 'same' or 'written'.

    Contents are compared by a hash over all rows that does not depend on their order.
    """
    spark = df.sparkSession
    digest = lambda d: d.select(F.xxhash64(F.to_json(F.struct(*sorted(d.columns)))).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    new = digest(df)
    if not new["n"]:
        return "empty"
    if exists(spark, path) and digest(spark.read.parquet(path)) == new:
        return "same"
    df.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return "written"


def without(df: DataFrame, condition: Column) -> DataFrame:
    """Delete by predicate: what remains (rows where the condition is null stay)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Delete the rows of gone keys from each table (table, its key column)."""
    return {name: df.join(gone.select(F.col(key).alias(c)), c, "left_anti") for name, (df, c) in tables.items()}


def versions(history: DataFrame, key: str = "handle", at: str = "created_at") -> DataFrame:
    """Append-only history with a status: the newest row of each key is active, older ones superseded.

    Rows with revoked_key set keep that status.
    """
    w = Window.partitionBy(key).orderBy(at, "id")
    status = F.when(F.coalesce("revoked_key", F.lit(False)), "revoked_key").when(F.lead("id").over(w).isNull(), "active").otherwise("superseded")
    return history.withColumn("status", status)


def current(history: DataFrame, key: str = "handle", at: str = "created_at") -> DataFrame:
    return latest_of_each(history.filter("status = 'active'"), [key], [at, "id"])


def upsert(table: DataFrame, updates: DataFrame, key: str, keep_nulls: bool = False) -> DataFrame:
    """Rows of both; where an update has the key, its non-null values replace the old ones, or with keep_nulls all of them."""
    rest = [c for c in table.columns if c != key]
    u = updates.select(F.col(key), F.lit(True).alias("_is"), *[F.col(c).alias(f"_{c}") for c in rest])
    value = lambda c: F.when(F.col("_is"), F.col(f"_{c}")).otherwise(F.col(c)) if keep_nulls else F.coalesce(f"_{c}", c)
    return table.join(u, key, "full_outer").select(key, *[value(c).alias(c) for c in rest])


def rename_keys(df: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """Re-key rows by renames (old, new)."""
    r = renames.select(F.col("old").alias(key), F.col("new").alias("_new"))
    return df.join(r, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")


def new_accounts(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """Handles for users (user_id, username) without an account: their name's, with a suffix where taken.

    Of new users with one name the first by user_id gets it plain.
    """
    short = fnv1a_base36(F.col("user_id"))
    plain = handle(F.col("username"))
    named = users.join(accounts.select("user_id"), "user_id", "left_anti").withColumn("handle", F.when(plain.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,37}[a-z0-9])?$"), plain).otherwise(F.concat(F.lit("member-"), short)))
    taken = accounts.select("handle", F.lit(True).alias("_taken")).distinct()
    first = F.row_number().over(Window.partitionBy("handle").orderBy("user_id")) == 1
    j = named.join(taken, "handle", "left").withColumn("_first", first)
    return j.withColumn("handle", F.when(F.col("_first") & F.col("_taken").isNull(), F.col("handle")).otherwise(F.concat(F.substring("handle", 1, 32), F.lit("-"), short))).drop("_taken", "_first")


def key_conflicts(registrations: DataFrame, keys: DataFrame, revoked: DataFrame) -> DataFrame:
    """code of each registration (account_id, key_id, public_key): first conflict, or OK."""
    from .integrity import first_failure

    k = keys.select("key_id", F.col("account_id").alias("k_account"), F.col("public_key").alias("k_public"))
    r = revoked.select("key_id", F.lit(True).alias("gone")).distinct()
    rules = [("KEY_REVOKED", F.col("gone")), ("KEY_TAKEN", F.col("k_account") != F.col("account_id")), ("KEY_MISMATCH", F.col("k_public") != F.col("public_key"))]
    return registrations.join(k, "key_id", "left").join(r, "key_id", "left").withColumn("code", first_failure(rules)).drop("k_account", "k_public", "gone")


def join_account(sessions: DataFrame, accounts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sessions with their account and profile, where they have one."""
    return sessions.join(accounts, "account_id").join(profiles, "account_id", "left")
