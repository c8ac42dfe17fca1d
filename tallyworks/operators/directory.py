"""The directory of members: merging, trust in signatures, search and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_texts
from ..session import scratch

HANDLE = r"^[a-z0-9](?:[a-z0-9-]{0,37}[a-z0-9])?$"
PRIVATE_HOST = r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$|localhost$)"


def valid_handle(x: Column) -> Column:
    return x.rlike(HANDLE)


def safe_url(x: Column) -> Column:
    """An https address without user names, of a public host."""
    host = F.lower(F.try_parse_url(x, F.lit("HOST")))
    return F.coalesce(x.rlike(r"(?i)^https://") & F.try_parse_url(x, F.lit("USERINFO")).isNull() & ~host.rlike(PRIVATE_HOST) & ~host.endswith(".local"), F.lit(False))


def valid_members(members: DataFrame) -> DataFrame:
    return members.filter(valid_handle(F.col("handle")) & safe_url(F.col("snapshot_url")))


def merge_registries(static: DataFrame, hosted: DataFrame) -> DataFrame:
    """Members of both by handle; the hosted row wins. origin says which one it is."""
    shared = [c for c in static.columns if c != "handle"]
    a, b = static.select("handle", F.struct(*shared).alias("_s")), hosted.select("handle", F.struct(*shared).alias("_h"))
    j = a.join(b, "handle", "full_outer")
    return j.select("handle", F.coalesce("_h", "_s").alias("_x"), F.when(F.col("_h").isNotNull(), "hosted").otherwise("static").alias("origin")).select("handle", "origin", "_x.*")


def coerce(members: DataFrame, texts: dict[str, int], arrays: list[str]) -> DataFrame:
    """Texts of third parties trimmed, without turning marks, cut to length; arrays of such texts capped."""
    return members.withColumns({c: clean_text(F.col(c), n) for c, n in texts.items()} | {c: clean_texts(F.col(c)) for c in arrays})


def _open(df: DataFrame) -> Column:
    return (F.size("open_to") > 0) | (F.size("engagement_types") > 0)


def search(members: DataFrame, query: str = "", tool: str | None = None, verified: bool = False, open_only: bool = False) -> DataFrame:
    """Members that use a tool, have a good signature, are open to work, and hold the query in their texts."""
    out = members
    if tool:
        out = out.filter(F.array_contains("tools", tool))
    if verified:
        out = out.filter(F.col("signature").isin("valid", "historical"))
    if open_only:
        out = out.filter(_open(out))
    if q := query.strip().lower():
        out = out.filter(_searched().contains(q))
    return out


def _searched() -> Column:
    """The text of a member that a query is looked for in."""
    return F.lower(F.concat_ws(" ", "display_name", "headline", F.coalesce("location", F.lit("")), "work_categories", "tools", "proofs"))


class SearchIndex:
    """Members behind an inverted index of the runs of three letters of their texts.

    In the folder stand the members by number, and the numbers of those whose text holds a run, sorted by run:
    a search reads the lists of its own runs (the scans skip all others by the bounds of their blocks), takes
    the members that are on every list, and holds the query against their texts. A query of fewer than three
    letters has no run, and is held against all.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, members: DataFrame) -> SearchIndex:
        members.withColumn("member", F.monotonically_increasing_id()).write.parquet(f"{self.folder}/members")
        runs = self.members().select("member", F.explode(_grams(_searched(), GRAM)).alias("run"))
        # a run that many members have goes over several files
        ordered = runs.repartitionByRange("run", "member").sortWithinPartitions("run", "member")
        ordered.write.option("parquet.block.size", 1 << 20).parquet(f"{self.folder}/runs")
        return self

    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/members")

    def search(self, query: str = "", **filters) -> DataFrame:
        """The rows of :func:`search`."""
        q = query.strip().lower()
        runs = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not runs:
            return search(self.members().drop("member"), query, **filters)
        lists = self.spark.read.parquet(f"{self.folder}/runs").filter(F.col("run").isin(runs))
        found = lists.groupBy("member").agg(F.count("*").alias("n")).filter(F.col("n") == len(runs)).select("member")
        return search(self.members().join(found, "member", "left_semi").drop("member"), query, **filters)


def employer_search(members: DataFrame, tool: str | None = None, category: str | None = None, least_days: int = 0, verified: bool = False, open_only: bool = False) -> DataFrame:
    out = members
    for column, wanted in (("tools", tool), ("work_categories", category)):
        if wanted:
            out = out.filter(F.array_contains(column, wanted))
    if least_days:
        out = out.filter(F.col("active_days") >= least_days)
    if verified:
        out = out.filter(F.col("signature") == "valid")
    return out.filter(_open(out)) if open_only else out


def facet(members: DataFrame, column: str) -> DataFrame:
    """Distinct values of an array column, in order."""
    return members.select(F.explode(column).alias("value")).distinct().orderBy("value")


def listed(profiles: DataFrame) -> DataFrame:
    """Latest published first, never published last, then by handle."""
    return profiles.orderBy(F.desc_nulls_last("published_at"), "handle")


def key_history(keys: DataFrame, revocations: DataFrame, active: str) -> DataFrame:
    """Status of each key: revoked if it is on the list, active if it is the active one, else rotated."""
    r = revocations.select("key_id", "revoked_at", "reason")
    status = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("key_id") == active, "active").otherwise("rotated")
    return keys.join(r, "key_id", "left").withColumn("status", status)


def classify_trust(signed: DataFrame, history: DataFrame, revoked: DataFrame, active: str | None) -> DataFrame:
    """trust of each signature (crypto_state, key_id, issued_at).

    A signature that is not valid keeps its state. A valid one is revoked if its key is on the revocation
    list or revoked in the history; active if its key is the active one; revoked if it was issued after
    the key's revocation; historical for other known keys; else history_unavailable.
    """
    h = history.select("key_id", F.col("status").alias("h_status"), F.col("revoked_at").alias("h_revoked_at"), F.lit(True).alias("in_history"))
    r = revoked.select("key_id", F.lit(True).alias("on_list")).distinct()
    no_history = history.isEmpty()
    j = signed.join(h, "key_id", "left").join(r, "key_id", "left")
    off = (F.col("h_status") == "revoked") | (F.col("h_revoked_at").isNotNull() & ~F.col("h_status").isin("active", "rotated"))
    rotated = F.coalesce(F.col("h_status") == "rotated", F.lit(False)) | (F.lit(active is not None) & (F.col("key_id") != F.lit(active)))
    trust = (
        F.when(F.col("crypto_state") != "valid", F.col("crypto_state"))
        .when(F.col("key_id").isNull(), "history_unavailable")
        .when(F.coalesce("on_list", F.lit(False)), "revoked")
        .when(F.lit(no_history), "history_unavailable")
        .when(F.coalesce(off, F.lit(False)), "revoked")
        .when(F.coalesce(F.col("key_id") == F.lit(active), F.lit(False)), "active")
        .when(rotated & F.coalesce(F.col("issued_at") > F.col("h_revoked_at"), F.lit(False)), "revoked")
        .when(rotated, "historical")
        .otherwise("history_unavailable")
    )
    return j.withColumn("trust", trust).drop("h_status", "h_revoked_at", "in_history", "on_list")


#: What a match of a project and a folder weighs; candidates need LEAST_SCORE. Fixed values.
WEIGHTS = {"folder_is": 340, "folder_has": 170, "package": 260, "text": 55, "domain": 420, "package_json": 30, "vite": 25, "next": 25, "python": 20}
LEAST_SCORE = 120


#: Letters of the parts by which names are looked up.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, in time that grows with it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def _candidates(projects: DataFrame, folders: DataFrame) -> DataFrame:
    """(project, folder) ids where one of the project's names stands in one of the folder's texts.

    An inverted index: each name is looked up by its rarest run of GRAM letters (a shorter name by itself) among
    the runs of the folders' texts, and then held against the text. Only runs that some name has are kept.
    """
    spaced = lambda a: F.replace(a, F.lit("-"), F.lit(" "))
    name = F.explode(F.concat(F.coalesce("aliases", F.array()), F.transform(F.coalesce("aliases", F.array()), spaced), F.transform(F.coalesce("domains", F.array()), F.lower)))
    names = projects.select("project", name.alias("word")).filter("word <> ''").distinct()
    text = F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in ("base", "package", "evidence")]))
    texts = folders.select("folder", text.alias("text")).filter("text <> ''")
    spark, path = folders.sparkSession, scratch(folders.sparkSession, "folder-texts")
    # many folders share a text: each text is indexed once
    texts.select("text").distinct().withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    places = spark.read.parquet(path)
    # of names: all their runs; of texts: those of the same lengths
    runs = F.when(F.length("word") >= GRAM, _grams(F.col("word"), GRAM)).otherwise(F.array("word"))
    of_names = names.select("word", F.explode(runs).alias("run")).distinct()
    of_texts = places.select("place", F.explode(F.array_union(F.array_union(_grams(F.col("text"), 1), _grams(F.col("text"), 2)), _grams(F.col("text"), GRAM))).alias("run")).join(of_names.select("run").distinct(), "run", "left_semi").distinct()
    path = scratch(spark, "folder-runs")
    of_texts.write.parquet(path)
    of_texts = spark.read.parquet(path)
    counts = of_texts.groupBy("run").agg(F.count("*").alias("n"))
    rarest = of_names.join(counts, "run", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))["run"].alias("run"))
    met = of_texts.join(rarest, "run").select("place", "word").join(places, "place").filter(F.contains("text", "word")).select("text", "word").distinct()
    return met.join(names, "word").select("project", "text").distinct().join(texts.hint("merge"), "text").select("project", "folder").distinct()  # texts and folders: too many to broadcast


def score_folders(projects: DataFrame, folders: DataFrame, most: int = 12) -> DataFrame:
    """The best folders of each project: name, dir, score.

    projects: name, aliases, domains; folders: dir, base, package, evidence (lower case), files. A folder in
    which no name or domain of a project stands cannot reach LEAST_SCORE: only the others are scored, and
    found through an index (see :func:`_candidates`). Empty names stand nowhere.
    """

    def kept(df: DataFrame, name: str, key: str) -> DataFrame:
        path = scratch(df.sparkSession, name)
        df.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
        return df.sparkSession.read.parquet(path)

    p, f = kept(projects.select("name", "aliases", "domains"), "projects", "project"), kept(folders.select("dir", "base", "package", "evidence", "files"), "folders", "folder")
    j = _candidates(p, f).join(p, "project").join(f.hint("merge"), "folder")
    w = WEIGHTS
    one = lambda a: F.when(a == "", 0).otherwise(F.when(F.col("base") == a, w["folder_is"]).when(F.col("base").contains(a), w["folder_has"]).otherwise(0) + F.when(F.col("package").contains(a), w["package"]).otherwise(0) + F.when(F.col("evidence").contains(a) | F.col("evidence").contains(F.replace(a, F.lit("-"), F.lit(" "))), w["text"]).otherwise(0))
    has = lambda *names: F.coalesce(F.arrays_overlap("files", F.array(*map(F.lit, names))).cast("int"), F.lit(0))
    score = (
        F.aggregate(F.coalesce("aliases", F.array()), F.lit(0), lambda s, a: s + F.coalesce(one(a), F.lit(0)))
        + F.aggregate(F.coalesce("domains", F.array()), F.lit(0), lambda s, d: s + F.when((d != "") & F.col("evidence").contains(F.lower(d)), w["domain"]).otherwise(0))
        + has("package.json") * w["package_json"] + has("vite.config.ts", "vite.config.js") * w["vite"] + has("next.config.ts", "next.config.js") * w["next"] + has("requirements.txt", "pyproject.toml") * w["python"]
    )
    from .rollup import top_n

    return top_n(j.select("name", "dir", score.alias("score")).filter(F.col("score") >= LEAST_SCORE), ["name"], [F.desc("score"), F.col("dir")], most)


def assign_folders(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """One folder for each project, first come first served: name, dir.

    candidates: name, dir, score, the best few of each project; order: name, ord, each once. In rounds every
    project asks for the best folder that is left to it, and a folder keeps of those that ask the first in
    order, and is left to none behind it; since all folders go by one order, what stands in the end is what
    serving the projects one after the other gives.
    """
    spark = candidates.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark, "folder-choices")
        df.write.parquet(path)
        return spark.read.parquet(path)

    left = kept(candidates.select("name", "dir", "score").distinct().join(order.select("name", "ord"), "name"))
    while True:
        asked = left.groupBy("name", "ord").agg(F.min_by("dir", F.struct(-F.col("score"), F.col("dir"))).alias("dir"))
        held = kept(asked.groupBy("dir").agg(F.min("ord").alias("holder")))
        after = kept(left.join(held, "dir", "left").filter("holder is null or ord <= holder").select("name", "dir", "score", "ord"))
        if after.count() == left.count():
            return asked.select("name", "dir")
        left = after


def observed_artifacts(artifacts: DataFrame, projects: DataFrame) -> DataFrame:
    """Artifacts with what backs them: a found project, a public link, or nothing but their word; best first."""
    found = projects.filter("found").select(F.lower("name").alias("_p")).distinct()
    j = artifacts.join(found, F.lower("linked_project") == F.col("_p"), "left")
    backing = F.when(F.col("_p").isNotNull(), "collector_observed").when(F.col("url").rlike("(?i)^https://"), "link_provided").otherwise("self_reported")
    j = j.withColumn("verification", backing).drop("_p")
    return j.withColumn("rank", F.when(F.col("verification") == "collector_observed", 0).when(F.col("verification") == "link_provided", 1).otherwise(2)).orderBy("rank", "ord")


def without_false_badges(artifacts: DataFrame) -> DataFrame:
    """An observed badge without a linked project is lowered; counts by badge are made anew with count_by."""
    claim = (F.col("verification") == "collector_observed") & F.coalesce(F.trim("linked_project") == "", F.lit(True))
    return artifacts.withColumn("verification", F.when(claim, "self_reported").otherwise(F.col("verification")))
