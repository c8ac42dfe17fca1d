"""Minimum-cost-flow resharding.

A layout of old shards is made of blocks: documents of one old shard whose texts share a hash range, so
that equal texts share a block. From the bytes of the old shards and the capacities of the new ones a
minimum-cost flow says how many bytes go from which shard to which (staying costs nothing, a moved byte
costs one); blocks realise the flow, and only the files of shards that give or take blocks are rewritten.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, stored, text_col


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at the least cost: 0 a byte where i = j, else 1.

    Successive shortest paths on the bipartite network of shards; sum(capacity) must be at least
    sum(supply). Its size is the number of shard pairs, whatever the number of rows.
    """
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    cap: list[dict[int, int]] = [{} for _ in range(m + n + 2)]
    cost: dict[tuple[int, int], int] = {}

    def arc(u: int, v: int, c: int, w: int) -> None:
        cap[u][v], cap[v][u], cost[u, v], cost[v, u] = c, 0, w, -w

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(n):
            arc(i, m + j, s, int(i != j))
    for j, c in enumerate(capacity):
        arc(m + j, sink, c, 0)
    while True:
        far, back, waiting = {source: 0}, {}, deque([source])
        while waiting:
            u = waiting.popleft()
            for v, c in cap[u].items():
                if c and far[u] + cost[u, v] < far.get(v, 1 << 60):
                    far[v], back[v] = far[u] + cost[u, v], u
                    waiting.append(v)
        if sink not in far:
            break
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        push = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= push
            cap[v][u] += push
    return {(i, j): cap[m + j][i] for i in range(m) for j in range(n) if cap[m + j][i]}


def choose_blocks(blocks: list[tuple[tuple, int, int, bool]], flow: dict[tuple[int, int], int]) -> dict[tuple, int]:
    """Blocks (key, old shard, bytes, part of a split block) that realise the flow between different shards.

    Whole blocks go first and parts of split ones last; each flow takes the largest block that still fits,
    and in the end the smallest left if that comes nearer than nothing.
    """
    moved: dict[tuple, int] = {}
    by_shard: dict[int, list[tuple[bool, int, tuple]]] = {}
    for key, old, size, split in blocks:
        by_shard.setdefault(old, []).append((split, -size, key))
    for (i, j), need in sorted(flow.items(), key=lambda x: -x[1]):
        if i == j:
            continue
        rest = []
        for split, size, key in sorted(by_shard.get(i, [])):
            if -size <= need:
                moved[key] = j
                need += size
            else:
                rest.append((split, size, key))
        if rest and need:
            least = max(rest, key=lambda x: x[1])
            if -least[1] - need < need:
                moved[least[2]] = j
                rest.remove(least)
        by_shard[i] = rest
    return moved


def place(docs: DataFrame, shards: int, old_shard: Column | None, capacities: list[int] | None, blocks_per_shard: int, split_over: float, balance: float) -> tuple[DataFrame, set[int]]:
    """(rows, affected): docs as a struct ``doc`` with doc_id, size, text_crc32, old_shard, shard; the shards that give or take any.

    Where a row goes follows from its own text and doc_id, so that null and repeated doc_ids are placed a row each.
    """
    text = text_col()
    group = F.xxhash64(text)
    old = F.pmod(group, F.lit(shards)) if old_shard is None else old_shard
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(doc, F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.cast("int").alias("old_shard"), F.pmod(F.shiftright(group, 20), F.lit(blocks_per_shard)).cast("int").alias("block"))
    light = stored(rows.drop("doc"), "shard-rows")
    sums = light.groupBy("old_shard", "block").agg(F.sum("size").alias("size")).collect()  # shards x blocks_per_shard rows
    total = sum(r["size"] for r in sums)
    target = -(-total // shards) if sums else 0
    room = [target] * shards if capacities is None else list(capacities)
    if len(room) != shards or min(room) < 0 or sum(room) < total:
        raise ValueError(f"{shards} capacities of {total} bytes in all are needed")
    spark = docs.sparkSession

    def with_part(df: DataFrame, split: DataFrame) -> DataFrame:
        return df.join(F.broadcast(split), ["old_shard", "block"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")

    def plan(share: float) -> tuple[dict[tuple, int], DataFrame, int]:
        """(moved blocks, split blocks, the most bytes by which a new shard misses its target), with blocks above this share of a shard split."""
        most = max(1, int(target * share))
        parts = {(r["old_shard"], r["block"]): -(-4 * r["size"] // most) for r in sums if r["size"] > most}
        split = spark.createDataFrame([(*k, v) for k, v in parts.items()], "old_shard int, block int, parts long")
        pieces = [((r["old_shard"], r["block"], 0), r["old_shard"], r["size"], False) for r in sums if (r["old_shard"], r["block"]) not in parts]
        if parts:  # at most 4 / share parts a shard
            fine = with_part(light, split).join(F.broadcast(split.drop("parts")), ["old_shard", "block"], "left_semi").groupBy("old_shard", "block", "part").agg(F.sum("size").alias("size")).collect()
            pieces += [((r["old_shard"], r["block"], r["part"]), r["old_shard"], r["size"], True) for r in fine]
        supply = [0] * max([shards, *(r["old_shard"] + 1 for r in sums)])
        for _, i, size, _ in pieces:
            supply[i] += size
        moved = choose_blocks(pieces, min_cost_flow(supply, room))
        free = list(room)
        for k, i, size, _ in pieces:
            if (j := moved.get(k, i)) < shards:
                free[j] -= size
        left = [(-size, k) for k, i, size, _ in pieces if k not in moved and (i >= shards or not room[i])]
        for size, k in sorted(left):  # remainders of shards that are given up
            moved[k] = max((j for j in range(shards) if room[j]), key=lambda j: (free[j], -j))
            free[moved[k]] += size
        off = [abs(x) for x in free] if capacities is None else [-x for x in free]
        return moved, split, max([0, *off])

    moved, split, off = plan(split_over)
    if off > balance * target:  # large groups that were kept whole stand in the way
        finer = plan(min(split_over, balance))
        if finer[2] < off:
            moved, split, _ = finer
    moves = spark.createDataFrame([(*k, v) for k, v in moved.items()], "old_shard int, block int, part int, new_shard int")
    placed = with_part(rows, split).join(F.broadcast(moves), ["old_shard", "block", "part"], "left")
    affected = {x for k, j in moved.items() for x in (k[0], j) if k[0] != j}
    return placed.select("doc", "doc_id", "size", "text_crc32", "old_shard", F.coalesce("new_shard", "old_shard").alias("shard"), F.lit(1).cast("long").alias("one")), affected


def reshard(docs: DataFrame, shards: int = 8, old_shard: Column | None = None, blocks_per_shard: int = 512, split_over: float = 1.0, capacities: list[int] | None = None, balance: float = 1 / 64) -> DataFrame:
    """Give every document a shard so that the shards' bytes are near equal and the fewest bytes move.

    :param old_shard: where a document is now, as a whole number from 0; by default ``shards`` shards by the
        hash of the text. Numbers of ``shards`` and above are shards that are given up.
    :param blocks_per_shard: blocks of an old shard; shards end equal to about one block.
    :param split_over: a block larger than this share of a shard (a group of copies that no shard can hold)
        is dealt to parts by document, which move apart only if the balance needs it. All other equal texts
        of one old shard stay together, unless
    :param balance: shards then miss their target by more than this share of it: groups larger than that share
        are dealt to parts too.
    :param capacities: the most bytes of each new shard, kept to about one block; by default equal ones that
        just hold all. A shard of capacity 0 is given up.

    Returns doc_id, size, text_crc32, old_shard, shard, slot; slots are gapless from 0 in each shard, by
    doc_id. Size is the UTF-8 bytes of the text (none if null) plus 1. Null and repeated doc_ids are kept,
    a row each. An empty table gives no rows. Other columns are read only if old_shard names them. This is
    the placement alone; :func:`reshard_files` also writes the documents.
    """
    placed, _ = place(docs, shards, old_shard, capacities, blocks_per_shard, split_over, balance)
    out = running(stored(placed.drop("doc"), "shard-placed"), ["shard"], ["doc_id", "text_crc32"], "one", "slot")
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("slot_before").alias("slot"))


def write_shards(rows: DataFrame, affected: set[int], out_dir: str) -> None:
    """Replace the folders of the affected shards by rows (with shard and slot); the others stay as they are."""
    spark = rows.sparkSession
    mine = rows.filter(F.col("shard").isin(sorted(affected)))
    mine.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(out_dir)
    filled = {r["shard"] for r in rows.select("shard").distinct().collect()}  # as many as shards
    for i in sorted(affected - filled):  # dynamic overwrite leaves the folder of a shard that got no rows
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir.rstrip('/')}/shard={i}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reshard_files(docs: DataFrame, out_dir: str, shards: int = 8, old_shard: Column | None = None, blocks_per_shard: int = 512, split_over: float = 1.0, capacities: list[int] | None = None, balance: float = 1 / 64) -> DataFrame:
    """Place the documents as :func:`reshard` does and rewrite the files of the shards that give or take any.

    out_dir holds a folder ``shard=i`` for each shard; those of affected shards are replaced (or removed, if
    given up), all others are not touched. Returns the columns of docs, shard and slot (own columns of
    these two names are replaced), a row for each document: of rewritten shards as the files have them, of
    the others as docs has them.
    """
    spark = docs.sparkSession
    placed, affected = place(docs, shards, old_shard, capacities, blocks_per_shard, split_over, balance)
    # rows of equal doc_id and text, which may be very many, are told apart by their place in the table
    placed = placed.drop("size", "old_shard").withColumn("at", F.monotonically_increasing_id())
    ranked = running(placed, ["shard"], ["doc_id", "text_crc32", "at"], "one", "slot")
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = ranked.select(*[F.col(f"doc.`{c}`").alias(c) for c in own], F.col("slot_before").alias("slot"), "shard")
    if not affected:
        return rows
    write_shards(rows, affected, out_dir)
    there = F.col("shard").isin(sorted(affected))
    return spark.read.schema(rows.schema).parquet(out_dir).filter(there).unionByName(rows.filter(~there))


def rewrite_affected(docs: DataFrame, shards: DataFrame, out_dir: str) -> DataFrame:
    """Write the documents of shards that give or take any; returns shard, rewritten for every shard.

    For a placement (of :func:`reshard`) made apart from the documents. Both are joined by doc_id, text and
    the number of the row among those equal in both, so that null and repeated doc_ids keep a row each;
    rows equal in doc_id and text are taken as interchangeable. Where they are not, because they differ in
    other columns, use :func:`reshard_files`. Files of shards that are not rewritten stay as they are. An
    empty table writes nothing.
    """
    changed = shards.filter("old_shard <> shard")
    moved = changed.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = {r["shard"] for r in moved.collect()}  # as many as shards
    one, at = F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("at")
    text = text_col()
    plain = docs.drop("shard", "slot")
    doc = F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("doc")
    key = ["_id", "_crc"]
    left = stored(plain.select(doc, F.col("doc_id").cast("long").alias("_id"), F.crc32(text.cast("binary")).alias("_crc"), one, at), "rewrite-docs")
    right = stored(shards.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot", one, at), "rewrite-shards")
    a, b = (running(x, key, ["at"], "one", "nth").drop("one", "at", "nth_total") for x in (left, right))
    on = a["_id"].eqNullSafe(b["_id"]) & (a["_crc"] == b["_crc"]) & (a["nth_before"] == b["nth_before"])
    if affected:
        write_shards(a.join(b, on).select(*[F.col(f"doc.`{c}`").alias(c) for c in plain.columns], "slot", "shard"), affected, out_dir)
    return shards.select("shard").distinct().withColumn("rewritten", F.col("shard").isin(sorted(affected)))
