"""Near-duplicate documents by MinHash.

Signatures. The distinct shingles of a document are hashed once; the range of the hash is cut into bins,
a bin keeps its least hash, and empty bins are filled by optimal densification. Bands of bins become
bucket keys. Documents of equal sets are one node from here on, however many they are.

Links. Each bucket first makes a star: the node that shares most buckets with others, which in a group of
copies is the one nearest to all, is paired with every other node. Pairs whose signatures agree far too
little are dropped, the rest are confirmed on the full sets of shingles, and linked nodes form components.
Most buckets lie within one component then. In any other, the nodes outside the bucket's largest
component are held against all its nodes of other components, block by block and inside tasks; again only
pairs whose signatures agree come out, each from the first bucket it shares, and are confirmed. So every
pair of a bucket that could still join two components is looked at, while a group of n copies costs about
n pairs. What remains is the chance that a linked pair shares no bucket, (1 - 0.8^6)^44 = 1.6e-6 at a
likeness of exactly 0.8, or that its signatures agree too little, 3e-5 there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_col

BANDS, ROWS = 44, 6
BINS = BANDS * ROWS
PROBES = 16
#: Pairs whose signatures agree in less than this share of bins are not confirmed: at a likeness of 0.8 it is four standard deviations off.
LEAST = 0.7
#: Nodes of a bucket that meet in one block, and the bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
        x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; all words as one where they are fewer; none without words."""
    from xxhash import xxh3_64_intdigest as h

    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(h, words), U, len(words))
    n = max(1, len(w) - size + 1)
    k = min(size, len(w))
    with np.errstate(over="ignore"):
        s = mix(w[:n] + U(k))
        for i in range(1, k):
            s = mix(s * U(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(s)


_random = np.random.default_rng(20240229)
PROBE = _random.integers(0, BINS, (BINS, PROBES))
SALT = _random.integers(1, 1 << 63, BINS).astype(U)


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set of hashes, densified."""
    at = ((s >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out, full = np.zeros(BINS, U), np.zeros(BINS, bool)
    out[at[first]], full[at[first]] = s[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[PROBE[empty]]
        found = hit.any(1)
        some = empty[found]
        out[some] = out[PROBE[some, hit[found].argmax(1)]]
        rest = empty[~found]
        if len(rest):  # few bins are filled: the one of them that comes first in the empty bin's own order
            bins = at[first]
            out[rest] = s[first][mix(SALT[rest][:, None] ^ SALT[bins][None, :] * U(3)).argmin(1)]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BINS) -> (documents, BANDS)."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(SALT[:BANDS], parts.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def sketch(size: int):
    """mapInArrow function: doc_id, text, text_key -> doc_id, text_key, n_shingles, node, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as h

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [shingles(x, size) for x in b.column(1).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = np.array([signature(sets[i]) for i in some], U).reshape(-1, BINS)
                keys = band_keys(sig).view(np.int64)
                node, key_col = ([None] * len(sets) for _ in range(2))
                for j, i in enumerate(some):
                    node[i], key_col[i] = np.array(h(sets[i].tobytes()), U).view(np.int64).item(), keys[j]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(key_col, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "node", "keys"])

    return run


SKETCH = "doc_id long, text_key long, n_shingles long, node long, keys array<long>"


def describe(size: int):
    """mapInArrow function: node, text -> node, sig (low bits of the signature), set, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [shingles(x, size) for x in b.column(1).to_pylist()]
                sig = (mix(np.array([signature(x) for x in sets], U).reshape(-1, BINS) ^ SALT) & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], ["node", "sig", "set", "n"])

    return run


DESCRIBE = "node long, sig binary, set binary, n long"


def alike(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets of hashes have the wished likeness."""
    p, q = np.frombuffer(a, U), np.frombuffer(b, U)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, BINS) for c in ("sig_a", "sig_b"))
            share = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
            yield b.select(["a", "b"]).filter(pa.array(share >= LEAST))


def _agreeing(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Linked pairs of one block, outliers (role 0) with nodes (role 1) of other components: one for each outlier and component."""
    role = rows["role"]
    out, all_ = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    if not len(out) or not len(all_):
        return
    y, band, sets = rows["sig"][all_], int(rows["band"][0]), rows["set"]
    for i in out:
        x, node = rows["sig"][i], rows["node"][i]
        able = (rows["comp"][all_] != rows["comp"][i]) & (~rows["outlier"][all_] | (rows["node"][all_] > node))
        if not able.any():
            continue
        some = all_[able]
        same = y[able] == x
        share = (same.mean(1) - 1 / 256) / (1 - 1 / 256)
        near = np.flatnonzero(share >= LEAST)
        if not len(near):
            continue
        # a pair is looked at in the first two of its buckets: low bits may show one that is none
        before = same[near].reshape(-1, BANDS, ROWS).all(2)[:, :band].sum(1)
        near = near[before < 2]
        linked: set[int] = set()
        for j in some[near[np.argsort(-share[near], kind="stable")]]:
            comp = int(rows["comp"][j])
            if comp not in linked and alike(sets[i], sets[j], percent):
                linked.add(comp)
                yield int(node), int(rows["node"][j])


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> pairs of each block; a block may go over several batches."""
    names = ("role", "node", "comp", "outlier", "band")
    kept: list[dict[str, np.ndarray]] = []
    last = None

    def emit() -> list[tuple[int, int]]:
        return list(_agreeing({k: np.concatenate([r[k] for r in kept]) for k in kept[0]}, percent)) if kept else []

    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "salt", "part")], 1)
        cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names} | {"sig": np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, BINS), "set": np.array(b.column("set").to_pylist(), object)}
        starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, b.num_rows]
        found: list[tuple[int, int]] = []
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if last is not None and last != tuple(key[i]):
                found += emit()
                kept.clear()
            last = tuple(key[i])
            kept.append({k: v[i:j] for k, v in cols.items()})
        x, y = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y).tolist(), pa.int64()), pa.array(np.maximum(x, y).tolist(), pa.int64())], ["a", "b"])
    found = emit()
    x, y = zip(*found, strict=True) if found else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y).tolist(), pa.int64()), pa.array(np.maximum(x, y).tolist(), pa.int64())], ["a", "b"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(x, y, percent) for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def connect(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Join the components (node, comp) that edges (a, b) link; comp is the least node of a component.

    Rounds of taking the least neighbouring component and of halving the paths to it, on the components
    that edges touch; each round is a stored table.
    """
    ends = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    links = stored(edges.join(ends[0], "a").join(ends[1], "b").filter("ca <> cb").select("ca", "cb").distinct(), "nd-links")
    parent = None
    while not links.isEmpty():
        both = links.union(links.select("cb", "ca"))
        step = stored(both.groupBy("ca").agg(F.least(F.min("cb"), F.first("ca")).alias("to")).select(F.col("ca").alias("comp"), "to"), "nd-step")
        for _ in range(2):  # twice: four steps at once
            far = step.select(F.col("comp").alias("to"), F.col("to").alias("far"))
            step = step.join(far, "to").select("comp", F.col("far").alias("to"))
        step = stored(step, "nd-step")
        if parent is None:
            parent = step
        else:
            onward = step.select(F.col("comp").alias("to"), F.col("to").alias("far"))
            parent = stored(parent.join(onward, "to", "left").select("comp", F.coalesce("far", "to").alias("to")), "nd-parent")
        one, two = step.select(F.col("comp").alias("ca"), F.col("to").alias("na")), step.select(F.col("comp").alias("cb"), F.col("to").alias("nb"))
        links = stored(links.join(one, "ca").join(two, "cb").filter("na <> nb").select(F.col("na").alias("ca"), F.col("nb").alias("cb")).distinct(), "nd-links")
    if parent is None:
        return labels
    return stored(labels.join(parent, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "nd-labels")


def confirm(likely: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that the full sets of shingles confirm. nodes: node, set."""
    sets = nodes.select("node", "set")
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return stored(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long"), "nd-edges")


def components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_key, n_shingles, node), (labels: node, comp) with labels for nodes that share a bucket."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"), F.xxhash64(text_col()).alias("text_key"))
    texts = d.select(F.xxhash64(F.struct("doc_id", "text_key")).alias("at"), "text")
    rows = stored(d.mapInArrow(sketch(size), SKETCH), "nd-rows")
    light = rows.select("doc_id", "text_key", "n_shingles", "node")
    # one row for a node: of its documents, the first by (doc_id, text)
    first = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("place"))
    shared = rows.filter("node is not null").select("node", F.posexplode("keys").alias("band", "bucket")).groupBy("bucket", "node").agg(F.min("band").alias("band"))
    counts = shared.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(shared.join(counts, "bucket"), "nd-buckets")
    weights = stored(buckets.groupBy("node").agg(F.sum("n").alias("weight")), "nd-nodes")
    labels = weights.select("node", F.col("node").alias("comp"))
    # signatures and sets of the nodes that share a bucket, each from one of its texts; the one shuffle of whole texts
    where = weights.select("node").join(first, "node").select("node", F.xxhash64("place").alias("at"))
    found = texts.join(where.hint("merge"), "at").dropDuplicates(["at"]).select("node", "text")
    nodes = stored(found.mapInArrow(describe(size), DESCRIBE), "nd-sets")
    sigs = nodes.select("node", "sig")
    # stars
    centres = buckets.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    starred = stored(buckets.join(centres, "bucket"), "nd-stars")
    pairs = starred.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    with_sigs = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    likely = stored(with_sigs.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely, "a long, b long"), "nd-likely")
    labels = connect(confirm(likely, nodes, percent), labels)
    # what stars have left open: centres have met all others, nodes of one component need not meet
    named = starred.filter("node <> centre").select("bucket", "band", "node").join(labels, "node").join(nodes.select("node", "n"), "node")
    sums = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("size"))
    large = sums.groupBy("bucket").agg(F.max(F.struct("n", "comp", "size")).alias("large"), F.sum("n").alias("nodes"), F.sum("size").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    cuts = lambda n, size: F.ceil(F.greatest(n / BLOCK, size * 8 / BLOCK_BYTES)).cast("int")
    large = large.select("bucket", F.col("large.comp").alias("large"), cuts(F.col("nodes"), F.col("size")).alias("salts"), cuts(F.col("nodes") - F.col("large.n"), F.col("size") - F.col("large.size")).alias("parts"))
    opened = named.drop("n").join(large, "bucket").join(nodes.select("node", "sig", "set"), "node").withColumn("outlier", F.col("comp") != F.col("large"))
    salt, part = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("salts", "parts"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keep = ["bucket", "band", "node", "comp", "outlier", "sig", "set"]
    every_node = opened.withColumn("salt", salt).withColumn("part", every("parts")).select(*keep, "salt", "part", F.lit(1).alias("role"))
    outliers = opened.filter("outlier").withColumn("part", part).withColumn("salt", every("salts")).select(*keep, "salt", "part", F.lit(0).alias("role"))
    key = ["bucket", "salt", "part"]
    met = every_node.union(outliers).repartition(*key).sortWithinPartitions(*key, "role")
    more = stored(met.select(*key, "band", "node", "comp", "outlier", "sig", "set", "role").mapInArrow(partial(_blocks, percent=percent), "a long, b long").distinct(), "nd-more")
    if not more.isEmpty():
        labels = connect(more, labels)
    return light, labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard likeness of at least percent / 100.

    :param size: words in a shingle.

    Returns doc_id, n_shingles, component_id, kept (and text_key, the text's 64-bit hash), a row for each
    input row. A text without words, or null, has no shingles and is linked with nothing: it is its own
    component, and kept. component_id is the least doc_id of the component, nulls aside; a null doc_id is
    never kept, unless no document of its component has one, in which case all of it is. Repeated rows of
    one doc_id are in one component and are all kept or not. An empty table gives no rows. Other columns are not read. Sets
    are compared as 64-bit hashes of shingles.
    """
    return _grouped(docs, size, percent).drop("comp")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    rows, labels = components(docs, size, percent)
    # nodes that share no bucket are components of their own
    firsts = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = firsts.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_node = stored(named.select("node", "comp").join(least, "comp").select("node", "comp", "component_id"), "nd-components")
    out = rows.join(of_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_key", "comp")


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which :func:`near_duplicates` keeps one each: all columns, one row for each group.

    Rows that repeat doc_id and text are one document, whatever their other columns. Of a group without
    any doc_id one text stays.
    """
    found = _grouped(docs, size, percent).filter("kept")
    # comp is null for texts without words
    least = found.groupBy("comp", "doc_id", F.when(F.col("comp").isNull(), F.col("text_key")).alias("alone")).agg(F.min("text_key").alias("text_key"))
    keep = stored(least.select(F.xxhash64(F.struct("doc_id", "text_key")).alias("at")).distinct(), "nd-kept")
    # the columns of docs as one, so that none is taken for a key
    at = F.xxhash64(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_col()).alias("text_key"))).alias("at")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), at)
    return rows.join(keep, "at", "left_semi").dropDuplicates(["at"]).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
