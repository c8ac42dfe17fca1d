"""Removal of passages that repeat across documents, word for word, by compressed full-text indexes.

Routing. Every window of ``window`` words has an anchor: of its runs of a few words the one of least hash,
the first of these on a tie. Equal windows have equal anchors, so a shard of anchors knows all about its
windows. Neighbouring windows with one anchor form a segment; documents, read into blocks, send the hashes of
their segments (anchor, content, place), of equal segments in a block the first alone. Sorted by anchor and
content, a segment that is not the first of its content is covered; one whose anchor no other content has
stands alone, and its windows with it. Only segments whose anchor has several contents can share some
windows and not others: their words go to the shard of their anchor.

Index. A shard builds a compressed full-text index (see fmindex) of these segments and streams them through it:
backward search over wavelet matrices gives matching statistics, and where a match reaches the window's
length its interval of the suffix order leads to the least place of an equal window, which says whether it
starts earlier elsewhere. An anchor with more than MOST contents is no task's: its segments fall into
windows, and these are judged as segments of one window each.

Coverage. What is covered returns to the blocks as runs of windows, which drop the words below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, partitions, stored, text_col
from .fmindex import FMIndex
from .neardup import mix

U = np.uint64
#: Words of a block, of an anchor and (about) of a shard; contents of an anchor that meet in one shard.
BLOCK_WORDS, ANCHOR_WORDS, SHARD_WORDS, MOST = 1_000_000, 6, 500_000, 4096
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BLOCKS = "block long, doc_ids array<long>, keys array<int>, sizes array<int>, n_bytes long, words binary"
#: A segment of n windows from word ``start`` of its block; content is null for one that its block knows as covered.
SEGMENTS = "anchor long, content long, doc_id long, key int, block long, start int, n int"
COVERED, SHARED, SPLIT = 0, 1, 2
JUDGED = "anchor long, block long, start int, n int, kind int"
RUNS = "block long, start int, n int"
RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,words:long>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, text -> BLOCKS; the documents of a block are in the order of their places."""
    number = TaskContext.get().partitionId() << 32
    docs: list[tuple] = []
    total = 0

    def row() -> pa.RecordBatch:
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0, d[1]))
        text = b"\n".join(d[3] for d in docs)
        cols = [[number], [[d[0] for d in docs]], [[d[1] for d in docs]], [[d[2] for d in docs]], [len(text)], [pa.compress(text, "zstd", asbytes=True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary()), strict=True)], ["block", "doc_ids", "keys", "sizes", "n_bytes", "words"])

    for b in batches:
        for i, key, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            docs.append((i, key, len(words), b" ".join(words)))
            total += len(words)
            if total >= BLOCK_WORDS or len(docs) >= BLOCK_WORDS // 10:
                yield row()
                docs, total, number = [], 0, number + 1
    if docs:
        yield row()


class Block:
    """The documents of a row of BLOCKS as one list of words."""

    def __init__(self, row: dict):
        self.number, self.doc_ids, self.keys = row["block"], row["doc_ids"], row["keys"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.words = pa.decompress(row["words"], row["n_bytes"], "zstd", asbytes=True).split()

    def hashes(self) -> np.ndarray:
        from xxhash import xxh3_64_intdigest as h

        return np.fromiter(map(h, self.words), U, len(self.words))

    def segments(self, window: int) -> tuple[np.ndarray, ...]:
        """(anchor, content, start, n) of all segments, in order."""
        a = self.hashes()
        none = np.zeros(0, np.int64)
        if len(a) < window:
            return none.astype(U), none.astype(U), none, none
        size = min(ANCHOR_WORDS, window)
        count = len(a) - size + 1
        with np.errstate(over="ignore"):
            least = mix(a[:count] + U(size))
            for i in range(1, size):
                least = mix(least * BASE + a[i : count + i])
        at = np.arange(count)
        every = least  # hash of the run at each place
        # the least of growing stretches, the first on a tie
        goal, have = window - size + 1, 1
        while have < goal:
            step = min(have, goal - have)
            m = len(least) - step
            further = least[step:] < least[:m]
            least, at = np.where(further, least[step:], least[:m]), np.where(further, at[step:], at[:m])
            have += step
        # at[i]: the anchor of the window that starts at i, which must end within its document
        whole = np.repeat(self.ends, self.sizes)[: len(at)] - np.arange(len(at)) >= window
        i = np.flatnonzero(whole)
        if not len(i):
            return none.astype(U), none.astype(U), none, none
        new = np.r_[True, (np.diff(i) != 1) | (np.diff(at[i]) != 0)]
        start = i[new]
        n = np.diff(np.r_[np.flatnonzero(new), len(i)])
        # the hash of words i..j from sums of hash * BASE^place
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.r_[U(1), np.full(len(a) - 1, BASE)])
            down = np.multiply.accumulate(np.r_[U(1), np.full(len(a) - 1, INVERSE)])
            sums = np.r_[U(0), np.cumsum(a * power, dtype=U)]
            content = mix((sums[start + n + window - 1] - sums[start]) * down[start] + n.astype(U))
        return every[at[start]], content, start, n

    def places(self, start: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """doc_id and key of the documents of words."""
        of = pa.array(np.searchsorted(self.ends, start, "right"))
        return pa.array(self.doc_ids, pa.int64()).take(of), pa.array(self.keys, pa.int32()).take(of)


def _rows(b: Block, anchor: np.ndarray, content: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> pa.RecordBatch:
    """SEGMENTS of a block: of equal segments the first; the others as covered runs of windows."""
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    first = np.ones(len(order), bool)
    first[order[1:]] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    s, m = start[~first], n[~first]
    if len(s):
        new = np.flatnonzero(np.r_[True, s[1:] != (s + m)[:-1]])
        s, m = s[new], np.add.reduceat(m, new)
    starts = np.r_[start[first], s]
    doc_id, key = b.places(starts)
    with np.errstate(over="ignore"):
        spread = mix(s.astype(U) + U(b.number) * BASE)
    known = np.arange(len(starts)) < first.sum()
    cols = [pa.array(np.r_[anchor[first], spread].view(np.int64)), pa.array(np.r_[content[first], spread].view(np.int64), mask=~known), doc_id, key, pa.array(np.full(len(starts), b.number)), pa.array(starts, pa.int32()), pa.array(np.r_[n[first], m], pa.int32())]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SEGMENTS.split(", ")])


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row)
            yield _rows(b, *b.segments(window), window)


def _judge(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """SEGMENTS sorted by anchor, content and place -> JUDGED. An anchor may go over several batches."""
    names = ("anchor", "content", "block", "start", "n")
    carry: dict[str, np.ndarray] = {}
    #: the anchor that has more than ``most`` rows, and its last content
    hot: tuple[int, int] | None = None

    def judge(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        nonlocal hot
        anchor, content, known = x["anchor"], x["content"], x["known"]
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        new = new_anchor | np.r_[True, (content[1:] != content[:-1]) | (known[1:] != known[:-1])]
        run = np.cumsum(new_anchor) - 1
        rows, contents = np.bincount(run)[run], np.bincount(run, new & known)[run]
        large = rows > most
        if hot and hot[0] == anchor[0]:
            large |= run == 0
            new[0] = hot[1] != content[0]
        if large[-1]:
            hot = int(anchor[-1]), int(content[-1])
        kind = np.where(~known | ~new, COVERED, np.where(large, SPLIT, SHARED))
        tell = ~known | ~new | large | (contents > 1)
        return pa.RecordBatch.from_arrays([pa.array(v[tell], t) for v, t in ((anchor, pa.int64()), (x["block"], pa.int64()), (x["start"], pa.int32()), (x["n"], pa.int32()), (kind, pa.int32()))], ["anchor", "block", "start", "n", "kind"])

    for b in batches:
        if not b.num_rows:
            continue
        x = {c: b.column(c).fill_null(0).to_numpy() for c in names} | {"known": b.column("content").is_valid().to_numpy(zero_copy_only=False)}
        x = {c: np.concatenate([carry[c], v]) for c, v in x.items()} if carry else x
        last = int(np.searchsorted(x["anchor"], x["anchor"][-1]))
        # an anchor of too many rows is not waited for
        if len(x["anchor"]) - last > most:
            last = len(x["anchor"])
        carry = {c: v[last:] for c, v in x.items()} if last < len(x["anchor"]) else {}
        if last:
            yield judge({c: v[:last] for c, v in x.items()})
    if carry:
        yield judge(carry)


def _asked(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """BLOCKS with the segments asked for -> SEGMENTS with their words, and without, under a hash of its words, each window of those that fall into windows."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row)
            whole = [r for r in row["asked"] if r["kind"] == SHARED]
            if whole:
                start = np.array([r["start"] for r in whole], np.int64)
                doc_id, key = b.places(start)
                words = [b" ".join(b.words[r["start"] : r["start"] + r["n"] + window - 1]) for r in whole]
                cols = [pa.array([r["anchor"] for r in whole], pa.int64()), pa.nulls(len(whole), pa.int64()), doc_id, key, pa.array(np.full(len(whole), b.number)), pa.array(start, pa.int32()), pa.array([r["n"] for r in whole], pa.int32()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "words"])
            parted = [r for r in row["asked"] if r["kind"] == SPLIT]
            if parted:
                n = np.array([r["n"] for r in parted], np.int64)
                start = np.unique(np.repeat([r["start"] for r in parted], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                a = b.hashes()
                one, two = a[start], a[start] ^ BASE
                with np.errstate(over="ignore"):
                    for i in range(1, window):
                        one, two = mix(one * BASE + a[start + i]), mix((two + a[start + i]) * INVERSE)
                single = _rows(b, one, two, start, np.ones(len(start), np.int64), window)
                yield single.append_column("words", pa.nulls(single.num_rows, pa.binary()))


def _earlier(t: pa.Table, window: int) -> pa.Table:
    """The words of a shard's segments -> RUNS of windows that start earlier in another place."""
    n = t.column("n").to_numpy().astype(np.int64)
    sizes = n + window - 1
    coded = pa.array([w for x in t.column("words").to_pylist() for w in x.split(b" ")], pa.binary()).dictionary_encode()
    # segments with a 0 after each
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    text[inside] = coded.indices.to_numpy() + 1
    index = FMIndex(text, window)
    # places of windows: documents in order, blocks in order where these agree, then words
    ids = t.column("doc_id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    by = (t.column("block").to_numpy(), t.column("key").to_numpy(), ids.fill_null(0).to_numpy(), ~known)
    order = np.lexsort(by)
    differ = np.zeros(len(order), bool)
    for x in by:
        differ[1:] |= x[order][1:] != x[order][:-1]
    document = np.empty(len(order), np.int64)
    document[order] = np.cumsum(differ)
    first = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(t.column("start").to_numpy().astype(np.int64), n) + first - np.repeat(starts, n)
    never = np.iinfo(np.int64).max
    place = np.full(len(text), never)
    place[first] = (np.repeat(document, n) << 32) + start
    cuts = index.cuts(window)
    least = np.minimum.reduceat(place[index.order], cuts[:-1])
    length, at = index.matching_statistics(text, starts, starts + sizes)
    found = length[first] >= window
    interval = np.searchsorted(cuts, at[first], "right") - 1
    removed = found & (least[interval] < place[first])
    block = np.repeat(t.column("block").to_numpy(), n)[removed]
    start = start[removed]
    order = np.lexsort((start, block))
    block, start = block[order], start[order]
    new = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(start) != 1)]) if len(start) else np.zeros(0, int)
    return pa.table({"block": pa.array(block[new], pa.int64()), "start": pa.array(start[new], pa.int32()), "n": pa.array(np.diff(np.r_[new, len(start)]), pa.int32())})


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """BLOCKS with their covered runs of windows -> RESULT."""
    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row)
            change = np.zeros(len(b.words) + 1, np.int64)
            for r in row["asked"] or ():
                change[r["start"]] += 1
                change[r["start"] + r["n"] + window - 1] -= 1
            gone = np.cumsum(change)[:-1] > 0
            out = []
            for i, lo, hi in zip(b.doc_ids, (b.ends - b.sizes).tolist(), b.ends.tolist(), strict=True):
                own = gone[lo:hi]
                edges = np.flatnonzero(np.diff(np.r_[False, own, False]))
                spans = [{"first": int(x), "words": int(y - x)} for x, y in zip(edges[::2], edges[1::2], strict=True)]
                at, kept = lo, []
                for x in spans:
                    kept += b.words[at : lo + x["first"]]
                    at = lo + x["first"] + x["words"]
                kept += b.words[at:hi]
                out.append((i, hi - lo, int(own.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"), spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ", 4)])


def remove_repeats(docs: DataFrame, window: int = 20, most: int = MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Remove every word that is covered by a window of words which also starts earlier in the corpus.

    :param window: words of a window.
    :param most: contents of an anchor (counted once a block) that may meet in one shard; those of an anchor
        with more are held against each other window by window, by 128-bit hashes.
    :param shard_words: words of an index, about.

    Earlier is: in a document of smaller doc_id, a null being the largest, or earlier in the same one. Rows of
    one doc_id are documents of their own, in the order of a hash of their texts; equal rows come one after
    another, so that all but one lose what they repeat. Windows are judged on the input.

    Returns doc_id, n_words, n_removed, kept (the words that stay, joined by blanks) and spans (first word
    and words of each part removed), a row for each input row. A null text counts as empty; one of fewer words
    than the window loses none. An empty table gives no rows. Other columns are not read.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    spark = docs.sparkSession
    parts = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text_col()).alias("key"), text_col().alias("text"))
    blocks = stored(d.mapInArrow(_blocks, BLOCKS), "ss-blocks")

    def judged(segments: DataFrame, name: str) -> DataFrame:
        by_anchor = segments.repartition(parts, "anchor").sortWithinPartitions("anchor", "content", F.col("doc_id").asc_nulls_last(), "key", "block", "start")
        return stored(by_anchor.mapInArrow(partial(_judge, most=most), JUDGED), name)

    def asked(rows: DataFrame, how: str) -> DataFrame:
        """Blocks with what is asked of them; both sides are dealt by block."""
        light = rows.groupBy("block").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "block"])).alias("asked"))
        return blocks.join(light.hint("merge"), "block", how)

    told = judged(blocks.mapInArrow(partial(_segments, window=window), SEGMENTS), "ss-judged")
    collect_garbage(spark)
    runs = told.filter(F.col("kind") == COVERED).select("block", "start", "n")
    counts = told.groupBy("kind").agg(F.sum(F.col("n") + F.lit(window)).alias("words")).collect()
    words = {r["kind"]: r["words"] for r in counts}
    if words.keys() & {SHARED, SPLIT}:
        open_ = told.filter(F.col("kind") != COVERED)
        found = stored(asked(open_, "inner").mapInArrow(partial(_asked, window=window), f"{SEGMENTS}, words binary"), "ss-asked")
        collect_garbage(spark)
        shard = F.pmod(F.xxhash64("anchor"), F.lit(max(parts, -(-words.get(SHARED, 0) // shard_words))).cast("long")).alias("shard")
        shared = found.filter("words is not null").drop("content").withColumn("shard", shard)
        runs = runs.union(stored(shared.groupBy("shard").applyInArrow(lambda t: _earlier(t, window), RUNS), "ss-earlier"))
        if SPLIT in words:
            single = judged(found.filter("words is null").drop("words"), "ss-windows")
            runs = runs.union(single.filter(F.col("kind") == COVERED).select("block", "start", "n"))
        collect_garbage(spark)
    return asked(runs, "left").mapInArrow(partial(_removed, window=window), RESULT)
