"""Ranked lexical search over sharded inverted lists, by block maxima of variable blocks.

Index. Documents are taken in shards of a few million terms as tasks read them; a shard holds, for each of
its terms, the documents and counts in order, and the lengths of its documents. Counts over all documents
(number, total length, document frequencies) are sums over shards.

Blocks. A posting adds weight * impact to a score, where the impact is known once the mean length is. Each
list is cut into blocks of neighbouring postings, of which only the largest impact is kept as a bound; a
dynamic program over the ends of blocks chooses the cuts that make the sum of bound minus impact over all
postings, plus a price for each block, least. Lists of like length go through the program side by side.

Search. The bound of a document is the sum of the bounds of the blocks that span it: the pivots of all of a
shard at once. Documents are taken by falling bound, in growing rounds; only blocks that span one of them are
opened, and their exact scores raise the threshold, which is the item's k-th best so far over all shards
of the task. Documents of a lower bound, and blocks that span no other, are never opened; a document whose
bound equals the threshold is, as its id may come first.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_col

#: Bytes to what is left of them: A-Z lower-cased, other ASCII that is no letter or digit a blank; all others stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Terms of a shard; postings of a block at most; the price of a block, in mean impacts of its list.
SHARD_TERMS, LONGEST, PRICE = 3_000_000, 64, 0.25
#: Items, and bytes of their texts, that are searched for in one pass over the index: what is broadcast.
CHUNK_ITEMS, CHUNK_BYTES = 2_000, 4 << 20
#: A row for each term of a shard (ids: places of its documents, counts), and one with term null: its documents and their lengths.
INDEX = "shard long, term string, documents long, total long, ids array<int>, counts array<int>, doc_ids array<long>"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split()


def _shard(shard: int, doc_ids: list, words: list[bytes], sizes: list[int]) -> pa.RecordBatch:
    coded = pa.array(words, pa.binary()).dictionary_encode()
    n_docs = len(sizes)
    key = coded.indices.to_numpy().astype(np.int64) * n_docs + np.repeat(np.arange(n_docs), sizes)
    key, tf = np.unique(key, return_counts=True)
    start = np.searchsorted(key // n_docs, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
    # the documents' own row comes first
    cut = np.r_[np.int32(0), np.int32(0), start[1:]]
    lists = lambda values: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int32()))
    n_terms = len(coded.dictionary)
    total = np.add.reduceat(tf, start[:-1])
    counts = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), start + np.int32(n_docs)], pa.int32()), pa.array(np.r_[np.array(sizes), tf], pa.int32()))
    ids = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), np.full(n_terms + 1, n_docs)], pa.int32()), pa.array(doc_ids, pa.int64()))
    cols = [pa.array(np.full(n_terms + 1, shard), pa.int64()), pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.cast(pa.string())]), pa.array(np.r_[n_docs, np.diff(start)], pa.int64()), pa.array(np.r_[len(words), total], pa.int64()), lists(key % n_docs), counts, ids]
    return pa.RecordBatch.from_arrays(cols, ["shard", "term", "documents", "total", "ids", "counts", "doc_ids"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc_ids: list = []
    words: list[bytes] = []
    sizes: list[int] = []
    shard = TaskContext.get().partitionId() << 32
    for b in batches:
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = terms_of(text)
            if own:
                doc_ids.append(i)
                words += own
                sizes.append(len(own))
            if len(words) >= SHARD_TERMS:
                yield from _parts(_shard(shard, doc_ids, words, sizes))
                doc_ids, words, sizes, shard = [], [], [], shard + 1
    if words:
        yield from _parts(_shard(shard, doc_ids, words, sizes))


def _parts(b: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for i in range(0, b.num_rows, rows))


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of docs (doc_id, text) as a stored table, see INDEX.

    Documents without terms, null texts among them, are in no shard. Each row is a document.
    """
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(_index, INDEX), "rank-index")


def cut_blocks(lists: list[np.ndarray], longest: int = LONGEST, price: float = PRICE) -> list[np.ndarray]:
    """The ends (exclusive) of the blocks of each list of impacts, least in bound error plus price.

    best[i], the least cost of the first i postings, is the least over lengths b of
    best[i - b] + b * max(the last b impacts) + the price; sums of impacts are the same for all cuts.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lists)
    by_length = sorted((i for i in range(len(lists)) if len(lists[i])), key=lambda i: len(lists[i]))
    at = 0
    while at < len(by_length):
        # lists up to twice as long as the first go together
        most = 2 * len(lists[by_length[at]])
        some = [i for i in by_length[at : at + 512] if len(lists[i]) <= most]
        at += len(some)
        n = max(len(lists[i]) for i in some)
        x = np.zeros((n, len(some)))
        for j, i in enumerate(some):
            x[: len(lists[i]), j] = lists[i]
        cost = np.array([price * lists[i].mean() for i in some])
        width = min(longest, n)
        sizes = np.arange(1, width + 1)[:, None]
        best = np.zeros((n + 1, len(some)))
        taken = np.zeros((n + 1, len(some)), np.int16)
        tops = np.zeros((width, len(some)))  # tops[b - 1]: the largest of the last b impacts
        for i in range(1, n + 1):
            w = min(width, i)
            tops[1:w] = tops[: w - 1]
            tops[0] = 0
            np.maximum(tops[:w], x[i - 1], out=tops[:w])
            total = best[i - 1 :: -1][:w] + sizes[:w] * tops[:w]
            b = total.argmin(0)
            best[i] = total[b, np.arange(len(some))] + cost
            taken[i] = b + 1
        for j, i in enumerate(some):
            ends, e = [], len(lists[i])
            while e:
                ends.append(e)
                e -= int(taken[e, j])
            out[i] = np.array(ends[::-1])
    return out


class Shard:
    """Lists of a shard's terms in blocks; all arrays are those of all terms, one after the other."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, terms: dict[bytes, tuple[np.ndarray, np.ndarray]], n: int, total: int, cut=cut_blocks):
        self.doc_ids, self.known, self.n_docs = doc_ids, known, len(doc_ids)
        whole = lengths.astype(object) if 50 * int(lengths.max()) * n >= 1 << 63 else lengths.astype(np.int64)
        m = (50 + (50 * n * whole) // total).astype(np.int64)
        self.impacts, self.ids = [], []
        for ids, tf in terms.values():
            tf = tf.astype(np.int64)
            self.ids.append(ids.astype(np.int64))
            self.impacts.append(1_000_000_000 * tf // (1000 * tf + 20 * m[ids]))
        ends = cut(self.impacts)
        offset = np.cumsum([0, *map(len, self.ids)])
        self.blocks_of = dict(zip(terms, zip(np.cumsum([0, *map(len, ends)])[:-1], map(len, ends), strict=True), strict=True))
        none = np.zeros(0, np.int64)
        self.hi = np.concatenate([none, *[o + e for o, e in zip(offset, ends, strict=False)]])
        self.lo = np.concatenate([none, *[np.r_[o, o + e[:-1]] for o, e in zip(offset, ends, strict=False)]])
        self.ids, self.impacts = (np.concatenate([none, *x]) for x in (self.ids, self.impacts))
        self.first, self.last = self.ids[self.lo], self.ids[self.hi - 1]
        self.top = np.maximum.reduceat(self.impacts, self.lo) if len(self.lo) else none
        self.opened = self.spanned = 0  # postings

    def search(self, query: dict[bytes, int], k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents that are among the k best and reach the threshold; some more may come."""
        none = np.zeros(0, np.int64)
        held = [(self.blocks_of[t], w) for t, w in query.items() if w > 0 and t in self.blocks_of]
        if not held:
            return none, none
        sizes = np.array([size for (_, size), _ in held])
        block = np.repeat([at for (at, _), _ in held], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        weight = np.repeat(np.array([w for _, w in held], np.int64), sizes)
        first, last, lo, hi, top = self.first[block], self.last[block], self.lo[block], self.hi[block], weight * self.top[block]
        self.spanned += int((hi - lo).sum())
        # sums of integers below 2^53 are exact in doubles
        change = np.bincount(first, top, self.n_docs + 1) - np.bincount(last + 1, top, self.n_docs + 1)
        bound = np.cumsum(change)[: self.n_docs]
        by_bound = np.flatnonzero((bound > 0) & (bound >= threshold))
        by_bound = by_bound[np.argsort(-bound[by_bound], kind="stable")]
        places, scores, at, size = none, none, 0, 2 * k
        score, closed = np.zeros(self.n_docs, np.int64), np.ones(len(block), bool)
        while at < len(by_bound) and bound[by_bound[at]] >= threshold:
            some = by_bound[at : at + size]
            some = some[bound[some] >= threshold]
            at, size = at + len(some), 2 * size
            wanted = np.zeros(self.n_docs + 1, np.int64)
            wanted[some + 1] = 1
            before = np.cumsum(wanted)
            # a block is opened once, for all its documents
            open_ = np.flatnonzero(closed & (before[last + 1] > before[first]))
            closed[open_] = False
            n = hi[open_] - lo[open_]
            posting = np.repeat(lo[open_], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.opened += len(posting)
            score += np.bincount(self.ids[posting], np.repeat(weight[open_], n) * self.impacts[posting], self.n_docs).astype(np.int64)
            good = some[score[some] >= max(1, threshold)]
            places, scores = np.r_[places, good], np.r_[scores, score[good]]
            if len(scores) >= k:
                threshold = max(threshold, int(np.partition(scores, -k)[-k]))
        return places, scores


def _search(items: list[dict[bytes, int]], n: int, total: int, k: int):
    """mapInArrow function: rows of INDEX sorted by shard, the documents' row first -> the k best of each item in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each item the best so far: scores, doc_ids, and whether these are known
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        shard, docs, terms = None, None, {}

        def done() -> None:
            if docs is None or not terms:
                return
            s = Shard(*docs, terms, n, total)
            for i, query in enumerate(items):
                scores, ids, known = best[i]
                places, found = s.search(query, k, int(scores[-1]) if len(scores) == k else 0)
                scores, ids, known = np.r_[scores, found], np.r_[ids, s.doc_ids[places]], np.r_[known, s.known[places]]
                order = np.lexsort((ids, ~known, -scores))[:k]
                best[i] = scores[order], ids[order], known[order]

        for b in batches:
            for r in range(b.num_rows):
                if b.column("shard")[r].as_py() != shard:
                    done()
                    shard, docs, terms = b.column("shard")[r].as_py(), None, {}
                counts = b.column("counts")[r].values.to_numpy()
                term = b.column("term")[r].as_py()
                if term is None:
                    own = b.column("doc_ids")[r].values
                    docs = own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), counts
                else:
                    terms[term.encode("utf-8", "surrogatepass")] = b.column("ids")[r].values.to_numpy(), counts
        done()
        for i, (scores, ids, known) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i), pa.int64()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def chunks(rows: Iterator, most_items: int = CHUNK_ITEMS, most_bytes: int = CHUNK_BYTES) -> Iterator[list]:
    """Rows (item_id, text) in lists of bounded number and size; a longer text comes alone."""
    out, size = [], 0
    for r in rows:
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if out and (len(out) >= most_items or size + n > most_bytes):
            yield out
            out, size = [], 0
        out.append(r)
        size += n
    if out:
        yield out


def search(index: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k documents of the highest score for each of the queries (item_id, text).

    :param index: of :func:`build_index`. :param queries: any number; they pass the driver, and are sent to
        the tasks, in chunks of at most CHUNK_ITEMS items and CHUNK_BYTES bytes.

    Returns item_id, rank, doc_id, score. A query without terms, or whose terms no document has, gets no
    rows. Rows that repeat item_id and text are one query. A null item_id is kept. Documents of one score
    come by rising doc_id, null last; those of one doc_id in any order.
    """
    spark = index.sparkSession
    whole = index.filter("term is null").agg(F.sum("documents").alias("n"), F.sum("total").alias("total")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not whole["n"]:
        return out
    asked = stored(queries.select(F.col("item_id").cast("long").alias("item_id"), text_col().alias("text")).distinct(), "rank-queries")
    for chunk in chunks(asked.toLocalIterator()):
        of_item = [set(terms_of(r["text"])) for r in chunk]
        names = sorted({t.decode("utf-8", "surrogatepass") for terms in of_item for t in terms})
        wanted = spark.createDataFrame([(t,) for t in names], "term string")
        lists = stored(index.join(F.broadcast(wanted), "term", "left_semi").select(index.columns), "rank-lists")
        df = {r["term"].encode("utf-8", "surrogatepass"): r["df"] for r in lists.groupBy("term").agg(F.sum("documents").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * x + 1))) for t, x in df.items()}
        items = [{t: weight[t] for t in sorted(terms) if t in weight} for terms in of_item]
        rows = index.filter("term is null").union(lists).repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = rows.mapInArrow(_search(items, whole["n"], whole["total"], k), "item long, doc_id long, score long")
        ids = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(chunk)], "item long, item_id long"))
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(ids, "item").select("item_id", "rank", "doc_id", "score")
        out = out.union(best)
    return out
