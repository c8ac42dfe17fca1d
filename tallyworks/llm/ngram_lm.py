"""Language-model scores from a weighted backoff automaton of smoothed word n-grams.

Model. P(w) = (c(w) + 1) / (N + V + 1) over the words of the training texts, their ends and one unknown
word. After a context h of k symbols (words, or the start of a text)
P(w | h) = (1 - b) c(h w) / c(h) + b P(w | h without its first symbol), which sums to one;
b = backoff[k - 1] * c(h) ** -power[k - 1] falls slowly with the count of h, and is 1 where h was not seen.

Automaton. The empty context and every context seen in training are states. A state h has an arc for each
n-gram h w that was seen, of weight log10 P(w | h), to the longest state that ends h w, and a failure arc to
h without its first symbol, of weight log10 b, which is followed without reading where no arc fits. The
empty state has an arc for every word. One traversal reads a text from left to right, carries the state
from word to word and adds the weights. A state remembers at most order - 1 symbols, so that after as many
words it does not depend on where the walk began: long texts are walked in segments, each warmed up on the
order - 1 words before it, and all segments of a block take their steps together.

Data flow. Texts are read once, into blocks of many texts: a block holds its own list of words (64-bit
hashes) and the texts as places in that list. A block sends its distinct words and longer n-grams (56-bit
hashes; two n-grams of one hash would be counted as one) of each length with their training counts, sorted, to reducers by ranges
of the hash; a reducer adds them up over the blocks and sends back the totals of just those keys, in the
same order. So a key of any frequency is one number for each block, no task sees more than some ranges of
keys or some blocks, and the block then builds the part of the automaton that its own texts can reach.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, text_col

END, START = 1, 2  # stand for the end of a text (a token) and for its start (a symbol of contexts)
SEGMENT = 512  # tokens of a text that are walked in a row
SPARE = 8  # low bits of a 64-bit hash that the keys of longer n-grams go without
BLOCK = "block long, doc_ids array<long>, lengths binary, words binary, places binary, n_tokens long"
ASK = "kind int, bucket int, block long, keys binary, counts binary"
ANSWER = "kind int, bucket int, block long, totals binary, n_types long, n_tokens long"


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, byte by byte of all numbers in turn (high bytes are mostly equal)."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, "u8"), dtype=np.uint64)


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def blocks(docs: DataFrame, most: int) -> DataFrame:
    """Texts as blocks of about ``most`` tokens (a longer text is a block of its own)."""

    def block(k: int, ids: list, hashes: list, lengths: list) -> tuple:
        words, place, n = np.unique(np.array(hashes, np.uint64), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return k, ids, squeeze(np.array(lengths, np.uint32)), squeeze(words[order]), squeeze(rank[place]), len(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as h

        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("places", pa.binary()), ("n_tokens", pa.int64())])
        at = TaskContext.get().partitionId() << 24
        ids, hashes, lengths = [], [], []

        def emit() -> pa.RecordBatch:
            nonlocal at, ids, hashes, lengths
            row, at = block(at, ids, hashes, lengths), at + 1
            ids, hashes, lengths = [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
                if hashes and len(hashes) + len(words) > most:
                    yield emit()
                hashes += map(h, words)
                hashes.append(END)
                ids.append(k)
                lengths.append(len(words) + 1)
        if ids:
            yield emit()

    return docs.select(F.col("doc_id").cast("long"), text_col()).mapInArrow(run, BLOCK)


class Block:
    """A block's words, texts and n-grams as arrays."""

    def __init__(self, doc_ids: list, lengths: bytes, words: bytes, places: bytes, folds: int, fold: int, order: int):
        self.doc_ids, self.order = doc_ids, order
        self.lengths = unsqueeze(lengths, "u4").astype(np.int64)
        self.words, self.places = unsqueeze(words, "u8"), unsqueeze(places, "u4").astype(np.int64)
        self.held = np.array([held_out(k, folds, fold) for k in doc_ids], bool)
        self.training = np.repeat(~self.held, self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(self.places)) - np.repeat(self.first, self.lengths)
        # grams[m]: the hash of the m symbols that end with each token; whole[m]: whether there are so many
        self.grams, self.whole = {1: self.words[self.places]}, {1: np.ones(len(self.places), bool)}
        for m in range(2, order + 1):
            before = np.r_[np.uint64(0), self.grams[m - 1][:-1]]
            if m == 2:
                before[self.first] = START
            with np.errstate(over="ignore"):
                x = before * np.uint64(0x9E3779B97F4A7C15)
                x = ((x ^ (x >> np.uint64(29))) + self.grams[1]) * np.uint64(0xBF58476D1CE4E5B9)
            self.grams[m], self.whole[m] = x ^ (x >> np.uint64(32)), self.at >= m - 2

    def names(self) -> np.ndarray:
        return np.r_[self.words, np.uint64(START)]

    def asks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(symbols, sorted keys, training counts): words, with the start as one more, then longer n-grams."""
        n = np.bincount(self.places[self.training], minlength=len(self.words))
        keys, n = self.names(), np.r_[n, int((~self.held).sum())]
        order = np.argsort(keys)
        yield 1, keys[order], n[order]
        for m in range(2, self.order + 1):
            keys, place = np.unique(self.grams[m][self.whole[m]] >> np.uint64(SPARE), return_inverse=True)
            yield m, keys, np.bincount(place[self.training[self.whole[m]]], minlength=len(keys))


class Automaton:
    """The states, arcs and failure arcs that the texts of a block can reach.

    State 0 is the empty context, 1 + i that of the i-th name (word of the block, then the start); states of
    longer contexts follow. Places of n-grams in ``asks()`` number them.
    """

    def __init__(self, block: Block, totals: dict[int, np.ndarray], n: int, v: int, backoff: list[float], power: list[float]):
        b, order, names = block, block.order, block.names()
        seen = np.empty(len(names), np.int64)
        seen[np.argsort(names)] = totals[1]
        self.words_seen = seen[:-1]
        share = (self.words_seen + 1) / (n + v + 1)
        self.word_weight = np.log10(share)
        self.word_to = np.where(self.words_seen > 0, 1 + np.arange(len(share)), 0)
        self.start = len(names) if seen[-1] else 0
        counts, fail_to, fall = [np.zeros(1, np.int64), seen], [np.zeros(1 + len(names), np.int64)], [np.ones(1)]
        # of each token: the state of the m symbols that end with it, and their share
        state, p = 1 + b.places, share[b.places]
        base, keys, weights, to = 1 + len(names), [], [], []
        for m in range(2, order + 1):
            count = counts[m - 1]  # of the contexts of m - 1 symbols
            fall.append(np.where(count > 0, backoff[m - 2] * np.maximum(count, 1.0) ** -power[m - 2], 1.0))
            ends = np.flatnonzero(b.whole[m])
            _, first, place = np.unique(b.grams[m][ends] >> np.uint64(SPARE), return_index=True, return_inverse=True)
            rep = ends[first]  # a token that ends each n-gram
            source = np.where(b.at[rep] > 0, state[rep - 1], len(names))
            context = source - (base - len(count))
            share = np.where(totals[m] > 0, (1 - fall[-1][context]) * totals[m] / np.maximum(count[context], 1) + fall[-1][context] * p[rep], 0.0)
            arcs = totals[m] > 0
            keys.append((source << 32 | b.places[rep])[arcs])
            weights.append(np.log10(share[arcs]))
            to.append(((base + np.arange(len(rep))) if m < order else state[rep])[arcs])
            if m < order:
                counts.append(totals[m])
                fail_to.append(state[rep])
                state, p = state.copy(), p.copy()
                state[ends], p[ends] = base + place, share[place]
                base += len(rep)
        self.fail_to = np.concatenate(fail_to)
        self.fail_weight = np.log10(np.concatenate(fall))
        keys = np.concatenate(keys)
        by_key = np.argsort(keys)
        self.keys, self.weights, self.to = keys[by_key], np.concatenate(weights)[by_key], np.concatenate(to)[by_key]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Read a word in each state; the states are replaced by those after it. Returns the weights."""
        weight, open_ = np.zeros(len(state)), np.arange(len(state))
        while len(open_):
            s, w = state[open_], word[open_]
            at = np.minimum(np.searchsorted(self.keys, s << 32 | w), max(0, len(self.keys) - 1))
            arc = (self.keys[at] == s << 32 | w) if len(self.keys) else np.zeros(len(s), bool)
            state[open_] = np.where(arc, self.to[at] if len(self.keys) else 0, np.where(s > 0, self.fail_to[s], self.word_to[w]))
            weight[open_] += np.where(arc, self.weights[at] if len(self.keys) else 0, np.where(s > 0, self.fail_weight[s], self.word_weight[w]))
            open_ = open_[~arc & (s > 0)]  # those that took a failure arc read the word again
        return weight

    def walk(self, b: Block, segment: int = SEGMENT) -> np.ndarray:
        """The weight of every token."""
        per_text = -(-b.lengths // segment)
        nth = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        counted = np.repeat(b.first, per_text) + nth * segment
        end = np.minimum(counted + segment, np.repeat(b.first + b.lengths, per_text))
        begin = np.where(nth > 0, counted - (b.order - 1), counted)
        by_length = np.argsort(begin - end, kind="stable")
        begin, end, counted, state = begin[by_length], end[by_length], counted[by_length], np.where(nth > 0, 0, self.start)[by_length]
        live = np.searchsorted(begin - end, -np.arange(1, (end - begin).max(initial=0) + 1), "right")
        out = np.empty(len(b.places))
        for t, n in enumerate(live):
            at = begin[:n] + t
            weight = self.step(state[:n], b.places[at])
            new = at >= counted[:n]
            out[at[new]] = weight[new]
        return out


def ranges(keys: np.ndarray, kind: int, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted keys, for the buckets that have some: never more than keys, however many buckets there are."""
    bucket = (keys >> np.uint64(32 if kind == 1 else 32 - SPARE)) * np.uint64(n_buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(n_buckets)))
    if not len(cuts):
        return iter(())
    return zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True)


def tokens_of_bucket(tokens: int, least: int, most: int = 4_000_000) -> int:
    """Tokens of a range of hashes: they grow with the root of the corpus, up to what a task holds, so that blocks meet fewer ranges."""
    return max(least, min(most, 40 * math.isqrt(tokens)))


def scores(b: Block, a: Automaton, n: int) -> pa.RecordBatch:
    cuts = [*b.first.tolist(), len(b.places)]

    def add(x: np.ndarray) -> list[float]:
        values = x.tolist()
        return [math.fsum(values[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    known = (a.words_seen[b.places] > 0).astype(np.int64)
    cols = [pa.array(b.doc_ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(np.add.reduceat(known, b.first)), pa.array(np.full(len(b.doc_ids), n)), pa.array(add(a.word_weight[b.places])), pa.array(add(a.walk(b)))]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2, backoff: tuple[float, ...] = (0.95, 0.75), power: tuple[float, ...] = (0.06, 0.1), block_tokens: int = 1_000_000, bucket_tokens: int = 500_000) -> DataFrame:
    """Score every text by an n-gram model learnt from the texts whose crc32(doc_id) mod folds is not fold.

    :param backoff, power: of b above, for contexts of one symbol, of two and so on; their number plus one is
        the order of the model (trigrams by default).
    :param block_tokens: tokens of a block. :param bucket_tokens: training n-grams of a range of hashes, at least (about).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null text counts as
    empty: its end alone is scored. A null doc_id hashes as the empty text. Repeated rows are scored, and
    learnt from, once each. An empty table gives no rows. Other columns are not read. An n-gram
    counts in full however rare or common it is.
    """
    order = 1 + len(backoff)
    held = stored(blocks(docs, block_tokens), "lm-blocks")
    size = held.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    least = partitions(docs.sparkSession)
    # tasks stay as large as they are however many texts there come to be
    n_buckets = max(least, -(-size["tokens"] // tokens_of_bucket(size["tokens"], bucket_tokens)))
    bucket_parts, block_parts = max(least, -(-order * n_buckets // 4)), max(least, -(-size["blocks"] // 2))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["doc_ids"], r["lengths"], r["words"], r["places"], folds, fold, order)
                for kind, keys, counts in b.asks():
                    rows = [(kind, j, r["block"], squeeze_sorted(keys[i:k]), squeeze(counts[i:k].astype(np.uint32))) for j, i, k in ranges(keys, kind, n_buckets)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def answer(t: pa.Table) -> pa.Table:
        kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
        keys = [unsqueeze_sorted(x) for x in t.column("keys").to_pylist()]
        counts = np.concatenate([unsqueeze(x, "u4") for x in t.column("counts").to_pylist()])
        types, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(types)).astype(np.int64)
        back, ends = total[place], np.cumsum([len(x) for x in keys])
        words = total[(types != np.uint64(START)) & (total > 0)] if kind == 1 else total[:0]
        out = [squeeze(x) for x in np.split(back, ends[:-1])]
        first = [1] + [0] * (len(out) - 1)
        return pa.table({"kind": pa.array([kind] * len(out), pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "block": t.column("block"), "totals": pa.array(out, pa.binary()), "n_types": pa.array([len(words) * x for x in first], pa.int64()), "n_tokens": pa.array([int(words.sum()) * x for x in first], pa.int64())})

    texts = held.select("block", "doc_ids", "lengths", "words", "places")
    asked = texts.mapInArrow(ask, ASK).repartition(bucket_parts, "kind", "bucket")
    answers = stored(asked.groupBy("kind", "bucket").applyInArrow(answer, ANSWER), "lm-answers")
    total = answers.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_types"), F.lit(0)).alias("v")).first()
    n, v = total["n"], total["v"]

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        rows = sorted(zip(found.column("kind").to_pylist(), found.column("bucket").to_pylist(), found.column("totals").to_pylist(), strict=True), key=lambda x: x[:2])
        totals = {m: np.concatenate([np.zeros(0, np.int64), *[unsqueeze(x, "i8") for k, _, x in rows if k == m]]) for m in range(1, order + 1)}
        (r,) = block.to_pylist()
        b = Block(r["doc_ids"], r["lengths"], r["words"], r["places"], folds, fold, order)
        return pa.Table.from_batches([scores(b, Automaton(b, totals, n, v, list(backoff), list(power)), n)])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    each = lambda df: df.repartition(block_parts, "block").groupBy("block")
    return each(texts).cogroup(each(answers.select("block", "kind", "bucket", "totals"))).applyInArrow(score, schema)
