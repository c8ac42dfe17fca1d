"""Best-fit packing of documents into sequences of fixed length.

Bulk-synchronous best-fit. Documents become pieces; pieces are range-sorted by length, longest first, and
ranked within their length. Lengths are whole numbers from 1 to the capacity, so that pieces of one length
and gaps of one size are interchangeable: a round takes all pieces of the next length, sweeps the gap
sizes from their successor upwards, pairs pieces and gaps by rank (the r-th piece of the round takes the
r-th gap), and returns the smaller gaps. What a round needs of the table is its count of pieces, so that
the sweep itself works on at most ``capacity`` classes of runs, whatever the number of rows; the rows find
their gaps by rank, in parallel. The result is that of one-by-one best-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, stored, text_col

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
OWN = ["doc_id", "piece", "start", "length", "ids_crc32"]


class WordIds:
    """Ids of texts under a word-level tokenizer, as packed little-endian 32-bit numbers.

    The tokenizer splits texts into words before merging, so that the ids of a text are those of its words
    in a row. Words are encoded by the library once and remembered, up to ``most`` of them. Texts with
    characters outside printable ASCII and precomposed Latin-1 letters (for which normalisation may reach
    beyond a word), or with ``<|`` (special tokens), are encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        spec = json.loads(self.t.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>" and spec["post_processor"] is None
        self.plain = re.compile(r"[\n\r\t -~À-ÖØ-öø-ÿ]*").fullmatch
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+").findall
        vocab = self.t.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.asarray(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str], step: int = 1000) -> None:
        """Encode words, many in one text: white space parts them, and a word's last id is marked as such."""
        lots = [words[i : i + step] for i in range(0, len(words), step)]
        for lot, e in zip(lots, self.t.encode_batch([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(cuts) != len(lot):
                self.known.update((w, self.whole(w)) for w in lot)
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(lot, cuts.tolist(), strict=True):
                self.known[w] = raw[at:to]
                at = to

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = [self.words(x.lower()) if self.by_word and "<|" not in x and self.plain(x) else None for x in texts]
        here = set().union(*(x for x in found if x))
        new = here - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self.known = {w: x for w in here if (x := self.known.get(w)) is not None}
        self.learn(list(new))
        get = self.known.__getitem__
        return [self.whole(x) if f is None else b"".join(map(get, f)) for x, f in zip(texts, found, strict=True)]


def lots(keys: list, texts: list[str], step: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Rows in lots of at most ``step`` characters, or one text."""
    at = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > step:
            yield keys[at:i], texts[at:i]
            at, size = i, 0
        size += len(x)
    yield keys[at:], texts[at:]


_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """One coder for each Python worker, kept between tasks."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Cut every document's ids, then ``end_id``, into pieces of at most ``capacity`` ids.

    ``ids`` has the ids of a piece as packed little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = coder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            for keys, texts in lots(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                for k, ids in zip(keys, encode(texts), strict=True):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((k, p, at // 4, len(part) // 4, zlib.crc32(part), part))
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [*OWN, "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_col()).mapInArrow(run, PIECES + ", ids binary")


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Match classes of pieces with classes of gaps; counts: pieces of each length (at most ``capacity`` entries).

    Returns rows (length, first rank, pieces, first sequence, offset, pieces side by side): the pieces of
    these ranks fill sequences from the first on, so many to each sequence, from this offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size -> runs (first sequence, sequences)
    sizes: list[int] = []
    made: list[tuple[int, int, int, int, int, int]] = []
    following = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            first, n = gaps[gap].pop()
            fit = min(gap // length, left)  # best fit goes on with the gap it has just made smaller
            take = min(n, left // fit)
            made.append((length, rank, take * fit, first, capacity - gap, fit))
            give(gap - fit * length, first, take)
            rank, left = rank + take * fit, left - take * fit
            if n > take:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                del gaps[gap]
                sizes.remove(gap)
        if left:
            fit = capacity // length
            full, rest = divmod(left, fit)
            for n, k in ((full, fit), (1, rest)):
                if n and k:
                    made.append((length, rank, n * k, following, 0, k))
                    give(capacity - k * length, following, n)
                    following, rank = following + n, rank + n * k
    return np.array(made, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as best-fit decreasing finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids: one row for each piece. The ids
    of a piece, packed little-endian 32-bit numbers, fill its sequence from offset on. Null text counts as
    empty and gives one piece with the end id alone. Null and repeated doc_ids are kept, a row each.
    Documents longer than the capacity are cut, others never. An empty table gives no rows. Other columns are
    not read.
    """
    # the pieces are ranked and placed without their ids, which join them by the row's number at the end
    whole = stored(pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    cut = whole.drop("ids")
    ranked = running(cut.withColumn("one", F.lit(1).cast("long")).withColumn("descending", -F.col("length")), ["descending"], ["doc_id", "piece", "ids_crc32", "row"], "one", "rank")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = best_fit_runs(counts, capacity)
    # (length, rank) as one sortable number: rank below 2^48
    order = np.argsort((runs[:, 0] << 48) + runs[:, 1]) if len(runs) else np.zeros(0, int)
    plan = docs.sparkSession.sparkContext.broadcast(runs[order])  # a few runs for each length and gap size: bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        starts = (p[:, 0] << 48) + p[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank_before"))
            r = p[np.searchsorted(starts, (length << 48) + rank, "right") - 1]
            k = rank - r[:, 1]
            own = [b.column(c) for c in (*OWN, "row")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(r[:, 3] + k // r[:, 5], pa.int64()), pa.array(r[:, 4] + k % r[:, 5] * length, pa.int64())], [*OWN, "row", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, PIECES + ", row long, sequence_id long, offset long")
    # hashing the light side spares a sort of the ids
    return whole.select("row", "ids").join(placed.hint("shuffle_hash"), "row").select(*OWN, "sequence_id", "offset", "ids")
