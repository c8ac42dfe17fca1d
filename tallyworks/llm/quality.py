"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k | x) = 1 / (1 + exp(s - t_k)) with one score s = w . x for all grades and ordered thresholds
t_0 < t_1 < ...; x says which hashed words, word beginnings, runs of signs and
shape marks a text holds. From it come the
expected grade and the probability of the upper grades, by which documents are selected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_col

_tokens = re.compile(r"[^\W\d_]+|[^\w\s]+").findall


def features(text: str, mask: int) -> list[int]:
    """Places of a text's marks in the hashed weights, each once."""
    found = _tokens(text)
    n = len(found)
    marks = set(map(str.lower, found))
    kinds = len(marks)
    marks |= {f"{x[:5]}-" for x in marks if len(x) > 5}  # words of one stem share a weight
    if n:
        repeats = sum(map(eq, found, found[1:]))
        signs = sum(1 for x in found if not x[0].isalpha())
        upper = sum(map(str.isupper, found))
        marks |= {f"\0repeat{10 * repeats // n}", f"\0signs{10 * signs // n}", f"\0upper{10 * upper // n}", f"\0kinds{10 * kinds // n if n > 50 else 'few'}"}
    else:
        marks.add("\0empty")
    crc = zlib.crc32
    return list({crc(x.encode("utf-8", "surrogatepass")) & mask for x in marks})


@dataclass
class Model:
    weights: np.ndarray  # of 2 ** bits places
    thresholds: np.ndarray  # ascending, one fewer than grades

    def upper(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, (texts, thresholds)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit_arrays(places: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, steps: int = 200, rate: float = 0.1, ridge: float = 1e-4, signif: float = 3.5) -> Model:
    """Penalised maximum likelihood by full-gradient Adam.

    Most marks are rare words that say nothing. A mark gets a weight only if, for some threshold, the share
    of its texts above it is ``signif`` standard deviations off the share of all texts.
    """
    size, n = 1 << bits, len(places)
    above = [(grades > k).astype(np.float32) for k in range(n_grades - 1)]
    texts, hits = np.zeros(size), [np.zeros(size) for _ in above]
    for p in range(0, n, 1000):  # a thousand texts at a time: the marks of all are not held in one array
        lot = places[p : p + 1000]
        flat, rows = np.concatenate(lot), np.repeat(np.arange(p, p + len(lot)), [len(x) for x in lot])
        texts += np.bincount(flat, minlength=size)
        for h, y in zip(hits, above, strict=True):
            h += np.bincount(flat, weights=y[rows], minlength=size)
    telling = np.zeros(size, bool)
    for h, y in zip(hits, above, strict=True):
        share = np.clip(float(y.mean()), 1e-6, 1 - 1e-6)
        telling |= np.abs(h - texts * share) >= signif * np.sqrt(np.maximum(texts, 1) * share * (1 - share))
    del texts, hits
    places = [x[telling[x]] for x in places]
    flat, rows = np.concatenate(places).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in places])
    used, at = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    t = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]  # the first threshold, then logarithms of the gaps
    p = np.r_[w, t]
    m, v = np.zeros_like(p), np.zeros_like(p)
    k, i = n_grades - 1, np.arange(n)
    for step in range(1, steps + 1):
        w, t = p[: len(used)], p[len(used) :]
        th = np.cumsum(np.r_[t[0], np.exp(t[1:])])
        s = np.bincount(rows, weights=w[at], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(s[:, None] - th[None, :], -500, 500))), np.ones((n, 1))], 1)
        lo, hi = below[i, grades], below[i, grades + 1]
        gap = np.maximum(hi - lo, 1e-12)
        ds = (1 - hi - lo) / n
        dth = np.zeros(k)
        np.add.at(dth, np.minimum(grades, k - 1), np.where(grades < k, -hi * (1 - hi) / gap, 0) / n)
        np.add.at(dth, np.maximum(grades - 1, 0), np.where(grades > 0, lo * (1 - lo) / gap, 0) / n)
        after = np.cumsum(dth[::-1])[::-1]
        g = np.r_[np.bincount(at, weights=ds[rows], minlength=len(used)) + ridge * w, after[0], after[1:] * np.exp(t[1:])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = p[: len(used)]
    t = p[len(used) :]
    return Model(weights, np.cumsum(np.r_[t[0], np.exp(t[1:])]))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, most: int = 12_000, bits: int = 20) -> Model | None:
    """Fit on rated documents.

    :param ratings: doc_id and what ``grade`` reads; ``grade`` gives whole numbers from 0 to n_grades - 1.
    :param most: bound on the rated documents used: those first by the hash of their doc_id, and of the
        rows of a repeated doc_id the one of the least text hash. The sample is gathered on the driver as hashed
        marks.

    None if fewer than two grades occur. Null ids, null texts and null grades are not used.
    """
    mask = (1 << bits) - 1
    rated = ratings.select("doc_id", grade.cast("int").alias("grade")).filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    sample = rated.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(features(x, mask), "<i4").tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["grade", "places"])

    known = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``most`` ids
    known = known.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))  # one row an id
    got = known.select("grade", "least.text").mapInArrow(run, "grade int, places binary").collect()
    if len({r["grade"] for r in got}) < 2:
        return None
    got.sort(key=lambda r: (r["grade"], bytes(r["places"])))  # the same fit however rows arrive
    return fit_arrays([np.frombuffer(r["places"], "<i4") for r in got], np.array([r["grade"] for r in got]), n_grades, bits)


def grade_of_labels() -> Column:
    """Grade from columns quality and toxic (0 or 1): 0 low quality, 1 good but toxic, 2 good and not toxic."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def classify(docs: DataFrame, model: Model | None, tail_from: int, least_tail: float = 0.7) -> DataFrame:
    """The rows of docs with expected_grade, tail (probability of a grade >= tail_from) and selected.

    selected is tail >= least_tail. Null text counts as empty. Without a model both numbers are null and
    all rows are selected. Own columns of these names are replaced; others, and repeated rows, pass. An
    empty table gives no rows.
    """
    d = docs.drop("expected_grade", "tail", "selected")
    if model is None:
        return d.withColumns({"expected_grade": F.lit(None).cast("double"), "tail": F.lit(None).cast("double"), "selected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits weights

    mask = len(model.weights) - 1

    def grade(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        w = m.weights.astype(np.float64)
        for b in batches:
            s = np.array([w[features(x or "", mask)].sum() for x in b.to_pylist()])
            up = m.upper(s)
            yield pa.StructArray.from_arrays([pa.array(up.sum(1)), pa.array(up[:, tail_from - 1])], ["expected_grade", "tail"])

    graded = F.arrow_udf(grade, "expected_grade double, tail double")
    # the columns of docs as one, so that none is taken for the grades
    both = d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("doc"), graded(text_col()).alias("graded"))
    return both.select("doc.*", "graded.expected_grade", "graded.tail", (F.col("graded.tail") >= least_tail).alias("selected"))
