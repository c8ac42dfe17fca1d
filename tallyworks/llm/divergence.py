"""How far the word frequencies of sources diverge from each other, and by which terms, by sorted runs.

Runs. A map task sorts the words of a block of texts by (lang, term, source, document); the lengths of the
runs are the documents and occurrences of a term in a source, so that what leaves the task is one row for
each (lang, term, source) of a block, however frequent the term. These partial runs are repartitioned by
(lang, term) and sorted by (lang, term, source); one scan of the stream adds up the runs of a source, knows
a term's document frequency when its last run ends, and emits what the term adds: its counts by source, and
for each pair of sources that both hold it the pair of counts, summed as a histogram.

Divergence. A pair's value is a sum over all kept terms of f(p, q), where p and q depend on a term only by
its counts in the two groups. With a, b the counts and 0 for a term that a group lacks,
    sum f = V f(0, 0) + sum over the one's counts of (f(a, 0) - f(0, 0)) + the same for the other's
            + sum over the terms of both of (f(a, b) - f(a, 0) - f(0, b) + f(0, 0)),
so that terms that neither or only one group holds need no row for the pair. All sums are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_col

#: Bytes to what is left of them: A-Z lower-cased, other ASCII that is no letter a blank; all others stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words that a block sorts at once, and rows of runs that a scan looks at together.
BLOCK_WORDS, SCAN_ROWS, PAIRS = 2_000_000, 200_000, 2_000_000
RUNS = "lang string, term string, source string, documents long, n long"
#: kind 'term': source and item (a kept term) with x its count there, y its count in the language, n = 1 once for each term;
#: kind 'pair': source and item (two sources, in order) and the number n of terms that occur x and y times there.
FOUND = "kind string, lang string, source string, item string, x long, y long, n long"
SCALE = 1_000_000_000


def _sorted_runs(words: list[bytes], sizes: list[int], groups: list[tuple[str, str]]) -> pa.RecordBatch:
    """Runs of (lang, term, source) over the documents of a block; sizes and groups are those of the documents."""
    terms = pa.array(words, pa.binary()).dictionary_encode()
    lang_of, langs = _codes(np.array([g[0] for g in groups], object))
    source_of, sources = _codes(np.array([g[1] for g in groups], object))
    each = np.array(sizes)
    document = np.repeat(np.arange(len(each)), each)
    lang, source, term = lang_of[document], source_of[document], terms.indices.to_numpy().astype(np.int64)
    # (lang, term, source) as one number; documents come in order, and the sort is stable
    key = (lang * len(terms.dictionary) + term) * len(sources) + source
    order = np.argsort(key, kind="stable")
    key, document = key[order], document[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    new_document = np.r_[True, (key[1:] != key[:-1]) | (document[1:] != document[:-1])]
    n = np.diff(np.r_[starts, len(key)])
    documents = np.add.reduceat(new_document.astype(np.int64), starts)
    key = key[starts]
    text = terms.dictionary.cast(pa.string())
    cols = [pa.array(langs, pa.string()).take(key // len(sources) // len(text)), text.take(pa.array(key // len(sources) % len(text))), pa.array(sources, pa.string()).take(key % len(sources)), pa.array(documents, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["lang", "term", "source", "documents", "n"])


def _codes(values: np.ndarray) -> tuple[np.ndarray, list[str]]:
    named = {v: i for i, v in enumerate(dict.fromkeys(values.tolist()))}
    return np.array([named[v] for v in values.tolist()], np.int64), list(named)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[bytes] = []
    sizes: list[int] = []
    groups: list[tuple[str, str]] = []
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            own = text.encode("utf-8", "surrogatepass").translate(LETTERS).split()
            if own:
                words += own
                sizes.append(len(own))
                groups.append((lang, source))
            if len(words) >= BLOCK_WORDS:
                yield _sorted_runs(words, sizes, groups)
                words, sizes, groups = [], [], []
    if words:
        yield _sorted_runs(words, sizes, groups)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before in any column; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[0] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


class _Histogram:
    """Numbers of terms by (pair of groups, counts), emitted whenever many pairs have come together."""

    def __init__(self):
        self.names: dict[tuple[str, str], int] = {}
        self.kept: list[np.ndarray] = []
        self.size = 0

    def add(self, group: np.ndarray, n: np.ndarray, run: np.ndarray) -> None:
        """Pairs within the runs of equal ``run`` of groups in order."""
        ends = np.searchsorted(run, run, "right")
        at = np.arange(len(run))
        for d in range(1, int((ends - at).max(initial=1))):
            at = at[at + d < ends[at]]
            self.kept.append(np.stack([group[at], group[at + d], n[at], n[at + d], np.ones(len(at), np.int64)]))
            self.size += len(at)
            if self.size > 2 * PAIRS:
                self.merge()

    def merge(self) -> None:
        if len(self.kept) > 1:
            x = np.concatenate(self.kept, 1)
            x = x[:, np.lexsort(x[3::-1])]
            starts = np.flatnonzero(np.r_[True, (x[:4, 1:] != x[:4, :-1]).any(0)]) if x.shape[1] else np.zeros(0, int)
            self.kept = [np.concatenate([x[:4, starts], np.add.reduceat(x[4:], starts, axis=1)])] if len(starts) else []
        self.size = sum(k.shape[1] for k in self.kept)

    def emit(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size <= least:
            return
        self.merge()
        names = list(self.names)
        for x in self.kept:
            lang, source, other = (pa.array(v, pa.string()) for v in ([g[0] for g in names], [g[1] for g in names], [g[1] for g in names]))
            for i in range(0, x.shape[1], SCAN_ROWS):
                g, o, a, b, n = x[:, i : i + SCAN_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(g)), lang.take(pa.array(g)), source.take(pa.array(g)), other.take(pa.array(o)), pa.array(a), pa.array(b), pa.array(n)], ["kind", "lang", "source", "item", "x", "y", "n"])
        self.kept, self.size = [], 0


def _scan(least_documents: int):
    """Runs sorted by (lang, term, source), of which no term is parted -> rows of FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Histogram()

        def ended(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """t: summed runs of whole terms."""
            term = np.cumsum(_changes([t.column("lang").combine_chunks(), t.column("term").combine_chunks()])) - 1
            documents, n = t.column("documents").to_numpy(), t.column("n").to_numpy()
            keep = (np.bincount(term, documents) >= least_documents)[term]
            if not keep.any():
                return
            in_lang = np.zeros(term[-1] + 1, np.int64)
            np.add.at(in_lang, term, n)
            t, n, term = t.filter(pa.array(keep)), n[keep], term[keep]
            first = np.r_[True, term[1:] != term[:-1]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(["term"] * len(n)), *(t.column(c).combine_chunks() for c in ("lang", "source", "term")), pa.array(n), pa.array(in_lang[term]), pa.array(first)], ["kind", "lang", "source", "item", "x", "y", "n"])
            named = zip(t.column("lang").to_pylist(), t.column("source").to_pylist(), strict=True)
            pairs.add(np.array([pairs.names.setdefault(g, len(pairs.names)) for g in named], np.int64), n, term)
            yield from pairs.emit(PAIRS)

        def summed(waiting: list[pa.Table]) -> pa.Table:
            """One row for each run of (lang, term, source)."""
            t = pa.concat_tables(waiting).combine_chunks()
            starts = np.flatnonzero(_changes([t.column(c).combine_chunks() for c in ("lang", "term", "source")]))
            out = t.take(pa.array(starts))
            for c in ("documents", "n"):
                out = out.set_column(out.schema.get_field_index(c), c, pa.array(np.add.reduceat(t.column(c).to_numpy(), starts)))
            return out

        waiting: list[pa.Table] = []
        for b in batches:
            if b.num_rows:
                waiting.append(pa.Table.from_batches([b]))
            if sum(x.num_rows for x in waiting) >= SCAN_ROWS:
                t = summed(waiting)
                # the last term may go on; of it there is one row for each source by now
                last = np.flatnonzero(_changes([t.column("lang").combine_chunks(), t.column("term").combine_chunks()]))[-1]
                if last:
                    yield from ended(t.slice(0, last))
                waiting = [t.slice(last)]
        if waiting:
            yield from ended(summed(waiting))
        yield from pairs.emit(0)

    return run


def smoothed(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 1) / whole), exactly; whole is above 0."""
    small = count < F.lit(9_000_000_000)
    n = F.expr("CAST(1000000000 AS DECIMAL(10,0))") * (count + 1).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.when(small, F.call_function("div", (F.when(small, count).otherwise(0) + 1) * F.lit(SCALE), whole)).otherwise(F.call_function("div", n, whole.cast("decimal(29,0)")))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_documents: int = 3, most_terms: int = 200) -> DataFrame:
    """Divergence between the sources of each language, and the terms in which a source exceeds its language.

    :param least_documents: documents of a language that a term must be in to be kept.
    :param most_terms: ranks of the term part.

    Returns lang, source, part, item, value, rank: ``pair`` rows for every two sources of a language, ``term``
    rows for the terms that are more frequent in the source than in the language; see the README for both
    values. Null lang, source and text count as empty texts. A row is a document: repeated rows, whatever
    their ids, count once each. A language without kept terms has pairs of value 0. An empty table gives no
    rows. Only lang, source and text are read.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = docs.select(named("lang"), named("source"), text_col().alias("text"))
    runs = d.mapInArrow(_runs, RUNS).repartition(partitions(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source")
    found = stored(runs.mapInArrow(_scan(least_documents), FOUND), "dv-found")
    terms = found.filter("kind = 'term'").drop("kind")
    counted = terms.groupBy("lang", "source").agg(F.sum("x").alias("tokens"), F.sum("n").alias("firsts"))
    counted = d.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").na.fill(0, ["tokens", "firsts"])
    w = Window.partitionBy("lang")  # one row for each source
    counted = counted.withColumns({"kept": F.sum("firsts").over(w), "lang_tokens": F.sum("tokens").over(w)})
    groups = stored(counted.select("lang", "source", "kept", (F.col("tokens") + F.col("kept")).alias("whole"), (F.col("lang_tokens") + F.col("kept")).alias("lang_whole")), "dv-groups")

    # pairs of sources: what no term, one's terms and common terms add
    some = groups.filter("kept > 0")
    p0 = lambda whole: smoothed(F.lit(0).cast("long"), F.col(whole))
    one = some.select("lang", "source", "kept", "whole", p0("whole").alias("p0"))
    other = some.select("lang", F.col("source").alias("item"), F.col("whole").alias("other_whole"), p0("whole").alias("q0"))
    both = one.join(other, "lang").filter("source <> item")
    none = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    exact = lambda n, x: (F.col(n).cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)").alias("value")
    f00 = distance(F.col("p0"), F.col("q0"))
    key = ["lang", "source", "item"]
    base = both.select(*key, exact("kept", f00))
    by_count = stored(terms.groupBy("lang", "source", F.col("x")).agg(F.count("*").alias("terms")), "dv-counts")
    p, q = smoothed(F.col("x"), F.col("whole")), smoothed(F.col("x"), F.col("other_whole"))
    mine = by_count.join(both, ["lang", "source"]).select(*key, exact("terms", distance(p, F.col("q0")) - f00))
    theirs = by_count.withColumnRenamed("source", "item").join(both, ["lang", "item"]).select(*key, exact("terms", distance(F.col("p0"), q) - f00))
    together = found.filter("kind = 'pair'").groupBy(*key, "x", "y").agg(F.sum("n").alias("terms"))
    # each pair stands in one order; both are wanted
    turned = F.explode(F.array(F.struct("source", "item", "x", "y"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("y").alias("x"), F.col("x").alias("y"))))
    together = together.select("lang", "terms", turned.alias("t")).select("lang", "terms", "t.*").join(both, key)
    y = smoothed(F.col("y"), F.col("other_whole"))
    common = together.select(*key, exact("terms", distance(p, y) - distance(p, F.col("q0")) - distance(F.col("p0"), y) + f00))
    summed = base.union(mine).union(theirs).union(common).groupBy(*key).agg(F.sum("value").alias("value"))
    pairs = none.join(summed, key, "left").select(*key, F.coalesce(F.col("value").cast("long"), F.lit(0).cast("long")).alias("value"))

    excess = terms.join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"]).select(*key, smoothed(F.col("x"), F.col("whole")).alias("p"), smoothed(F.col("y"), F.col("lang_whole")).alias("q"))
    excess = excess.filter("p > q").select(*key, distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").union(ranked(excess, "term").filter(F.col("rank") <= most_terms))
