"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once. The top bits of the hash choose a bin, and a bin keeps its
smallest hash. Empty bins are filled by optimal densification: an empty bin tries bins in an order of
its own, the same for all documents, until one is not empty. The low four
bits of each bin, hashed with its number, are packed into 64-bit numbers.
Two fingerprints agree in a bin with the likeness of the sets or by chance (1 in 16), so that likeness =
(share of equal bins - 1/16) / (1 - 1/16).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_col

BINS, BITS, PROBES = 256, 4, 8
PER_LONG = 64 // BITS


def _get(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def with_fingerprint(df: DataFrame, text: str, out: str, size: int = 5) -> DataFrame:
    """Add the packed fingerprint of a text column as ``out`` (array of long).

    Words are separated by ASCII white space and lower-cased. A text of fewer than ``size`` words has one
    shingle of all of them; one without words the empty shingle, so that such texts are like each other
    only. Texts of any length are taken whole. Null counts as empty.
    """
    d = df.withColumn("_w", F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    many = F.transform(F.slice("_w", F.lit(1), F.greatest(n - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[_get(F.col("_w"), i + k) for k in range(1, size)]))
    few = F.array(F.aggregate("_w", F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))
    d = d.withColumn("_h", F.sort_array(F.when(n >= size, many).otherwise(few)))
    bin_of = lambda h: F.shiftrightunsigned(h, 56).cast("int").bitwiseXOR(F.lit(128))  # noqa: E731  in the order of signed numbers
    # the smallest hash of each bin, in the order of the bins
    d = d.withColumn("_least", F.filter("_h", lambda h, i: (i == 0) | (bin_of(h) != bin_of(_get(F.col("_h"), i - 1)))))
    before = lambda i: F.coalesce(bin_of(_get(F.col("_least"), i - 1)), F.lit(-1))
    none = F.lit(None).cast("long")
    filled = F.flatten(F.transform("_least", lambda h, i: F.concat(F.array_repeat(none, bin_of(h) - F.when(i == 0, F.lit(-1)).otherwise(before(i)) - 1), F.array(h))))
    d = d.withColumn("_bins", F.concat(filled, F.array_repeat(none, F.lit(BINS - 1) - bin_of(F.element_at("_least", -1)))))
    probe = lambda j, t: _get(F.col("_bins"), F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)))
    # where all probes fail few bins are filled: of those, the one that comes first in the bin's own order of all bins
    rest = lambda j: F.array_min(F.transform("_least", lambda h: F.struct(F.xxhash64(j, F.lit(PROBES), bin_of(h)).alias("o"), h.alias("h"))))["h"]
    # hashed again with the bin: hashes that differ then agree by chance in each bin anew, also where one fills many bins
    low = lambda h, j: F.xxhash64(h, j).bitwiseAND(F.lit((1 << BITS) - 1))
    d = d.withColumn("_full", F.transform("_bins", lambda v, j: low(F.coalesce(v, *[probe(j, t) for t in range(PROBES)], rest(j)), j)))
    pack = lambda k: F.aggregate(F.slice("_full", k * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v))
    # the size is asked of the array itself: used twice, it is not computed anew for each number
    d = d.withColumn(out, F.transform(F.sequence(F.lit(0), F.floor(F.size("_full") / PER_LONG).cast("int") - 1), pack))
    return d.drop("_w", "_h", "_least", "_bins", "_full")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, from 0 to 1, corrected for equal bits by chance."""
    ones = F.lit(int("1" * PER_LONG, 16))

    def differing(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(ones))

    odd = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), (1 - odd / BINS - 2.0**-BITS) / (1 - 2.0**-BITS))


def as_hex(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def neighbours(docs: DataFrame) -> DataFrame:
    """key, doc_id, next_key, prev_key, want (code points the previous document takes), n_chars of each distinct row.

    Order: descending doc_id (null last), then the row's key; after the last comes the first. Rows are
    range-sorted and numbered within partitions; the partitions' counts give their offsets.
    """
    light = docs.groupBy("key", "doc_id", "n_chars").agg(F.count("*").alias("copies"))
    light = stored(light.select("key", "doc_id", "n_chars"), "fp-light")
    n = partitions(docs.sparkSession)
    order = [F.desc_nulls_last("doc_id"), F.col("key")]
    at = stored(light.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "fp-order")
    at = at.withColumn("pid", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = at.groupBy("pid").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))  # a row for each partition
    offsets = counts.select("pid", F.sum("n").over(w.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("off"), F.sum("n").over(w).alias("total"))
    ranked = stored(at.join(offsets, "pid").select("key", "doc_id", "n_chars", (F.coalesce("off", F.lit(0)) + F.col("place")).alias("rank"), "total"), "fp-ranks")
    after = ranked.select(F.pmod(F.col("rank") - 1, F.col("total")).alias("rank"), F.col("key").alias("next_key"))
    before = ranked.select(F.pmod(F.col("rank") + 1, F.col("total")).alias("rank"), F.col("key").alias("prev_key"), F.floor(F.col("n_chars") / 3).cast("int").alias("want"))
    return ranked.join(after, "rank").join(before, "rank").select("key", "doc_id", "next_key", "prev_key", "want")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare both and the next document's.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document, in descending doc_id; after the last comes the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text counts as empty. Null
    doc_ids come last. Rows of one doc_id follow each other by a hash of doc_id and text; rows that repeat
    doc_id and text have one place, and all the same result. An only document is its own next one. An
    empty table gives no rows. Other columns are not read.
    """
    text = text_col()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # 128 bits, so that no two documents share a key
    d = d.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), F.col("text")))))
    links = stored(neighbours(d.select("key", "doc_id", F.length("text").cast("long").alias("n_chars"))), "fp-links")
    own = d.select("key", "text")
    # the shuffle of ``own`` by key serves both joins; what is shipped on is only the part that the previous document takes
    given = own.join(links.select("key", "prev_key", "want"), "key").select(F.col("prev_key").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("want")).alias("taken")).groupBy("key").agg(F.first("taken").alias("taken"))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    both = own.join(links.select("key", "doc_id", "next_key"), "key").join(given, "key").withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), "taken"))
    both = with_fingerprint(with_fingerprint(both, "text", "own_fp"), "edited", "edited_fp")
    made = stored(both.select("key", "next_key", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own_fp", "edited_fp"), "fp-made")
    following = made.select(F.col("key").alias("next_key"), F.col("own_fp").alias("next_fp")).dropDuplicates(["next_key"])
    out = made.join(following, "next_key")
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("own_fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("own_fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"))
