"""Token counts with a digest cache.

The digest of the (normalised) content and the digest of the tokenizer file key a stored count. Documents
are joined to the cache; only distinct contents that miss are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, text_col

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str, normal_form: str | None = None) -> str:
    """Version of a tokenizer: digest of its file and of the normalisation applied before it."""
    return hashlib.sha256(Path(path).read_bytes() + str(normal_form).encode()).hexdigest()


def _counter(path: str):
    """Function from a list of texts to their token counts, by the library that fits the file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def _encode(path: str, step: int = 1 << 20):
    """mapInArrow function: digest, text -> digest, n_tokens. Batches of at most ``step`` characters, or one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(path)
        for b in batches:
            texts, out, some, size = b.column(1).to_pylist(), [], [], 0
            for x in texts:
                some.append(x)
                size += len(x)
                if size >= step:
                    out += count(some)
                    some, size = [], 0
            if some:
                out += count(some)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache table; empty if nothing was ever appended to it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def compact(spark: SparkSession, cache: str, files: int) -> None:
    """Rewrite a cache of many small appends as few files, each count once; the old files go when the new ones are there."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(cache).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = f"{cache.rstrip('/')}.next", f"{cache.rstrip('/')}.old"
    whole = read_cache(spark, cache).groupBy("tokenizer", "digest").agg(F.first("n_tokens").alias("n_tokens"))
    whole.select("tokenizer", "digest", "n_tokens").repartition(files).write.mode("overwrite").parquet(fresh)
    fs.rename(fs_path(cache), fs_path(old))
    fs.rename(fs_path(fresh), fs_path(cache))
    fs.delete(fs_path(old), True)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, normal_form: str | None = None, most_hot: int = 1000, most_sent: int = 250_000) -> DataFrame:
    """Count the tokens of every text; returns doc_id, n_bytes, n_tokens.

    :param tokenizer: file for tokenizers (.json) or sentencepiece (.model), readable on every executor.
    :param cache: table of counts in shared storage; by default one in ``spark.checkpoint.dir`` for each
        version of a tokenizer, which later calls find again.
    :param normal_form: unicodedata form applied before hashing and encoding (None: the text as it is).
    :param most_hot: so many of the most frequent contents are joined by broadcast, so that thousands of
        copies do not meet in one task; the others are joined by a shuffle.
    :param most_sent: up to so many distinct misses (some 150 bytes each in memory) are broadcast, and only their contents
        leave the tasks that read them; beyond, all contents are shuffled, and those of hits dropped then.

    Digests are held against the cache first; where it has all, no content is read again or shuffled.

    Null text counts as empty (0 tokens). A null or repeated doc_id is kept, one row for each input row. An
    empty table gives no rows. Other columns are not read. Equal contents are encoded once: a content of
    thousands of copies shrinks to one row per map task before the shuffle.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer, normal_form)
    cache = cache or f"{shared_dir(spark).rstrip('/')}/token-counts-{version[:16]}"
    d = docs.select("doc_id", text_col().alias("text"))
    if normal_form:
        normal = F.udf(lambda x: unicodedata.normalize(normal_form, x), "string")
        d = d.withColumn("content", normal("text"))
    else:
        d = d.withColumn("content", F.col("text"))
    d = d.withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    read = lambda: read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    sizes = stored(d.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-sizes")
    misses = stored(sizes.select("digest").distinct().join(read(), "digest", "left_anti"), "token-misses")
    n_misses = misses.limit(most_sent + 1).count()
    if n_misses:
        # contents of misses alone are shuffled, copies merged before; of more misses than can be sent, all contents are
        texts = d.join(F.broadcast(misses), "digest", "left_semi") if n_misses <= most_sent else d
        distinct = texts.groupBy("digest").agg(F.first("content").alias("content"))
        asked = distinct if n_misses <= most_sent else distinct.join(misses, "digest", "left_semi")
        new = asked.select("digest", "content").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
        new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read()
    hot = sizes.groupBy("digest").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "digest").limit(most_hot).select("digest")
    hot = F.broadcast(stored(hot, "token-hot"))  # at most ``most_hot`` rows
    often = sizes.join(F.broadcast(stored(counts.join(hot, "digest"), "token-hot-counts")), "digest")
    seldom = sizes.join(hot, "digest", "left_anti").join(counts, "digest")
    return often.union(seldom.select(*often.columns)).select("doc_id", "n_bytes", "n_tokens")
