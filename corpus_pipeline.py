"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents. The result of a stage is written and read again before the next one begins, so that a stage
can be run again by itself and lost executors cost no more than tasks of one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import mixing, neardup, packing, quality
from tallyworks.llm.common import exists, stored, sweep
from tallyworks.llm.queries import table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def staged(f: Stage) -> Stage:
    """A stage that leaves no tables and shuffle files behind but those that its result, or another DataFrame still held, reads."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out = f(spark, docs, sf_dir)
        sweep(spark)
        return out

    return stage


@staged
def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier grades as clean; learnt from the labelled ones among them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.grade_of_labels(), 3)
    return quality.classify(docs, model, tail_from=2).filter("selected").select(*COLUMNS)


@staged
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, likeness of 0.8 or more."""
    return neardup.deduplicate(docs, size=5, percent=80).select(*COLUMNS)


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 0.9 of the largest entropy, at most 4 passes over any, none left out; in block order."""
    mixed = mixing.mix(docs, target_entropy=0.9, most_repeats=4.0)
    return mixed.repartition("mix_block").sortWithinPartitions("mix_block", "mix_order").select(*COLUMNS)


@staged
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, with their ids and a digest of them."""
    packed = packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", select_quality),
    ("MinHash near-dedup", remove_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the likeness of shingle sets and the tokenizer are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of sf_dir.

    :param folder: shared folder, one for each input, in which the results of the stages stay: a run whose
        driver was lost goes on after the last stage that was written whole. Without one they are the
        application's, and go when nothing reads them any longer.

    The result can be read for as long as it is held, whatever runs begin meanwhile.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        title = f"{i + 1}-{name.replace(' ', '-')}"
        if folder is not None:
            path = f"{folder.rstrip('/')}/{title}"
            if not exists(spark, f"{path}/_SUCCESS"):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        else:
            docs = stage(spark, docs, sf_dir)
            docs = stored(docs, title) if i + 1 < len(STAGES) else docs
        sweep(spark)
    return docs
