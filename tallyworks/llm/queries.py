"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 4096 tokens; a digest of the packed ids."""
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to 0.9 of the largest entropy, at most 4 passes; one row for each emitted document."""
    from .mixing import mix, positions

    mixed = mix(table(spark, sf_dir, "documents"), target_entropy=0.9, most_repeats=4.0)
    return positions(mixed, ["doc_id", "source", "mix_tokens"]).withColumnRenamed("mix_tokens", "n_tokens")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade (0 junk, 1 toxic, 2 clean) of every text, and whether it is selected."""
    from .quality import classify, fit, grade_of_labels

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), grade_of_labels(), 3)
    return classify(docs.select("doc_id", "text"), model, tail_from=2).drop("text")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors by cosine of every vector whose id is divisible by 50."""
    from .ann import nearest

    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.withColumn("score", F.round("score", 12))  # beyond it the order of adding shows


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with at least 80 of 100 two-word shingles in common."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80).drop("text_key")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, with matched share and place."""
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, from a cold cache; whether the tokens exceed 4096."""
    from .common import tables_dir
    from .tokencount import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), cache=f"{tables_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text by a trigram automaton learnt from six of seven folds."""
    from .ngram_lm import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), folds=7, fold=2, backoff=(0.95, 0.75), power=(0.06, 0.1))
    # sums of logarithms to the eighth place: beyond it they depend on the order of adding
    return scored.withColumns({c: F.round(c, 8) for c in ("base_score", "score")})


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how like they are."""
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resharded from 8 hash shards to 8 of near equal bytes; digests of the rewritten files."""
    from .common import tables_dir, text_col
    from .sharding import reshard_files

    text = text_col()
    out = reshard_files(table(spark, sf_dir, "documents"), f"{tables_dir(spark)}/shards-{uuid.uuid4().hex}", shards=8)
    digests = out.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(8)).cast("int").alias("old_shard"), "shard", "slot")
    return digests.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of word frequencies between the sources of each language, and the terms that stand out."""
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least_documents=3, most_terms=200)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text when passages of 20 words or more that start earlier elsewhere go."""
    from .substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of the highest score for each benchmark item."""
    from .ranked import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_nearest": op4_nearest,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_licenses": op6_licenses,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scores": op8_lm_scores,
    "op9_fingerprints": op9_fingerprints,
    "op10_sharding": op10_sharding,
    "op11_divergence": op11_divergence,
    "op12_substrings": op12_substrings,
    "op13_search": op13_search,
}

# The checksum by its definition, bit by bit: reversed polynomial 0xEDB88320.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    # every query against every vector
    "op4_nearest": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER () AS r FROM embeddings WHERE vec_id IS NOT NULL),
w AS (SELECT vec_id, x, r, sqrt(list_dot_product(x, x)) AS size FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0),
s AS (SELECT q.vec_id AS query_id, w.vec_id, list_dot_product(q.x, w.x) / (q.size * w.size) AS score FROM w q JOIN w ON q.vec_id % 50 = 0 AND q.vec_id <> w.vec_id AND len(q.x) = len(w.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 12) AS score FROM s QUALIFY rank <= 5""",
    # all pairs that share a shingle, and what is reached over those that are alike
    "op5_near_duplicates": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS x FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT r, r AS x FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.x),
m AS (SELECT reach.r, min(doc_id) AS least FROM reach JOIN d ON d.r = reach.x GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least AS component_id, doc_id = least AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
    # every token with the two symbols before it; an end is no word, as no word holds a blank
    "op8_lm_scores": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held_out, list_concat({_WORDS}, ['the end']) AS words FROM documents),
t AS (SELECT r, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS i, unnest(list_concat(['the start'], words[:-2])) AS v FROM d),
k AS (SELECT *, lag(v) OVER (PARTITION BY r ORDER BY i) AS u FROM t),
c1 AS (SELECT w, count(*) AS n FROM k WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM k WHERE NOT held_out GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM k WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT v, sum(n) AS n FROM c2 GROUP BY v),
z AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, count(*) AS kinds FROM c1),
p1 AS (SELECT k.*, coalesce(c1.n, 0) AS n1, (coalesce(c1.n, 0) + 1) / (z.tokens + z.kinds + 1) AS p, z.tokens FROM k LEFT JOIN c1 USING (w), z),
p2 AS (SELECT p1.*, CASE WHEN s.n > 0 THEN 0.95e0 * pow(s.n, -0.06e0) ELSE 1e0 END AS b2, s.n AS sn, c2.n AS n2 FROM p1 LEFT JOIN s USING (v) LEFT JOIN c2 USING (v, w)),
q2 AS (SELECT *, CASE WHEN n2 > 0 THEN (1 - b2) * n2 / sn + b2 * p ELSE b2 * p END AS pp FROM p2),
p3 AS (SELECT q2.*, CASE WHEN h.n > 0 THEN 0.75e0 * pow(h.n, -0.1e0) ELSE 1e0 END AS b3, h.n AS hn, c3.n AS n3 FROM q2 LEFT JOIN c2 h ON h.v = q2.u AND h.w = q2.v LEFT JOIN c3 ON c3.u = q2.u AND c3.v = q2.v AND c3.w = q2.w),
q3 AS (SELECT *, CASE WHEN n3 > 0 THEN (1 - b3) * n3 / hn + b3 * pp ELSE b3 * pp END AS ppp FROM p3)
SELECT any_value(doc_id) AS doc_id, any_value(q3.held_out) AS held_out, count(*) AS n_tokens, count_if(n1 > 0)::BIGINT AS n_known, any_value(tokens) AS train_tokens,
  round(fsum(log10(p)), 8) AS base_score, round(fsum(log10(ppp)), 8) AS score FROM q3 JOIN d USING (r) GROUP BY r""",
    # every kept term of a language for every group of it
    "op11_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c, 0)::HUGEINT AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
y AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, count(*) OVER (PARTITION BY lang, source) AS v, sum(c) OVER (PARTITION BY lang, term) AS lc FROM x),
p AS (SELECT *, 1 + 1000000000::HUGEINT * (c + 1) // (n + v) AS p, 1 + 1000000000::HUGEINT * (lc + 1) // (sum(c) OVER (PARTITION BY lang) + v) AS q FROM y),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
entries AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM entries QUALIFY part = 'pair' OR rank <= 200""",
    # every window of every text; those that are not the first of their words cover theirs
    "op12_substrings": r"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, i, array_to_string(words[i:i + 19], ' ') AS x FROM (SELECT r, words, unnest(range(1, len(words) - 18)) AS i FROM d)),
c AS (SELECT r, i FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY r, i) > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM c),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d) ANTI JOIN g USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)""",
    # the score of every document for every item
    "op13_search": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
n AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
z AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM n),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(z.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, z GROUP BY term),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n.n * z.n // z.l))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(terms) AS term FROM q) JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), z GROUP BY q, r HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s QUALIFY rank <= 50""",
}
