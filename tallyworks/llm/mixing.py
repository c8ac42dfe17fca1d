"""Mixing sources to target weights.

Temperature mixing: source s with token share p_s gets weight p_s^a / sum p^a. The exponent a is found by
bisection: the largest at which the weights' entropy reaches a target, but not so small that a source is
repeated more often than a limit. Weights times the budget are the sources' quotas, realised as whole
passes and one part pass over each source, every pass in its own random order; the passes are cut into
blocks in which all sources have their weight, and each block has its own random order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running, stored, text_col

SALTS = 16  # parts of a source in joins beyond the bounds for broadcasting


class Shares:
    """What the exponent depends on: token shares p of the sources, as sums over all of them.

    powers(a) gives the sum of p ** a and of p ** a * log(p); small tables of sources are summed on the
    driver, others by Spark.
    """

    def __init__(self, n: int, total: int, least: int, largest: int, powers: Callable[[float], tuple[float, float]]):
        self.n, self.total, self.least, self.largest, self.powers = n, total, least, largest, powers

    @classmethod
    def of(cls, tokens: list[int]) -> Shares:
        t = np.array(tokens, float)
        p = t / t.sum()
        return cls(len(tokens), sum(tokens), min(tokens), max(tokens), lambda a: ((p**a).sum(), (p**a * np.log(p)).sum()))

    @classmethod
    def of_table(cls, sizes: DataFrame) -> Shares:
        """sizes: a row with tokens for each source."""
        r = sizes.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
        log = F.log(F.col("tokens") / r[1])
        return cls(*r, lambda a: tuple(sizes.agg(F.sum(F.exp(a * log)), F.sum(F.exp(a * log) * log)).first()))

    def norm(self, exponent: float) -> float:
        return self.powers(exponent)[0]

    def entropy(self, exponent: float) -> float:
        """Of the weights p ** a / norm."""
        norm, logs = self.powers(exponent)
        return math.log(norm) - exponent * logs / norm

    def budget(self, exponent: float, budget: int | None) -> float:
        """The given budget, or the least with which every source is read whole at least once (the largest is the last to be)."""
        return budget if budget is not None else self.largest * self.norm(exponent) / (self.largest / self.total) ** exponent

    def repetition(self, exponent: float, budget: int | None) -> float:
        """Passes over the smallest source, which is read most often."""
        return (self.least / self.total) ** exponent / self.norm(exponent) * self.budget(exponent, budget) / self.least


def bisect(ok, lo: float = 0.0, hi: float = 1.0, steps: int = 60, largest: bool = True) -> float:
    """The largest (smallest) exponent in [lo, hi] at which ok holds, for ok that holds up (down) to a point."""
    if ok(hi if largest else lo):
        return hi if largest else lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        if ok(mid) == largest:
            lo = mid
        else:
            hi = mid
    return lo if largest else hi


def fit_exponent(shares: Shares, target_entropy: float, most_repeats: float, budget: int | None = None) -> float:
    """Exponent from 0 to 1 for a target entropy (share of the largest possible) and a repetition limit.

    Entropy falls and repetition falls as the exponent grows. Where both cannot hold, the limit does.
    """
    goal = target_entropy * math.log(shares.n)
    by_entropy = bisect(lambda a: shares.entropy(a) >= goal) if shares.n > 1 else 1.0
    by_limit = bisect(lambda a: shares.repetition(a, budget) <= most_repeats, largest=False)
    return max(by_entropy, by_limit)


def met(df: DataFrame, by_source: DataFrame, keys: list[str], most: int) -> DataFrame:
    """df with what a table by source says: by broadcast up to ``most`` rows, else by a shuffle of every source in SALTS parts."""
    if by_source.limit(most + 1).count() <= most:
        return df.join(F.broadcast(by_source), keys)
    parted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(parted, [*keys, "salt"]).drop("salt")


def mix(docs: DataFrame, target_entropy: float = 0.9, most_repeats: float = 4.0, budget: int | None = None, n_blocks: int = 64, seed: int = 17, tokens: Column | None = None, most_sources: int = 20_000) -> DataFrame:
    """Repeat and order documents so that sources have their mixing weights.

    :param target_entropy: entropy of the weights as a share of the logarithm of the number of sources.
    :param most_repeats: no source is read more often; holds even where the entropy then stays lower.
    :param budget: tokens of the mixture; None for the least with which every source is read at least once.
        With a smaller budget large sources are read in part: the first documents of their random order.
    :param n_blocks: blocks of equal budget, each with all sources at their weight.
    :param tokens: a document's tokens; by default its words and one end. Null, zero or less counts as one.
    :param most_sources: rows by source (at most 2 KB each: a bound for each block) that are held on the
        driver and broadcast; beyond, they are summed and joined by Spark.

    Returns the columns of docs, then mix_tokens, mix_epoch (from 0), mix_block and mix_order (random order
    within the block); own columns of these names are replaced. A null source is a source of its own.
    Null text counts as empty (one token, the end). Equal rows share their place in the random order, one
    after another; where a block or the quota ends among them they are numbered, so that a part pass holds as
    many of them as the quota does. A quota is met to within one document; one of nothing takes nothing, and
    neither does a budget of 0 or less. An empty table gives no rows.
    """
    n_tokens = (F.size(F.regexp_extract_all(text_col(), F.lit(f"({WORD})"))) + 1 if tokens is None else tokens).cast("long")
    own = [c for c in docs.columns if c not in ("mix_tokens", "mix_epoch", "mix_block", "mix_order")]
    # the columns of docs as one, so that none is taken for one of the names used here
    doc = F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source")
    key = F.xxhash64("doc_id", text_col()).alias("id")
    d = docs.select(doc, source, key, F.greatest(F.coalesce(n_tokens, F.lit(1)), F.lit(1)).cast("long").alias("tokens"))
    light = stored(d.drop("doc"), "mix-light")
    sizes = stored(light.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    some = [r["tokens"] for r in sizes.select("tokens").limit(most_sources + 1).collect()]
    if not some:
        planned = sizes.select("source", F.lit(0.0).alias("passes"), F.lit(0.0).alias("quota"))
    else:
        shares = Shares.of(sorted(some)) if len(some) <= most_sources else Shares.of_table(sizes)
        exponent = fit_exponent(shares, target_entropy, most_repeats, budget)
        quota = F.pow(F.col("tokens") / shares.total, F.lit(exponent)) / shares.norm(exponent) * shares.budget(exponent, budget)
        # rounding must not make 1.0 passes into 0.9999
        planned = sizes.select("source", F.round(quota / F.col("tokens"), 9).alias("passes"), quota.alias("quota"))
    planned = stored(planned, "mix-plan")
    order = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("id")).alias("order")
    some_passes = planned.filter(F.ceil("passes") >= 1)
    passes = lambda x: met(x, some_passes, ["source"], most_sources).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("passes").cast("int") - 1))).select("*", order)
    # where each (source, pass) enters each block, as bounds on the random order; block n_blocks is what the quota leaves out
    each = stored(passes(light), "mix-passes")
    summed = running(each, ["source", "epoch"], ["order"], "tokens", "t")
    before = F.col("epoch") * F.col("t_total") + F.col("t_before")
    block = F.floor(before * n_blocks / F.col("quota"))
    inside = (block < n_blocks) & (F.col("epoch") + F.col("t_before") / F.col("t_total") < F.col("passes"))
    placed = summed.withColumn("block", F.when(inside, block).otherwise(n_blocks))
    bounds = placed.groupBy("source", "epoch", "block").agg(F.min("order").alias("first"), F.max("order").alias("last"))
    # n_blocks + 1 bounds at most for each pass
    bounds = bounds.groupBy("source", "epoch").agg(F.array_sort(F.collect_list(F.struct("block", "first", "last"))).alias("bounds"))
    # orders that more than one block has: equal rows among which a block ends
    ends = F.zip_with(F.slice("bounds", 1, F.size("bounds") - 1), F.slice("bounds", 2, F.size("bounds")), lambda x, y: F.when(x["last"] == y["first"], x["last"]))
    bounds = stored(bounds.withColumn("tied", F.array_distinct(F.array_compact(ends))), "mix-bounds")
    named = met(passes(d), bounds, ["source", "epoch"], most_sources)
    is_tied = F.array_contains("tied", F.col("order"))
    plain = named.filter(~is_tied).withColumn("block", F.get(F.filter("bounds", lambda b: b["last"] >= F.col("order")), F.lit(0))["block"])
    columns = ["doc", "id", "tokens", "epoch", "block"]
    out = plain.select(*columns)
    ties = stored(bounds.select("source", "epoch", F.explode("tied").alias("order")), "mix-ties")
    if not ties.isEmpty():
        key = ["source", "epoch", "order"]
        shares_of = met(placed, ties, key, most_sources).groupBy(*key, "block").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("block"))  # n_blocks + 1 rows at most
        shares_of = stored(shares_of.withColumn("upto", upto).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("upto", "block"))).alias("shares")), "mix-shares")
        rows = named.filter(is_tied).drop("bounds", "tied").withColumns({"one": F.lit(1).cast("long"), "any": F.rand(seed)})
        numbered = met(running(rows, key, ["any"], "one", "copy"), shares_of, key, most_sources)
        out = out.union(numbered.withColumn("block", F.get(F.filter("shares", lambda x: x["upto"] > F.col("copy_before")), F.lit(0))["block"]).select(*columns))
    out = out.filter(F.col("block") < n_blocks).withColumn("block", F.col("block").cast("int"))
    mixed = [F.col("tokens").alias("mix_tokens"), F.col("epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), F.xxhash64(F.lit(seed), F.col("block"), F.col("epoch"), F.col("id")).alias("mix_order")]
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in own], *mixed)


def positions(mixed: DataFrame, keep: list[str]) -> DataFrame:
    """The exact place of each row of a mixture in its block, from 0, with the columns to keep."""
    rows = stored(mixed.select(*keep, "mix_epoch", "mix_block", "mix_order", F.lit(1).cast("long").alias("one")), "mix-rows")
    out = running(rows, ["mix_block"], ["mix_order", *[k for k in keep if k == "doc_id"]], "one", "position")
    return out.select(*keep, F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("position_before").alias("position"))
