"""Mixing, classifier, nearest neighbours, sharding and the corpus pipeline."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import ann, mixing, quality, sharding
from tallyworks.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata"
SF = os.environ.get("TEST_SF_DIR", f"{DATA}/sf0.001")
with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, source string, mix_order string, shard string, old_shard string, part string, selected string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], DOCS)


# mixing


def some_sources():
    rng = random.Random(2)
    rows = []
    for i in range(600):
        source = rng.choices(["a", "b", "c", None], [70, 20, 9, 1])[0]
        rows.append((i, " ".join(["w"] * rng.randrange(0, 40)) + f" {i}", source))
    return [*rows, (None, None, "a"), (None, "", "b"), (7, "again", "c"), (7, "again", "c")]


def brute_exponent(tokens, target, most, budget):
    """By the definitions, on a fine grid refined twice."""
    total = sum(tokens.values())

    def weights(a):
        raw = {s: (t / total) ** a for s, t in tokens.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def high(a):
        return -sum(x * math.log(x) for x in weights(a).values()) >= target * math.log(len(tokens)) - 1e-12

    def rare(a):
        w = weights(a)
        b = budget if budget is not None else max(t / w[s] for s, t in tokens.items())
        return max(w[s] * b / t for s, t in tokens.items()) <= most + 1e-12

    lo, hi, found = 0.0, 1.0, []
    for ok, last in ((high, True), (rare, False)):
        lo, hi = 0.0, 1.0
        for _ in range(6):
            grid = [lo + (hi - lo) * i / 50 for i in range(51)]
            good = [x for x in grid if ok(x)]
            if not good:
                lo = hi = 1.0 if not last else 0.0
                break
            at = max(good) if last else min(good)
            lo, hi = max(0.0, at - (hi - lo) / 50), min(1.0, at + (hi - lo) / 50)
        found.append((lo + hi) / 2 if 0 < (lo + hi) / 2 < 1 - 1e-7 else round((lo + hi) / 2))
    return weights(max(found))


def brute_mix(spark, rows, size, n_blocks, seed, target, most, budget):
    """Rows one after the other: source, pass by pass, in the random order; their blocks by the tokens before."""
    tokens = Counter()
    for _, x, s in rows:
        tokens[s] += size(x)
    w = brute_exponent(tokens, target, most, budget)
    total = budget if budget is not None else max(t / w[s] for s, t in tokens.items())
    hashed = make(spark, rows).select("doc_id", "text", "source", F.array(*[F.xxhash64(F.lit(seed), F.lit(e), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))) for e in range(6)]).alias("h")).collect()
    out = Counter()
    for s, t in tokens.items():
        mine, quota = [r for r in hashed if r.source == s], w[s] * total
        for e in range(math.ceil(round(quota / t, 6))):
            before = 0
            for r in sorted(mine, key=lambda r: r.h[e]):
                b = math.floor((e * t + before) * n_blocks / quota + 1e-9)
                if b < n_blocks and (e * t + before) / quota < 1 - 1e-9:
                    out[r.doc_id, r.text, s, e, b] += 1
                before += size(r.text)
    return out


def test_exponent():
    tokens = [9000, 900, 100]
    shares = mixing.Shares.of(tokens)
    a = mixing.fit_exponent(shares, 0.8, 1e9)
    w = np.array(tokens) ** a / (np.array(tokens, float) ** a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.8 * math.log(3), abs=1e-6)
    a = mixing.fit_exponent(shares, 1.0, 5.0)
    w = np.array(tokens) ** a / (np.array(tokens, float) ** a).sum()
    assert (w / tokens).max() * (tokens / w).max() == pytest.approx(5.0, abs=1e-6)
    assert mixing.fit_exponent(mixing.Shares.of([5]), 0.9, 4.0) == pytest.approx(1.0)


@pytest.mark.parametrize("options", [{}, {"most_sources": 2}, {"budget": 3000}, {"target_entropy": 1.0, "most_repeats": 2.5}, {"odd tokens": True}])
def test_mix(spark, options):
    rows = some_sources()
    size, given = (lambda x: len((x or "").split()) + 1), dict(options)
    if given.pop("odd tokens", False):
        size = lambda x: max(1, len(x or "") % 7 - 1)
        n = F.length("text") % 7 - 1
        given["tokens"] = F.when(n > 1, n).when(n == 1, F.lit(None)).when(n == 0, F.lit(0)).otherwise(F.lit(-3))
    got = mixing.mix(make(spark, rows), n_blocks=8, **given).collect()
    found = Counter((r.doc_id, r.text, r.source, r.mix_epoch, r.mix_block) for r in got)
    assert all(r.mix_tokens == size(r.text) for r in got)
    want = brute_mix(spark, rows, size, 8, 17, given.get("target_entropy", 0.9), given.get("most_repeats", 4.0), given.get("budget"))
    # a row whose place is a block's end to within rounding may stand on either side
    assert sum(((found - want) + (want - found)).values()) <= 4
    if "budget" not in given:
        assert {x[:3] for x in found} == set(rows)  # none is left out


@pytest.mark.parametrize("budget", [-5, 0, 1, 37, 2000, None])
def test_shares_where_rows_repeat(spark, budget):
    """Half of the rows are one row: every source has its weight of the budget to within a document, in all and in each block."""
    rows = [(1, "one and the same row", "big")] * 1000 + [(i, "w " * (i % 9), "big") for i in range(1000)] + [(i, "v " * 3, "small") for i in range(150)] + [(2, "two words", "tiny")] * 9
    size, n_blocks = (lambda x: len(x.split()) + 1), 8
    got = mixing.mix(make(spark, rows).repartition(5), n_blocks=n_blocks, budget=budget).collect()
    if budget is not None and budget <= 0:
        assert got == []
        return
    tokens = Counter()
    for _, x, s in rows:
        tokens[s] += size(x)
    w = brute_exponent(tokens, 0.9, 4.0, budget)
    total = budget if budget is not None else max(t / w[s] for s, t in tokens.items())
    taken, by_block = Counter(), Counter()
    for r in got:
        taken[r.source] += r.mix_tokens
        by_block[r.source, r.mix_block] += r.mix_tokens
    largest = {s: max(size(x) for _, x, t in rows if t == s) for s in tokens}
    for s in tokens:
        assert -1e-3 <= taken[s] - w[s] * total <= largest[s]
        assert all(abs(by_block[s, b] - w[s] * total / n_blocks) <= largest[s] + 1e-3 for b in range(n_blocks))
    if budget is None:
        assert Counter((r.doc_id, r.text, r.source) for r in got if not r.mix_epoch) == Counter(rows)


def test_mix_keeps_columns_of_any_name(spark):
    names = ["_id", "_source", "_epochs", "_quota", "_order", "_bounds", "id", "salt", "passes", "epoch", "block", "tokens", "doc", "mix_block", "order", "bounds", "a b.c"]
    docs = make(spark, some_sources()[:50]).select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names])
    for most in (20_000, 1):
        got = mixing.mix(docs, n_blocks=2, most_sources=most)
        assert got.columns == ["doc_id", "text", "source", *[n for n in names if n != "mix_block"], "mix_tokens", "mix_epoch", "mix_block", "mix_order"]
        assert all(r[n] == n for r in got.collect() for n in names if n != "mix_block")


def test_mix_positions_and_nothing(spark):
    mixed = mixing.mix(make(spark, some_sources()), n_blocks=4)
    got = mixing.positions(mixed, ["doc_id", "source"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.block].append(r.position)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert mixing.mix(make(spark, [])).collect() == []


def test_positions_with_ties_and_nulls(spark):
    rows = [(None, 1, 0, 5), (None, 1, 0, 5), (3, 1, 0, 5), (3, 1, 0, 5), (4, 1, 0, 2), (4, 2, 1, 5), (None, 1, 1, 7)]
    mixed = spark.createDataFrame(rows, "doc_id long, mix_epoch int, mix_block int, mix_order long")
    got = mixing.positions(mixed, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.epoch, r.block) for r in got) == Counter(r[:3] for r in rows)
    assert sorted(r.position for r in got if r.block == 0) == [0, 1, 2, 3, 4] and sorted((r.position, r.doc_id) for r in got if r.block == 1) == [(0, 4), (1, None)]
    assert [r.doc_id for r in got if r.block == 0 and r.position == 0] == [4]


# quality classifier


def test_gradient_leads_to_the_greatest_likelihood():
    rng = np.random.default_rng(1)
    places, grades = [], []
    for _ in range(900):
        g = rng.integers(0, 3)
        places.append(np.unique(np.r_[rng.integers(10, 200, 6), [g] if rng.random() < 0.9 else []]).astype(np.int32))
        grades.append(g)
    m = quality.fit_arrays(places, np.array(grades), 3, 8)
    assert np.all(np.diff(m.thresholds) > 0)
    assert m.weights[0] < m.weights[1] < m.weights[2]
    up = m.upper(np.array([m.weights[p].sum() for p in places]))
    assert np.all(up[:, 0] >= up[:, 1])
    assert np.mean((up.sum(1).round()) == grades) > 0.8


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="no test tables")
def test_classifier_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = quality.fit(docs, labels.filter(~held), quality.grade_of_labels(), 3)
    got = quality.classify(docs.join(labels.filter(held), "doc_id"), model, tail_from=2).select("quality", "toxic", "selected").toPandas()
    clean = (got.quality == 1) & (got.toxic == 0)
    assert len(got) > 300
    assert got.selected[clean].mean() > 0.9 and got.selected[~clean].mean() < 0.25


def test_classify_follows_the_definition(spark):
    """Expected grade and tail from the model's numbers, one text at a time; columns of any name stay."""
    model = quality.Model(np.random.default_rng(3).standard_normal(1 << 10).astype(np.float32), np.array([-0.5, 0.25, 2.0]))
    texts = ["", None, "one two two THREE !!", "Größe " * 70, "x " * 5000, "a b c d e f g"]
    docs = spark.createDataFrame([(i, x, "g", "p", "s") for i, x in enumerate(texts)], "doc_id long, text string, _graded string, places string, tail string")
    got = {r.doc_id: r for r in quality.classify(docs, model, tail_from=2, least_tail=0.4).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        score = sum(float(model.weights[j]) for j in set(quality.features(x or "", 1023)))
        above = [1 / (1 + math.exp(t - score)) for t in (-0.5, 0.25, 2.0)]
        assert got[i].expected_grade == pytest.approx(sum(above), abs=1e-6) and got[i].tail == pytest.approx(above[1], abs=1e-6)
        assert got[i].selected == (above[1] >= 0.4) and (got[i]._graded, got[i].places) == ("g", "p")


def test_fit_is_the_greatest_penalised_likelihood():
    """Against steepest ascent on the likelihood as defined, with differences for slopes."""
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 400)
    places = [np.flatnonzero(rng.random(3) < [0.2 + 0.3 * g, 0.8 - 0.3 * g, 0.5]).astype(np.int32) for g in grades]
    x = np.zeros((400, 3))
    for i, p in enumerate(places):
        x[i, p] = 1

    def loss(v, ridge=1e-4):
        s, t = x @ v[:3], np.array([v[3], v[3] + math.exp(v[4])])
        below = np.concatenate([np.zeros((400, 1)), 1 / (1 + np.exp(s[:, None] - t)), np.ones((400, 1))], 1)
        return -np.mean(np.log(below[np.arange(400), grades + 1] - below[np.arange(400), grades])) + ridge / 2 * (v[:3] ** 2).sum()

    v = np.array([0.0, 0.0, 0.0, -0.5, 0.0])
    for _ in range(3000):
        slope = np.array([(loss(v + d) - loss(v - d)) / 2e-5 for d in 1e-5 * np.eye(5)])
        v -= 0.5 * slope
    m = quality.fit_arrays(places, grades, 3, 8, steps=600, signif=0.0)
    got = np.r_[m.weights[:3], m.thresholds[0], math.log(m.thresholds[1] - m.thresholds[0])]
    assert loss(got) <= loss(v) + 1e-4


def test_classifier_edges(spark):
    docs = make(spark, [(1, "good words here", "a"), (2, "bad junk there", "a"), (None, None, None), (3, "", "b"), (3, "", "b"), (4, "x " * 50_000, "b")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 1), (9, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, quality.grade_of_labels(), 3)
    got = quality.classify(docs, model, tail_from=2)
    assert got.count() == 6
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got.collect())
    assert quality.fit(docs, labels.filter("doc_id = 1"), quality.grade_of_labels(), 3) is None
    assert quality.classify(docs, None, tail_from=2).filter("selected").count() == 6
    assert quality.classify(docs.limit(0), model, tail_from=2).collect() == []


def test_classifier_takes_one_row_of_a_repeated_id(spark, monkeypatch):
    docs = make(spark, [(1, f"good words {i}", "a") for i in range(50)] + [(2, "bad junk there", "a")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_arrays", lambda places, grades, *_: seen.append(sorted(grades.tolist())))
    quality.fit(docs, labels, quality.grade_of_labels(), 3)
    assert seen == [[0, 2]]


# nearest neighbours


def brute_nearest(rows, ask, k):
    out = {}
    for q, x in rows:
        if ask(q):
            x = np.array(x)
            score = sorted((-(x @ y) / math.sqrt((x @ x) * (y @ y)), i) for i, y in ((i, np.array(y)) for i, y in rows if i != q and len(y) == len(x)))
            out[q] = score[:k]
    return out


@with_tables
@pytest.mark.parametrize("options", [{}, {"cell_rows": 400, "part_queries": 7, "sample_rows": 900}])
def test_nearest_recall(spark, options):
    """Over one cell, and over many of them; at 64 dimensions."""
    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet" if options else f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.asarray(r.embedding, float)) for r in table.collect()]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, k=5, **options).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = n = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = x @ x[at]
        score[at] = -2
        want = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        found = sorted(got[ids[at].item()])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        for _, i, s in found:
            assert s == pytest.approx(score[np.flatnonzero(ids == i)[0]], abs=1e-9)
        hit, n = hit + len(want & {i for _, i, _ in found}), n + 5
    assert hit / n >= 0.9


@pytest.mark.parametrize("block", [8192, 40])
def test_nearest_edges(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # ties
    rows += [(5000 + i, (np.array(rows[100][1]) * 2.0 ** (i - 100)).tolist()) for i in range(200)]  # one direction, lengths of many kinds
    odd = [(None, [1.0, 0.0, 0.0, 0.0]), (2000, None), (2050, []), (2100, [0.0, 0.0, 0.0, 0.0]), (2150, [1.0, None, 0.0, 0.0]), (2200, [float("nan"), 1.0, 0.0, 0.0]), (2250, [float("inf"), 1.0, 0.0, 0.0])]
    other = [(3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + odd + other + [rows[0]]], "vec_id long, embedding array<double>, block string, rank int")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, k=5, cell_rows=block, part_queries=5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows + other, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want)
    same = sum(len({i for _, i, _ in got[q]} & {i for _, i in found}) for q, found in want.items())
    assert same >= 0.9 * sum(map(len, want.values()))
    assert [i for _, i, _ in sorted(got[50])] == [1000, 1001, 1002, 1003, 1004]
    assert [(r, i) for r, i, _ in got[3000]] == [(1, 3001)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_tree_finds_the_leaf_of_every_point():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.standard_normal((500, 3)), np.ones((700, 3))])
    tree = ann.Tree(points, 4, strict=True)
    found = tree.find(points)
    assert tree.leaves > 4 and set(found.tolist()) == set(range(tree.leaves)) and len(set(found[500:].tolist())) == 1
    for i, (lo, hi) in enumerate(tree.rows):
        if tree.dim[i] < 0:
            assert set(tree.order[lo:hi].tolist()) == set(np.flatnonzero(found == tree.leaf[i]).tolist())


def test_walk_leaves_out_what_the_test_rules_out(monkeypatch):
    """Clustered vectors: the walk stops long before all leaves, and finds the nearest."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 64)) * 4
    x = np.repeat(centres, 200, 0) + 0.3 * rng.standard_normal((12_000, 64))
    cell = ann.Cell(np.arange(len(x)), x, 8, 0.95, 5)
    looked = []
    monkeypatch.setattr(ann, "heappop", lambda heap, pop=ann.heappop: looked.append(1) or pop(heap))
    u, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 12_000, 600):
        want = [i for i in np.argsort(-(u @ u[q]), kind="stable")[:6] if i != q][:5]
        hit += len(set(want) & set(cell.nearest(q, x[q], 5, -2.0)[0].tolist()))
    assert hit >= 90 and len(looked) < 20 * len(cell.tree.dim) / 3


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert ann.chi_square_quantile(0.99, 8) == pytest.approx(20.090, abs=1e-3)


# sharding


def test_min_cost_flow_moves_the_fewest_bytes():
    rng = random.Random(9)
    for _ in range(20):
        supply = [rng.randrange(0, 5) for _ in range(3)]
        capacity = [-(-sum(supply) // 3)] * 3
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(3)] == supply
        moved = sum(v for (i, j), v in flow.items() if i != j)
        best = None
        items = [i for i, s in enumerate(supply) for _ in range(s)]
        for to in itertools.product(range(3), repeat=len(items)):
            if all(Counter(to)[j] <= capacity[j] for j in range(3)):
                cost = sum(i != j for i, j in zip(items, to, strict=True))
                best = cost if best is None else min(best, cost)
            if best == moved:
                break
        assert moved == best == sum(max(0, s - capacity[0]) for s in supply)


def shard_rows():
    rng = random.Random(11)
    rows = [(i, "z" * rng.randrange(0, 300) + str(i), "a") for i in range(1500)]
    rows += [(5000 + i, "copy" * 40, "a") for i in range(600)]  # a large group of copies
    return [*rows, (None, None, "a"), (None, "", "a"), (3, "again", "a"), (3, "again", "a")]


def test_reshard(spark):
    import zlib

    rows = shard_rows()
    got = sharding.reshard(make(spark, rows), shards=4).collect()
    want = Counter((i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(4)) and max(sizes.values()) / min(sizes.values()) < 1.02
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    old = Counter()
    for r in got:
        old[r.old_shard] += r["size"]
    target = sum(old.values()) / 4
    moved = sum(r["size"] for r in got if r.shard != r.old_shard)
    assert moved <= sum(max(0, v - target) for v in old.values()) + 0.02 * target


def test_reshard_fewer_shards_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 50), i % 6) for i in range(600)], "doc_id long, text string, at int")
    out = sharding.reshard(docs, shards=4, old_shard=F.col("at")).cache()
    assert {r.shard for r in out.select("shard").distinct().collect()} == set(range(4))
    made = {r.shard: r.rewritten for r in sharding.rewrite_affected(docs, out, str(tmp_path / "out")).collect()}
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == sum(1 for r in out.collect() if made[r.shard])
    assert sharding.reshard(docs.limit(0), shards=4).collect() == []


def test_reshard_files_keep_what_is_not_affected(spark, tmp_path):
    """Shards 0 to 2 change, 3 does not: its files stay; null and repeated doc_ids keep a row each."""
    rows = [(i, f"t{i:04}" + "x" * 94, 0) for i in range(30)] + [(100 + i, f"u{i:04}" + "x" * 94, 1) for i in range(10)]
    rows += [(200, "again" + "x" * 94, 2)] * 3 + [(None, f"n{i:04}" + "x" * 94, 2) for i in range(7)]
    rows += [(300 + i, f"v{i:04}" + "x" * 94, 3) for i in range(20)] + [(400, "w0000" + "x" * 94, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = str(tmp_path / "out")
    docs.withColumn("slot", F.lit(0).cast("long")).select("doc_id", "text", "slot", "shard").write.partitionBy("shard").parquet(out)
    kept = {p.name for p in (tmp_path / "out" / "shard=3").iterdir()}
    got = sharding.reshard_files(docs, out, shards=4, old_shard=F.col("shard"), capacities=[1700, 1700, 1700, 2000]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, x) for i, x, _ in rows)
    assert {p.name for p in (tmp_path / "out" / "shard=3").iterdir()} == kept
    lying = spark.read.parquet(out).collect()
    assert Counter((r.doc_id, r.text) for r in lying) == Counter((i, x) for i, x, _ in rows)
    assert Counter(r.shard for r in lying) == Counter({0: 17, 1: 17, 2: 17, 3: 20})  # 4 is given up
    for i in range(3):
        assert sorted(r.slot for r in lying if r.shard == i) == list(range(17))


def test_rewrite_affected_with_null_and_repeated_ids(spark, tmp_path):
    rows = shard_rows() + [(9000, None, "a")] * 4
    docs = make(spark, rows)
    placed = sharding.reshard(docs, shards=4).cache()
    out = str(tmp_path / "out")
    spark.createDataFrame([(77, 7)], "doc_id long, shard int").write.partitionBy("shard").parquet(out)
    made = {r.shard: r.rewritten for r in sharding.rewrite_affected(docs, placed, out).collect()}
    assert all(made[i] for i in range(4))
    assert Counter((r.doc_id, r.text) for r in spark.read.schema("doc_id long, text string, shard int").parquet(out).collect()) == Counter((i, x) for i, x, _ in rows) + Counter([(77, None)])


@with_tables
def test_sharding_query_writes_the_texts(spark):
    from tallyworks.llm.common import tables_dir

    there = set(os.listdir(tables_dir(spark).removeprefix("file:")))
    got = QUERIES["op10_sharding"](spark, SF).collect()
    (made,) = (x for x in set(os.listdir(tables_dir(spark).removeprefix("file:"))) - there if x.startswith("shards-"))
    texts = spark.read.parquet(f"{tables_dir(spark)}/{made}")
    affected = {x for r in got for x in (r.old_shard, r.shard) if r.old_shard != r.shard}
    lying = texts.select("doc_id", "shard", "slot", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")).collect()
    assert affected and Counter(tuple(r) for r in lying) == Counter((r.doc_id, r.shard, r.slot, r.text_crc32) for r in got if r.shard in affected)


# queries and pipeline


@with_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


@with_tables
def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    packed = cp.run(spark, SF).collect()
    ids = {r.doc_id for r in packed}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    clean = [i for i, (q, t) in labels.items() if q == 1 and t == 0]
    chosen = {r.doc_id for r in cp.select_quality(spark, docs, SF).select("doc_id").collect()}
    assert sum(i in chosen for i in clean) >= 0.9 * len(clean)
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 4
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == cp.COLUMNS


def test_tables_stay_while_something_reads_them(spark):
    import gc

    import corpus_pipeline as cp
    from tallyworks.llm.common import sweep, tables_dir

    folder = tables_dir(spark).removeprefix("file:")
    tables = lambda prefix: {x for x in os.listdir(folder) if x.startswith(prefix)}
    sweep(spark)
    docs, before = spark.read.parquet(f"{SF}/documents.parquet").limit(60), tables("nd-")
    left = cp.remove_near_duplicates(spark, docs, SF)
    assert len(tables("nd-") - before) == 1  # of a dozen, the one that says which documents stay
    n = left.count()
    derived = left.select("doc_id")
    del left
    gc.collect()
    assert cp.mix_sources(spark, docs, SF).count() > 0
    assert derived.count() == n


@with_tables
def test_results_outlive_other_runs_and_runs_resume(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    os.mkdir(tmp_path / "sf")
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "sf/labels.parquet"))
    sf, calls = str(tmp_path / "sf"), []

    def failing(f, name, fail):
        def stage(*args):
            calls.append(name)
            if fail():
                raise RuntimeError("lost")
            return f(*args)

        return stage

    lost = [True]
    monkeypatch.setattr(cp, "STAGES", [(n, failing(f, n, lambda n=n: n == "mixing sources to target weights" and lost[0])) for n, f in cp.STAGES])
    lost[0] = False
    one = cp.run(spark, sf)
    n = one.count()
    cp.select_quality(spark, docs, sf).count()
    two = cp.run(spark, sf)
    assert two.count() == n == one.count()
    lost[0], folder = True, str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        cp.run(spark, sf, folder)
    lost[0] = False
    calls.clear()
    assert cp.run(spark, sf, folder).count() == n and calls == ["mixing sources to target weights", "best-fit packing"]
    calls.clear()
    assert cp.run(spark, sf, folder).count() == n and not calls


def test_pipeline_against_its_definition(spark, tmp_path):
    """Exact stages against brute force: one of each group stays, nothing else goes; every source whole, in order of weights; ids packed as they are."""
    import corpus_pipeline as cp
    from tallyworks.llm import packing
    from tallyworks.llm.queries import tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = group[i], group[j]
            group = {k: a if g == b else g for k, g in group.items()}
    left = cp.remove_near_duplicates(spark, docs, SF)
    left.write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    kept = sorted(r.doc_id for r in left.collect())
    assert kept == sorted(min(i for i in group if group[i] == g) for g in set(group.values()))
    mixed = cp.mix_sources(spark, left, SF)
    times = Counter(r.doc_id for r in mixed.collect())
    assert sorted(times) == kept and max(times.values()) <= 4
    packed = cp.pack_sequences(spark, left, SF).collect()
    encode = packing.WordIds(tokenizer("word_bpe_49k.json"))
    ids = defaultdict(bytes)
    for r in sorted(packed, key=lambda r: r.piece):
        ids[r.doc_id] += bytes(r.ids)
    assert dict(ids) == {r.doc_id: encode.whole(r.text or "") + (1).to_bytes(4, "little") for r in rows if r.doc_id in set(kept)}
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
