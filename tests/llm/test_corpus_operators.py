"""Divergence, repeated passages and ranked search against brute-force versions, with nulls, empty texts, repeats and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import divergence, fmindex, ranked, substrings

SCHEMA = "doc_id long, text string, lang string, source string, kind string, term string, item string, n long, words string, block string, anchor string, shard string, x int"


def make(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, "k", "t", "i", 1, "w", "b", "a", "s", 0) for r in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_rows():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("alpha", "Beta", "gamma", "été", "数据", "x1y") for b in ("", "s", "er", "-", "2")]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(60):
        x = [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 80]))]
        if i % 3 == 0:
            at = rng.randrange(0, 30)
            x = x[:7] + passage[at : at + rng.choice([5, 19, 20, 25, 30])] + x[7:]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(x), rng.choice(["en", "de"]), rng.choice(["web", "books", "code", None])))
    rows += [(100, rows[3][1], "en", "web"), (101, rows[3][1].upper(), "en", "web"), (-7, rows[9][1], None, "web")]
    rows += [(102, None, "en", "web"), (103, "", "fr", "only"), (104, "\t \n", "fr", "other"), (None, " ".join(passage), "en", None), (None, None, None, None)]
    rows += [(105, "same row " * 15, "en", "x"), (105, "same row " * 15, "en", "x"), (105, "other text " * 15, "en", "x")]
    rows += [(106, "z " * 70, "de", "web"), (107, " ".join(passage[:30] + ["z"] * 25 + passage[30:]), "de", "web")]
    rows.append((200, " ".join(rng.choice(words) for _ in range(5000)), "en", "books"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


# divergence


def brute_divergence(rows, least, most):
    terms = lambda x: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(x))
    by_lang = defaultdict(list)
    for _, text, lang, source in rows:
        by_lang[lang or ""].append((source or "", terms(text)))
    out = []
    for lang, docs in by_lang.items():
        df = Counter(t for _, words in docs for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter() for s, _ in docs}
        for s, words in docs:
            counts[s].update(t for t in words if df[t] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda x, y: (x - y) * (x - y) // y
        for s in counts:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in counts if o != s]
            over = [(f(ps[s][t], q[t]), t) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", over)):
                ranked_ = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked_) if part == "pair" or i < most]
    return sorted(out)


@pytest.mark.parametrize("least,most", [(3, 200), (1, 4), (1000, 5)])
def test_divergence(docs, rows, least, most):
    got = divergence.divergence(docs, least, most)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_divergence(rows, least, most)


def test_divergence_of_nothing_and_of_repeated_rows(spark, rows):
    assert divergence.divergence(make(spark, [])).collect() == []
    twice = [r for r in rows[:40] for _ in range(3)]
    got = divergence.divergence(make(spark, twice).repartition(3), 3, 10)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_divergence(twice, 3, 10)


def test_divergence_scans_terms_that_fill_many_batches(spark, monkeypatch):
    """Runs of one term over several looks of the scan, and a histogram that is emitted again and again."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "SCAN_ROWS", 7)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    rng = random.Random(1)
    runs = sorted((lang, f"t{rng.randrange(6)}", f"s{rng.randrange(5)}", 1, rng.randrange(1, 4)) for lang in ("a", "b") for _ in range(60))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "documents", "n"), r, strict=True)) for r in runs[i : i + 9]]) for i in range(0, len(runs), 9)]
    got = [r for b in divergence._scan(3)(iter(batches)) for r in b.to_pylist()]
    n = Counter()
    for lang, term, source, _, k in runs:
        n[lang, term, source] += k
    want_terms = {(lang, s, t): k for (lang, t, s), k in n.items() if sum(r[:2] == (lang, t) for r in runs) >= 3}
    assert {(r["lang"], r["source"], r["item"]): r["x"] for r in got if r["kind"] == "term"} == want_terms
    pairs, want = Counter(), Counter()
    for r in got:
        if r["kind"] == "pair":
            one, two = (r["source"], r["x"]), (r["item"], r["y"])
            pairs[r["lang"], *min((one, two), (two, one))] += r["n"]
    for (lang, s, t), k in want_terms.items():
        for (lang2, s2, t2), k2 in want_terms.items():
            if lang == lang2 and t == t2 and s < s2:
                want[lang, *min(((s, k), (s2, k2)), ((s2, k2), (s, k)))] += 1
    assert pairs == want


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(3, 10), (8_999_999_999, 10**10), (9_000_000_000, 10**10), (7 * 10**15, 9 * 10**17), (10**18, 10**18 + 5)]
    df = spark.createDataFrame(rows, "c long, w long").select("c", "w", divergence.smoothed(F.col("c"), F.col("w")).alias("p"))
    assert {(r.c, r.w): r.p for r in df.collect()} == {(c, w): 1 + 10**9 * (c + 1) // w for c, w in rows}


# repeated passages


def brute_repeats(rows, window):
    """rows in their order; of each the words that stay."""
    seen, out = set(), []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for j in range(len(words) - window + 1):
            w = tuple(words[j : j + window])
            gone |= set(range(j, j + window)) if w in seen else set()
            seen.add(w)
        out.append((i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return out


@pytest.mark.parametrize("window,most", [(20, 4096), (20, 1), (20, 3), (3, 4096), (3, 2), (1, 4096)])
def test_repeats(spark, docs, rows, window, most):
    """Whatever the number of contents from which an anchor's segments fall into windows."""
    keys = {(r.doc_id, r.text): r.key for r in docs.select("doc_id", "text", F.hash(F.coalesce("text", F.lit(""))).alias("key")).collect()}
    ordered = sorted(((i, x) for i, x, _, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, keys[r]))
    got = substrings.remove_repeats(docs, window, most, shard_words=200).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(brute_repeats(ordered, window), key=repr)
    texts = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, x, _, _ in rows:
        if i is not None and i != 105:
            words = (x or "").split()
            for s in reversed(texts[i].spans):
                del words[s["first"] : s["first"] + s["words"]]
            assert " ".join(words) == texts[i].kept


def test_repeats_of_nothing_and_a_window_of_none(spark):
    assert substrings.remove_repeats(make(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(make(spark, []), 0)


def test_repeats_of_a_large_group(spark):
    """A passage in every document under ever new words: one anchor of many contents."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"a{rng.randrange(9)}" for _ in range(5)] + passage[: 20 + i % 20] + [f"b{rng.randrange(9)}" for _ in range(30)]), "en", "s") for i in range(150)]
    want = sorted(brute_repeats([r[:2] for r in rows], 20))
    for most in (5, 4096):
        got = substrings.remove_repeats(make(spark, rows).repartition(9), 20, most)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == want


def longest_match(pattern, pieces, depth):
    """The longest beginning of a pattern that a piece holds, up to a depth."""
    for n in range(min(depth, len(pattern)), 0, -1):
        if any(p[i : i + n] == pattern[:n] for p in pieces for i in range(len(p) - n + 1)):
            return n
    return 0


@pytest.mark.parametrize("depth,symbols,seed", [(1, 2, 0), (4, 2, 1), (5, 3, 2), (20, 2, 3), (20, 60, 4), (7, 1, 5)])
def test_matching_statistics(depth, symbols, seed):
    rng = random.Random(seed)
    pieces = [[rng.randint(1, symbols) for _ in range(rng.choice([1, 3, 30]))] for _ in range(12)]
    text = np.array([s for p in pieces for s in [*p, 0]])
    index = fmindex.FMIndex(text, depth)
    queries = [[rng.randint(0, symbols) for _ in range(25)] for _ in range(8)] + pieces
    flat = np.array([s for q in queries for s in q])
    flat[flat > text.max()] = 0
    ends = np.cumsum([len(q) for q in queries])
    length, place = index.matching_statistics(flat, ends - [len(q) for q in queries], ends)
    at = 0
    for q in queries:
        for i in range(len(q)):
            pattern = flat[at + i : at + len(q)].tolist()
            assert length[at + i] == longest_match(pattern, pieces, depth), (q, i)
            if length[at + i]:
                found = index.order[place[at + i]]
                assert text[found : found + length[at + i]].tolist() == pattern[: length[at + i]]
        at += len(q)


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 37, 1000)
    w = fmindex.WaveletMatrix(x, 37)
    c, i = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert w.rank(c, i).tolist() == [int((x[:j] == s).sum()) for s, j in zip(c, i, strict=True)]


# ranked search


def brute_search(rows, items, k):
    terms = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(x))
    docs = [(i, Counter(terms(x))) for i, x, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, j + 1, i, -s) for j, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha été x1y2"), (2, "ALPHA alpha betas"), (3, None), (4, "no such term"), (5, "数据er same z"), (1, "alpha été x1y2"), (1, "gamma"), (None, "other text"), (6, "alpha alphas alphaer beta betas betaer gamma gammas gammaer 2")]


@pytest.mark.parametrize("k", [1, 5, 50, 500])
def test_search(spark, docs, rows, k):
    items = spark.createDataFrame([(*x, "t", 1) for x in ITEMS], "item_id long, text string, term string, shard long")
    got = ranked.search(ranked.build_index(docs), items, k)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(rows, ITEMS, k)


def test_search_in_chunks_and_of_nothing(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ranked, "CHUNK_ITEMS", 2)
    assert [len(c) for c in ranked.chunks(iter([{"text": "x" * n} for n in (3, 3, 9, 1, 1, 1)]), 3, 8)] == [2, 1, 3]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(ranked.build_index(docs), items.limit(0)).collect() == []
    assert ranked.search(ranked.build_index(make(spark, [(1, None, "en", "s"), (2, " -", "en", "s")])), items).collect() == []
    assert ranked.search(ranked.build_index(make(spark, [])), items).collect() == []


def least_cost(x, longest, price):
    best = [0.0]
    for i in range(1, len(x) + 1):
        best.append(min(best[i - b] + b * max(x[i - b : i]) + price for b in range(1, min(longest, i) + 1)))
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_have_the_least_cost(seed):
    rng = np.random.default_rng(seed)
    lists = [rng.integers(1, 50, n) for n in (1, 2, 3, 5, 17, 40, 41, 90, 200)]
    for x, ends in zip(lists, ranked.cut_blocks(lists, 16, 2.0), strict=True):
        assert ends[-1] == len(x) and (np.diff(ends) > 0).all() and np.diff(np.r_[0, ends]).max() <= 16
        cost = sum((e - s) * x[s:e].max() + 2.0 * x.mean() for s, e in zip([0, *ends[:-1]], ends, strict=True))
        assert cost == pytest.approx(least_cost(x.tolist(), 16, 2.0 * x.mean()))


def test_blocks_of_low_bounds_stay_closed():
    """Exact for any threshold, with far fewer postings opened where impacts are uneven."""
    rng = np.random.default_rng(1)
    n = 20_000
    lengths = rng.integers(100, 900, n)
    terms = {}
    for j in range(12):
        ids = np.flatnonzero(rng.random(n) < 0.3)
        tf = 1 + (rng.random(len(ids)) < 0.01) * rng.integers(5, 60, len(ids))
        terms[b"t%d" % j] = ids, tf
    s = ranked.Shard(np.arange(n), np.ones(n, bool), lengths, terms, n, int(lengths.sum()), cut=lambda x: ranked.cut_blocks(x, 64, 0.2))
    query = {t: 1000 + 100 * j for j, t in enumerate(terms)}
    score = np.zeros(n, np.int64)
    for t, (ids, tf) in terms.items():
        score[ids] += query[t] * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * n * lengths[ids] // int(lengths.sum()))))
    for k in (1, 10):
        for threshold in (0, int(np.sort(score)[-5])):
            places, scores = s.search(query, k, threshold)
            assert (score[places] == scores).all()
            want = [x for x in np.sort(score)[::-1][:k] if x >= threshold]
            assert np.sort(scores)[::-1][: len(want)].tolist() == want
    assert s.opened < 0.6 * s.spanned
