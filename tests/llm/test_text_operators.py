"""Operators on document texts against brute-force versions, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import fingerprint, licenses, neardup, ngram_lm, packing, tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, shard string, rank string, key string, one int, length string, digest string, block string, part string"


def make(spark, rows):
    """A documents table with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, x, "en", "web", 0, "n", "s", "r", "k", 1, "l", "d", "b", "p") for i, x in rows], SCHEMA)


def some_texts():
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 8, 60, 200])))) for i in range(1, 80)]
    base = [rng.choice(WORDS) for _ in range(150)]
    for i in range(100, 140):  # near copies, some beyond the limit
        x = list(base)
        for _ in range(rng.randrange(0, 14)):
            x[rng.randrange(len(x))] = rng.choice(WORDS)
        rows.append((i, " ".join(x)))
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, rows[50][1]), (-5, rows[50][1])]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "one"), (None, "ein Satz ohne Nummer"), (None, None)]
    rows += [(305, "Größe ÄÖÜ é x 数据 😀 <|endoftext|> it's 2024"), (306, "same row"), (306, "same row"), (306, "other text")]
    rows.append((400, " ".join(rng.choice(WORDS) for _ in range(30_000))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, size):
    w = ascii_words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, percent):
    sets = [shingle_set(x, size) for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, groups


# packing


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        able = [g for g in gaps if g >= n]
        if able:
            gaps.remove(min(able))
            gaps.append(min(able) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=256, end_id=1).collect()
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, p, at, len(part), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) == best_fit_decreasing([r.length for r in got], 256)


def test_packed_sequences_hold_the_ids(docs, rows):
    """Every sequence, put together by offset, is the ids of its documents' pieces; none is lost."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    whole = defaultdict(list)
    for r in packing.pack(docs, path, capacity=256, end_id=1).collect():
        assert (len(r.ids), zlib.crc32(r.ids)) == (4 * r.length, r.ids_crc32)
        whole[r.sequence_id].append((r.offset, [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]))
    sequences = [[v for at, ids in sorted(x) for v in ids] for x in whole.values()]
    assert all(at == sum(len(ids) for other, ids in x if other < at) for x in whole.values() for at, _ in x)
    assert Counter(v for x in sequences for v in x) == Counter(v for _, x in rows for v in [*t.encode(x or "", add_special_tokens=False).ids, 1])


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_runs(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 300) for n in rng.sample(range(1, 65), 30)}
    runs = packing.best_fit_runs(counts, 64)
    used = defaultdict(set)
    placed = Counter()
    for length, _, pieces, first, offset, side in runs.tolist():
        placed[length] += pieces
        for k in range(pieces):
            at = offset + k % side * length
            cells = set(range(at, at + length))
            assert not cells & used[first + k // side] and max(cells) < 64
            used[first + k // side] |= cells
    assert placed == counts
    assert len(used) == best_fit_decreasing([n for n, c in counts.items() for _ in range(c)], 64)


def test_packing_of_nothing(none):
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []


# near duplicates


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    sets, groups = brute_components(rows, size, 80)
    want = Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        least = min(ids) if ids else None
        for i in members:
            want[rows[i][0], len(sets[i]), least, rows[i][0] == least] += 1
    got = neardup.near_duplicates(docs, size=size, percent=80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_deduplicate(docs, rows):
    _, groups = brute_components(rows, 5, 80)
    got = neardup.deduplicate(docs, size=5, percent=80)
    assert got.columns == docs.columns
    wordy = [g for g in groups.values() if ascii_words(rows[g[0]][1])]
    silent = {(i, x or "") for i, x in rows if not ascii_words(x)}
    assert got.count() == len(wordy) + len(silent)


def test_deduplicate_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "z", "w"), (3, "other words here now and then", "u", "v")], "doc_id long, text string, _at string, `a b.c` string")
    got = neardup.deduplicate(docs).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a b c d e f", "x", "y"), (3, "other words here now and then", "u", "v")] and got[0].__fields__ == ["doc_id", "text", "_at", "a b.c"]


def test_near_duplicates_of_many_components(spark, monkeypatch):
    """Buckets cut into many small blocks lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(rng.randrange(4, 14)):
            x[rng.randrange(len(x))] = rng.choice(WORDS)
        rows.append((i, " ".join(x)))
    _, groups = brute_components(rows, 2, 80)
    want = {rows[i][0]: min(rows[j][0] for j in g) for g in groups.values() for i in g}
    got = neardup.near_duplicates(make(spark, rows), size=2, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_nothing(none):
    assert neardup.near_duplicates(none).collect() == []
    assert neardup.deduplicate(none).collect() == []


# licenses


def test_align_finds_the_longest_common_words():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        n, first, end = licenses.align(a, [""] * 10 + b, 10)
        assert n == table[-1][-1]
        assert not n or (b[first - 10] in a and b[end - 11] in a)


def test_license_scan(spark):
    mit, gpl = licenses.TEMPLATES["MIT permission"], licenses.TEMPLATES["GPL-3.0 line"]
    words = mit.split()
    changed = " ".join([*words[:30], "quite", "new", *words[30:50], *words[53:]])
    rows = [(1, f"Code.\n{mit}\nMore."), (2, f"x {changed.upper()} y"), (3, " ".join(words[:20])), (4, f"{gpl} {gpl}"), (5, None), (6, ""), (None, gpl), (7, "text " * 50_000 + gpl), (8, gpl), (8, gpl), (9, "Größe İİ")]
    got = licenses.scan(make(spark, rows)).collect()
    found = Counter((r.doc_id, r.license) for r in got)
    assert found == Counter({(1, "MIT permission"): 1, (2, "MIT permission"): 1, (4, "GPL-3.0 line"): 2, (None, "GPL-3.0 line"): 1, (7, "GPL-3.0 line"): 1, (8, "GPL-3.0 line"): 2})
    texts = dict(rows)
    for r in got:
        if r.doc_id in (1, 7):
            assert r.coverage == 1.0
            span = texts[r.doc_id][r.start : r.end]
            assert re.findall(r"\w+", span) == re.findall(r"\w+", mit if r.doc_id == 1 else gpl)
        if r.doc_id == 2:
            assert r.coverage == pytest.approx(1 - 3 / len(re.findall(r"[^\W_]+", mit)), abs=0.02)


@pytest.mark.parametrize("name", [x for x, t in licenses.TEMPLATES.items() if len(t.split()) <= 14])
def test_licenses_back_to_back(name):
    """Each of adjacent copies is a match, also where a word of one is missing."""
    line, index = licenses.TEMPLATES[name], licenses.build(licenses.TEMPLATES, 0.8)
    for n in (1, 2, 3, 7):
        text = "Code. " + " ".join([line] * n) + " More."
        got = [m for m in licenses.matches(text, index, 8, 0.8) if m[0] == name]
        assert [(m[1], m[3], m[4]) for m in got] == [(1.0, at, at + len(line.rstrip("."))) for at in range(6, len(text) - 6, len(line) + 1)]
    if len(re.findall(r"[^\W_]+", line)) >= 5:
        text = f"{line} {line.split(maxsplit=1)[1]} {line}"
        assert len([m for m in licenses.matches(text, index, 8, 0.8) if m[0] == name]) == 3


@pytest.mark.parametrize("name", ["MIT line", "CC-BY-NC-4.0 line", "GPL-3.0 line", "CC-BY-4.0 line", "MPL-2.0 header"])
def test_no_license_match_is_lost(name):
    """Against alignment at every place: wherever that finds the template, the index has led to a match."""
    rng = random.Random(name)
    template = licenses._word.findall(licenses.TEMPLATES[name].lower())
    index = licenses.build({name: licenses.TEMPLATES[name]}, 0.8)
    seen = 0
    for _ in range(60):
        words = []
        for _ in range(3):
            words += [rng.choice(["filler", "text", *template]) for _ in range(rng.randrange(0, 12))]
            for w in template:  # words left out, changed and put in
                r = rng.random()
                words += [w] if r < 0.8 else [] if r < 0.87 else ["other"] if r < 0.93 else [w, *["more"] * rng.randrange(1, 5)]
        got = [(m[3], m[4]) for m in licenses.matches(" ".join(words), index, 8, 0.8)]
        ends = [0]
        for w in words:
            ends.append(ends[-1] + len(w) + 1)
        for start in range(-8, len(words)):
            shift = start - 8
            n, first, end = licenses.align(template, [""] * max(0, -shift) + words[max(0, shift) : start + len(template) + 8], 8)
            if n >= 0.8 * len(template):
                first, end = first + shift, end + shift
                seen += 1
                assert any(a < ends[end] and b > ends[first] for a, b in got), (words, start, n)
    assert seen > 20


def test_inserted_word_and_kindred_templates(spark):
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan(make(spark, [(1, "released under the fine MIT License"), (2, licenses.TEMPLATES["GPL-2.0 header"]), (3, licenses.TEMPLATES["MIT"])]), most_words=60).collect()}
    assert got[1, "MIT line"] == 1.0 and {x for i, x in got if i == 3} == {"MIT", "MIT permission"}
    assert {x for i, x in got if i == 2} >= {"GPL-2.0 header"}
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan(make(spark, [(i, x) for i, x in enumerate(licenses.TEMPLATES.values())])).collect()}
    assert all(got[i, x] == 1.0 for i, x in enumerate(licenses.TEMPLATES))
    assert {x for i, x in got if "GPL" in list(licenses.TEMPLATES)[i]} == {x for x in licenses.TEMPLATES if "GPL" in x}


def test_license_scan_of_nothing(none):
    assert licenses.scan(none).collect() == []


# token counts


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(docs, rows, name, tmp_path):
    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        length = lambda x: len(sp.encode(x))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        length = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = Counter((i, len((x or "").encode()), length(x or "")) for i, x in rows)
    for _ in range(2):
        got = tokencount.count_tokens(docs, path, cache=cache).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == len({x or "" for _, x in rows})  # the second run appended none


def test_token_counts_use_stored_counts(spark, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    digest = hashlib.sha256(b"some text").digest()
    spark.createDataFrame([(tokencount.tokenizer_digest(path), bytearray(digest), 77)], tokencount.CACHE_SCHEMA).write.parquet(cache)
    got = tokencount.count_tokens(make(spark, [(1, "some text"), (2, "more")]), path, cache=cache).collect()
    assert {r.doc_id: r.n_tokens for r in got}[1] == 77
    assert spark.read.parquet(cache).count() == 2


def test_token_counts_of_a_normal_form_and_of_frequent_contents(spark, tmp_path):
    """Composed and decomposed letters are one content under a normal form; frequent contents and rare ones join alike."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "e\u0301" if i % 2 else "\u00e9") for i in range(40)] + [(100 + i, f"text {i}") for i in range(9)]
    got = {}
    for form, most in (("NFC", 1), (None, 1), (None, 0), (None, 1000)):
        cache = str(tmp_path / f"{form}{most}")
        found = tokencount.count_tokens(make(spark, rows), path, cache=cache, normal_form=form, most_hot=most).collect()
        got[form, most] = {r.doc_id: (r.n_bytes, r.n_tokens) for r in found}
        assert len(found) == len(rows) and spark.read.parquet(cache).count() == (10 if form else 11)
    assert got[None, 0] == got[None, 1] == got[None, 1000]
    assert {b for i, (b, _) in got["NFC", 1].items() if i < 40} == {2, 3} and len({n for i, (_, n) in got["NFC", 1].items() if i < 40}) == 1
    tokencount.compact(spark, str(tmp_path / "None1"), 1)
    assert spark.read.parquet(str(tmp_path / "None1")).count() == 11


def test_a_full_cache_shuffles_no_text(spark, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij klmno") for _ in range(20_000)) for _ in range(40)]
    docs = make(spark, list(enumerate(texts))).repartition(3).cache()
    docs.count()

    def shuffled() -> int:
        sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    written, counts = [shuffled()], []
    for _ in range(2):
        counts.append(sorted(map(tuple, tokencount.count_tokens(docs, path, cache=cache).collect())))
        written.append(shuffled())
    cold, warm = written[1] - written[0], written[2] - written[1]
    assert counts[0] == counts[1] and cold > 400_000 and warm < 40_000
    # more misses than can be sent: the same counts
    assert sorted(map(tuple, tokencount.count_tokens(docs, path, cache=str(tmp_path / "other"), most_sent=3).collect())) == counts[0]


def test_token_counts_of_nothing(none):
    assert tokencount.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")).collect() == []


# language model


def test_ranges_are_as_many_as_keys_at_most():
    """However many ranges of hashes there are, a block walks those that it has keys of."""
    rng = np.random.default_rng(1)
    for kind in (1, 2):
        keys = np.unique(rng.integers(0, 1 << (63 if kind == 1 else 56), 1000, dtype=np.int64).astype(np.uint64))
        for n in (1, 7, 1000, 1 << 31):
            found = list(ngram_lm.ranges(keys, kind, n))
            assert len(found) <= min(n, len(keys)) and [i for _, i, _ in found] == [0, *[k for _, _, k in found][:-1]] and found[-1][2] == len(keys)
            top = (keys >> np.uint64(32 if kind == 1 else 32 - ngram_lm.SPARE)).astype(object)
            assert all(int(x) * n >> 32 == j for j, i, k in found for x in top[i:k])
    assert list(ngram_lm.ranges(np.zeros(0, np.uint64), 1, 5)) == []
    # rows from each token fall as the corpus grows
    rows = lambda t: (t / 1e6) * (t / ngram_lm.tokens_of_bucket(t, 500_000)) / t
    assert ngram_lm.tokens_of_bucket(10**8, 500_000) == 500_000 and rows(10**10) < 8 * rows(10**9)


def brute_scores(rows, backoff, power):
    """The recursive definition, on words."""
    grams = Counter()
    texts = [(i, [*ascii_words(x), None], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, x in rows]
    order = 1 + len(backoff)
    for _, w, held in texts:
        if not held:
            line = ["\0start", *w]
            grams.update(tuple(line[i : i + m]) for m in range(1, order + 1) for i in range(len(line) - m + 1))
    single = {g[0]: c for g, c in grams.items() if len(g) == 1 and g != ("\0start",)}
    n, v = sum(single.values()), len(single)

    def p(context, word):
        if not context:
            return (single.get(word, 0) + 1) / (n + v + 1)
        c = grams[context]
        if not c:
            return p(context[1:], word)
        b = backoff[len(context) - 1] * c ** -power[len(context) - 1]
        return (1 - b) * grams[(*context, word)] / c + b * p(context[1:], word)

    out = Counter()
    for i, w, held in texts:
        line = ["\0start", *w]
        base = sum(math.log10(p((), b)) for b in w)
        score = sum(math.log10(p(tuple(line[max(0, j + 2 - order) : j + 1]), b)) for j, b in enumerate(w))
        out[i, held, len(w), sum(single.get(x, 0) > 0 for x in w), n, round(base, 6), round(score, 6)] += 1
    return out


@pytest.mark.parametrize(("block", "backoff", "power"), [(2_000_000, (0.95, 0.75), (0.06, 0.1)), (500, (0.95, 0.75), (0.06, 0.1)), (500, (0.9,), (0.2,)), (3000, (0.9, 0.8, 0.5), (0.1, 0.0, 0.3))])
def test_lm_scores(docs, rows, block, backoff, power):
    got = ngram_lm.score_texts(docs, backoff=backoff, power=power, block_tokens=block, bucket_tokens=2000).collect()
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert found == brute_scores(rows, backoff, power)


def test_lm_longer_contexts_help(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [ngram_lm.score_texts(docs, backoff=b, power=p).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first() for b, p in (((0.95,), (0.06,)), ((0.95, 0.75), (0.06, 0.1)))]
    assert held[1][0] > held[0][0] > held[0][1]


def test_lm_without_training_texts(spark):
    rows = [(i, "a b a") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    for r in ngram_lm.score_texts(make(spark, rows)).collect():
        assert (r.n_known, r.train_tokens, r.score) == (0, 0, 0.0)


def test_lm_scores_of_nothing(none):
    assert ngram_lm.score_texts(none).collect() == []


# fingerprints


def test_fingerprints(docs, rows):
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    known = [(i, x or "") for i, x in rows if i is not None]
    unique = {i for i, n in Counter(i for i, _ in known).items() if n == 1}
    order = sorted({x for x in known}, key=lambda x: -x[0])
    by_id = {}
    for r in got:
        assert len(r.fingerprint) == len(r.edited_fingerprint) == fingerprint.BINS * fingerprint.BITS // 4
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in unique:
            by_id[r.doc_id] = r
    errors = []
    for (i, x), (j, y) in zip(order, order[1:], strict=False):
        if i not in unique or j not in unique:
            continue
        cut = len(x) // 3
        edited = x[: len(x) - cut] + y[:cut]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (y, r.near_next)):
            a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (ascii_words(x), ascii_words(other)))
            errors.append(abs(len(a & b) / len(a | b) - near))
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.25
    by_text = defaultdict(set)
    for i, r in by_id.items():
        by_text[dict(known)[i]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_one_and_nothing(spark, none):
    (r,) = fingerprint.fingerprints(make(spark, [(1, "a b c d e f")])).collect()
    assert (r.edited_sha256, r.n_chars) == (hashlib.sha256(b"a b c d a b").hexdigest(), 11)
    assert fingerprint.fingerprints(none).collect() == []


def test_fingerprints_stay_in_the_engine(docs):
    plan = fingerprint.with_fingerprint(docs, "text", "fp")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_likeness_of_random_sets(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        x = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(400)]
        y = x[: 10 * i] + [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(400 - 10 * i)]
        a, b = ({tuple(w[k : k + 5]) for k in range(396)} for w in (x, y))
        rows.append((" ".join(x), " ".join(y), len(a & b) / len(a | b)))
    d = spark.createDataFrame(rows, "x string, y string, true double")
    d = fingerprint.with_fingerprint(fingerprint.with_fingerprint(d, "x", "p"), "y", "q").select("true", fingerprint.likeness(F.col("p"), F.col("q")).alias("near"))
    assert max(abs(r["true"] - r["near"]) for r in d.collect()) < 0.15
