from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groupfit.llm import near_copies, quality, storage, substrings, wordbytes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def awkward(spark):
    """Nulls, an empty and a very long text, ties, repeated rows, and columns that clash with the operators' own."""
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é"]) + str(rng.randrange(400)) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long + " end"), (6, "a b c"), (6, "a b c"), (None, "x y z w v u t"), (7, "a  b c"), (8, "same text here for all of us now " * 9), (9, "same text here for all of us now " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("tk", "kept", "n_words", "counts", "posterior", "key", "size", "rows", "spans", "base", "found", "copies", "bands", "id", "chosen"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return rows, df


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b  #%日", max_size=60)), max_size=20), st.integers(1, 40))
def test_words(texts, size):
    found, hashes = [], {}
    for lo, hi, data, bounds in wordbytes.chunks(pa.array(texts, pa.string()), size):
        w = wordbytes.Words(data, bounds)
        for i in range(hi - lo):
            own = slice(w.first[i], w.first[i + 1])
            found.append([data[a:b].tobytes().decode() for a, b in zip(w.starts[own], w.ends[own], strict=True)])
            for x, h in zip(found[-1], w.hashes[own], strict=True):
                assert hashes.setdefault(x, h) == h
    assert found == [brute.words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_runs_and_minima():
    h = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 35):
        seen = {}
        runs = wordbytes.runs_hash(h, n)
        for i, x in enumerate(runs):
            assert seen.setdefault(tuple(h[i : i + n]), x) == x
        assert len(set(seen.values())) == len(seen)
        assert (wordbytes.sliding_min(h, n) == [h[i : i + n].min() for i in range(len(h) - n + 1)]).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc \n#|é.", max_size=80), min_size=1, max_size=12))
def test_counts(texts):
    parts = [quality.text_counts(d, b) for _, _, d, b in wordbytes.chunks(pa.array(texts), 50)]
    for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        assert np.concatenate([p[k] for p in parts]).tolist() == [brute.counts(t)[k] for t in texts]


def votes_by_hand(text):
    """The votes of the nine rules, in their order, from a text itself."""
    w, lines = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
    n, c = len(w), brute.counts(text)
    chars, symbols, dup, rep = c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]
    letters = sum(any(ch.isascii() and ch.isalpha() or ord(ch) > 127 for ch in x) for x in w)
    # by the last byte of a line's last word
    stopped = sum(brute.words(x)[-1][-1] in ".!?:;\"')" for x in lines)
    run = longest = 0
    for i, x in enumerate(w):
        run = run + 1 if i and w[i - 1] == x else 1
        longest = max(longest, run)
    if not n:
        return (-1, 0, 0, 0, 0, 0, 0, 0, 0)
    pick = lambda bad, good: -1 if bad else int(good)
    return (
        pick(n < 20, n >= 100), pick(chars < 2 * n or chars > 14 * n, 3 * n <= chars <= 9 * n), pick(10 * symbols > n, symbols == 0), pick(2 * symbols > n, 50 * symbols <= n),
        pick(dup >= 4 and 10 * dup > 3 * len(lines), len(lines) >= 3 and dup == 0), pick(10 * rep > 4 * n, 10 * rep <= n), pick(10 * letters < 7 * n, 20 * letters >= 19 * n),
        pick(len(lines) >= 4 and 10 * stopped < len(lines), 2 * stopped >= len(lines)), pick(longest >= 8, longest <= 2),
    )


def posterior_by_hand(votes, rounds=200):
    """EM in plain Python, a document at a time."""
    m = len(votes[0])
    prior, good, bad = 0.8, [{-1: 0.005, 1: 0.6} for _ in range(m)], [{-1: 0.3, 1: 0.5} for _ in range(m)]

    def probability(v):
        a, b = prior, 1 - prior
        for j, x in enumerate(v):
            if x:
                ratio = good[j][x] / bad[j][x]
                a *= min(ratio, 1.5) if x > 0 else ratio
        return a / (a + b)

    for _ in range(rounds):
        p = [probability(v) for v in votes]
        new_good, new_bad = [], []
        for j in range(m):
            sums = []
            for c, w in enumerate((p, [1 - x for x in p])):
                start = ((0.005, 0.395, 0.6), (0.3, 0.2, 0.5))[c]
                total = [sum(x for x, v in zip(w, votes, strict=True) if v[j] == k) + s for k, s in zip((-1, 0, 1), start, strict=True)]
                sums.append([x / sum(total) for x in total])
            sums[0][0] = min(sums[0][0], sums[1][0] / 3)
            sums = [[max(x, 1e-3) for x in y] for y in sums]
            sums = [[x / sum(y) for x in y] for y in sums]
            new_good.append({-1: sums[0][0], 1: sums[0][2]})
            new_bad.append({-1: sums[1][0], 1: sums[1][2]})
        prior = min(0.95, max(0.05, (sum(p) + 80) / (len(p) + 100)))
        good, bad = new_good, new_bad
    return [probability(v) for v in votes]


def test_quality_query(spark):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    docs = corpus(spark)
    want = posterior_by_hand([votes_by_hand(t) for _, t in docs])
    for (d, t), p in zip(docs, want, strict=True):
        c = brute.counts(t)
        assert all(got[d][k] == v for k, v in c.items())
        assert got[d].base_failed == (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"])
        assert abs(got[d].posterior - p) < 1e-6
        assert got[d].kept == (not got[d].base_failed and got[d].posterior >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q and d in got and not got[d].base_failed]
    assert sum(got[d].kept for d in good) >= 0.98 * len(good)


def test_abstentions_carry_no_weight():
    votes = np.array([[1, 0], [-1, 0], [0, -1], [0, 0]])
    m = quality.estimate(votes, np.array([80.0, 10.0, 5.0, 1000.0]))
    base, added = m.weights()
    assert base == np.log(m.prior / (1 - m.prior)) and all(len(a) == 2 and a[0] < 0 for a in added)


def test_em_finds_a_noisy_rule():
    rng = np.random.default_rng(4)
    bad = rng.random(20_000) < 0.2
    says = lambda right, speak: np.where(rng.random(len(bad)) < speak, np.where((rng.random(len(bad)) < right) == bad, -1, 1), 0)
    votes = np.stack([says(0.95, 0.9), says(0.9, 0.8), says(0.9, 0.9), says(0.6, 0.9)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = quality.estimate(patterns, n.astype(float), near=float("inf"))
    accuracy = [min(a) for a in m.accuracy()]
    assert accuracy[3] < min(accuracy[:3]) and abs(m.prior - 0.8) < 0.05
    base, added = m.weights()
    odds = base + sum(np.choose(votes[:, j] + 1, [added[j][0], 0.0, added[j][1]]) for j in range(4))
    assert ((odds < 0) == bad).mean() > 0.95
    assert quality.estimate(np.zeros((0, 3)), np.zeros(0)).prior > 0.5


def test_quality_awkward(spark):
    rows, df = awkward(spark)
    out = quality.filter_documents(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {4, 5, 8, 9}
    assert quality.filter_documents(df.limit(0)).count() == 0


def test_substrings_query(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.query(spark, SF).collect()}
    docs = corpus(spark)
    for (d, _), (n, gone, kept) in zip(docs, brute.kept_words([t for _, t in docs], 35), strict=True):
        assert got[d] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("window,run", [(35, 6), (6, 2), (3, 3)])
def test_substrings_small(spark, monkeypatch, window, run):
    monkeypatch.setattr(substrings, "FLUSH", 300)
    rng = random.Random(window)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.choice([0, 2, 5, 34, 36, 90]))) for _ in range(120)] + [None, "", "z " * 400, "q " * 40, "q " * 40, "b\n\na  b"]
    df = spark.createDataFrame([(i % 100 if i % 9 else None, t, "own", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, k1 int").repartition(3)
    got = sorted((str(r.row.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, window=window, run=run).collect())
    rows = df.collect()
    want = sorted((str(r.doc_id), *k) for r, k in zip(rows, brute.kept_words([r.text for r in rows], window), strict=True))
    assert got == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "runs_hash", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    h = np.array([1, 2, 3, 1, 2, 9, 9, 9], np.uint64)
    at = np.arange(7)
    assert substrings.repeats(h, at, np.ones(7, np.int64), 2).tolist() == [True, False, False, True, False, True, True]


def test_sequences_with_equal_keys_are_told_apart():
    h = np.array([1, 2, 1, 2, 1, 3, 9, 1, 3], np.uint64)
    first, words = np.array([0, 2, 4, 7, 5]), np.array([2, 2, 2, 2, 3])
    one, back, number = substrings.alike(h, first, words, np.zeros(5, np.uint64))
    assert sorted(number) == [1, 2, 2] and back[0] == back[1] and back[2] == back[3]
    assert (back[one] == np.arange(3)).all()


def test_many_repeated_rows(spark, monkeypatch):
    """Spans of repeated rows don't multiply: one set of them for all rows."""
    monkeypatch.setattr(substrings, "FLUSH", 20_000)
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    keyed = df.limit(3000).select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), "text")
    spans = substrings.repeated_spans(keyed).select("a", "b").distinct().collect()
    assert {k for s in spans for k in range(s.a, s.b)} == set(range(100)) and len(spans) <= 100
    out = substrings.remove_repeats(df).groupBy("n_words", "n_removed", "kept").count().collect()
    assert [tuple(r) for r in out] == [(100, 100, "", 10_000)]


def test_frequent_runs_come_last(spark):
    texts = [f"w{i} the very same words in all of them w{i} x{i} y{i} z{i}" for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    frequent, total = substrings.frequent_runs(df, 4, 100)
    assert total == sum(len(brute.words(t)) - 3 for t in texts)
    assert 0 < len(frequent) <= 200
    order = substrings.Order(frequent)
    assert (order(frequent) >= 1 << 63).all() and (order(frequent + np.uint64(1)) < 1 << 63).all()


def test_near_copies_query(spark):
    docs = corpus(spark)
    got = {r.doc_id: r.class_id for r in near_copies.query(spark, SF).collect()}
    assert [got[d] for d, _ in docs] == brute.classes(docs)


def test_near_copies_of_one_family(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(450):
        own = list(base)
        own[rng.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(own)))
    common = " ".join(f"c{k}" for k in range(60))
    rows += [(1000 + i, common + " " + " ".join(f"u{i}x{k}" for k in range(60))) for i in range(260)]
    twin = dict(rows)[1007].split()
    rows.append((2000, " ".join([*twin[:-1], "other"])))
    got = {r.id: r.class_id for r in near_copies.with_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(450)} == {0} and got[2000] == 1007
    assert all(got[1000 + i] == 1000 + i for i in range(260))


def test_links_across_shares_of_a_crowded_leader(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SHARE", 5)
    rng = random.Random(11)
    common = [f"c{k}" for k in range(170)]
    rows = [(i, " ".join(common + [f"u{i}x{k}" for k in range(60)])) for i in range(60)]
    rows += [(100 + i, " ".join([*rows[i][1].split()[:-1], f"z{i}"])) for i in range(0, 60, 3)]
    got = {r.id: r.class_id for r in near_copies.with_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == brute.classes(rows)


def test_near_copies_among_crowded_strangers(spark, monkeypatch):
    """With one band that all texts agree on, every pair shares a band and one leader has all followers: all similar pairs must be found."""
    monkeypatch.setattr(near_copies, "SHARE", 4)
    monkeypatch.setattr(near_copies, "bands_of", lambda *_: F.array(F.lit(1).cast("long")))
    rows = [(i, " ".join([f"c{k}" for k in range(170)] + [f"u{i}x{k}" for k in range(60)])) for i in range(30)]
    rows += [(100 + i, " ".join([*rows[i][1].split()[:-1], f"z{i}"])) for i in range(0, 30, 2)]
    got = {r.id: r.class_id for r in near_copies.with_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.classes(rows)
    assert len(set(want)) == 30
    assert [got[d] for d, _ in rows] == want


def test_buckets_of_the_same_texts_are_joined_once(spark, monkeypatch):
    """No pair is lost, neither where buckets hold other texts by one nor where some hold one class alone."""
    rng = random.Random(8)
    rows = []
    for i in range(40):
        bands = [*range(30), *(100 + k for k in range(5) if i != 7 * k), *rng.sample(range(200, 240), 8), 300 + i // 2, 400 + i // 2, 500 + i]
        rows.append((bytes([i * 37 % 256]), bytes([rng.randrange(20) if i < 20 else 50]), bands))
    held = {}
    for tk, top, bands in rows:
        for m in bands:
            held.setdefault(m, []).append((tk, top))
    parted = {m: x for m, x in held.items() if len({top for _, top in x}) > 1}
    want = {(tk, min(x)[0]) for x in parted.values() for tk, _ in x if tk != min(x)[0]}
    rowed = []
    by_key = near_copies.by_key
    monkeypatch.setattr(near_copies, "by_key", lambda a, b, key, total: rowed.append(total) or by_key(a, b, key, total))
    of = spark.createDataFrame(rows, "tk binary, top binary, bands array<bigint>")
    for crowded, each in ((False, list(parted.values())), (True, {tuple(sorted(x)) for x in parted.values()})):
        got = near_copies.pairs_of(of, crowded).collect()
        assert len(got) == len(want) and {(bytes(r.tk), bytes(r.leader)) for r in got} == want
        assert rowed.pop() == sum(map(len, each))


def test_near_copies_awkward(spark):
    rows, df = awkward(spark)
    got = sorted((str(r.id), str(r.class_id)) for r in near_copies.with_classes(df).collect())
    assert got == sorted((str(d), str(c)) for (d, _), c in zip(rows, brute.classes(rows), strict=True))
    one = near_copies.keep_one(df)
    assert one.columns == df.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted({str(c) for c in brute.classes(rows)})
    assert near_copies.keep_one(df.limit(0)).count() == 0


def text_of(w):
    return next(near_copies.texts_of(pa.array([" ".join(w)])))


def test_order_matters():
    a = [f"w{i}" for i in range(200)]
    assert text_of(a).similar(text_of(a))
    assert not text_of(a).similar(text_of(a[100:] + a[:100]))
    assert text_of(a).similar(text_of([*a[:160], *"x" * 40]))
    assert not text_of(a).similar(text_of([*a[:159], *"x" * 41]))
    assert not text_of([]).similar(text_of([]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=30), st.integers(0, 30))
def test_alignment(x, y, most):
    want = brute.distance(x, y)
    assert near_copies.edits(x, y, most) == (want if want <= most else None)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 4)), max_size=12))
def test_alignment_of_copies(x, changes):
    y = list(x)
    for at, to in changes:
        y[at : at + 1] = [] if to == 4 else [to]
    assert text_of([f"w{v}" for v in x]).similar(text_of([f"w{v}" for v in y])) == brute.similar(x, y)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=25), st.lists(st.tuples(st.integers(0, 25), st.integers(0, 4)), max_size=5))
def test_similar_texts_have_pairs_in_common(x, changes):
    """The bound that the second join rests on."""
    y = list(x)
    for at, to in changes:
        y[at : at + 1] = [] if to == 4 else [to]
    if brute.similar(x, y) and x != y:
        pairs = [Counter(zip(v, v[1:], strict=False)) for v in (x, y)]
        common = (pairs[0] & pairs[1]).total()
        assert common >= near_copies.in_common(len(x)) and common >= near_copies.in_common(len(y))


def test_near_copies_are_found(spark):
    """Recall: copies with a tenth of their words replaced, and short ones with one word replaced."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.choice([12, 20, 40, 80, 200, 600])
        own = [f"w{rng.randrange(5000)}" for _ in range(n)]
        rows.append((2 * i, " ".join(own)))
        for at in rng.sample(range(n), max(1, n // 10)):
            own[at] = "other"
        rows.append((2 * i + 1, " ".join(own)))
    got = {r.id: r.class_id for r in near_copies.with_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i for i in range(300))
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) >= 270


def test_hot_keys(spark, monkeypatch):
    """Many copies of one text, a large class, and repeated rows: the same classes when nearly every key counts as hot."""
    monkeypatch.setattr(storage, "HOT", 10**9)
    monkeypatch.setattr(near_copies, "MEETINGS", 2)
    monkeypatch.setattr(near_copies, "SHARE", 50)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base)) for i in range(1500)] + [(2000 + i, " ".join([*base[:90], f"x{i}", *base[91:]])) for i in range(1200)] + [(7000, "a b c d e f g")] * 1100
    got = {(r.id, r.class_id) for r in near_copies.with_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i, _ in rows if i < 7000} | {(7000, 7000)}


def test_kept_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, None)]
    assert near_copies.with_classes(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3
    kept = [x.name for x in tmp_path.rglob("*") if x.is_dir()]
    assert kept and not any(x.startswith(("meetings", "met-")) for x in kept)
    storage.clear(spark)
    assert list(tmp_path.iterdir()) == []


def test_small_tables_have_few_files(spark, tmp_path, monkeypatch):
    """With many partitions, tables of a few keys are still one file each, and no row is lost."""
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    base = [f"w{k}" for k in range(60)]
    rows = [(10 * f + i, " ".join(f"f{f}{w}" if k != i + 30 else f"x{i}" for k, w in enumerate(base))) for f in range(12) for i in range(5)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.id: r.class_id for r in near_copies.with_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 10 * 10 for i, _ in rows}
    files = {x.name.rsplit("-", 1)[0]: len(list(x.glob("part-*"))) for x in tmp_path.glob("groupfit-*/*")}
    assert {k: n for k, n in files.items() if k in ("pairs", "shares", "links", "tops", "ids", "labels")} == dict.fromkeys(("pairs", "shares", "links", "tops", "ids", "labels"), 1)
    storage.clear(spark)
