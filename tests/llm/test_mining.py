"""Phrases, fingerprints and whitening against plain Python and numpy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.llm import phrases, simhash, whitening, workload
from tests.conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# phrases

def plain_counts(rows):
    """Occurrences of every run of one to four words, by language, and the words of each language."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i:i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    return counts, totals


def plain_collocations(rows, threshold, first):
    counts, totals = plain_counts(rows)
    f = {k: v for k, v in counts.items() if v >= threshold}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        if any(100 * b >= 80 * a for (other, v), b in f.items()
               if other == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(w), a, l, r, totals[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, seen = [], Counter()
    for x in out:
        seen[x[0]] += 1
        if seen[x[0]] <= first:
            ranked.append((x[0], seen[x[0]], *x[1:]))
    return ranked


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "é", "漢字", "a", "b", "c-d", "e"]
    langs = ["en", "de", None, "und", ""]
    rows = []
    for _ in range(n):
        w = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\x0b", "!", "\x1c"]) for _ in range(rng.randrange(12))]
        rows.append((rng.choice(langs), rng.choice([" ", "  ", "\t"]).join(w)))
    return rows + [("en", None), (None, None), ("en", ""), ("en", " \t\n.,"), ("xx", "x y z " * 3000), ("en", "New York city. " * 50), ("de", rows[0][1])] + rows[:40]


@pytest.mark.parametrize("threshold, first", [(5, 2000), (12, 4)])
def test_collocations(spark, threshold, first):
    rows = corpus(threshold, 40 * threshold + 100)
    df = spark.createDataFrame([(t, g, "x", "y") for g, t in rows], "text string, lang string, phrase string, h string")
    got = [tuple(r) for r in phrases.collocations(df, threshold=threshold, first=first).orderBy("lang", "rank").collect()]
    want = plain_collocations(rows, threshold, first)
    assert len(want) >= 5 and got == sorted(want, key=lambda x: (x[0].encode(), x[1]))


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12), st.integers(2, 9))
def test_summary_keeps_what_is_frequent(chunks, threshold):
    true = Counter(x for c in chunks for x in c)
    summary = phrases.Summary(sum(true.values()) // threshold + 1)
    for c in chunks:
        k, n = np.unique(np.array(c, np.uint64), return_counts=True)
        summary.merge(k, n.astype(np.int64))
        assert len(summary.keys) <= summary.capacity
    found = set(summary.frequent(threshold).tolist())
    assert summary.taken < threshold and {x for x, n in true.items() if n >= threshold} <= found
    for k, n in zip(summary.keys.tolist(), summary.counts.tolist()):
        assert n <= true[k] <= n + summary.taken


def test_survivors_of_many_summaries(spark, monkeypatch):
    """Every task sends several summaries, the merged ones are over their capacity, and no frequent run is lost."""
    rng = random.Random(3)
    words = [f"r{i}" for i in range(20_000)] + ["often", "common"] * 700
    rows = [("en", " ".join(rng.choice(words) for _ in range(200))) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    monkeypatch.setattr(phrases, "HELD", 20_000)
    monkeypatch.setattr(phrases, "CAPACITY", 4_000)
    monkeypatch.setattr(phrases, "BLOCK", 100)
    found = {r.h for r in phrases.survivors(phrases.summaries(df, "lang", "text", 4, 2), 30).collect()}
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    off = np.cumsum([0, *(len(t) for _, t in rows)])
    lang = next(phrases.runs_of(df.limit(1).toArrow().combine_chunks().to_batches()[0]))[2].langs[:1]
    runs = phrases.Runs(data, off, np.repeat(lang, len(rows)))
    true = Counter(h for n in range(1, 5) for h in runs.of(n)[0].view(np.int64).tolist())
    want = {h for h, n in true.items() if n >= 30}
    assert 3 < len(want) < 200 and want <= found and len(found) < len(true) / 20


# fingerprints

def plain_fingerprint(text):
    w = [x.decode() for x in (text or "").translate(LOWER).encode().split()]
    runs = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(fp)):
        for y in range(x):
            if (fp[x][1] ^ fp[y][1]).bit_count() <= radius:
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(fp):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, f"{f:016x}", least.get(find(x))) for x, (i, f) in enumerate(fp)), key=str)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=30), st.integers(0, 600))
def test_xxh64(strings, long):
    strings = [*strings, b"y" * long, bytes(range(256)) * 3]
    ends = np.cumsum([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    got = simhash.xxh64(data, ends - [len(s) for s in strings], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, seed=42) for s in strings]


def test_hash_is_that_of_spark(spark):
    data = np.frombuffer("one two é".encode(), np.uint8)
    want = spark.sql("SELECT xxhash64('one two é')").first()[0]
    assert int(simhash.xxh64(data, np.array([0]), np.array([len(data)])).view(np.int64)[0]) == want


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 400))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            near[rng.randrange(len(near))] = "other"
            rows.append("  ".join(near).upper())
    rows += [None, "", " \n", "one", "one two", "ONE\ttwo", "a b c " * 9000, "x" * 3000 + " y z q", "é ß 漢字 \x1c"]
    rng.shuffle(rows)
    return [(i * 3 % 211 if i % 17 else None, t) for i, t in enumerate(rows)] + [(3, "dup id"), (3, "dup id other text")]


def test_simhash(spark):
    rows = texts(1)
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], "doc_id long, text string, fp string, id string, pick int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == plain_components(rows)
    assert len({g[2] for g in got}) < len(rows) - 20
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [5, 2048])
def test_links_of_large_groups(spark, block):
    """One group that holds most rows: with small blocks it is compared in pairs of blocks."""
    rng = np.random.default_rng(block)
    base = int(rng.integers(0, 2**63))
    fp = {base}
    for _ in range(150):
        x = rng.choice(sorted(fp)) if rng.random() < 0.3 else base
        for b in rng.choice(26, rng.integers(1, 5), replace=False):
            x = int(x) ^ (1 << int(b))
        fp.add(int(x))
    fp |= {int(x) for x in rng.integers(-2**63, 2**63, 300)}
    rows = spark.createDataFrame([(x,) for x in fp], "fp long")
    got = simhash.links(rows, block).collect()
    u64 = lambda x: x % 2**64
    assert all((u64(r.a) ^ u64(r.b)).bit_count() <= 64 for r in got)
    assert split([(r.a, r.b) for r in got], fp) == split([(x, y) for x in fp for y in fp if x < y and (u64(x) ^ u64(y)).bit_count() <= 2], fp)
    assert len(got) < 40 * len(fp)


def split(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    parts = {}
    for x in nodes:
        parts.setdefault(find(x), []).append(x)
    return sorted(sorted(p) for p in parts.values())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 30), st.integers(0, 4), st.integers(0, 2**32))
def test_bit_planes_count_distances(n, groups, radius, seed):
    rng = np.random.default_rng(seed)
    group = np.sort(rng.integers(0, groups, n))
    fp = rng.integers(0, 1 << 6, n, dtype=np.uint64) << np.uint64(50)
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(fp, group, list(range(48, 58)), radius) for a, b in zip(x, y)}
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= radius}
    assert got == want


# whitening

def plain_whitening(vectors):
    x = np.floor(np.array(vectors, float) * 256)
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    values, own = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    return len(fit), fit.sum(axis=0).astype(int), x.astype(int), mean, values[::-1], own[:, ::-1]


def check_whitening(spark, vectors, extra=()):
    n, sums, x, mean, values, own = plain_whitening(vectors)
    rows = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(vectors)] + [(1000 + i, v, "y", 2) for i, v in enumerate(extra)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int")
    got = whitening.whiten(df).collect()
    k = min(4, int((values > 1e-20 * max(values[0], 1)).sum()))
    assert len(got) == k * len(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(1, k + 1):
        e = values[j - 1]
        want = (x - mean) @ own[:, j - 1] / math.sqrt(e)
        have = np.array([by[i, j].whitened for i in range(len(vectors))])
        if min(abs(e - o) for t, o in enumerate(values) if t != j - 1) > 1e-6 * e if len(values) > 1 else True:
            assert np.abs(have - np.sign(have @ want) * want).max() < 1e-7 * max(1, np.abs(want).max())
        assert abs(by[0, j].explained - e / values.sum()) < 1e-10
    for i in range(len(vectors)):
        assert by[i, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)) and by[i, 1].n == n
    assert got[0].identity_error < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))
    v[50:150] = v[50]
    check_whitening(spark, v, [None, [1.0] * 11 + [float("nan")], [float("-inf")] + [0.0] * 11, [None] + [0.0] * 11])


@pytest.mark.parametrize("case", ["few", "constant", "one", "close", "two"])
def test_whitening_of_odd_tables(spark, case):
    rng = np.random.default_rng(8)
    if case == "few":
        v = rng.standard_normal((3, 6))  # fewer distinct rows than dimensions
    elif case == "constant":
        v = np.hstack([rng.standard_normal((60, 3)), np.full((60, 5), 2.5)])
    elif case == "one":
        v = rng.standard_normal((40, 1))
    elif case == "close":
        v = np.vstack([np.eye(6), -np.eye(6)])  # all eigenvalues equal
        n = plain_whitening(v)[0]
        got = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()
        assert len(got) == 4 * n and got[0].identity_error < 1e-9 and abs(got[0].explained - 1 / 6) < 1e-12
        return
    else:
        v = np.array([[0.0, 1.0], [3.0, 5.0], [0.0, 1.0]])
    check_whitening(spark, v)


def test_whitening_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).collect() == [] and make([(1, None)]).collect() == [] and make([(1, [])]).collect() == []
    assert make([(1, [1.0, 2.0]), (None, [1.0, 2.0])]).collect() == []
    short = make([(1, [1.0]), (2, [1.0, 2.0]), (None, [3.0, 2.0]), (2, [1.0, 2.0])]).collect()  # filled with zeros
    assert {r.vec_id for r in short} == {1, 2, None} and short[0].n == 3 and len(short) == 8


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 2**32), st.sampled_from(["plain", "graded", "equal", "sparse"]))
def test_directions(d, seed, kind):
    rng = np.random.default_rng(seed)
    r = np.triu(rng.standard_normal((d, d)))
    if kind == "graded":
        r *= 10.0 ** -np.arange(d)[:, None]
    elif kind == "equal":
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    elif kind == "sparse":
        r[:, rng.integers(0, d, d // 2)] = 0
    values, vectors = whitening.directions(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-11, atol=1e-13 * want[0])
    assert np.allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-10)
    assert np.allclose(((r @ vectors.T) ** 2).sum(axis=0), values[:len(vectors)], rtol=1e-9, atol=1e-13 * want[0])
    assert len(vectors) == min(4, d) or want[len(vectors)] <= 1e-24 * want[0] * d * d + 1e-300


def test_small_values_are_accurate():
    """dqds keeps the relative accuracy of a graded bidiagonal matrix."""
    a, b = 10.0 ** -np.arange(0, 60, 6.0), 0.3 * 10.0 ** -np.arange(0, 54, 6.0)
    from decimal import Decimal, getcontext

    getcontext().prec = 120
    product = math.prod(Decimal(x) ** 2 for x in a)  # the determinant
    found = math.prod(Decimal(x) for x in whitening.dqds(a, b))
    assert abs(found / product - 1) < Decimal("1e-13")


def test_queries_read_whole_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in workload.op13_simhash(spark, DATA).collect()), key=str)
    assert got == plain_components(rows)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id")
    assert [r.vec_id for r in vectors.collect()] == list(range(vectors.count()))
    n, _, x, mean, values, own = plain_whitening([r.embedding for r in vectors.collect()])
    got = workload.op12_whitening(spark, DATA).where(F.col("component") == 1).orderBy("vec_id").collect()
    want = (x - mean) @ own[:, 0] / math.sqrt(values[0])
    have = np.array([r.whitened for r in got])
    assert got[0].n == n and np.abs(have - np.sign(have @ want) * want).max() < 1e-8
