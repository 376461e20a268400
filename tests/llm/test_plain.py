"""Toxicity models and benchmark leaks against plain Python; what the pipeline's stages leave."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from skyledger.llm import kernels, leaks, minhash, quality, toxicity
from tests.conftest import DATA
from tests.llm.test_operators import plain_components, plain_measures, prose, words


# toxicity

def byte_runs(text, n):
    raw = bytes([0xFE] * (n - 1)) + bytes(toxicity.BARE[np.frombuffer(text.encode(), np.uint8)]) + b"\xff"
    return [raw[i:i + n] for i in range(len(raw) - n + 1)]


class PlainModels:
    """Kneser-Ney by dictionaries: counts of the longest runs, then numbers of distinct runs with an ending."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        first = [defaultdict(int), defaultdict(int)]
        for label, text in texts:
            for run in byte_runs(text, order):
                first[label][run] += 1
        self.counts[order] = first
        for n in range(order - 1, 0, -1):
            self.counts[n] = [defaultdict(int), defaultdict(int)]
            for c in (0, 1):
                for run, count in self.counts[n + 1][c].items():
                    self.counts[n][c][run[1:]] += count > 0

    def probability(self, run, c):
        n = len(run)
        if n == 1:
            both = [self.counts[1][x] for x in (0, 1)]
            return (both[0][run] + both[1][run] + 0.5) / (sum(both[0].values()) + sum(both[1].values()) + 128)
        same = {r: k for r, k in self.counts[n][c].items() if r[:-1] == run[:-1]}
        total = sum(same.values())
        below = self.probability(run[1:], c)
        if not total:
            return below
        return max(same.get(run, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(same) / total * below

    def evidence(self, text):
        d = [math.log(self.probability(r, 1) / self.probability(r, 0)) for r in byte_runs(text, self.order)]
        best = [max(sum(d[max(0, i + 1 - size):i + 1]) / size for i in range(len(d))) for size in toxicity.WINDOWS]
        return [sum(d) / len(d), *best]


def test_evidence_against_plain_models():
    rng = random.Random(2)
    texts = [(i % 2, " ".join(rng.choice(["nice", "day", "Bad!", "awful", "über", "x"][2 * (i % 2):4 + 2 * (i % 2)]) for _ in range(rng.randrange(9)))) for i in range(24)]
    plain = PlainModels(texts, toxicity.ORDER)
    runs = sorted({r for n in plain.counts[toxicity.ORDER] for r in n})
    grams = np.array([int.from_bytes(r, "big") for r in runs], np.uint64)
    n = np.array([[plain.counts[toxicity.ORDER][c].get(r, 0) for r in runs] for c in (0, 1)], float)
    model = toxicity.Model(toxicity.ratios(grams, n, toxicity.ORDER)[1], np.zeros(5))
    for text in ["", "nice day", "awful awful bad", "unseen words Ω", "x" * 90, texts[3][1] + " and more"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = model.evidence(raw, np.array([0, len(raw)]))[0]
        assert np.allclose(got, plain.evidence(text), atol=1e-9), text


# leaks

def plain_leaks(docs, items):
    """Every text with every item under every shift at which a mask agrees; the best run by trying all."""
    out = set()
    for key, text in docs:
        w = words(text, True)
        for item, item_text in items:
            b = words(item_text, True)
            for shift in range(-len(b), len(w)):
                hit = any(
                    all(w[p + k] == b[p - shift + k] for k, c in enumerate(mask) if c == "1")
                    for mask in leaks.MASKS for p in range(max(shift, 0), min(shift + len(b), len(w)) - len(mask) + 1))
                if not hit:
                    continue
                places = range(max(shift, 0), min(shift + len(b), len(w)))
                gain = [1 if w[p] == b[p - shift] else -1 for p in places]
                runs = [(sum(gain[i:j]), -j, i) for i in range(len(gain)) for j in range(i + 1, len(gain) + 1)]
                best, end, begin = max(runs)
                least = min(leaks.SCORE, max(math.ceil(leaks.SHORT_SHARE * len(b)), 6))
                if best >= least:
                    out.add((key, item, shift, places[begin], places[-end - 1], best))
    return out


def test_leaks_against_plain(spark):
    rng = random.Random(7)
    few = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(few) for _ in range(n))
    items = [(i, text(rng.choice([5, 8, 12, 30]))) for i in range(8)] + [(8, None), (9, ""), (10, "w1 " * 14)]
    docs = [(i, text(40)) for i in range(12)]
    for i in range(12, 26):  # an item inside a text, some of its words replaced
        w = rng.choice(items[:8])[1].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "other"
        docs.append((i, " ".join([text(rng.randrange(9)), *w, text(rng.randrange(9))])))
    docs += [(26, None), (27, " "), (28, "w1 " * 20), (3, docs[13][1]), (None, docs[14][1])]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_leaks(docs, items)
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 15


# the pipeline

@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each that returns texts."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [[tuple(r) for r in table.collect()]]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = spark.createDataFrame(stage(spark, table, DATA).toPandas(), table.schema)
        out.append([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table.collect()])
    return out


def test_rules_keep_what_passes(stages):
    before, after = stages[0], stages[1]

    def passes(text):
        n_words, chars, symbols, dup, repeat = plain_measures(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        upper = sum("A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ" or "Α" <= c <= "Ω" or "А" <= c <= "Я" for c in text or "")
        return (n_words >= 20 and 100 * repeat <= 30 * n_words and 100 * symbols <= 20 * n_words and 100 * dup <= 50 * len(lines)
                and 2 * n_words <= chars <= 20 * n_words and 100 * upper <= 50 * chars)

    assert len(quality.RULES) == 6
    assert sorted(after) == sorted(r for r in before if passes(r[1]))


def test_one_text_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    root = plain_components([r[:2] for r in before])
    assert sorted(after) == sorted(r for r in before if root[r[0]] == r[0])
    assert minhash.PERCENT == 75


def test_passages_only_shorten_texts(stages):
    before = {r[0]: r for r in stages[2]}
    assert {r[0] for r in stages[3]} == set(before)
    for key, text, *rest in stages[3]:
        mine, old = words(text), iter(words(before[key][1]))
        assert tuple(rest) == before[key][2:] and all(w in old for w in mine)
    windows = defaultdict(set)  # no run of 60 words is left in two texts
    for key, text, *_ in stages[3]:
        w = words(text, True)
        for i in range(len(w) - 59):
            windows[tuple(w[i:i + 60])].add(key)
    assert not [k for k in windows.values() if len(k) > 1]


def test_leaking_rows_go(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = stages[3]
    gone = {r[0] for r in rows} - {r[0] for r in stages[4]}
    assert set(stages[4]) <= set(rows)
    small = [r[:2] for r in rows if r[0] in gone or len(words(r[1])) < 150][:40]
    assert {k for k, *_ in plain_leaks(small, items)} == gone & {k for k, _ in small}


def test_kernels_agree_on_words(stages):
    for _, text, *_ in stages[0][:50]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        line, lo, hi = kernels.Words(raw, np.array([0, len(raw)])).joined()
        assert [bytes(line[a:b]).decode() for a, b in zip(lo, hi)] == words(text, True)
