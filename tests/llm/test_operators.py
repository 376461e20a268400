"""The text operators against plain Python, exact round trips and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import chat, components, ctw, idfile, kernels, leaks, minhash, packing, pages, passages, phrases, quality, tokens, toxicity, workload
from skyledger.llm.tokens import Encoder, tokenizer_path
from tests.conftest import DATA

CLASH = "doc_id long, text string, lang string, ledger string, n_words string, k string, id string, spans string, kept_id string, leaking string, h string, w string"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[60] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, "ONE  two"),
            (9, prose(rng, 40) + " " + passage + " " + prose(rng, 50)), (10, prose(rng, 80) + "\n" + passage.upper() + "\n" + prose(rng, 30)),
            (11, prose(rng, 20_000)), (12, "same line\n" * 30), (13, "a b c d e f g h " * 40), (14, prose(rng, 25)), (14, prose(rng, 25)),
            (15, prose(rng, 30)), (15, prose(rng, 30)), (None, prose(rng, 30)), (16, "é ß 漢字 \x1c x\ty  \n z"), (17, base + " tail")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, *(["x"] * 10)) for i, t in texts], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def words(text, lower=False):
    raw = (text or "").encode()
    return [w.decode() for w in (raw.lower() if lower else raw).split()]


# rules

def plain_measures(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_ledger(docs, texts, empty):
    got = quality.ledger(docs, "out").select("doc_id", "text", "out.*").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text)
        assert bool(r.failed_bits & 1) == (r.n_words < 20) and bool(r.failed_bits & 2) == (100 * r.n_repeat_words > 30 * r.n_words)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(empty).count() == 0


def test_texts_are_measured_once(spark):
    """Neither the ledger nor a filter on its bits repeats the measurements in the plan."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    for df in (quality.ledger(table), quality.keep_good(table)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[^#*$%&|<>]+") == 1
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_ledger_beside_a_column_of_that_name(docs):
    got = quality.ledger(docs)
    assert got.columns == [*docs.columns, "ledger_"] and got.where("ledger <> 'x'").count() == 0


def test_ablation(docs):
    bits = quality.ledger(docs, "out").select("out.failed_bits")
    all_bits = [r[0] for r in bits.collect()]
    for r in quality.ablation(bits).collect():
        mask = quality.mask(quality.POLICIES[r.policy])
        assert r.n_docs == len(all_bits) and r.kept == sum(b & mask == 0 for b in all_bits)
        assert r.kept_without_rule == sum(b & mask & ~quality.bit(r.rule) == 0 for b in all_bits)


# token ids

@pytest.fixture(scope="module")
def coded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in texts]


def test_encoder(texts, coded):
    odd = ["x <|endoftext|>y", "a<|endoftext|", "", " ", "\n", "a\n\n b", "a \n\n\n  b  ", "don't  stop", "!\x1c!", "x  y", "tab\t\tend ", "<|endoftext|> a", None]
    encoder = Encoder(tokenizer_path())
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode([t for _, t in texts] + odd)]
    assert got[:len(texts)] == [ids for _, ids in coded]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    assert [g[:-1] for g in got[len(texts):]] == [plain.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert 50256 in got[len(texts) + odd.index("<|endoftext|> a")]


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bit_fields(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 777).astype(np.uint32)
    payload = idfile.pack_ids(ids, bits)
    assert len(payload) == -(-777 // 32) * bits * 4
    for a, n in ((0, 777), (31, 1), (32, 64), (500, 277), (3, 0)):
        assert idfile.unpack_ids(payload, bits, a, n).tolist() == ids[a:a + n].tolist()


def test_id_file(spark, docs, coded, empty):
    path = idfile.write_ids(docs, tokenizer_path(), 50_257)
    got = sorted(idfile.read_texts(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(x)) for i, x in coded)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert idfile.read_text(spark, path, 11).tolist() == dict(coded)[11]
    assert idfile.read_texts(spark, idfile.write_ids(empty, tokenizer_path(), 50_257)).count() == 0


# chats

def test_chats(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\|im_start|>", "<|im_", "a\n<|im_end|>\n", "", None, "\\", "<|im_start|>"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "a\\n", "<|im_end|>", None]), rng.choice(hard) if rng.random() < 0.7 else "plain text")
            for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(90, t, "assistant", f"turn {t}") for t in range(3000)] + [(None, None, "assistant", "x"), (91, 0, "user", "b"), (91, 0, "user", "a"), (91, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("c", F.lit(1))
    done = chat.parse_chats(chat.format_chats(table))
    done = done.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("mask"))).collect()
    want = defaultdict(list)
    for c, t, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda x: (x[1] or 0, x[2], x[3])):
        want[c].append((r, x))
    assert len(done) == len(want)
    for r in done:
        assert r.identical and [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert len(re.findall(r"<\|im_(?:start|end)\|>", r.formatted)) == 2 * len(want[r.conv_id])
        assert sum(m.length for m in r.mask) == len(r.formatted)
    assert chat.format_chats(table.limit(0)).count() == 0


# toxicity

def test_toxicity(spark, empty):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = prose(rng, rng.randint(20, 200)).split()
        for _ in range(4 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["zounds", "blackguard"]) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "x" * 200_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    fitted = toxicity.fit(table, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(table, fitted).collect()}
    held = [(got[i], y) for i, y in marks if i % 3 == 1]
    assert sum(s >= 0.7 for s, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert not any(s >= 0.7 for s, y in held if not y)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 603
    assert toxicity.score(empty, fitted).count() == 0
    none = toxicity.fit(table, labels.where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.score(table, none).collect()} == {0.0}


def test_ratio_model_sums_to_one():
    grams = np.unique(np.random.default_rng(1).integers(97, 101, (4000, 3)), axis=0, return_counts=True)
    packed = (grams[0][:, 0] << 16 | grams[0][:, 1] << 8 | grams[0][:, 2]).astype(np.uint64)
    p, _ = toxicity.ratios(packed, np.stack([grams[1], grams[1][::-1]]).astype(float), 3)
    for c in (0, 1):
        total = np.bincount((packed >> np.uint64(8)).astype(int), p[c])
        assert (total[total > 0] <= 1.0001).all() and total[total > 0].min() > 0.95  # the rest is left to unseen bytes


# leaks

def test_leaks(spark, empty):
    rng = random.Random(4)
    items = [(i, prose(rng, 40)) for i in range(20)] + [(50, None), (51, ""), (52, "too short"), (53, prose(rng, 12))]
    rows, want = [], set()
    for i in range(60):
        text = prose(rng, 100)
        if i % 3 == 0:
            k = rng.randrange(20)
            w = items[k][1].split()
            for j in range(3, 40, 8):
                w[j] = "subst"
            text = prose(rng, 30) + "\n" + " ".join(w).upper() + " " + prose(rng, 30)
            want.add((i, k))
        rows.append((i, text))
    rows += [(70, items[23][1]), (71, None), (72, ""), (73, prose(rng, 5000))]
    want.add((70, 53))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("h", F.lit(1)).withColumn("leaking", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaks(table, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = leaks.without_leaks(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert leaks.leaks(table, bench.limit(0)).count() == 0 and leaks.leaks(empty, bench).count() == 0


# packing

@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    top = rng.choice([1024, 500, 150])
    sizes = Counter(rng.randint(1, top) for _ in range(rng.choice([1, 7, 200, 3000])))
    stock = packing.Stock(sizes)
    fixed = packing.dominating(stock, 1024)
    patterns = packing.plan(sizes)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 1024 and n > 0
        for s in p:
            used[s] += n
    assert used == sizes and patterns[:len(fixed)] == fixed
    total = sum(s * n for s, n in sizes.items())
    assert sum(n for _, n in patterns) <= math.ceil(11 / 9 * total / 1024) + sum(n for s, n in sizes.items() if s > 512) // 2 + 1


def best(sizes, capacity):
    """Fewest sequences by trying all."""
    sizes = sorted(sizes, reverse=True)
    least = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(sizes):
            least[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, rooms[:k] + (rooms[k] - sizes[i],) + rooms[k + 1:])
        go(i + 1, rooms + (capacity - sizes[i],))

    go(0, ())
    return least[0]


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(2, 20) for _ in range(9)]
    stock = packing.Stock(Counter(sizes))
    fixed = packing.dominating(stock, 20)
    left = [s for s, n in stock.count.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + best(left, 20) == best(sizes, 20)


def test_pack(docs, coded, empty):
    rows = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    by_text = Counter()
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 64 and (r.piece == 0 or r.length == 64)
        parts[r.sequence_id].append((r.offset, r.length))
        by_text[r.doc_id] += r.length
    for p in parts.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 64
    want = Counter()
    for i, ids in coded:
        want[i] += len(ids)
    assert by_text == want
    assert len(parts) <= math.ceil(sum(want.values()) / 64) + 3
    assert packing.pack(empty, tokenizer_path()).count() == 0


# language model

def plain_ctw(train, depth):
    """Context-tree weighting by recursion over dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(text):
        raw = bytes([0xFE] * depth) + text.encode().lower() + b"\xff"
        for i in range(depth, len(raw)):
            for j in range(8):
                yield raw[i - depth:i], 1 << j | raw[i] >> (8 - j), raw[i] >> (7 - j) & 1

    for t in train:
        for context, node, bit in decisions(t):
            for d in range(depth + 1):
                key = (context[depth - d:], node)
                counts[key][bit] += 1
                if d:
                    children[context[depth - d + 1:], node].add(key)
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(counts[key])
            below = sum(map(weighted, children[key])) if len(key[0]) < depth else None
            memo[key] = own if below is None else np.logaddexp(own, below) - math.log(2)
        return memo[key]

    def one(context, node, d=0):
        key = (context[depth - d:], node)
        n = counts[key]
        p = (n[1] + 0.5) / (sum(n) + 1)
        deeper = (context[depth - d - 1:], node)
        if d == depth or deeper not in counts:
            return p
        own, below = kt(n), sum(map(weighted, children[key]))
        w = math.exp(own - np.logaddexp(own, below))
        return w * p + (1 - w) * one(context, node, d + 1)

    def score(text):
        total = 0.0
        for context, node, bit in decisions(text):
            p = one(context, node) if (b"", node) in counts else 0.5
            total += math.log10(p if bit else 1 - p)
        return total

    return score


@pytest.mark.parametrize("lookup_rows", [10**6, 0])
def test_scores(spark, lookup_rows):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "Bca", "é", "c"]) for _ in range(rng.randint(0, 30)))) for i in range(20)]
    rows += [(30, None), (31, "xyz unseen \x00"), (3, rows[3][1]), (None, "ab ab")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 3 != 0
    got = ctw.scores(table, train, depth=3, lookup_rows=lookup_rows).collect()
    learn = [t or "" for i, t in rows if i is not None and i % 3]
    plain = plain_ctw(learn, 3)
    count = Counter(w for t in learn for w in [*words(t, True), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        tokens = [*words(t, True), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[i, len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 4), round(plain(t or ""), 2)] += 1
    have = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in got)
    assert len(got) == len(rows)
    near = lambda a, b: a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-3 and abs(a[5] - b[5]) < 0.02
    for a in have.elements():
        assert any(near(a, b) for b in want)
    assert ctw.scores(table.limit(0), train, depth=3).count() == 0


def test_scores_do_not_depend_on_files(spark):
    """Small files and read splits, and a join instead of a table in memory, give the same numbers."""
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 120))) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 4 != 0
    want = {r.doc_id: r for r in ctw.scores(table, train).collect()}
    conf = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0", "spark.sql.shuffle.partitions": "3"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    old = {k: spark.conf.get(k) for k in conf}
    hadoop.set("parquet.block.size", "8192")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for lookup_rows in (10**7, 0):
            for r in ctw.scores(table, train, lookup_rows=lookup_rows).collect():
                for c in ("score", "base_score", "bits_per_byte"):
                    assert math.isclose(r[c], want[r.doc_id][c], rel_tol=1e-9), (r, want[r.doc_id])
                assert (r.n_tokens, r.n_known) == (want[r.doc_id].n_tokens, want[r.doc_id].n_known)
    finally:
        hadoop.unset("parquet.block.size")
        for k, v in old.items():
            spark.conf.set(k, v)


# near duplicates and passages

def shingle_set(text):
    w = words(text, True)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    sets = defaultdict(set)
    for i, t in rows:
        sets[i].add(shingle_set(t))
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs, texts, empty):
    got = minhash.near_duplicates(docs).collect()
    want = plain_components([(i, t) for i, t in texts if i is not None])
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingle_set(t))) for i, t in texts)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and minhash.near_duplicates(empty).count() == 0


def test_chains_of_near_duplicates(spark):
    """Copies that drift: neighbours are near, the ends are not, and many share a key."""
    rng = random.Random(8)
    w = prose(rng, 100).split()
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(100)] = rng.choice(WORDS)
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_pigeonhole():
    """Signatures within the distance always share a key."""
    rng = np.random.default_rng(0)
    size, errors = minhash.SYMBOLS // minhash.CHUNKS, minhash.DISTANCE // minhash.CHUNKS
    for _ in range(200):
        wrong = np.zeros(minhash.SYMBOLS, bool)
        wrong[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] = True
        assert wrong.reshape(minhash.CHUNKS, size).sum(axis=1).min() <= errors


def test_parity_sketches():
    """A sketch never rules out a link, and rules out most pairs well below the similarity, at any width."""
    rng = np.random.default_rng(4)
    sets = [np.zeros(0, np.uint64)]
    for n in (1, 3, 17, 60, 300, 4000, 50_000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets.append(base)
        for keep in (0.99, 0.93, 0.9, 0.86, 0.857, 0.8, 0.7):  # members in common; 0.857 gives a similarity of 0.75
            same = base[:math.ceil(n * keep)]
            sets += [np.unique(np.concatenate([same, rng.integers(0, 2**63, n - len(same), dtype=np.uint64)])), np.unique(same)]
    size = np.array([len(s) for s in sets])
    bits = minhash.parities(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    assert max(map(len, bits)) <= minhash.WIDEST and bits[0] == b""
    x, y = np.triu_indices(len(sets), 1)
    x, y = x[x > 0], y[x > 0]
    ok = minhash.possible(pa.array(bits, pa.binary()), size, x, y)
    links = out = 0
    for i, j, kept in zip(x, y, ok):
        both = len(np.intersect1d(sets[i], sets[j]))
        union = size[i] + size[j] - both
        if 100 * both >= 75 * union:
            links += 1
            assert kept
        elif 100 * both < 68 * union and 60 <= size[i] <= 4000:
            out += 1
            assert not kept
    assert links > 50 and out > 500


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(docs, empty, texts):
    got = {(r.doc_id, r.source_id) for r in passages.repeated_passages(docs).collect()}
    assert (10, 9) in got and {d for d, _ in got} == {1, 2, 10, 17}
    spans = [(r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect() if r.doc_id == 10]
    assert spans == [(80, 139)]
    cut = passages.without_passages(docs)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    text = {r.doc_id: r.text for r in cut.collect()}
    plain = dict(texts)
    assert words(text[10]) == words(plain[10])[:80] + words(plain[10])[140:]
    assert all(text[i] == plain[i] for i in plain if i not in (1, 2, 10, 14, 15, 17))
    assert passages.repeated_passages(empty).count() == 0


def test_fuzzy_passage(spark):
    rng = random.Random(6)
    p = prose(rng, 120).split()
    q = list(p)
    for j in range(20, 120, 25):
        q[j] = "typo"
    del q[50]
    q.insert(90, "extra")
    rows = [(1, prose(rng, 200) + " " + " ".join(p)), (2, " ".join(q) + " " + prose(rng, 200)), (3, prose(rng, 300))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(2, 1)}
    assert min(r.start_word for r in got) <= 5 and max(r.end_word for r in got) >= 110


def all_chains(p, q):
    """Scores of a quadratic search; ``p`` ascends."""
    score = [float(passages.K)] * len(p)
    for i in range(len(p)):
        for j in range(i):
            dp, dq = p[i] - p[j], q[i] - q[j]
            if 0 < dp <= passages.MAX_GAP and 0 < dq <= passages.MAX_GAP:
                new = min(passages.K, dp, dq) - passages.GAP_COST * max(0, min(dp, dq) - passages.K) - passages.SHIFT_COST * abs(dp - dq)
                score[i] = max(score[i], score[j] + new)
    return score


def test_counts_of_one_task_are_added(spark, monkeypatch):
    """Keys that a task meets in several slices are sent on once, with all their training occurrences."""
    rows = [(i, "ab abc ab") for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sent = []
    monkeypatch.setattr(ctw, "CHUNK", 4)  # a text a slice
    monkeypatch.setattr(ctw, "keep", lambda df, name: sent.append(df) or df)
    runs, words = ctw.counted(table, F.col("doc_id") > 0, "doc_id", "text", 3)
    assert sorted(r.n for r in words.collect()) == [3, 3, 6] and sum(r.n for r in runs.collect()) == 30
    keys, counts = ctw.summed_counts([np.array([5, 7], np.uint64), np.array([5], np.uint64)], [np.array([1, 2]), np.array([4])])
    assert (keys.tolist(), counts.tolist()) == ([5, 7], [5, 2])


def test_words_go_straight_to_the_model():
    """Parts of letters get the ids of the whole call without it."""
    encoder = Encoder(tokenizer_path())
    rng = random.Random(3)
    parts = {rng.choice(["", " "]) + "".join(rng.choice("abcdefXYZéßçñЖяλ") for _ in range(rng.randint(1, 14))) for _ in range(500)}
    assert all(map(encoder.is_word, parts)) and not any(map(encoder.is_word, [" ", "  a", "a1", "\na", "漢", "a.", "e\u0301"]))
    want = dict(zip(parts, encoder.whole(list(parts))))
    encoder.whole = None
    encoder.learn(list(parts))
    assert encoder.parts == want


def test_first_parts_outlast_a_full_table(monkeypatch):
    """A full table of parts keeps those met first, which are learned once; the ids stay those of the whole call."""
    monkeypatch.setattr(tokens, "MOST", 40)
    encoder, learned = Encoder(tokenizer_path()), Counter()
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: learned.update(new) or learn(new))
    often = " the of and \n\nalso, " + "Straße кот 12. "
    texts = [often + " ".join(f"q{chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(k, k + 30)) for k in range(0, 300, 30)]
    encoder.encode([often])
    got = [x for t in texts for x in encoder.encode([t, None])]
    assert got[::2] == [x + encoder.end for x in encoder.whole(texts)] and set(got[1::2]) == {encoder.end}
    assert len(encoder.parts) < 40 + 60 and all(learned[p] == 1 for p in (" the", " of", " and", " Straße"))


def test_pages_are_small_in_the_shuffle():
    html = ["<p>" + "the same words again " * 200, ""]
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["u", None]), pa.array(html), pa.array(["", ""]), pa.array(["", ""])], names=list("kuhsp"))
    got = pa.Table.from_batches(pages.deflated([batch])).to_pydict()
    assert [zlib.decompress(x).decode() for x in got["h"]] == html and len(got["h"][0]) < len(html[0]) // 10 and got["k"] == [1, 2]


def test_blocks_of_differences():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    at = np.array([0, 128, 256, 300, 301, 1000])
    raw = phrases.differenced(keys, at)
    assert (phrases.summed_up(raw, at) == keys).all()
    assert len(zlib.compress(raw, 1)) < 0.95 * len(zlib.compress(keys.tobytes(), 1))


@pytest.mark.parametrize("seed", range(6))
def test_chain_against_all_chains(seed):
    """The Fenwick tree finds the chain scores of a quadratic search."""
    rng = random.Random(seed)
    for _ in range(60):
        n, wide = rng.randint(2, 80), rng.choice([40, 300, 1500])
        p, q = [], []
        while len(p) < n:  # runs on one diagonal with small shifts, and single matches
            a, b = rng.randrange(wide), rng.randrange(wide)
            for _ in range(rng.choice([1, 3, 20])):
                p.append(a)
                q.append(b)
                step = rng.randint(1, 20)
                a, b = a + step, b + max(0, step + rng.choice([0, 0, 0, 1, -2]))
        order = sorted(range(len(p)), key=lambda i: (p[i], -q[i]))
        p, q = [p[i] for i in order], [q[i] for i in order]
        score, prev = passages.best_chains(p, q)
        assert np.allclose(score, all_chains(p, q))
        for i, j in enumerate(prev):
            assert j < 0 or math.isclose(score[i], score[j] + passages.gain(p[i] - p[j], q[i] - q[j]))
        spans = passages.chains(np.array(p), np.array(q))
        assert all(a <= b and c <= d for a, b, c, d in spans) and {(a, c) for a, _, c, _ in spans} <= set(zip(p, q))


def test_two_passages_of_one_source(spark):
    rng = random.Random(4)
    one, two = prose(rng, 200), prose(rng, 120)
    rows = [(1, " ".join([prose(rng, 30), one, prose(rng, 100), two])), (2, " ".join([prose(rng, 30), one, prose(rng, 300), two, prose(rng, 20)]))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.source_id, r.source_start) for r in got) == [(2, 30, 229, 1, 30), (2, 530, 649, 1, 330)]
    rest = {r.doc_id: r.text for r in passages.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert rest[1] == rows[0][1] and one not in rest[2] and two not in rest[2] and len(rest[2].split()) == 350


@pytest.mark.parametrize("copies", [1, 40])
def test_passage_whose_parts_stand_in_smaller_texts(spark, copies):
    """Parts of a passage in other texts of smaller ids, also in many, do not hide the text that has all of it."""
    rng = random.Random(8)
    passage = prose(rng, 60).split()
    parts = [" ".join(passage[k:k + 20]) for k in range(0, 60, 20)] + [" ".join(passage[k:k + 20]) for k in range(10, 50, 20)]
    rows = [(1 + i, f"{prose(rng, 30)} {part} {prose(rng, 30)}") for i, part in enumerate(parts * copies)]
    rows += [(1000, prose(rng, 40) + " " + " ".join(passage)), (1001, " ".join(passage) + " " + prose(rng, 40))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.source_id, r.source_start) for r in got] == [(1001, 0, 59, 1000, 40)]


def test_altered_passage_at_a_later_place(spark):
    """A seed that stands earlier in the source too is matched at all its places there."""
    rng = random.Random(12)
    p = prose(rng, 75).split()
    q = list(p)
    q[24] = q[49] = "typo"
    apart = " ".join(f"{' '.join(p[k:k + 24])} {prose(rng, 80)}" for k in (50, 25, 0))
    rows = [(1, apart + " " + " ".join(p)), (2, prose(rng, 20) + " " + " ".join(q))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (2, 20, 94, 1) in {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in got}


def test_repeated_ids_with_other_texts(spark):
    """Only the row whose text the passages were found in is cut."""
    rng = random.Random(6)
    shared = prose(rng, 90)
    rows = [(1, prose(rng, 40) + " " + shared), (2, "a " + prose(rng, 200) + " " + shared + " end"), (2, "b short"), (2, "c " + shared + " " + prose(rng, 9)), (2, None)]
    got = [r.text for r in passages.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 5 and {rows[0][1], "b short", rows[3][1], None} < set(got)
    assert sum(t is not None and t.startswith("a ") and len(t.split()) == 202 for t in got) == 1


# pages

def test_blocks_and_text():
    page = ("<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div>"
            "<article><header><h1>Head &amp; more</h1></header><p><b>One\n two<br>three<p>Four &eacute;</p><aside>Side</aside><div class='comments'><p>me too</p></div></article>"
            "<form>Your mail</form><footer>&copy; me</footer></body></html>")
    assert pages.main_text(pages.blocks(page), None) == "Head & more\nOne two three\nFour é"
    assert pages.blocks("") == [] and pages.main_text([], None) == ""


def plain_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [8, 200, 1 << 28])
def test_shared_lines(monkeypatch, bits):
    monkeypatch.setattr(pages, "BITS", bits)
    rng = random.Random(bits)
    for _ in range(150):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randrange(25))] for _ in range(2))
        got = sorted(pages.shared_lines(a, b))
        rest = iter(b)
        assert len(got) == plain_common(a, b) and all(a[i] in rest for i in got)


def test_long_pages():
    a = [f"line {i}" for i in range(6000)]
    assert len(pages.shared_lines(a, a[3000:] + a[:3000])) == 3000
    assert len(pages.shared_lines(["x", "y"] * 4000, ["y", "x", "z"] * 3000)) >= 6000


def test_ranges_do_not_matter(spark):
    """The same texts from one partition and from one for each page."""
    rng = random.Random(1)
    rows = [(i, f"http://{rng.choice('ab')}.example/{rng.randrange(4)}/{i}", f"<p>Site {i % 2}</p><p>story {i} {prose(rng, 8)}</p><p>All rights</p>") for i in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    old, found = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}, []
    try:
        for n in (1, 7, 200):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(tuple(r) for r in pages.extract(table).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2] and len(found[0]) == 40 and all("All rights" not in t for _, _, t in found[0])


def test_extract(spark):
    frame = "<div><p>Site name</p>{}<p>All rights</p></div>"
    rows = [(i, f"http://h.example/{i // 2}/{i}.html", frame.format(f"<p>story {i}</p><p>more of {i} in some length</p>")) for i in range(6)]
    rows += [(10, "http://lone.example/x", "<p>kept whole</p>"), (11, None, None), (12, "no url", ""), (13, "http://h.example/9/a", rows[0][2]), (13, "http://h.example/9/a", rows[0][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("y"))
    got = defaultdict(list)
    for r in pages.extract(table.coalesce(1)).collect():
        got[r.page_id].append(r.text)
    assert got[2] == ["story 2\nmore of 2 in some length"] and got[10] == ["kept whole"] and got[11] == [""] and got[12] == [""]
    assert len(got[13]) == 2 and sum(map(len, got.values())) == len(rows)
    assert pages.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shared_lines(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    got = sorted(pages.shared_lines(a, b))
    rest = iter(b)
    assert len(got) == best[-1][-1] and all(a[i] in rest for i in got)


def test_whole_texts_come_in_few_rows():
    """Spans with a whole text beside each are not turned into words for a batch of any size at once."""
    batch = pa.record_batch([pa.array(range(1000))], names=["a"])
    got = [b.column(0).to_pylist() for b in passages.few_rows([batch, batch.slice(0, 0), batch.slice(5, 3)])]
    assert max(map(len, got)) <= passages.ROWS < 1000 and sum(got, []) == [*range(1000), 5, 6, 7]


# helpers

def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = kernels.Lookup(keys, np.arange(len(keys)), -1)
    other = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    assert (table.get(keys) == np.arange(len(keys))).all() and (table.get(np.setdiff1d(other, keys)) == -1).all()
    assert kernels.Lookup(keys[:0], np.zeros(0), 7.0).get(keys[:3]).tolist() == [7.0] * 3


def test_words(texts):
    for t in [t for _, t in texts] + ["a", " a", "a ", "\x0b\x0c"]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        w = kernels.Words(raw, np.array([0, len(raw)]))
        assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == words(t, True)


# queries and pipeline

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_with_sql(spark, duck, name):
    mine = workload.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(workload.ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(want.columns)
    as_rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert as_rows(mine) == as_rows(want)


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLES)))
def test_query_without_sql(spark, name):
    found = workload.QUERIES[name](spark, DATA)
    n = found.count()
    whole = {"op2_token_ids": "documents", "op4_toxicity": "documents", "op7_lm_score": "documents", "op10_page_text": "pages"}.get(name)
    assert n > 0 and (whole is None or n == spark.read.parquet(f"{DATA}/{whole}.parquet").count())


def test_pipeline(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "best_fit_packing"]
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, table, DATA)
        assert after.columns == table.columns
        after = spark.createDataFrame(after.toPandas(), table.schema)
        assert 0 < after.count() <= table.count()
        table = after
    left = {r.doc_id: r.text for r in table.collect()}
    bench = [words(r.text, True) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for text in left.values():
        w = " ".join(words(text, True))
        assert not any(len(b) >= 20 and " ".join(b[2:-2]) in w for b in bench)
    ends = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
    assert {r.doc_id for r in ends.select("doc_id").distinct().collect()} == set(left)
    assert corpus_pipeline.STAGES[0][1](spark, docs, DATA).columns == docs.columns


def test_digest_of_packing(spark):
    rows = workload.op6_packing(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    encoder = Encoder(tokenizer_path())
    for r in random.Random(1).sample(rows, 40):
        assert r.ids_crc32 == zlib.crc32(encoder.encode([texts[r.doc_id]])[0][4 * r.start:4 * (r.start + r.length)])


def test_lookup_in_pieces_without_copies(monkeypatch):
    monkeypatch.setattr(kernels.Lookup, "PIECE", 7)
    keys = np.unique(np.random.default_rng(4).integers(0, 2**63, 1000, dtype=np.uint64))
    values = np.arange(len(keys)) / 3
    table = kernels.Lookup(keys, values)
    assert np.shares_memory(table.keys, keys) and np.shares_memory(table.values, values)
    assert (table.get(keys[::-1]) == values[::-1]).all() and (table.get(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), 1, 0)).all()


def test_both_score_tables_count(spark, monkeypatch):
    """The bound on broadcast rows holds for the two tables together."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b e")], "doc_id long, text string")
    joined, looked_up = [], ctw.looked_up
    monkeypatch.setattr(ctw, "looked_up", lambda *a: joined.append(a) or looked_up(*a))
    runs, words = (x.count() for x in ctw.counted(docs, F.lit(True), "doc_id", "text", 3))
    ways = [sorted((r.doc_id, r.n_tokens, r.n_known, round(r.score, 9), round(r.base_score, 9)) for r in ctw.scores(docs, F.lit(True), depth=3, lookup_rows=n).collect())
            for n in (runs + words, runs + words - 1)]
    assert ways[0] == ways[1] and len(joined) == 2


def test_known_pieces_need_no_python(monkeypatch):
    """Texts of known pieces are put together by array operations alone; all ids are those of the whole call."""
    encoder, rng = Encoder(tokenizer_path()), random.Random(5)
    words = ["the", "Straße", "кот", "a.b", "don't", "x,", "&&&", "12", "e\u0301", "\n", "\n\n", "", "", "\0", "\t", "<|endoftext|>"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert encoder.encode(texts) == [x + encoder.end for x in encoder.whole(texts)]
    plain = ["the кот\n\nStraße, don't a.b\n", " x,  the &&& 12\ne\u0301", "", None]
    first = encoder.encode(plain)
    monkeypatch.setattr(tokens, "PART", None)
    encoder.learn = encoder.whole = None
    assert encoder.encode(plain[::-1]) == first[::-1]
    monkeypatch.setattr(tokens, "SLICE", 1)
    assert encoder.encode(plain * 3) == first * 3


def test_texts_stand_once_before_their_spans(spark, monkeypatch):
    """A text goes to a task once for all its spans there, not beside each; many spans are dealt out with a copy each."""
    spans = spark.createDataFrame([(i, i % 2, i, i + 60, 0, 60) for i in range(2, 402)], "id long, src long, a int, b int, c int, d int")
    texts = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c"), (7, "no spans of it"), (None, "x")], "i long, t string")
    for most, copies in ((1000, 1), (50, 5)):
        monkeypatch.setattr(passages, "SPANS", most)
        rows = passages.after_texts(spans, spans, texts, "src", "id").collect()
        assert Counter((r.i, r.t) for r in rows if r.t is not None) == {(0, "a"): copies, (1, "c"): copies}
        assert sorted(r.id for r in rows if r.t is None) == [*range(2, 402)]
    last = None
    for r in passages.after_texts(spans, spans, texts, "src", "id").coalesce(1).collect():
        last = (r.i, r.g) if r.t is not None else last
        assert last == (r.i, r.g) and (r.t is not None or r.src == r.i)


def test_frequent_keys_need_no_join(spark, monkeypatch):
    """Where the tables are too large to broadcast, their frequent rows are, and only the rare keys of a text are joined."""
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["the", "same", "few", "words"]) for _ in range(200)) + f" {chr(0x4E00 + i)}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, keep = {}, ctw.keep
    monkeypatch.setattr(ctw, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    size = sum(x.count() for x in ctw.counted(docs, F.lit(True), "doc_id", "text", 3))
    ways = []
    for n in (size, size - 1, 0):
        kept.clear()
        ways.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.score, 9), round(r.base_score, 9)) for r in ctw.scores(docs, F.lit(True), depth=3, lookup_rows=n).collect()))
        if n == size - 1:
            left = kept["told_apart"].where("g IS NOT NULL")
            assert 30 <= left.count() < 30 * 12 and left.where("kind = 1").count() <= 30  # of about 100 runs and 6 words a text
    assert ways[0] == ways[1] == ways[2]


def altered_among_parts(rng):
    """Texts 100 and 101 share an altered passage; each of its seeds stands in more than ``PLACES`` texts, first in text 0 apart from the others."""
    p = prose(rng, 75).split()
    q = list(p)
    q[24] = q[49] = "typo"
    parts = [" ".join(p[k:k + 24]) for k in (0, 25, 50)]
    rows = [(0, " ".join(f"{part} {prose(rng, 90)}" for part in parts[::-1]))]
    rows += [(1 + i, f"{prose(rng, 30)} {parts[i % 3]} {prose(rng, 90)}") for i in range(90)]
    return rows + [(100, prose(rng, 40) + " " + " ".join(p)), (101, prose(rng, 20) + " " + " ".join(q))]


def test_altered_passage_of_frequent_seeds(spark, monkeypatch):
    """A passage whose seeds all stand in many texts is found in the one that has it, not only sought in the smallest id of each."""
    monkeypatch.setattr(passages, "PLACES", 8)
    rows = altered_among_parts(random.Random(14))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.start_word, r.end_word, r.source_id, r.source_start) for r in passages.repeated_passages(docs).collect()]
    assert got == [(101, 20, 94, 100, 40)]


def test_altered_passage_of_frequent_seeds_is_cut(spark, monkeypatch):
    """The stage of the pipeline cuts it out of the text with the larger id, and nothing else."""
    monkeypatch.setattr(passages, "PLACES", 8)
    rows = altered_among_parts(random.Random(14))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rest = {r.doc_id: r.text for r in passages.without_passages(docs).collect()}
    assert len(rest[101].split()) == 20 and all(rest[i] == t for i, t in rows[:-1])


def test_places_of_runs():
    """Runs of one seed at equal steps are laid side by side from both ends; other places meet each with each."""
    p = np.array([0, 3, *range(10, 40, 2), 90])
    assert sorted(x for run in passages.runs_of(p) for x in run.tolist()) == p.tolist() and max(map(len, passages.runs_of(p))) >= 14
    pairs = set(map(tuple, passages.matched(np.arange(0, 40, 2), np.arange(101, 121, 2)).T.tolist()))
    assert {x for x, _ in pairs} == set(range(0, 40, 2)) and (0, 101) in pairs and (38, 119) in pairs and len(pairs) <= 40
    assert passages.matched(np.array([1, 9]), np.array([4, 6, 7])).shape == (2, 6)
    h, at = np.array([5] * 10 + [7]), np.arange(11) * 3
    assert passages.ends_of_runs(h, at).tolist() == [0, 1, 8, 9, 10]
