"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions. Each decision, in each context of up to
``DEPTH`` bytes before it, has a Krichevsky-Trofimov estimate from all training texts;
a context's estimate is mixed with that of its longer contexts, half and half a
priori, so the mixture runs over all depths. Contexts that no training text has
take no part: the path ends at the longest one seen.

The corpus gives two tables: the runs of ``DEPTH + 1`` bytes of all texts with their
training counts, and the words of all texts with theirs. Tree nodes are sums over
runs. Subtrees of the two nearest bytes are worked out apart in partitions of the
runs; their roots (at most 65,280 numbers) join in the two top levels. Each run gets
the log-probability of its last byte, and a text is the sum over its bytes and one
end mark, so scoring is a lookup: in two broadcast tables while they have at most
``LOOKUP_ROWS`` rows together. Else half as many of their most frequent rows are broadcast, and
only the runs and words of a text that are not among them are counted and joined.

Both ways give the same numbers, whatever the files the tables are split into. A text of
any length is read whole by one task.

Defined cases: a null text is empty and scores its end mark; repeated rows count
repeatedly; a null id is held out; columns besides id and text are not read; without
training texts every decision has probability one half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import kernels
from skyledger.llm.store import keep

DEPTH = 5
LOOKUP_ROWS = 6_000_000
CHUNK = 1 << 20  # bytes of text whose keys are sorted at once
SCORED = 1 << 19  # bytes of text looked up at once, beside the two tables
HELD = 1 << 20  # distinct keys a task adds up before it sends them on
ROWS = 1 << 17  # of one batch sent on
ALPHA = 0.1  # of the base score
END_WORD = 0x454E44  # stands for the end among the words


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; for x > 0."""
    x = x.astype(float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - shift


def block_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


class Level:
    """The nodes of one depth: keys (context bytes, then the decision's prefix), counts and weights."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0.astype(float), n1.astype(float)
        estimate = block_log(n0, n1)
        if below is None:
            self.log, self.weight = estimate, np.ones(len(key))
        else:
            both = np.logaddexp(estimate, below)
            self.log, self.weight = both - np.log(2), np.exp(estimate - both)

    def descend(self, acc: np.ndarray, rem: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the parent's mixture so far, what is left and its value as last node: the same for these nodes."""
        n = self.n0 + self.n1
        estimate = (self.n1 + 0.5) / (n + 1)
        seen = n > 0
        last = np.where(seen, acc + rem * estimate, end)
        return np.where(seen, acc + rem * self.weight * estimate, acc), np.where(seen, rem * (1 - self.weight), rem), last


def levels(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Levels from ``depth`` up to ``top``, the parent of each node, and the deepest node of each (run, decision)."""
    x = (grams & np.uint64(255)).astype(np.int64)
    j = np.arange(8)
    node = (1 << j) | (x[:, None] >> (8 - j))
    bit = (x[:, None] >> (7 - j)) & 1
    key = ((grams >> np.uint64(8)).astype(np.int64)[:, None] << 8 | node).ravel()
    weight = np.repeat(n.astype(float), 8)
    unique, inverse = np.unique(key, return_inverse=True)
    out = [Level(unique, np.bincount(inverse, weight * (bit.ravel() == 0), len(unique)), np.bincount(inverse, weight * bit.ravel(), len(unique)), None)]
    parents = []
    for d in range(depth - 1, top - 1, -1):
        child = out[-1]
        up, to = np.unique(child.key & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        parents.append(to)
        out.append(Level(up, np.bincount(to, child.n0, len(up)), np.bincount(to, child.n1, len(up)), np.bincount(to, child.log, len(up))))
    return out, parents, inverse


def logs_of_runs(grams: np.ndarray, n: np.ndarray, depth: int, top: dict) -> np.ndarray:
    """log10 of the probability of the last byte of each run, given the mixtures at depth 1."""
    tree, parents, deepest = levels(grams, n, depth, 2)
    at = np.searchsorted(top["key"], tree[-1].key & 0xFFFF)
    state = tree[-1].descend(*(top[k][at] for k in ("acc", "rem", "end")))
    for level, parent in zip(tree[-2::-1], parents[::-1]):
        state = level.descend(*(s[parent] for s in state))
    one = state[2][deepest].reshape(-1, 8)
    bit = ((grams.astype(np.int64)[:, None] >> (7 - np.arange(8))) & 1).astype(bool)
    return np.log10(np.where(bit, one, 1 - one)).sum(axis=1)


def top_levels(roots: pa.Table) -> dict:
    """Mixtures at depth 1 from its nodes (key, n0, n1, below)."""
    key, n0, n1, below = (roots.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
    order = np.argsort(key)
    first = Level(key[order], n0[order].astype(float), n1[order].astype(float), below[order])
    up, to = np.unique(first.key & 255, return_inverse=True)
    root = Level(up, np.bincount(to, first.n0, len(up)), np.bincount(to, first.n1, len(up)), np.bincount(to, first.log, len(up)))
    state = root.descend(np.zeros(len(up)), np.ones(len(up)), np.full(len(up), 0.5))
    acc, rem, end = first.descend(*(s[to] for s in state))
    return {"key": first.key, "acc": acc, "rem": rem, "end": end}


def summed_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def counted(docs: DataFrame, train: Column, key: str, text: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Runs (g, n, f) and words (g, n, f) of all texts with their training counts, kept.

    ``f`` orders them by frequency: the training count and one for each time that a task sent the key on.
    A task sorts the keys of about ``CHUNK`` bytes of text at once, those of training texts and the others apart,
    and adds up ``HELD`` distinct ones before it sends them on.
    """
    def run(batches):
        held = {0: ([], []), 1: ([], [])}

        def send(kind):
            k, n = summed_counts(*held[kind])
            held[kind] = ([], [])
            for low in range(0, len(k), ROWS):
                some = k[low:low + ROWS]
                yield pa.record_batch([pa.array(np.full(len(some), kind, np.int32)), pa.array(kernels.signed(some)), pa.array(n[low:low + ROWS])], names=["kind", "g", "n"])

        for batch in batches:
            learn = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for start, data, off in kernels.slices(batch.column(1), CHUNK):
                mine = learn[start:start + len(off) - 1]
                for kind in (0, 1):
                    found, first = keys_of(data, off, depth, kind == 1)
                    owned = np.repeat(mine, np.diff(first))
                    for keys, own in ((found[owned], True), (found[~owned], False)):
                        u, n = np.unique(keys, return_counts=True)
                        held[kind][0].append(u)
                        held[kind][1].append(n.astype(np.int64) * own)
                    if sum(map(len, held[kind][0])) > HELD:
                        held[kind] = tuple([x] for x in summed_counts(*held[kind]))
                        if len(held[kind][0][0]) > HELD // 2:
                            yield from send(kind)
        for kind in (0, 1):
            if held[kind][0]:
                yield from send(kind)

    rows = docs.select(F.coalesce(train, F.lit(False)).alias("learn"), F.col(text).cast("string"))
    sums = F.sum("n").alias("n"), (F.sum("n") + F.count(F.lit(1))).alias("f")
    found = keep(rows.mapInArrow(run, "kind int, g long, n long").groupBy("kind", "g").agg(*sums), "counts")
    return found.where("kind = 0").select("g", "n", "f"), found.where("kind = 1").select("g", "n", "f")


def run_logs(runs: DataFrame, depth: int) -> DataFrame:
    """(g, v, f): log10 probability of the last byte of each run."""
    rows = runs.repartition(F.col("g").bitwiseAND(0xFFFF00))  # a shuffle puts the runs with the same two nearest bytes in one partition

    def table(batches):
        got = [[c.to_numpy() for c in b.columns] for b in batches if len(b)]
        return [np.concatenate(x) for x in zip(*got)] if got else None

    def roots(batches):
        got = table(batches)
        if got:
            top = levels(got[0].view(np.uint64), got[1], depth, 2)[0][-1]
            yield pa.record_batch([pa.array(x) for x in (top.key & 0xFFFF, top.n0, top.n1, top.log)], names=["key", "n0", "n1", "below"])

    first = rows.mapInArrow(roots, "key long, n0 double, n1 double, below double").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()
    top = runs.sparkSession.sparkContext.broadcast(top_levels(first))

    def logs(batches):
        got = table(batches)
        if got:
            v = logs_of_runs(got[0].view(np.uint64), got[1], depth, top.value)
            yield pa.record_batch([pa.array(got[0]), pa.array(v), pa.array(got[2])], names=["g", "v", "f"])

    return keep(rows.mapInArrow(logs, "g long, v double, f long"), "run_logs")


def keys_of(data: np.ndarray, off: np.ndarray, depth: int, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs or words (with the end) of the texts, and where each text's begin."""
    if not words:
        return kernels.byte_grams(kernels.LOWER[data], off, depth + 1)
    found = kernels.Words(data, off)
    first = found.first + np.arange(len(off))
    keys = np.full(first[-1], END_WORD, np.uint64)
    keys[np.arange(len(found.start)) + np.repeat(np.arange(len(off) - 1), found.count)] = found.hashes()
    return keys, first


def often(tables: list[DataFrame], most: int) -> Column:
    """Whether a row is one of the most frequent of the tables, which are at most ``most`` in all of them together."""
    bins = F.floor(8 * F.log2("f"))
    both = tables[0].select("f")
    for table in tables[1:]:
        both = both.union(table.select("f"))
    total, least = 0, None
    for b, n in sorted(both.groupBy(bins.alias("b")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = b
    return F.lit(False) if least is None else bins >= least


def lookup_arrays(table: DataFrame) -> list[np.ndarray]:
    """Keys and values of a table (key, value)."""
    return [c.to_numpy() for c in table.toArrow().columns]


def told_apart(docs: DataFrame, key: str, text: str, runs: DataFrame, words: DataFrame, base: float, depth: int) -> DataFrame:
    """(row, key, kind, g, m, v, hits): for each text and kind of key a row without ``g``, and the keys that the tables lack; kept.

    The row without ``g`` has the number of keys that the broadcast tables (g, v) and (g, n) have, the sum of their values
    and the number of those with training counts; the others have their number in the text.
    """
    context = docs.sparkSession.sparkContext
    by_run, by_word = context.broadcast(lookup_arrays(runs)), context.broadcast(lookup_arrays(words))

    def run(batches):
        tables = [kernels.Lookup(x.value[0].view(np.uint64), x.value[1], np.nan) for x in (by_run, by_word)]
        for batch in batches:
            for start, data, off in kernels.slices(batch.column(2), SCORED):
                rows, ids = (batch.column(c).slice(start, len(off) - 1) for c in (0, 1))
                for kind in (0, 1):
                    keys, first = keys_of(data, off, depth, kind == 1)
                    found = tables[kind].get(keys)
                    has = ~np.isnan(found)
                    value = np.log10(found + ALPHA) - base if kind else found
                    sums = kernels.summed(has, first), kernels.summed(np.where(has, value, 0), first), kernels.summed(found > 0, first)
                    yield sent(rows, ids, kind, None, sums[0], sums[1], sums[2])
                    t, k = np.repeat(np.arange(len(rows)), np.diff(first))[~has], keys[~has]
                    order = np.lexsort((k, t))
                    t, k = t[order], k[order]
                    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])) if len(k) else np.zeros(0, np.int64)
                    yield sent(rows.take(pa.array(t[new])), None, kind, k[new], np.diff(np.append(new, len(k))), None, None)

    def sent(rows, ids, kind, g, m, v, hits):
        size = len(rows)
        column = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x.astype(kind.to_pandas_dtype()), kind)
        return pa.record_batch([rows, pa.nulls(size, pa.int64()) if ids is None else ids, pa.array(np.full(size, kind, np.int32)),
                                column(g, pa.int64()), column(m, pa.int64()), column(v, pa.float64()), column(hits, pa.int64())],
                               names=["row", key, "kind", "g", "m", "v", "hits"])

    texts = docs.select(F.monotonically_increasing_id(), F.col(key).cast("long"), F.col(text).cast("string"))
    return keep(texts.mapInArrow(run, f"row long, `{key}` long, kind int, g long, m long, v double, hits long"), "told_apart")


def looked_up(found: DataFrame, table: DataFrame, kind: int) -> DataFrame:
    """(row, n, v, hits): for each text its number of keys, sum of their values and number with a positive ``c``; the keys left by a join."""
    mine = found.where(F.col("kind") == kind)
    own = mine.where("g IS NULL").select("row", F.col("m").alias("n"), "v", "hits")
    left = mine.where("g IS NOT NULL").select("row", "g", "m").join(table, "g")
    left = left.select("row", F.col("m").alias("n"), (F.col("m") * F.col("v")).alias("v"), F.when(F.col("c") > 0, F.col("m")).otherwise(0).alias("hits"))
    return own.unionByName(left).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", "v", "hits")])


def scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of ``docs``."""
    runs, words = counted(docs, train, key, text, depth)
    logs = run_logs(runs, depth)
    total = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size, kinds = int(total[0]), int(total[1])
    base = np.log10(size + ALPHA * (kinds + 1))
    width = "n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    if runs.count() + kinds > lookup_rows:  # the rows that would be broadcast
        frequent = often([logs, words], lookup_rows // 2)
        found = told_apart(docs, key, text, logs.where(frequent).select("g", "v"), words.where(frequent).select("g", F.col("n").cast("double")), base, depth)
        by_run = looked_up(found, logs.where(~frequent).select("g", "v", F.lit(0).alias("c")), 0)
        by_word = looked_up(found, words.where(~frequent).select("g", (F.log10(F.col("n") + ALPHA) - base).alias("v"), F.col("n").alias("c")), 1)
        rows = found.where("kind = 0 AND g IS NULL").select("row", key)
        out = rows.join(by_run.select("row", F.col("v").alias("score"), F.col("n").alias("bytes")), "row").join(by_word, "row")
        return out.select(key, F.col("n").alias("n_tokens"), F.col("hits").alias("n_known"), F.lit(size).cast("long").alias("train_tokens"),
                          F.col("v").alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"))
    spark = docs.sparkSession
    by_run = spark.sparkContext.broadcast(lookup_arrays(logs.select("g", "v")))
    by_word = spark.sparkContext.broadcast(lookup_arrays(words.where("n > 0").select("g", F.col("n").cast("double"))))

    def run(batches):
        lookup = kernels.Lookup(by_run.value[0].view(np.uint64), by_run.value[1])
        counts = kernels.Lookup(by_word.value[0].view(np.uint64), by_word.value[1])
        for batch in batches:
            for start, data, off in kernels.slices(batch.column(1), SCORED):
                keys, first = keys_of(data, off, depth, False)
                score = kernels.summed(lookup.get(keys), first)
                n_bytes = np.diff(first)
                keys, first = keys_of(data, off, depth, True)
                c = counts.get(keys)
                value = kernels.summed(np.log10(c + ALPHA) - base, first)
                known = kernels.summed(c > 0, first).astype(np.int64)
                rows = len(off) - 1
                yield pa.record_batch([batch.column(0).slice(start, rows), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(rows, size)), pa.array(value),
                                       pa.array(score), pa.array(-score * np.log2(10) / n_bytes)],
                                      names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{key}` long, {width}")
