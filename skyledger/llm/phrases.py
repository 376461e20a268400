"""Collocations of each language: phrases of two to four words that occur together more than apart.

Texts are cut into pieces at punctuation and line ends and the pieces into words. Two
passes over the texts find the exact number of occurrences of every frequent phrase
without counting the rare ones:

1. Every task sums its runs of one to four words by hash and sends these summaries, in
   blocks of steps between sorted hashes, to the hash partitions, together with the mass (occurrences) that each
   partition gets from it. There they are merged into one Misra-Gries summary for each
   partition: when it has more entries than its capacity, the first count beyond the
   capacity is taken from all. The capacity exceeds mass / threshold, so less than the
   threshold is taken in all and every frequent run survives; an entry whose count plus
   what was taken stays below the threshold is left out.
2. Runs whose hash survived are counted exactly, by their words. Which hashes survived is
   told by a bitmap of at most ``2 ** WIDEST_BITS`` bits; runs it lets through wrongly
   are counted too and then dropped by the threshold.

A run is known by a 64-bit hash in the first pass and when one task adds equal runs of one
slice of about a megabyte; counts are otherwise taken by the words themselves.

Defined cases: a null text is empty; a null language is ``und``; texts of any length are
counted whole, and one text is held by one task; repeated rows count each time; equal
scores are ordered by count and then by the bytes of the phrase; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import kernels
from skyledger.llm.store import keep

THRESHOLD = 30
LONGEST = 4
COVERED = 80  # per cent of a phrase's occurrences inside a longer one from which it is dropped
FIRST = 2000
CAPACITY = 1 << 20  # entries of one summary, from which more hash partitions are made
MOST_BITS = 20  # of the number of a hash partition
HELD = 1 << 19  # entries a task sums before it sends them on
BLOCK = 128  # entries sent in one row
BYTES = 1 << 20  # of texts worked on at once
WIDEST_BITS = 30
SALT = 64
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True


class Runs:
    """The word runs of the texts of one slice, with the language in every hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray):
        breaks = BREAK[data]
        cuts = np.sort(np.concatenate([off, np.flatnonzero(breaks)]), kind="stable")
        self.text = np.minimum(np.searchsorted(off, cuts[:-1], side="right") - 1, len(off) - 2)  # pieces without words may be given to any text
        self.words = kernels.Words(np.where(breaks, np.uint8(32), data), cuts)
        self.langs, self.word_hashes = langs, self.words.hashes()

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of every run of ``n`` words."""
        h, piece, at = self.words.grams(self.word_hashes, n)
        text = self.text[piece]
        return kernels.mix(h ^ self.langs[text]), text, at


def runs_of(batch: pa.RecordBatch):
    """The slices of a batch (language, text): first row, codes and names of the languages, and the word runs."""
    coded = batch.column(0).fill_null("und").dictionary_encode()
    names = coded.dictionary
    hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.to_pylist()], np.uint64)
    codes = coded.indices.to_numpy()
    for start, data, off in kernels.slices(batch.column(1), BYTES):
        own = codes[start:start + len(off) - 1]
        yield own, names, Runs(data, off, hashes[own])


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def byte_places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lowest byte of each number goes, and how far its next byte is, if each block (from ``at[i]`` to ``at[i + 1]``) has its bytes by rank."""
    size = np.diff(at)
    return np.arange(at[-1]) + np.repeat(7 * at[:-1], size), np.repeat(size, size)


def differenced(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of the blocks of ascending keys: the first key and the steps to the next, whose high bytes are zeros side by side."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    steps[at[:-1]] = keys[at[:-1]]
    rows, out = steps.astype("<u8").view(np.uint8).reshape(-1, 8), np.empty(8 * len(keys), np.uint8)
    place, far = byte_places(at)
    for k in range(8):
        out[place + k * far] = rows[:, k]
    return out


def summed_up(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of the blocks that ``differenced`` made."""
    rows = np.empty((at[-1], 8), np.uint8)
    place, far = byte_places(at)
    for k in range(8):
        rows[:, k] = raw[place + k * far]
    total = np.cumsum(rows.view("<u8").ravel(), dtype=np.uint64)
    before = np.append(np.zeros(1, np.uint64), total)[at[:-1]]
    return total - np.repeat(before, np.diff(at))


def partition_bits(docs: DataFrame, text: str, longest: int, threshold: int, capacity: int) -> int:
    """Bits of a hash partition's number, so that a summary has about ``capacity`` entries at most.

    A text of ``b`` bytes has at most ``(b + 1) / 2`` words and as many runs of each length.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")) + 1)).first()[0] or 0
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BITS, max(least, longest * size // 2 // threshold // capacity).bit_length())


def summaries(docs: DataFrame, lang: str, text: str, longest: int, bits: int) -> DataFrame:
    """(part, mass, keys, counts): blocks of the runs of each task summed by hash, and the task's mass of each hash partition."""
    shift = np.uint64(64 - bits)

    def send(keys, counts, mass):
        part = (keys >> shift).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        mass += np.bincount(part[first], np.add.reduceat(counts, first), len(mass)).astype(np.int64)
        while len(keys):
            block = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
            at = np.append(np.flatnonzero(block % BLOCK == 0), len(keys))
            some = np.minimum(counts, 2**32 - 1).astype(np.uint32)
            blocks = lambda size, data: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(data)])
            yield pa.record_batch([pa.array(part[at[:-1]]), pa.nulls(len(at) - 1, pa.int64()), blocks(8, differenced(keys, at)), blocks(4, some)],
                                  names=["part", "mass", "keys", "counts"])
            rest = counts > some  # counts beyond 32 bits go on in another block
            keys, counts, part = keys[rest], (counts - some)[rest], part[rest]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else first

    def run(batches):
        keys, counts, mass = [], [], np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, runs in runs_of(batch):
                for n in range(1, longest + 1):
                    h, _, _ = runs.of(n)
                    h, c = np.unique(h, return_counts=True)
                    keys.append(h)
                    counts.append(c.astype(np.int64))
                if sum(map(len, keys)) > HELD:
                    k, c = added(keys, counts)
                    keys, counts = [k], [c]
                    if len(k) > HELD // 2:
                        yield from send(k, c, mass)
                        keys, counts = [], []
        if sum(map(len, keys)):
            yield from send(*added(keys, counts), mass)
        at = np.flatnonzero(mass)
        none = pa.nulls(len(at), pa.binary())
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(mass[at]), none, none], names=["part", "mass", "keys", "counts"])

    return docs.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(run, "part int, mass long, keys binary, counts binary")


class Summary:
    """A Misra-Gries summary that other summaries are merged into; ``taken`` is what every count may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = added([self.keys, keys], [self.counts, counts])
        beyond = len(self.keys) - self.capacity
        if beyond > 0:
            cut = np.partition(self.counts, beyond - 1)[beyond - 1]  # the first count beyond the capacity
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut
            self.taken += int(cut)

    def frequent(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.taken >= threshold]


def survivors(sent: DataFrame, threshold: int) -> DataFrame:
    """(h): the hashes that can have ``threshold`` occurrences, of the summaries of all tasks."""
    def run(batches):
        part, mass, summary, keys, counts, size = -1, 0, None, [], [], 0

        def merge():
            nonlocal summary, keys, counts, size
            if size:
                summary = summary or Summary(mass // threshold + 1)
                summary.merge(*added(keys, counts))
                keys, counts, size = [], [], 0

        def found():
            merge()
            if summary:
                yield pa.record_batch([pa.array(kernels.signed(summary.frequent(threshold)))], names=["h"])

        for batch in batches:
            parts = batch.column(0).to_numpy()
            ends = np.append(np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)) if len(parts) else np.zeros(0, int)
            for low, high in zip(np.append(0, ends[:-1]), ends):
                if parts[low] != part:
                    yield from found()
                    part, mass, summary = parts[low], 0, None
                rows = batch.slice(low, high - low)
                mass += sum(x or 0 for x in rows.column(1).to_pylist())  # of a partition the masses come first
                blocks = rows.filter(rows.column(1).is_null())
                for start in range(0, len(blocks), 1024):
                    some = blocks.slice(start, 1024)
                    raw = some.column(2).to_pylist()
                    keys.append(summed_up(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(x) // 8 for x in raw)])))
                    counts.append(np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint32).astype(np.int64))
                    size += len(keys[-1])
                    if size > CAPACITY // 4:
                        merge()
        yield from found()

    ordered = sent.repartition("part").sortWithinPartitions("part", F.col("mass").isNull())
    return ordered.mapInArrow(run, "h long")


def bitmap(hashes: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of the hashes, eight to sixteen bits for each, and their number."""
    bits = min(WIDEST_BITS, max(10, (8 * rows).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out, bits


def frequent(docs: DataFrame, lang: str, text: str, threshold: int = THRESHOLD, longest: int = LONGEST, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of every run of at least ``threshold`` occurrences, and (lang, n)."""
    spark = docs.sparkSession
    bits = partition_bits(docs, text, longest, threshold, capacity)
    hashes = keep(survivors(summaries(docs, lang, text, longest, bits), threshold), "survivors")
    some, width = bitmap(hashes, hashes.count())
    sent = spark.sparkContext.broadcast(some)

    def run(batches):
        some, total = sent.value, {}
        for batch in batches:
            for codes, names, runs in runs_of(batch):
                line, lo, hi = runs.words.joined()
                for code, count in enumerate(np.bincount(codes[runs.text], runs.words.count, len(names)).tolist()):
                    total[names[code].as_py()] = total.get(names[code].as_py(), 0) + int(count)
                for n in range(1, longest + 1):
                    h, text, at = runs.of(n)
                    slot = h >> np.uint64(64 - width)
                    ok = np.flatnonzero((some[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    _, first, count = np.unique(h[ok], return_index=True, return_counts=True)
                    first = ok[first]
                    for part in kernels.parts(hi[at[first] + n - 1] - lo[at[first]]):
                        own = first[part]
                        yield pa.record_batch([names.take(pa.array(codes[text[own]])), kernels.spans(line, lo[at[own]], hi[at[own] + n - 1]),
                                               pa.array(np.full(len(own), n, np.int32)), pa.array(count[part].astype(np.int64))],
                                              names=["lang", "phrase", "words", "c"])
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array([0] * len(total), pa.int32()),
                               pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "words", "c"])

    rows = docs.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(run, "lang string, phrase string, words int, c long")
    exact = rows.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("a")).where((F.col("a") >= threshold) | (F.col("words") == 0))
    exact = keep(exact, "frequent")
    return exact.where("words > 0"), exact.where("words = 0").select("lang", F.col("a").alias("n"))


def part(begin: str, size: str) -> F.Column:
    return F.expr(f"array_join(slice(split(phrase, ' '), {begin}, {size}), ' ')")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): every phrase of two or more words with its lowest-scoring cut."""
    cuts = counts.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", part("1", "k")).withColumn("rest", part("k + 1", "words - k"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def covering(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the most frequent longer phrase that holds each shorter one."""
    inner = counts.where("words > 2").withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
    return inner.select("lang", part("at", "size").alias("inner"), "a").groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", threshold: int = THRESHOLD, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``first`` phrases of each language."""
    counts, totals = frequent(docs, lang, text, threshold)
    rows = scored(counts).join(covering(counts), ["lang", "phrase"], "left").where(
        f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {COVERED}")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
