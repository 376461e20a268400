"""Near-duplicate texts: b-bit minwise signatures joined by a multi-index Hamming search.

A text is the set of its runs of five lower-case words. Equal sets form one class,
which takes part once. The signature of a class has ``LENGTH`` symbols of 16 bits, of
which the first ``SYMBOLS`` are cut into ``CHUNKS`` chunks. Signatures that differ in at
most ``DISTANCE`` of the keyed symbols have, by the pigeonhole principle, a chunk with
at most ``DISTANCE // CHUNKS`` differing symbols; each chunk is therefore indexed once
for every choice of the symbols that may differ, and pairs within the distance always
meet under a key. At a similarity of 0.75 signatures differ in 10 of the 40 keyed
symbols on average; pairs beyond 19 may still meet, and a pair at 0.75 is missed with a
chance of about 2e-6. Pairs that meet are compared on all 128 symbols, of which 32
differ on average at 0.75; ``NEAR`` is five standard deviations beyond.

A class also has a parity sketch: each member of its set flips one bit, and the sketch
has four to eight bits a member (``WIDEST`` at most). The exclusive or of two sketches
has no more set bits than there are members in one set only, so too many set bits rule
a pair out for certain. This test loses no link; a sketch at its bound only rules out less.

Links are found in two steps, so that a key with many texts gives no pairs of all
with all. First each text of a key is compared with the smallest one; confirmed
links give components. Then only texts of one key that are still in different
components are compared, in blocks of bounded size, first by signature and then by
full sets. A pair comes from the first of its keys only. Every link is confirmed on
the full sets.

Defined cases: null or empty texts and texts without a word have an empty set and
link with nothing; a text of fewer than five words is one run; rows with the same
id are one node, and all of them are returned; a null id is a class of its own only
if its text is, and such a row is never kept unless it stands alone; extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import kernels
from skyledger.llm.components import components
from skyledger.llm.store import fresh, keep, small

SHINGLE = 5
PERCENT = 75
SYMBOLS, CHUNKS, DISTANCE = 40, 10, 19
LENGTH, NEAR = 128, 56
WIDEST = 8192  # bytes of the longest parity sketch
BYTES = 1 << 19  # of whole texts that a task works on at once
BLOCK = 1024  # texts of one key compared by one task
SIZE, ERRORS = SYMBOLS // CHUNKS, DISTANCE // CHUNKS
PICKS = np.array([[c * SIZE + i for i in pick] for c in range(CHUNKS) for pick in combinations(range(SIZE), SIZE - ERRORS)])
SEED = np.random.default_rng(8).integers(1, 2**63, (2, LENGTH), dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a run, sorted, and where each text's begin."""
    words = kernels.Words(data, off)
    h = words.hashes()
    grams, text, _ = words.grams(h, SHINGLE)
    few = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(few):
        short = np.array([kernels.mix(np.array([hash_run(h[words.first[t]:words.first[t + 1]])], np.uint64))[0] for t in few], np.uint64)
        grams, text = np.concatenate([grams, short]), np.concatenate([text, few])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(off)))


def hash_run(h: np.ndarray) -> int:
    """Hash of a whole short sequence of words, apart from those of full runs."""
    value = len(h)
    for x in h:
        value = (value * kernels.BASE + int(x)) % 2**64
    return value


def parities(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The parity sketch of each set of a run; a narrower one is a wider one with its halves folded together."""
    n = np.diff(first)
    width = np.where(n > 0, np.clip(2 ** np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64), 64, 8 * WIDEST), 0)
    begin = np.concatenate([[0], np.cumsum(width)])
    text = np.repeat(np.arange(len(n)), n)
    at = (kernels.mix(grams ^ SEED[1, 2]) & (width[text] - 1).astype(np.uint64)).astype(np.int64) + begin[text]
    odd = (np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[a:b] for a, b in zip(begin[:-1] // 8, begin[1:] // 8)]


def possible(sketches: pa.Array | pa.ChunkedArray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sets ``x[i]`` and ``y[i]`` can have the similarity, by their sizes and sketches; never false for a link."""
    ok = 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])
    raw = sketches.to_pylist()
    own = np.array([len(r) for r in raw], np.int64)
    shared = np.minimum(own[x], own[y])
    above, width = None, int(own.max(initial=0))
    while width >= 8:
        table = np.zeros((len(raw), width // 8), np.uint64) if above is None else above[:, :width // 8] ^ above[:, width // 8:]
        for row in np.flatnonzero(own == width):
            table[row] = np.frombuffer(raw[row], np.uint64)
        pairs = np.flatnonzero(ok & (shared == width))
        step = max(1, (1 << 25) // width)
        for start in range(0, len(pairs), step):
            some = pairs[start:start + step]
            apart = np.bitwise_count(table[x[some]] ^ table[y[some]]).sum(axis=1, dtype=np.int64)
            ok[some] = (100 - PERCENT) * (size[x[some]] + size[y[some]]) >= (100 + PERCENT) * apart
        above, width = table, width // 2
    return ok


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, f1, f2, sig, bits): size and fingerprints of each set, its signature of 16-bit symbols and its parity sketch."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary()), ("bits", pa.binary())])

    def run(batches):
        for batch in batches:
            for start, data, off in kernels.slices(batch.column(1), BYTES):
                grams, first = shingles(data, off)
                n, full = np.diff(first), np.flatnonzero(np.diff(first))
                at = first[:-1][full]
                f = np.zeros((2, len(n)), np.uint64)
                sig = np.zeros((len(n), LENGTH), np.uint16)
                if len(full):
                    f[0, full] = np.add.reduceat(kernels.mix(grams ^ SEED[0, 0]), at)
                    f[1, full] = np.add.reduceat(kernels.mix(grams ^ SEED[1, 1]), at)
                    for j in range(LENGTH):
                        low = np.minimum.reduceat((grams ^ SEED[0, j]) * SEED[1, j], at)
                        sig[full, j] = (kernels.mix(low) >> np.uint64(48)).astype(np.uint16)
                yield pa.record_batch([batch.column(0).slice(start, len(n)), pa.array(n), pa.array(kernels.signed(f[0])), pa.array(kernels.signed(f[1])),
                                       pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(parities(grams, first), pa.binary())], schema=schema)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, n long, f1 long, f2 long, sig binary, bits binary")


def sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, s): the full sets."""
    def run(batches):
        for batch in batches:
            for start, data, off in kernels.slices(batch.column(1), BYTES):
                grams, first = shingles(data, off)
                yield pa.record_batch([batch.column(0).slice(start, len(off) - 1), pa.ListArray.from_arrays(
                    pa.array(first, pa.int32()), pa.array(kernels.signed(grams)))], names=["id", "s"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, s array<long>")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(k, pick, id): the keys of each signature, one for each chunk and choice of symbols that may differ."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sig = symbols(batch.column(1)).astype(np.uint64)
            out = np.empty((len(batch), len(PICKS)), np.uint64)
            for j, pick in enumerate(PICKS):
                h = np.full(len(batch), j + 1, np.uint64)
                for i in pick:
                    h = kernels.mix(h * np.uint64(kernels.BASE) + sig[:, i])
                out[:, j] = h
            picks = np.tile(np.arange(len(PICKS), dtype=np.int32), len(batch))
            yield pa.record_batch([pa.array(kernels.signed(out.ravel())), pa.array(picks), batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), len(PICKS))))],
                                  names=["k", "pick", "id"])

    return classes.select("id", "sig").mapInArrow(run, "k long, pick int, id long")


def symbols(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The signatures of a binary column as rows of symbols."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), LENGTH)


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``NEAR`` symbols and whose sketches allow a link."""
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.slice(start, BLOCK)
                part = part.filter(pa.array((symbols(part["sa"]) != symbols(part["sb"])).sum(axis=1) <= NEAR))
                first = np.arange(len(part))
                size = np.concatenate([part["na"].to_numpy(), part["nb"].to_numpy()])
                ok = possible(pa.chunked_array([part["pa"], part["pb"]]), size, first, first + len(part))
                yield part.filter(pa.array(ok)).select(["a", "b"])

    both = pairs.join(classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"), F.col("bits").alias("pb")), "b").join(
        classes.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"), F.col("bits").alias("pa")), "a")
    return both.select("a", "b", "sa", "sb", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    pairs = keep(pairs, "pairs")
    used = pairs.select(F.col("a").alias("u")).unionAll(pairs.select(F.col("b").alias("u"))).distinct()
    used = keep(used, "used")
    full = keep(sets(docs.select(key, text).join(small(used), F.col(key) == F.col("u"), "left_semi"), key, text), "sets", "lz4")
    both = pairs.join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(
        full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct()


def apart(keys: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of texts that share a key, lie in different components, have near signatures and sketches that allow a link."""
    rooted = keys.join(roots, keys["id"] == roots["node"], "left").select("k", "pick", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("g")).where("lo < hi")
    rows = rooted.join(mixed.select("k", "g"), "k").join(classes.select("id", "sig", "bits", F.col("n").alias("size")), "id")
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    rows = rows.withColumn("n", blocks).withColumn("m", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    rows = rows.select("k", "pick", "id", "root", "sig", "bits", "size", "m", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    rows = rows.select("k", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), "pick", "id", "root", "sig", "bits", "size", "m")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, root, m = (t[c].to_numpy() for c in ("id", "root", "m"))
        sig, pick = symbols(t["sig"]), t["pick"][0].as_py()
        across = t["i"][0].as_py() != t["j"][0].as_py()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in range(len(ids) - 1):
            y = x + 1 + np.flatnonzero((root[x + 1:] != root[x]) & ((m[x + 1:] != m[x]) | (not across)))
            y = y[(sig[y] != sig[x]).sum(axis=1) <= NEAR]
            # the pair comes from the first key that both have
            y = y[~(sig[y][:, PICKS[:pick]] == sig[x][PICKS[:pick]]).all(axis=2).any(axis=1)]
            a.append(np.full(len(y), x))
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = possible(t["bits"], t["size"].to_numpy(), a, b)
        a, b = ids[a[ok]], ids[b[ok]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("k", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``."""
    signed = keep(signatures(docs, key, text), "signatures")
    classes = signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"))
    classes = keep(classes, "classes")
    sigs = keep(signed.where("n > 0").join(classes.select("n", "f1", "f2", F.col("id").alias("c")), ["n", "f1", "f2"]).where("id = c")
                .groupBy("id", "f1", "f2").agg(F.min("sig").alias("sig"), F.min("bits").alias("bits"), F.min("n").alias("n")).select("id", "n", "sig", "bits"), "class_signatures")
    keys = chunk_keys(sigs)
    hubs = keys.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("k", "a")
    met = keep(keys.join(hubs, "k").select("k", "pick", "id", "a"), "met")
    links = keep(confirmed(near(met.where("a < id").select("a", F.col("id").alias("b")).distinct(), sigs), docs, key, text), "links")
    roots = keep(components(links), "roots")
    more = confirmed(apart(met.select("k", "pick", "id"), roots, sigs), docs, key, text)
    roots = keep(components(links.unionAll(more)), "roots")
    home = classes.join(roots, classes["id"] == roots["node"], "left").select("n", "f1", "f2", F.coalesce("root", "id").alias("c"))
    out = signed.join(home, ["n", "f1", "f2"], "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One text of each group of near-duplicates, with the columns of ``docs``; rows with a null id go through."""
    name = fresh(docs, "kept_id")
    gone = near_duplicates(docs, key, text).where("NOT kept").select(F.col(key).alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(gone, docs[key] == gone[name], "left_anti")
