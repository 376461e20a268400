"""Near-duplicate texts by SimHash fingerprints, compared in vertical bit planes.

The fingerprint of a text has a bit set if more than half of the XXH64 hashes of its
three-word runs have it. Equal fingerprints are one class. The 64 bits are cut into
``RADIUS + 3`` blocks; two fingerprints that differ in at most ``RADIUS`` bits agree in
all but ``RADIUS`` blocks, so classes that agree in all other blocks, for some choice
of ``RADIUS`` free ones, form a group, and every link lies in a group.

The fingerprints of many groups, sorted by group, are turned into bit planes: one vector of
64-bit words for each free bit position, with one lane for each fingerprint. A plane and
the same plane shifted by ``s`` lanes differ where a fingerprint and the ``s``-th after it
differ, so one pass over the planes counts all distances at that shift, 64 in each word, in
carry-save counters that start so high that the first distance beyond the radius overflows.
A word whose lanes have all overflowed, or hold no pair of one group, is abandoned.

Only the links that join parts of a batch are given out, so a group of many close
fingerprints gives no more rows than it has members; groups of more than ``BLOCK``
are compared in pairs of blocks.

Defined cases: a null or empty text or one without a word has the fingerprint zero and is
linked like any other; fewer than three words are one run; repeated words count each time;
texts of any length are read whole, one text by one task; rows with one id stay apart and
keep their own fingerprints; a null id is never the smallest of a group that has others;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import kernels
from skyledger.llm.components import components
from skyledger.llm.store import keep

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCK = 2048  # members of a group from which it is compared in pairs of blocks
ROWS = 1 << 16  # rows whose planes are made at once
STEP = 4  # planes between two looks for words to abandon
EDGES = np.linspace(0, 64, RADIUS + 4).astype(int)
FREE = [[b for i in pick for b in range(EDGES[i], EDGES[i + 1])] for pick in combinations(range(RADIUS + 3), RADIUS)]
MASKS = [sum(1 << b for b in range(64) if b not in free) for free in FREE]
MASKS = [m - (m >> 63 << 64) for m in MASKS]  # as signed numbers

# The five primes of XXH64, fixed values of its definition.
PRIME = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
LONG = 256  # bytes from which a string is hashed alone


def turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte spans; all spans of one length class take a step together."""
    import xxhash

    size = hi - lo
    order = np.argsort(-size, kind="stable")
    out = np.empty(len(size), np.uint64)
    long = int(np.searchsorted(-size[order], -LONG, side="left"))
    for i in order[:long]:
        out[i] = xxhash.xxh64_intdigest(data[lo[i]:hi[i]].tobytes(), seed=seed)
    order = order[long:]
    at, size = lo[order], size[order]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    p1, p2, p3, p4, p5 = PRIME

    def stir(acc, lane):
        return turn(acc + lane * p2, 31) * p1

    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        starts = [seed + p1 + p2, seed + p2, seed, seed - p1]
        h = np.full(len(at), seed + p5, np.uint64)
        at, left = at.copy(), size.copy()
        wide = int((size >= 32).sum())
        if wide:
            acc = [np.full(wide, s, np.uint64) for s in starts]
            n = wide
            while n:
                for i in range(4):
                    acc[i][:n] = stir(acc[i][:n], eight[at[:n] + 8 * i])
                at[:n] += 32
                left[:n] -= 32
                n = int((left[:n] >= 32).sum())
            total = turn(acc[0], 1) + turn(acc[1], 7) + turn(acc[2], 12) + turn(acc[3], 18)
            for a in acc:
                total = (total ^ stir(np.uint64(0), a)) * p1 + p4
            h[:wide] = total
        h += size.astype(np.uint64)
        for _ in range(3):
            n = np.flatnonzero(left >= 8)
            h[n] = turn(h[n] ^ stir(np.uint64(0), eight[at[n]]), 27) * p1 + p4
            at[n] += 8
            left[n] -= 8
        n = np.flatnonzero(left >= 4)
        h[n] = turn(h[n] ^ (four[at[n]].astype(np.uint64) * p1), 23) * p2 + p3
        at[n] += 4
        left[n] -= 4
        for _ in range(3):
            n = np.flatnonzero(left >= 1)
            h[n] = turn(h[n] ^ (data[at[n]].astype(np.uint64) * p5), 11) * p1
            at[n] += 1
            left[n] -= 1
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    out[order] = h
    return out


def shingle_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the runs of each text, repeats included, and the text of each, in order of the texts."""
    words = kernels.Words(data, off)
    line, lo, hi = words.joined()
    size = np.minimum(words.count, SHINGLE)
    count = np.where(size > 0, words.count - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + words.first[:-1][text]
    return xxh64(line, lo[at], hi[at + size[text] - 1]), text


def majority(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The fingerprint of each text; ``text`` ascends."""
    ones = np.zeros((texts, 64), np.int64)
    for low in range(0, len(hashes), 1 << 18):
        own = text[low:low + (1 << 18)]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(hashes[low:low + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_ = 2 * ones > np.bincount(text, minlength=texts)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").reshape(-1).view("<u8")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each row's text, as a signed number."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start, data, off in kernels.slices(batch.column(1)):
                fp = majority(*shingle_hashes(data, off), len(off) - 1)
                yield pa.record_batch([batch.column(0).slice(start, len(off) - 1), pa.array(kernels.signed(fp))], names=["id", "fp"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def packed(bits: np.ndarray, room: int) -> np.ndarray:
    """A vector of 64-bit words with one lane for each entry, and ``room`` words in all."""
    out = np.zeros(room * 8, np.uint8)
    raw = np.packbits(bits, bitorder="little")
    out[:len(raw)] = raw
    return out.view("<u8")


def close_pairs(fp: np.ndarray, group: np.ndarray, free: list[int], radius: int = RADIUS):
    """Give, shift by shift, the places of pairs of one group that differ in at most ``radius`` of the free bits.

    ``group`` ascends. Fingerprints of one group agree in all other bits.
    """
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [len(fp)]]))
    member = np.arange(len(fp)) - np.repeat(first, size)
    after = np.repeat(size, size) - 1 - member  # members of the group behind each place
    words = -(-len(fp) // 64)
    planes = [packed((fp >> np.uint64(b)) & np.uint64(1), 2 * words + 2) for b in free]
    width = (radius + 1).bit_length()
    full = ~np.uint64(0)
    for shift in range(1, int(size.max(initial=0))):
        valid = packed(after >= shift, words)
        at = np.flatnonzero(valid)
        over = ~valid[at]
        start = (1 << width) - 1 - radius
        count = [np.full(len(at), full if start >> i & 1 else np.uint64(0)) for i in range(width)]
        skip, bit = divmod(shift, 64)
        for j, plane in enumerate(planes):
            other = plane[at + skip]
            if bit:
                other = (other >> np.uint64(bit)) | (plane[at + skip + 1] << np.uint64(64 - bit))
            carry = plane[at] ^ other
            for i in range(width):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
            if j % STEP == STEP - 1:
                live = np.flatnonzero(over != full)
                if len(live) < len(at):
                    at, over, count = at[live], over[live], [c[live] for c in count]
                if not len(at):
                    break
        if len(at):
            word, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            x = at[word] * 64 + lane
            yield x, x + shift


def forest(fp: np.ndarray, group: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the close pairs of the batch join, at most one for each place."""
    root = np.arange(len(fp))
    for x, y in close_pairs(fp, group, free):
        while True:
            a, b = root[x], root[y]
            new = a != b
            if not new.any():
                break
            np.minimum.at(root, np.maximum(a, b)[new], np.minimum(a, b)[new])
            while (root[root] != root).any():
                root = root[root]
    tied = np.flatnonzero(root != np.arange(len(fp)))
    return tied, root[tied]


def group_links(rows: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints; the rows (pick, part, i, j, fp) of a group stand together."""
    def links(pick, group, fp):
        for p in np.unique(pick):
            own = pick == p
            values = fp[own]
            a, b = forest(values, group[own], FREE[p])
            yield pa.record_batch([pa.array(kernels.signed(values[a])), pa.array(kernels.signed(values[b]))], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(5)])
            size += len(batch)
            if size >= ROWS:
                held, size, done = cut([np.concatenate(c) for c in zip(*held)], last=False)
                yield from done
        if size:
            yield from cut([np.concatenate(c) for c in zip(*held)], last=True)[2]

    def cut(columns, last):
        """Compare the whole groups; give what is left of the last one, its size, and the links."""
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
        group = np.cumsum(new)
        end = len(new) if last else int(np.flatnonzero(new)[-1])
        done = links(columns[0][:end], group[:end], columns[4][:end].view(np.uint64)) if end else iter(())
        return [[c[end:] for c in columns]], len(new) - end, done

    return rows.mapInArrow(run, "a long, b long")


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join all fingerprints (fp) within the radius of each other."""
    keys = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("pick"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(MASKS)])).alias("k"))
    keys = keys.select("k.pick", "k.part", "fp")
    large = keep(keys.groupBy("pick", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "large_groups")
    keys = keys.join(large, ["pick", "part"], "left")
    blocks = F.when(F.col("n").isNull(), 1).otherwise(F.ceil(F.col("n") / block)).cast("int")
    keys = keys.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("own")))
    rows = keys.withColumn("other", F.explode(others)).select("pick", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return group_links(rows.repartition("pick", "part", "i", "j").sortWithinPartitions("pick", "part", "i", "j"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``."""
    signed = keep(fingerprints(docs, key, text), "fingerprints")
    classes = keep(signed.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    roots = keep(components(links(classes)), "roots")
    smallest = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("id").alias("smallest"))
    linked = keep(roots.join(smallest, "root").select(F.col("node").alias("fp"), "smallest"), "linked")
    home = keep(classes.join(linked, "fp", "left").select("fp", F.when(F.col("smallest").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id")), "home")
    return signed.join(home, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
