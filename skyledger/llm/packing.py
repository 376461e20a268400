"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Pieces of texts have whole lengths from 1 to ``CAPACITY``, so the whole packing
problem is a histogram of at most ``CAPACITY`` numbers, whatever the number of
texts. The reduction fixes sequences that dominate every other sequence with the
same longest piece: a piece that nothing fits beside; a pair that fills the
sequence; a pair whose second is the longest that fits where no two pieces fit
together beside the first; and a pair at least as long as any two that fit where no
three do. What is left is packed best-fit, longest first, again by counts. The plan
is a list of patterns with their number of sequences. Pieces are numbered within
their length by prefix sums over tasks and take their places from the plan, so no
group meets in one task.

Defined cases: a null or empty text is the end id alone; only texts longer than the
capacity are cut, their first piece being the shorter; repeated rows and null ids
are packed like any other; columns besides id and text are not read; an empty table
packs nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import kernels
from skyledger.llm.store import keep
from skyledger.llm.tokens import SLICE, encoders

CAPACITY = 1024


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids, part, rank): pieces and their number among those of one length in a task."""
    names = [key, "piece", "start", "length", "ids", "part", "rank"]

    def run(batches):
        from pyspark import TaskContext

        encoder, part, seen = encoders(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for low, _, off in kernels.slices(batch.column(1), SLICE):
                rows = batch.slice(low, len(off) - 1)
                owner, number, start, length, ids, rank = [], [], [], [], [], []
                for i, coded in enumerate(encoder.encode(rows.column(1).to_pylist())):
                    n = len(coded) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(coded[4 * a:4 * b])
                        rank.append(int(seen[b - a]))
                        seen[b - a] += 1
                yield pa.record_batch([rows.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                                       pa.array(ids, pa.binary()), pa.array([part] * len(owner), pa.int32()), pa.array(rank, pa.int64())], names=names)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, f"`{key}` long, piece int, start long, length long, ids binary, part int, rank long")


class Stock:
    """Counts of the lengths still to pack, with their sorted list."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def longest(self, most: int) -> int | None:
        k = bisect_left(self.sizes, most + 1)
        return self.sizes[k - 1] if k else None

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.count[s])
            if len(out) == n:
                break
        return out

    def best_pair(self, most: int) -> int:
        """Largest sum of two lengths up to ``most``, or 0."""
        best = 0
        for s in self.sizes:
            other = self.longest(most - s)
            if other == s and self.count[s] < 2:
                k = bisect_left(self.sizes, s)
                other = self.sizes[k - 1] if k else None
            if other is not None:
                best = max(best, s + other)
        return best


def dominating(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix the sequences that dominate all others with the same longest piece, and take them from the stock."""
    fixed = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        fixed.append((lengths, n))
        for s in lengths:
            stock.take(s, n)

    for size in sorted(stock.sizes, reverse=True):
        while size in stock.count:
            n, room = stock.count[size], capacity - size
            stock.count[size] -= 1  # itself does not count as a neighbour
            fits = stock.longest(room)
            if fits == size and stock.count[size] == 0:
                k = bisect_left(stock.sizes, size)
                fits = stock.sizes[k - 1] if k else None
            least = [s for s in stock.smallest(4) if s <= room][:3]
            stock.count[size] += 1
            if fits is None:
                fix((size,), n)
                continue
            pair_fits = len(least) > 1 and sum(least[:2]) <= room
            triple_fits = len(least) > 2 and sum(least) <= room
            if fits == room or not pair_fits or (not triple_fits and fits >= stock.best_pair(room)):
                m = n // 2 if fits == size else min(n, stock.count[fits])
                if m:
                    # what does not fit now fits no later, so the same choice holds for all of them
                    fix((size, fits), m)
                    continue
            break
    return fixed


def best_fit(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: patterns and their number of sequences."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room == 0:
            done.append((pattern, n))
        else:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, n))

    for size in sorted(stock.sizes, reverse=True):
        left = stock.count[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):  # a new sequence, with as many of this length as it holds
                per = min(left, capacity // size)
                put((size,) * per, left // per)
                left -= per * (left // per)
                continue
            room = rooms[k]
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            per = min(left, room // size)
            m = min(n, left // per)
            if m < n:
                put(pattern, n - m)
            put(pattern + (size,) * per, m)
            left -= per * m
    return done + [x for group in open_.values() for x in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    stock = Stock(histogram)
    fixed = dominating(stock, capacity)
    return fixed + best_fit(stock, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, place): pieces of that length numbered low to high - 1 go to sequence + number - low."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        place = 0
        for s in pattern:
            low = used.get(s, 0)
            out.append((s, low, low + n, sequence, place))
            used[s] = low + n
            place += s
        sequence += n
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset); ids are little-endian unsigned 32-bit."""
    cut = keep(pieces(docs, path, key, text, capacity), "pieces")
    counted = keep(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one number for each length: at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = slots(plan(histogram, capacity))
    schema = "length long, low long, high long, sequence long, place long"
    table = docs.sparkSession.createDataFrame(placed, schema)
    ranked = cut.join(F.broadcast(offsets) if counted.count() <= 1_000_000 else offsets, ["length", "part"]).withColumn("r", F.col("rank") + F.col("before"))
    # the plan is bounded by the capacity: its patterns do not grow with the texts
    joined = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")))
    return joined.select(key, "piece", "start", ranked["length"], "ids", (F.col("sequence") + F.col("r") - F.col("low")).alias("sequence_id"),
                         F.col("place").alias("offset"))
