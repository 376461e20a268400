"""Benchmark passages in texts: spaced-seed hashing, by DataFrame functions only.

A mask picks some of the words in a short span and ignores the others, so a
substituted word spoils only the masks that pick it. Each place of each text is
hashed under every mask and looked up among the hashes of the benchmark items. A
hit names a text, an item and their shift; around it the words of both are
compared under that shift, and the best run, counting one for an equal word and
minus one for a different one, must reach ``SCORE`` (less for short items).

Defined cases: null or empty texts and items hit nothing; items with fewer words
than the shortest mask (7) say too little to be looked for and hit nothing; repeated rows are found each; rows with a null id are searched and reported with a
null id; extra columns are kept and not read; empty tables give no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.quality import let, words_of
from skyledger.llm.store import fresh, keep, small

MASKS = ("110110011", "101100111", "1110111")
SCORE = 10
SHORT_SHARE = 0.6  # of the words of a short item


def lowered(text: Column) -> Column:
    return words_of(F.lower(F.coalesce(text, F.lit(""))))


def hashes(words: Column, at: Column) -> Column:
    """Array of (mask, hash) of the masks at one place; a mask that passes the end has a null hash."""
    out = []
    for number, mask in enumerate(MASKS):
        picks = [F.get(words, at + k) for k, c in enumerate(mask) if c == "1"]
        out.append(F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(number), *picks)))
    return F.array(*out)


def places(table: DataFrame, key: str, text: str) -> DataFrame:
    """(id, at, h) for all places and masks."""
    least = min(map(len, MASKS))
    words = table.select(F.col(key).alias("id"), lowered(F.col(text)).alias("w"))
    words = words.select("id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - least, F.lit(0)))).alias("at"))
    return words.select("id", "at", F.explode(hashes(F.col("w"), F.col("at"))).alias("h")).where("h IS NOT NULL")


def hits(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(id, item, shift): places where a text and an item agree under a mask."""
    seeds = keep(places(items, item, item_text).select("h", F.col("id").alias("item"), F.col("at").alias("j")).distinct(), "item_seeds")
    found = places(docs, key, text).join(small(seeds), "h")
    return found.select("id", "item", (F.col("at") - F.col("j")).alias("shift")).distinct()


def best_run(w: Column, b: Column, shift: Column) -> Column:
    """(score, first, last): best run of equal words of an item in a text under a shift, as places in the text."""
    at = F.sequence(F.greatest(shift, F.lit(0)), F.least(shift + F.size(b), F.size(w)) - 1)
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("from"), F.lit(0).alias("best"), F.lit(0).alias("first"), F.lit(-1).alias("last"))

    def step(x: Column, p: Column) -> Column:
        gain = F.when(F.get(w, p) == F.get(b, p - shift), 1).otherwise(-1)
        new = F.struct(F.greatest(x["s"] + gain, F.lit(0)).alias("s"), F.when(x["s"] == 0, p).otherwise(x["from"]).alias("from"))
        return let(new, lambda n: F.struct(
            n["s"].alias("s"), n["from"].alias("from"), F.greatest(x["best"], n["s"]).alias("best"),
            F.when(n["s"] > x["best"], n["from"]).otherwise(x["first"]).alias("first"), F.when(n["s"] > x["best"], p).otherwise(x["last"]).alias("last")))

    return F.aggregate(at, start, step)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, shift, start_word, end_word, score): benchmark passages found in the texts."""
    found = keep(hits(docs, items, key, text, item, item_text), "hits")
    bench = items.select(F.col(item).alias("item"), lowered(F.col(item_text)).alias("b"))
    pairs = keep(found.join(bench, "item"), "hit_items")
    words = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    joined = words.join(small(pairs, 200_000), F.col("k").eqNullSafe(F.col("id")))
    least = F.least(F.lit(SCORE), F.greatest(F.ceil(SHORT_SHARE * F.size("b")), F.lit(6)).cast("int"))
    joined = joined.select("k", "item", "shift", least.alias("least"), let(lowered(F.col("t")), lambda w: best_run(w, F.col("b"), F.col("shift"))).alias("r"))
    return joined.where("r.best >= least").select(
        F.col("k").alias(key), F.col("item").alias(item), "shift", F.col("r.first").alias("start_word"), F.col("r.last").alias("end_word"), F.col("r.best").alias("score")).distinct()


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with their own columns."""
    name = fresh(docs, "leaking")
    gone = leaks(docs, items, key, text).select(F.col(key).alias(name)).distinct()
    return docs.join(small(keep(gone, "leaking")), docs[key].eqNullSafe(F.col(name)), "left_anti")
