"""Quality rules: a ledger of failure bits and measurements, and policies over it.

Every rule is evaluated once for each text. The ledger keeps the measurements and
one bit for each failed rule; a policy is a mask, and applying it, comparing
versions or leaving a rule out are bitwise operations on the stored number.

Defined cases: a null text counts as empty and fails ``few_words``; repeated rows
get the same ledger each; a text of any length is measured whole; an empty table
gives an empty ledger; columns of the input never clash, as the ledger is one
struct column under a free name; ties do not occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import fresh

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8

# name of the rule -> failing condition over the struct of measurements; the place gives the bit
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m.n_words < 20,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 30 * m.n_words,
    "many_symbols": lambda m: 100 * m.n_symbols > 20 * m.n_words,
    "repeated_lines": lambda m: 100 * m.n_dup_lines > 50 * m.n_lines,
    "odd_word_length": lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words),
    "shouting": lambda m: 100 * m.n_upper > 50 * m.word_chars,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "many_symbols"), "v2": tuple(RULES)}
CURRENT = "v2"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(r) for r in rules)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of ``WINDOW`` words that occur twice or more in the text.

    Equal windows agree in the hash of any of their words. Hashes of four of the
    eight show most texts to have no such window; the others compare the windows
    themselves.
    """
    probe = (0, 2, 5, 7)
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.hash(*[F.get(words, i + k) for k in probe]))
    at = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("g"), i.alias("p"))))

    def places(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda e, k: F.struct(e.p.alias("p"), (
            (F.coalesce(F.get(w, k - 1).g == e.g, F.lit(False))) | (F.coalesce(F.get(w, k + 1).g == e.g, F.lit(False)))
        ).alias("twice"))), lambda e: e.twice)
        return F.sort_array(F.transform(at, lambda e: e.p))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(p, start, lambda s, x: F.struct(
            (s.n + WINDOW - F.greatest(s.end - x, F.lit(0))).cast("long").alias("n"), (x + WINDOW).alias("end")), lambda s: s.n)

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= WINDOW, none).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(let(windows, places), covered))))


def measure(text: Column) -> Column:
    """One struct of the measurements of a text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda kept: F.length(F.regexp_replace(text, kept, "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    by_word = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"),
                                                         F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).alias("r")))
    return let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda x: F.struct(
        x.w.n.alias("n_words"),
        x.w.c.alias("word_chars"),
        count("[^#*$%&|<>]+").alias("n_symbols"),
        (x.l.n - x.l.d).alias("n_dup_lines"),
        x.w.r.alias("n_repeat_words"),
        x.l.n.alias("n_lines"),
        count("[^A-ZÀ-ÖØ-ÞΑ-ΩА-Я]+").alias("n_upper"),
    ))


def ledger(docs: DataFrame, name: str = "ledger", text: str = "text") -> DataFrame:
    """``docs`` with one more column, a struct of the measurements and ``failed_bits``.

    It is called ``name``, with underscores behind it where ``docs`` has such a column.
    The bits are made from the measurements inside one expression, so that a filter
    on them, also when it is pushed down to the scan, measures each text once.
    """
    def entry(m: Column) -> Column:
        bits = [F.when(rule(m), F.lit(bit(r))).otherwise(F.lit(0)).cast("long") for r, rule in RULES.items()]
        total = bits[0]
        for b in bits[1:]:
            total = total.bitwiseOR(b)
        return F.struct(*[m[c].alias(c) for c in MEASURES], total.alias("failed_bits"))

    return docs.withColumn(fresh(docs, name), let(measure(docs[text]), entry))


def passes(bits: Column, rules: tuple[str, ...]) -> Column:
    """Whether a text passes a policy."""
    return bits.bitwiseAND(F.lit(mask(rules)).cast("long")) == 0


def ablation(bits: DataFrame, column: str = "failed_bits", policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy and rule: texts kept with the policy, and without that rule of it.

    The ledger is first counted by its bits, at most ``2 ** len(RULES)`` rows.
    """
    counted = bits.groupBy(F.col(column).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).cast("long").alias("mask"),
                               F.lit(mask(rules) & ~bit(r)).cast("long").alias("without")) for p, rules in policies.items() for r in rules])
    kept = lambda m: F.sum(F.when(F.col("bits").bitwiseAND(F.col(m)) == 0, F.col("n")).otherwise(0))
    return counted.select("bits", "n", F.inline(cases)).groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), kept("mask").alias("kept"), kept("without").alias("kept_without_rule"))


def keep_good(docs: DataFrame, rules: tuple[str, ...] = POLICIES[CURRENT], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their own columns."""
    name = fresh(docs, "ledger")
    done = ledger(docs, name, text)
    return done.where(passes(done[name].failed_bits, rules)).drop(name)
