"""Rule bitmask ledger: every quality rule is evaluated once and leaves one failure bit.

``ledger`` stores the measurements and the bits of all rules; policies (versioned
sets of rules) and ablations read the bits alone and never touch the text again.
Native: DataFrame functions only, one narrow pass, no shuffle before the ablation.

Defined results: a null or empty text has no words, all measurements 0, and fails
``too_few_words``. Repeated rows are judged alike, each for itself. Extra columns are
ignored (``ledger``) or carried along (``keep``). Windows of three words are compared
by their 64-bit xxHash within one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named predicate over the measurements; true means that the document fails."""

    name: str
    fails: Callable[[Column], Column]


#: Order gives the bit. The first two are the base rules.
RULES = (
    Rule("too_few_words", lambda m: m.n_words < 50),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("symbol_heavy", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 5 * m.n_lines),
    Rule("odd_word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 25 * m.n_words)),
    Rule("few_letters", lambda m: 10 * m.n_letters < 5 * m.word_chars),
    Rule("shouting", lambda m: 10 * m.n_upper > 6 * m.n_letters),
)
BASE = 0b11
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("too_few_words", "repeated_windows"),
    "v2": tuple(r.name for r in RULES),
}


def policy_mask(policy: str) -> int:
    names = POLICIES[policy]
    return sum(1 << i for i, r in enumerate(RULES) if r.name in names)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def covered(s: Column) -> Column:
        size = F.size(s)
        again = F.filter(
            s,
            lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
            | ((j < size - 1) & (F.get(s, j + 1)["h"] == x["h"])),
        )
        starts = F.array_sort(F.transform(again, lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).alias("last"))
        return F.aggregate(
            starts,
            zero,
            lambda a, p: F.struct((a["c"] + F.least(F.lit(3), p - a["last"])).alias("c"), p.alias("last")),
            lambda a: a["c"],
        )

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        rows = F.transform(
            at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
        )
        return F.when(F.size(w) >= 4, let(F.sort_array(rows), covered)).otherwise(F.lit(0).cast("long"))

    return windows(words)


def measurements(text: Column) -> Column:
    """All measurements of one text as a struct; each is computed once."""
    text = F.coalesce(text, F.lit(""))

    def chars(t: Column, pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "")).cast("long")

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
        return let(
            F.struct(
                t.alias("t"),
                F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"),
                lines.alias("lines"),
            ),
            lambda v: F.struct(
                F.size(v.w).cast("long").alias("n_words"),
                chars(v.t, r"[\x20\x09-\x0D]+").alias("word_chars"),
                (F.length(v.t) - F.length(F.translate(v.t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(v.lines) - F.size(F.array_distinct(v.lines))).cast("long").alias("n_dup_lines"),
                F.size(v.lines).cast("long").alias("n_lines"),
                _repeat_words(v.w).alias("n_repeat_words"),
                chars(v.t, r"[^\p{L}]+").alias("n_letters"),
                chars(v.t, r"[^\p{Lu}]+").alias("n_upper"),
            ),
        )

    return let(text, of)


def failure_bits(m: Column) -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, measurements, ``fail_bits``."""
    judged = let(measurements(F.col(text)), lambda m: F.struct(m.alias("m"), failure_bits(m).alias("fail_bits")))
    out = docs.select(F.col(key), judged.alias("j"))
    return out.select(key, "j.m.*", "j.fail_bits")


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """``ledger`` rows with ``base_failed`` and ``kept`` under ``policy``; base rules always reject."""
    mask = policy_mask(policy) | BASE
    return rows.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0,
        }
    )


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of ``policy`` rejects, and what only it rejects.

    Documents are first counted by failure mask (at most 2^rules groups, partial
    sums before the shuffle), so neither a hot source nor the corpus size matters.
    """
    mask = policy_mask(policy)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(
        F.array(
            *(
                F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                for i, r in enumerate(RULES)
                if mask >> i & 1
            )
        )
    )
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits") == F.col("r.bit")
    return (
        masks.select("bits", "n", rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("rejected"),
            F.coalesce(F.sum(F.when(only, F.col("n"))), F.lit(0)).alias("rejected_by_it_alone"),
        )
    )


def keep(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The documents that ``policy`` keeps, all their columns unchanged."""
    mask = policy_mask(policy) | BASE
    verdict = let(measurements(F.col(text)), lambda m: failure_bits(m).bitwiseAND(F.lit(mask)) == 0)
    return docs.where(verdict)
