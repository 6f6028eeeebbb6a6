"""Quality rules as a ledger: measure once, store one bit per failed rule, judge by policy.

Every rule is evaluated once per text. Its outcome is a bit of ``failures``; what it
measured stays beside it. A policy is a named set of rules, hence a mask: applying
another version, or asking what each rule contributes, only reads the ledger.

Everything is DataFrame functions inside one scan; nothing is shuffled. Repeated word
windows are found inside the row: hashes of all windows, with the window's place in
the low bits, are sorted as plain longs, and equal neighbours are compared word by word.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.llm.texts import SPACE, SPACES, boxed, unboxed, whole

WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rules by name, in the order of their bits: each is true for a text that fails. A bit never changes its meaning;
#: a new rule takes the next one.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
}
BASE = ("few_words", "repeated_words")


def mask(rules: Sequence[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a text is kept unless it fails one of ``rules``."""

    version: str = "v1"
    rules: tuple[str, ...] = field(default_factory=lambda: tuple(RULES))

    @property
    def mask(self) -> int:
        return mask(self.rules)


DEFAULT_POLICY = Policy()


def _fixed(x: Column) -> Column:
    """The same value, tied to the row number so that no filter on it is pushed below the measuring columns.

    There it would repeat their expressions, lambdas within lambdas, and no longer be linear in the text's length.
    """
    return F.when(F.monotonically_increasing_id() >= 0, x)


def _measured(df: DataFrame, text: str = "_text") -> DataFrame:
    """Add the measures of ``MEASURES``; what lambdas read twice is a column of its own, so it is computed once."""
    e = F.expr
    df = df.withColumn("_trimmed", F.btrim(F.col(text), F.lit(SPACES)))
    df = df.withColumns(
        {
            "_words": F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE)),
            "_lines": F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    ).drop("_trimmed", text)
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_bits": F.length(F.bin(F.size("_words").cast("long"))),
        }
    ).drop("_lines")
    # The place of a window in the low bits, as much of its hash as fits in the others.
    df = df.withColumn(
        "_keys",
        e(
            f"""if(size(_words) < {WINDOW}, cast(array() as array<bigint>), sort_array(transform(
                sequence(0L, size(_words) - {WINDOW}L),
                i -> shiftleft(xxhash64(_words[cast(i as int)], _words[cast(i as int) + 1], _words[cast(i as int) + 2]), _bits) | i)))"""
        ),
    )

    def same(a: str, b: str) -> str:
        at = [f"cast({x} & (shiftleft(1L, _bits) - 1) as int)" for x in (a, b)]
        words = " AND ".join(f"_words[{at[0]} + {k}] = _words[{at[1]} + {k}]" for k in range(WINDOW))
        return f"(shiftright({a}, _bits) = shiftright({b}, _bits) AND {words})"

    df = df.withColumn(
        "_repeats",
        e(
            f"""sort_array(transform(filter(_keys, (x, i) -> (i > 0 AND {same("x", "_keys[i - 1]")})
                OR (i < size(_keys) - 1 AND {same("x", "_keys[i + 1]")})), x -> x & (shiftleft(1L, _bits) - 1)))"""
        ),
    ).drop("_keys", "_words", "_bits")
    covered = e(
        f"""aggregate(transform(_repeats, (p, i) -> if(i = 0, {WINDOW}L, least({WINDOW}L, p - _repeats[i - 1]))),
            0L, (a, x) -> a + x)"""
    )
    return df.withColumn("n_repeat_words", _fixed(covered)).drop("_repeats")


def _failures() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _judged(docs: DataFrame, text: str) -> DataFrame:
    df = _measured(docs.select(boxed(docs), whole(text).alias("_text")))
    return df.withColumn("failures", _fixed(_failures()))


def quality_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measure every text once: ``key``, the measures, and ``failures``, one bit per failed rule.

    A null or empty text has no words and fails ``few_words``. Repeated rows are judged
    one by one; a null key stays null; other columns are ignored. An empty table gives
    an empty ledger. Texts of any length are measured whole, inside their row.
    """
    df = _judged(docs, text)
    return df.select(F.col("_doc").getField(key).alias(key), *MEASURES, "failures")


def apply_policy(ledger: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``policy`` to a ledger without looking at a text again."""
    failed = F.col("failures")
    return ledger.withColumns(
        {
            "base_failed": failed.bitwiseAND(F.lit(mask(BASE))) != 0,
            "kept": failed.bitwiseAND(F.lit(policy.mask | mask(BASE))) == 0,
            "policy": F.lit(policy.version),
        }
    )


def ablation(ledger: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """For every rule of the policy: texts that fail it, that fail it alone, and that stay without it.

    The ledger is reduced to one count per distinct bit pattern (at most two to the
    number of rules) before any rule is looked at.
    """
    patterns = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in policy.rules]))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return (
        patterns.withColumn("r", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(failed & (rest == 0), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(rest == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, text: str = "text", policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The rows of ``docs`` that pass the policy, with all their columns and no others; null and empty texts fail.

    Repeated rows are judged alike and each is kept or dropped; texts of any length are measured whole; columns
    of any name pass through, as rows travel in one struct; an empty table gives an empty result.
    """
    return unboxed(apply_policy(_judged(docs, text), policy).where("kept"), docs.columns)


def policies(ledger: DataFrame, versions: Mapping[str, Policy]) -> DataFrame:
    """One boolean column ``kept_<version>`` per policy, all from the same ledger."""
    return ledger.withColumns(
        {f"kept_{v}": F.col("failures").bitwiseAND(F.lit(p.mask | mask(BASE))) == 0 for v, p in versions.items()}
    )
