"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each
failed rule; a *policy* is a named, versioned mask of bits. Applying another policy, or asking what
each rule costs, is arithmetic on the stored bits: the texts are not read again.

Defined results: a null text is an empty text (no words); repeated rows are judged row by row;
extra columns are ignored by ``ledger`` and kept by ``apply_rules``; an empty table gives an empty
ledger. Nothing is cut: texts are measured whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.words import WHITE, WordNumbers, as_bytes, free_name, struct_udf

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
)
NUMBER_BITS = 21  # three word numbers of this width fit one 64-bit key

_numbers = WordNumbers()


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    count = len(words)
    if count < 4:
        return 0
    ids = _numbers.fresh().of(words)
    if len(_numbers) >= 1 << NUMBER_BITS:
        ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    if ids.max() < 1 << NUMBER_BITS:
        keys = (ids[:-2] << 2 * NUMBER_BITS) | (ids[1:-1] << NUMBER_BITS) | ids[2:]
    else:  # over two million different words: number the pairs first
        pairs = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1].astype(np.int64)
        keys = (pairs[:-1] << 32) | ids[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    again = np.isin(keys, twice)
    covered = np.zeros(count, bool)
    for shift in range(3):
        covered[shift : count - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: pa.Array) -> pa.Array:
    raws = as_bytes(texts)
    chars = np.fromiter(
        (len(r) - len(r.translate(None, WHITE)) for r in raws), np.int64, len(raws)
    )
    points = np.array(
        [0 if n is None else n for n in pc.utf8_length(texts).to_pylist()], np.int64
    )
    rows = np.zeros((len(raws), len(MEASURES)), np.int64)
    for i, raw in enumerate(raws):
        words = raw.split()
        lines, duplicates = duplicate_lines(raw)
        rows[i] = (
            len(words), 0, len(raw) - len(raw.translate(None, SYMBOLS)), lines, duplicates,
            repeated_words(words), len(raw) - len(raw.translate(None, UPPER)),
        )
    rows[:, 1] = points - chars
    return pa.StructArray.from_arrays(
        [pa.array(rows[:, k]) for k in range(len(MEASURES))], names=list(MEASURES)
    )


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct."""
    return struct_udf(", ".join(f"{m} bigint" for m in MEASURES), measure)(text)


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the measurements' columns by name; true means the document fails."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("capitals", lambda m: m("n_upper") * 10 > m("word_chars") * 3),
    Rule("short_words", lambda m: m("word_chars") < m("n_words") * 3),
    Rule("long_words", lambda m: m("word_chars") > m("n_words") * 10),
    Rule("duplicate_lines", lambda m: m("n_dup_lines") * 10 > m("n_lines") * 3),
)


def mask_of(*names: str) -> int:
    bits = {rule.name: 1 << i for i, rule in enumerate(RULES)}
    return sum(bits[name] for name in names)


#: Versioned policies: which failed rules reject a document.
POLICIES = {
    "base": mask_of("few_words", "repeated_windows"),
    "v1": mask_of("few_words", "repeated_windows", "symbols", "capitals"),
    "v2": mask_of(*(rule.name for rule in RULES)),
}
PRODUCTION = "v2"


def with_ledger(df: DataFrame, text: str, measured: str, bits: str) -> DataFrame:
    """``df`` with a struct of measurements and the failure bits."""
    df = df.withColumn(measured, measurements(F.col(text)))
    failed = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        fails = rule.fails(lambda name: F.col(f"{measured}.{name}"))
        failed = failed + F.when(fails, 1 << i).otherwise(0)
    return df.withColumn(bits, failed)


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measurements and ``fail_bits`` (bit i: rule i failed), one row per row."""
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return with_ledger(narrow, "text", "m", "fail_bits").select(
        F.col("key").alias(key), *[F.col(f"m.{m}").alias(m) for m in MEASURES], "fail_bits"
    )


def passes(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(
    stored: DataFrame, policy: str, kept: str = "kept", bits: str = "fail_bits"
) -> DataFrame:
    """A stored ledger with the policy's verdict as column ``kept``."""
    return stored.withColumn(kept, passes(F.col(bits), policy))


def ablation(stored: DataFrame, policy: str, bits: str = "fail_bits") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the
    policy would keep without it. One aggregate over the stored bits; no text is read."""
    mask = POLICIES[policy]
    relevant = F.col(bits).bitwiseAND(F.lit(mask).cast("long"))
    counts = [F.count_if(relevant == 0).alias("kept")]
    chosen = [(i, rule) for i, rule in enumerate(RULES) if mask >> i & 1]
    for i, _ in chosen:
        one = F.lit(1 << i).cast("long")
        counts.append(F.count_if(relevant.bitwiseAND(one) != 0).alias(f"failed_{i}"))
        counts.append(F.count_if(relevant == one).alias(f"alone_{i}"))
    total = stored.agg(*counts)
    rules = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.col(f"failed_{i}").alias("failed"),
            F.col(f"alone_{i}").alias("failed_alone"),
            (F.col("kept") + F.col(f"alone_{i}")).alias("kept_without"),
        )
        for i, rule in chosen
    ]
    return total.select(F.explode(F.array(*rules)).alias("r")).select("r.*")


def apply_rules(df: DataFrame, policy: str = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass the policy, with the columns of ``df``."""
    measured, bits = free_name(df, "_measured"), free_name(df, "_failed")
    judged = with_ledger(df, text, measured, bits)
    return judged.where(passes(F.col(bits), policy)).select(*df.columns)
