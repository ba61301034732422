"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a document's ledger row holds its measurements and
one failure bit per rule. A policy is a versioned mask of the rules it enforces,
so changing a policy, or asking what each rule alone removes, is bit arithmetic
over the ledger and never reads a text again.

Defined results: a null or empty text has no words, lines or symbols, and fails
``too_few_words``. Repeated rows are judged one by one. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kern

#: Bit i of ``failed`` belongs to RULES[i].
RULES = ("too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length")
#: Policy versions and the rules that each enforces. "base" is the contract's base.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "word_length"),
    "strict": RULES,
}
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_100_WORDS = 20
MAX_DUP_LINES_PERCENT = 30
WORD_CHARS = (2, 20)
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, failed long"


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def measure(buf: np.ndarray, hashes: kern.Keyed) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of one text."""
    start, end = kern.word_spans(buf)
    n = len(start)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = int(np.count_nonzero(((buf & 0xC0) != 0x80) & ~kern.SPACE[buf]))
    symbols = int(np.count_nonzero(_SYMBOL[buf]))
    breaks = np.flatnonzero(buf == 10)
    line_start = np.concatenate(([0], breaks + 1))
    line_end = np.concatenate((breaks, [len(buf)]))
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    lines = hashes.spans(buf, line_start[worded], line_end[worded])
    dup_lines = len(lines) - len(np.unique(lines))
    repeat = 0
    if n > WINDOW:
        grams = hashes.windows(hashes.spans(buf, start, end), WINDOW)
        order = np.argsort(grams, kind="stable")
        same = np.diff(grams[order]) == 0
        if same.any():
            twice = np.zeros(len(grams), bool)
            twice[order[:-1][same]] = True
            twice[order[1:][same]] = True
            at = np.flatnonzero(twice)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(step[:n]) > 0))
    return n, chars, symbols, len(lines), dup_lines, repeat


def judge(n: int, chars: int, symbols: int, lines: int, dup_lines: int, repeat: int) -> int:
    """Failure bits, in the order of RULES."""
    tests = (
        n < MIN_WORDS,
        100 * repeat > MAX_REPEAT_PERCENT * n,
        100 * symbols > MAX_SYMBOLS_PER_100_WORDS * n,
        100 * dup_lines > MAX_DUP_LINES_PERCENT * lines,
        n > 0 and not WORD_CHARS[0] * n <= chars <= WORD_CHARS[1] * n,
    )
    return sum(1 << i for i, bad in enumerate(tests) if bad)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and failure bits. No shuffle."""
    key = kern.new_key()

    def rows(batches):
        hashes = kern.keyed(key)
        for batch in batches:
            found = [m + (judge(*m),) for m in (measure(buf, hashes) for buf in kern.byte_rows(batch.column(1)))]
            cells = np.array(found, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(np.ascontiguousarray(cells[:, i])) for i in range(7))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, LEDGER)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy version to ledger rows."""
    hit = lambda name: F.col("failed").bitwiseAND(F.lit(mask(POLICIES[name]))) != 0
    return rows.withColumn("base_failed", hit("base")).withColumn("kept", ~hit("base") & ~hit(policy))


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents it fails, documents only it fails, and
    how many the policy keeps without it. One aggregation over at most 2**rules masks."""
    full = mask(POLICIES[policy])
    by_mask = rows.groupBy(F.col("failed").bitwiseAND(F.lit(full)).alias("bits")).count()
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).alias("bit")) for r in POLICIES[policy]))).alias("r")
    hit = by_mask.select("bits", "count", rules).select("*", "r.rule", F.col("r.bit").cast("long").alias("bit"))
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0)).alias
    return hit.groupBy("rule").agg(
        number(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        number(F.col("bits") == F.col("bit"))("n_only"),
        number(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("n_kept_without"),
    )
