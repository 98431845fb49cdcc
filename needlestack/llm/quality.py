"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document whose measure lies above a cutoff. Labelled good documents
are the holdout: for a cutoff that rejects k of n of them, the exact (Clopper-Pearson)
upper bound of its false rejection rate must not exceed the rule's share of `risk`.
Cutoffs are tested from the laxest to the strictest and testing stops at the first
failure, so a rule's many cutoffs need no correction; the level is divided by the number
of rules and strata (Bonferroni). With probability 1 - `level` no stratum loses more
than `risk` of its good documents. Among its certified cutoffs a rule takes the one that
rejects the most bad documents for the fewest good ones; without a gain, or with too few
labels to certify anything, it stays off.

Nulls and the rest: a null text has no words and fails the base rules; a null stratum
counts as the stratum of the empty name; null labels are left out, and of repeated labels
of one id the highest holds; without labels only the base rules act.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import materialize
from .bpe import _once
from .text import WordHashes, window_hashes, words_of

RISK = 0.02
LEVEL = 0.05
WINDOW = 8
SYMBOLS = "#*$%&|<>"
STEPS = 128
#: A bad document rejected is worth this share of a good one lost.
GOOD_WORTH = 25
#: Measures and the width of their cutoff steps; a higher value is worse.
RULES = {
    "symbols": ("n_symbols / n_words", 0.02),
    "exclaims": ("n_exclaims / n_words", 0.02),
    "capitals": ("n_capitals / n_chars", 0.01),
    "dup_lines": ("n_dup_lines / n_lines", 0.01),
    "repeats": ("n_repeat_words / n_words", 0.01),
    "long_words": ("word_chars / n_words", 0.25),
}
CAPITALS = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims",
          "n_capitals", "n_chars")


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more."""
    own = window_hashes(hashes, window)
    if len(own) < 2:
        return 0
    _, back, counts = np.unique(own, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """The counts of `COUNTS` of one whole text."""
    text = text or ""
    words = words_of(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return (len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(hashes.of(words)) if len(words) > WINDOW else 0,
            len(lines), text.count("!"), sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(text))


_worker: dict = {}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, counts...) of every whole text; one narrow pass."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                        F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([plain.schema["id"], plain.schema["stratum"], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _once(_worker, "hashes", WordHashes)
        for batch in batches:
            rows = [text_counts(t.as_py(), hashes) for t in batch.column(2)]
            columns = zip(*rows) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], names=schema.names)
    return plain.mapInArrow(run, schema)


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a rate when k of n were seen (Clopper-Pearson, one-sided)."""
    if k >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def at_most_k(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(log_choose))
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if at_most_k(mid) > level:
            low = mid
        else:
            high = mid
    return high


def certified_cutoff(good: list[int], bad: list[int], risk: float, level: float,
                     good_worth: float = GOOD_WORTH) -> int | None:
    """The cutoff step to reject above, from histograms of the measure's steps; None: the rule stays off.

    Tests cutoffs from the laxest down, stops at the first that fails, and picks the best of those that passed.
    """
    n, k, caught = sum(good), 0, 0
    best, gain = None, 0.0
    for step in range(len(good) - 2, -1, -1):
        k += good[step + 1]
        caught += bad[step + 1]
        if k > risk * n or upper_bound(k, n, level) > risk:
            break
        if caught - good_worth * k > gain:
            best, gain = step, caught - good_worth * k
    return best


def fit_cutoffs(measured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                risk: float = RISK, level: float = LEVEL) -> dict[tuple[str, str], int]:
    """Certified cutoff steps by (stratum, rule). All labelled rows count; only histograms reach the driver.

    A stratum whose good documents are too few to certify even a cutoff that rejects none is not tested.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("good"))
    rows = materialize(measured.join(marks, "id").where("n_words > 0").select(
        "stratum", "good", *[_step(rule).alias(rule) for rule in RULES]), "quality_holdout")
    share = risk / len(RULES)
    least = math.ceil(math.log(level / len(RULES)) / math.log1p(-share))
    tested = [r["stratum"] for r in rows.where("good = 1").groupBy("stratum").count().where(
        F.col("count") >= least).select("stratum").collect()]     # each has at least `least` labelled rows
    if not tested:
        return {}
    long = rows.where(F.col("stratum").isin(tested)).unpivot(["stratum", "good"], list(RULES), "rule", "step")
    bars: dict = {}
    for r in long.groupBy("stratum", "rule", "good", "step").count().collect():
        bars.setdefault((r["stratum"], r["rule"]), [[0] * STEPS, [0] * STEPS])[r["good"] == 1][r["step"]] += r["count"]
    cutoffs = {key: certified_cutoff(good, bad, share, level / (len(RULES) * len(tested)))
               for key, (bad, good) in bars.items()}
    return {key: step for key, step in cutoffs.items() if step is not None}


def _step(rule: str):
    """Number of the cutoff step a measure lies in; the last one is open."""
    expression, width = RULES[rule]
    return F.least(F.floor(F.expr(f"try_divide({expression.split(' / ')[0]}, {expression.split(' / ')[1]})") / width),
                   F.lit(STEPS - 1)).cast("int")


def judge(measured: DataFrame, cutoffs: dict[tuple[str, str], int]) -> DataFrame:
    """Adds base_failed and kept. A document is kept unless a base rule or a rule of its stratum rejects it."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.lit(False)
    for rule in RULES:
        own = {stratum: step for (stratum, r), step in cutoffs.items() if r == rule}
        if own:
            cutoff = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])[F.col("stratum")]
            rejected = rejected | F.coalesce(_step(rule) > cutoff, F.lit(False))
    return measured.select("*", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
