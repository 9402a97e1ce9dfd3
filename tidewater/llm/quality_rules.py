"""Quality rules with risk-controlled cutoffs (operator 7).

Base measures of every whole text come from one vectorised pass. Each rule rejects a document when a
measure lies beyond a cutoff. Cutoffs are not guessed: on labelled holdouts, per stratum, a cutoff is
admitted only if an exact binomial (Clopper-Pearson) test shows that at most ``RISK`` of the good
documents are rejected by it. The level is divided by the number of rules (Bonferroni); within a rule
the cutoffs are tested from the loosest on until one fails, an order fixed beforehand, which needs no
further division. Of the admitted cutoffs a rule takes the one with the largest share of bad documents
rejected less ``PENALTY`` times the share of good ones, the loosest if equal, and none if that is not
positive. A stratum with too few good documents gets no cutoff.

Rows: null and empty texts have no word and fail the base rule; a repeated row is judged on its own;
rows without a label, or with a null label, serve no holdout; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import textkit as K
from tidewater.llm.common import bounded_batches, checkpointed

RISK = 0.01  # false rejections allowed to one rule
PENALTY = 10.0  # shares of bad documents that one share of good documents costs
ERROR = 0.05  # chance that any cutoff of a stratum breaks that bound
STEPS = 60  # cutoffs tried for each rule

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words in repeated windows

#: Rules: measure -> (sign, least, most). A document fails if sign x measure > cutoff; cutoffs run over
#: an even grid from sign x least to sign x most. Measures are ratios, so the grids fit any corpus.
RULES = {
    "symbol_ratio": (1, 0.0, 1.5),
    "dup_line_ratio": (1, 0.0, 1.0),
    "repeat_ratio": (1, 0.0, 1.0),
    "upper_ratio": (1, 0.0, 1.0),
    "same_word_ratio": (1, 0.0, 1.0),
    "long_words": (1, 4.0, 16.0),
    "short_words": (-1, 6.0, 0.0),
    "few_words": (-1, 60.0, 0.0),
}


def measures(docs: DataFrame) -> DataFrame:
    """Base counts of every row: the row's columns without ``text``, then the measures (long)."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_lines", "_upper", "_same", "_letters"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in counts])

    def run(batches):
        for batch in batches:
            parts = [measured(part) for _, part in K.chunks(batch.column(len(keep)))]
            cols = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in counts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in cols]], names=[*keep, *counts])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of an Arrow array."""
    words = K.Words(texts, K.NONSPACE, lower=False)
    n, raw, off = words.texts, words.raw, words.offsets

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    points = (raw & 0xC0) != 0x80  # first bytes of code points
    nonspace = K.NONSPACE[raw]
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    upper = (raw >= 65) & (raw <= 90)
    letters = upper | ((raw >= 97) & (raw <= 122))
    # words in windows that occur twice or more in their text
    h, own, at = words.grams(WINDOW)
    covered = np.zeros(len(words.hash) + WINDOW + 1, dtype=np.int64)
    if len(h):
        order = np.lexsort((h, own))
        sh, so = h[order], own[order]
        same = (sh[1:] == sh[:-1]) & (so[1:] == so[:-1])
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        pos = at[order[twice]]
        np.add.at(covered, pos, 1)
        np.add.at(covered, pos + WINDOW, -1)
    hit = np.cumsum(covered)[: len(words.hash)] > 0
    again = np.zeros(len(words.hash), dtype=bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.owner[1:] == words.owner[:-1])
    sums = lambda flags: np.bincount(words.owner, weights=flags, minlength=n).astype(np.int64)
    dup, lines = lines_of(raw, off, nonspace)
    return {"n_words": words.counts.astype(np.int64), "word_chars": per_text(points & nonspace), "n_symbols": per_text(symbol[raw]), "n_dup_lines": dup, "n_repeat_words": sums(hit), "_lines": lines, "_upper": per_text(upper), "_same": sums(again), "_letters": per_text(letters)}


def lines_of(raw: np.ndarray, off: np.ndarray, nonspace: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word that equal an earlier line of their text, lines with a word) of each text."""
    n = len(off) - 1
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, dtype=bool)
    ends = np.empty(len(starts), dtype=np.int64)
    ends[:-1] = starts[1:] - 1
    if len(starts):
        ends[last] = off[owner[last] + 1]
    up, down = K.powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=K.U)
    np.cumsum((raw.astype(K.U) + K.U(1)) * up[: len(raw)], out=total[1:])
    filled = np.concatenate([[0], np.cumsum(nonspace, dtype=np.int64)])
    full = filled[ends] > filled[starts]
    starts, ends, owner = starts[full], ends[full], owner[full]
    h = K.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(K.U))
    h2, own2, count = K.distinct_counts(h, owner)
    lines = np.bincount(owner, minlength=n)
    return (lines - np.bincount(own2, minlength=n)).astype(np.int64), lines.astype(np.int64)


def with_ratios(m: DataFrame) -> DataFrame:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        m.withColumn("symbol_ratio", over("n_symbols", "n_words")).withColumn("dup_line_ratio", over("n_dup_lines", "_lines"))
        .withColumn("repeat_ratio", over("n_repeat_words", "n_words")).withColumn("upper_ratio", over("_upper", "_letters"))
        .withColumn("same_word_ratio", over("_same", "n_words")).withColumn("long_words", over("word_chars", "n_words"))
        .withColumn("short_words", F.col("long_words")).withColumn("few_words", F.col("n_words").cast("double"))
    )


def binomial_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(Bin(n, p) <= k) = I_{1-p}(n - k, k + 1), by the continued fraction of the incomplete beta."""
    out = np.ones(len(k))
    for i, (a0, b0) in enumerate(zip(n - k, k + 1)):
        if a0 <= 0:
            continue
        out[i] = incomplete_beta(float(a0), float(b0), 1 - p)
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * f


def grid(rule: str) -> tuple[float, float, int]:
    sign, a, b = RULES[rule]
    return sign * a, (sign * b - sign * a) / STEPS, STEPS


def cutoffs(holdout: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule -> cutoff, from the labelled documents of ``holdout`` (measures, stratum, good).

    A document's values become, per rule, the number of grid cutoffs that it exceeds; counts of
    (stratum, rule, number) are aggregated in Spark, so the test sees STEPS + 1 rows a rule.
    """
    over = []
    for rule, (sign, _, _) in RULES.items():
        first, step, n = grid(rule)
        beyond = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((F.col(rule) * sign - F.lit(first)) / F.lit(step))))
        over.append(F.struct(F.lit(rule).alias("rule"), beyond.cast("int").alias("beyond")))
    rows = holdout.select(F.col(stratum).alias("stratum"), "good", F.explode(F.array(*over)).alias("x"))
    counts = rows.groupBy("stratum", "x.rule", "x.beyond").agg(F.sum(F.col("good").cast("long")).alias("n_good"), F.sum((~F.col("good")).cast("long")).alias("n_bad"))

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        rule = pdf["rule"].iloc[0]
        first, step, n = grid(rule)
        total, rejected = {}, {}  # by cutoff i: documents beyond more than i cutoffs
        for kind in ("n_good", "n_bad"):
            at = np.bincount(pdf["beyond"], weights=pdf[kind], minlength=n + 1)
            total[kind], rejected[kind] = at.sum(), at.sum() - np.cumsum(at)[:n]
        fails = np.flatnonzero(binomial_tail(rejected["n_good"], np.full(n, total["n_good"]), risk) > error / len(RULES))
        loosest_first = np.arange(n)[::-1]
        admitted = loosest_first[: n - 1 - fails.max()] if len(fails) else loosest_first
        share = {k: rejected[k] / max(total[k], 1) for k in total}
        gain = (share["n_bad"] - PENALTY * share["n_good"])[admitted]
        rows = []
        if len(admitted) and total["n_good"] and gain.max() > 0:
            i = int(admitted[gain.argmax()])
            rows = [(pdf["stratum"].iloc[0], rule, first + i * step, int(total["n_good"]), int(rejected["n_good"][i]))]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected"], dtype=object)

    return counts.groupBy("stratum", "rule").applyInPandas(admit, "stratum string, rule string, cutoff double, n_good long, n_rejected long")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Base measures, ``base_failed``, ``kept`` and the names of failed rules of every row of ``docs``.

    ``docs``: doc_id, text and the stratum column; ``labels``: doc_id, quality (1: good). A document with
    several label rows is good if all of them are 1.
    """
    m = with_ratios(measures(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    m = checkpointed(m.withColumn("base_failed", base))
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    # rules act on what the base rule leaves, so their holdouts do too
    holdout = m.filter(~F.col("base_failed")).join(marks, "doc_id")
    found = cutoffs(holdout, "stratum", risk, error).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    found = found.withColumnRenamed("stratum", "_of")
    out = m.join(found, F.col("stratum").eqNullSafe(F.col("_of")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) * sign > F.element_at("cut", r), F.lit(r)) for r, (sign, _, _) in RULES.items()]))
    out = out.withColumn("failed_rules", F.when(F.col("cut").isNull(), F.array().cast("array<string>")).otherwise(failed))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))
