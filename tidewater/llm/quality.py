"""Quality rules with risk-controlled thresholds.

Each rule compares one number of a document with a cutoff of its stratum
(here: the language). Cutoffs come from labelled documents: going from the
laxest cutoff to stricter ones, a cutoff is certified while the exact binomial
(Clopper-Pearson) upper bound on the share of good documents it rejects stays
at or below ``RISK``; the walk ends at the first that fails (fixed-sequence
testing), and the error level is divided by the number of rules and strata
(Bonferroni), so with probability 1 - ``LEVEL`` all certified cutoffs hold at
once. Of the certified cutoffs a rule uses the one that rejects most bad
documents, where a rejected good one outweighs ``GOOD_WEIGHT`` bad ones. A
rule without a certified cutoff rejects nothing in that stratum.

All labelled rows count; they are reduced to histograms of ``STEPS`` bins per
stratum and rule before anything leaves the executors.

Defined results: null texts have no words and fail the base rule; a null or
unknown stratum has no cutoffs; labels with null ids or values are ignored,
of repeated ones the lowest counts; repeated rows each give a row; extra
columns are ignored by ``judge`` and kept by ``keep_good``, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._spark import cut, maybe_among, whole_row
from ._text import IS_SPACE, mix, range_hash, slices, tidy, word_bounds

RISK, LEVEL, GOOD_WEIGHT, STEPS = 0.05, 0.05, 20, 64
SYMBOLS = b"#*$%&|<>"
MOST_STRATA = 10_000  # above it the cutoffs are joined by a shuffle, not broadcast

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper", "n_bare_words"]
#: rule: (numerator, denominator, value of the highest bin)
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.5),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 0.5),
    "upper": ("n_upper", "word_chars", 1.0),
    "bare_words": ("n_bare_words", "n_words", 0.6),
    "long_words": ("word_chars", "n_words", 32.0),
}


def count_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row of a slice."""
    n = len(offsets) - 1
    row_sum = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    inside = ~IS_SPACE[data]
    start, end, first = word_bounds(data, offsets)
    of_row = np.repeat(np.arange(n), np.diff(first)).astype(np.uint64)
    out = {"n_words": np.diff(first), "word_chars": row_sum(inside & ((data & 0xC0) != 0x80)), "n_symbols": row_sum(_IS_SYMBOL[data]), "n_upper": row_sum(_IS_UPPER[data])}
    letter = np.concatenate([[0], np.cumsum(((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data >= 0x80))])
    out["n_bare_words"] = np.bincount(of_row.astype(np.int64)[letter[end] == letter[start]], minlength=n) if len(start) else np.zeros(n, np.int64)

    line_end = np.union1d(np.flatnonzero(data == 10), offsets[1:])  # a break, or the end of a row
    line_start = np.concatenate([[0], line_end[:-1] + (data[np.minimum(line_end[:-1], max(0, len(data) - 1))] == 10)]) if len(line_end) else np.zeros(0, np.int64)
    keep = line_start < line_end
    line_start, line_end = line_start[keep], line_end[keep]
    word_at = np.concatenate([[0], np.cumsum(inside)])
    real = word_at[line_end] > word_at[line_start]
    line_start, line_end = line_start[real], line_end[real]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    key = mix(range_hash(data, line_start, line_end, lower=False) + mix(line_row.astype(np.uint64)))
    _, once = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[once], minlength=n)

    words = range_hash(data, start, end, lower=False)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(words) >= 3:
        own = of_row[:-2] == of_row[2:]
        window = mix((words[:-2] * np.uint64(0xD6E8FEB86659FD93) + words[1:-1]) * np.uint64(0xA0761D6478BD642F) + words[2:] + mix(of_row[:-2]))
        at = np.flatnonzero(own)
        _, which, times = np.unique(window[at], return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        marked = np.zeros(len(words), bool)
        for k in range(3):
            marked[twice + k] = True
        out["n_repeat_words"] = np.bincount(of_row[marked].astype(np.int64), minlength=n)
    return out


def _features(rows: DataFrame) -> DataFrame:
    """COUNTS after the other columns of ``rows``; the text is the column ``text``, which is not passed on, or the field ``text`` of the struct ``row``, which is."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    held, names = "row" in rows.columns, [f.name for f in rows.schema.fields]

    def run(batches):
        for batch in batches:
            text = pc.struct_field(batch.column(names.index("row")), "text") if held else batch.column(names.index("text"))
            for lo, hi, data, offsets in slices(text):
                got = count_features(data, offsets)
                own = [batch.column(names.index(f.name)).slice(lo, hi - lo) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=[*(f.name for f in kept), *COUNTS])

    return rows.mapInArrow(tidy(run), StructType([*kept, *(StructField(c, LongType()) for c in COUNTS)]))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(rule: str):
    over, under, top = RULES[rule]
    return F.when(F.col(under) > 0, F.least(F.lit(STEPS - 1), F.floor(F.col(over) / F.col(under) * (STEPS / top)))).otherwise(F.lit(0)).cast("int")


def binomial_upper(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest share under which at most k of n still has probability ``level``."""
    if k >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(log_choose)) if 0 < p < 1 else float(p <= 0)
        low, high = (p, high) if tail > level else (low, p)
    return high


def certified_cutoff(good: np.ndarray, bad: np.ndarray, level: float) -> int:
    """The bin from which on the rule rejects; STEPS (never) if no cutoff is certified or useful."""
    n, best, value = int(good.sum()), STEPS, 0
    if not n:
        return STEPS
    for at in range(STEPS - 1, 0, -1):
        lost = int(good[at:].sum())
        if lost > RISK * n or binomial_upper(lost, n, level) > RISK:
            break
        gain = int(bad[at:].sum()) - GOOD_WEIGHT * lost
        if gain > value:
            best, value = at, gain
    return best


def cutoffs(labelled: DataFrame) -> DataFrame:
    """(stratum, cut_<rule>...) from rows of stratum, is_good and COUNTS; documents that fail the base rule don't count."""
    binned = labelled.where(~base_failed()).select("stratum", "is_good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _bin(r).alias("bin")) for r in RULES))).alias("x"))
    table = binned.groupBy("stratum", "x.rule", "x.bin").agg(F.sum(F.col("is_good").cast("long")).alias("good"), F.sum((~F.col("is_good")).cast("long")).alias("bad"))
    table = cut(table)
    level = LEVEL / max(1, len(RULES) * table.select("stratum").distinct().count())

    def of_stratum(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = []
        for rule in RULES:
            own = rows[rows["rule"] == rule]
            good, bad = (np.bincount(own["bin"], weights=own[c], minlength=STEPS).astype(np.int64) for c in ("good", "bad"))
            cuts.append(certified_cutoff(good, bad, level))
        return pd.DataFrame([[rows["stratum"].iloc[0], *cuts]], columns=["stratum", *(f"cut_{r}" for r in RULES)])

    return table.groupBy("stratum").applyInPandas(of_stratum, "stratum string, " + ", ".join(f"cut_{r} int" for r in RULES))


def _labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_quality"))
    return features.where("stratum is not null").join(marks, F.col("doc_id") == F.col("_id")).select("stratum", (F.col("_quality") == 1).alias("is_good"), *COUNTS)


def _judged(features: DataFrame, cuts: DataFrame) -> DataFrame:
    cuts = cut(cuts.where("stratum is not null").withColumnRenamed("stratum", "_stratum"))
    if cuts.count() <= MOST_STRATA:
        cuts = F.broadcast(cuts)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (_bin(r) >= F.coalesce(F.col(f"cut_{r}"), F.lit(STEPS)))
    out = features.join(cuts, F.col("stratum") == F.col("_stratum"), "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *(f"cut_{r}" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, BASE..., base_failed, kept, stratum), a row for each row of ``docs``."""
    features = cut(_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), "text")))
    return _judged(features, cutoffs(_labelled(features, labels))).select("doc_id", *BASE, "base_failed", "kept", "stratum")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whatever their other columns are called.

    Rows travel as one struct. Features are counted twice for labelled
    documents only (a broadcast filter of ids, ahead of the exact join, finds
    them), so no copy of the texts is written and none is shuffled.
    """
    id_ = F.col("doc_id").cast("long").alias("doc_id")
    some = maybe_among(docs.select(id_, F.col("lang").cast("string").alias("stratum"), "text"), labels.where("quality is not null").select(id_), ["doc_id"])
    cuts = cutoffs(_labelled(cut(_features(some)), labels))
    rows = docs.select(whole_row(docs).alias("row"), F.col("lang").cast("string").alias("stratum"))
    return _judged(_features(rows), cuts).where("kept").select("row.*")
