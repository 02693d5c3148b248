"""Quality rules with risk-controlled thresholds.

Every document gets counts over its whole text and, from them, five ratios.  Labelled documents are split by a hash of their id
into a design half and a holdout.  For each stratum (language) and ratio, thresholds are tried from the most lenient to the
strictest; a threshold holds while the exact (Clopper-Pearson) upper bound of the holdout's false rejections stays within
``alpha`` over the number of ratios.  Trials are distinct documents: rows alike in doc_id or in text count once, as copies say nothing
new about the false rejections.  The sequence stops at the first that fails, so the tests within it need no correction;
over strata and ratios ``delta`` is divided (Bonferroni).  So with probability 1 - delta no stratum loses more than alpha of its
good documents.  Ratios take their turns; of the thresholds that hold, the design half picks the one that rejects the most bad
documents of those that no ratio before rejects, less ``cost`` times the good ones, the most lenient on ties.  One without a gain is
not used, so good documents aren't spent on what another ratio or the base rule has caught.

Cases: null or empty text has no words and fails the base rule; a null language is the stratum ""; a stratum without enough labels
rejects by the base rule only; label rows with a null are ignored, and of several rows for a document the worst counts; repeated
documents are judged alike and count as one label, the worst, held in or out together; empty tables give no rows; ``clean`` passes other columns through untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_top_word"]
#: ratio -> (counted, out of).
RATIOS = {"symbols": ("n_symbols", "word_chars"), "upper": ("n_upper", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "top_word": ("n_top_word", "n_words")}
BINS = 64

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_NOT_IN_WORDS = bytes([0x20, *range(9, 14), *range(0x80, 0xC0)])  # white space and all but the first byte of a character
_WINDOW = 5
_SLICE = 1 << 19


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text, as columns."""
    n = len(offsets) - 1
    out, hashes = np.zeros((n, len(COUNTS)), np.int64), []
    for i in range(n):
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, [0, 1, 2, 3, 5, 6]] = len(words), len(text.translate(None, _NOT_IN_WORDS)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), len(lines), len(text) - len(text.translate(None, _UPPER))
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
    words, ends = np.concatenate([*hashes, np.zeros(0, np.int64)]), np.cumsum(out[:, 0])
    owner = np.repeat(np.arange(n), out[:, 0])
    out[:, 4] = np.bincount(owner, _repeated(words, owner, ends), n)
    keys = common.mix(words.view(np.uint64)) + common.mix(owner.astype(np.uint64))
    order = np.argsort(keys)
    at = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
    np.maximum.at(out[:, 7], owner[order[at]], np.diff(np.append(at, len(keys))))
    return out


def _repeated(words: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each word in a window of five that its text holds twice or more."""
    n = len(words)
    cover = np.zeros(n + 1, np.int64)
    if n >= _WINDOW:
        mixed = common.mix(words.view(np.uint64))
        m = n - _WINDOW + 1
        key = common.mix(owner[:m].astype(np.uint64))
        for j in range(_WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + m]
        inside = np.flatnonzero(np.arange(m) + _WINDOW <= ends[owner[:m]])
        order = inside[np.argsort(key[inside])]
        same = key[order][1:] == key[order][:-1]
        same &= owner[order][1:] == owner[order][:-1]
        for j in range(_WINDOW):
            same[same] = words[order[1:][same] + j] == words[order[:-1][same] + j]
        twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + _WINDOW, -1)
    return np.cumsum(cover)[:n] > 0


def bins(found: np.ndarray) -> np.ndarray:
    """The bin of each ratio, 0 where nothing is counted."""
    at = {c: found[:, i] for i, c in enumerate(COUNTS)}
    return np.stack([np.minimum(BINS, -(-BINS * at[a] // np.maximum(1, at[b]))) for a, b in RATIOS.values()], 1)


def base_failed(found: np.ndarray, least_words: int = 10, repeat_percent: int = 20) -> np.ndarray:
    return (found[:, 0] < least_words) | (100 * found[:, 4] > repeat_percent * found[:, 0])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, same (a hash of the text), the counts and the bin of each ratio."""

    common.small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(2))
            for a, b in common.slices(offsets, _SLICE):
                found = counts(data, offsets[a : b + 1])
                same = [int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=8).digest(), "little", signed=True) for i in range(a, b)]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(same, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in (*found.T, *bins(found).T)), pa.array(base_failed(found))]
                yield pa.record_batch(columns, names=["doc_id", "stratum", "same", *COUNTS, *RATIOS, "base_failed"])

    kinds = ", ".join(f"{c} long" for c in (*COUNTS, *RATIOS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, stratum string, same long, {kinds}, base_failed boolean")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a proportion of which k in n were seen (Clopper-Pearson)."""
    if k >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(k + 1, n - k, mid) < 1 - delta else (lo, mid)
    return hi


def trials_needed(alpha: float, delta: float, strata: int) -> int:
    """Good holdout documents without which no bound can hold, even if none of them is rejected."""
    return math.ceil(math.log(delta / (strata * len(RATIOS))) / math.log1p(-alpha / len(RATIOS)))


def with_enough(held: dict[str, int], alpha: float, delta: float) -> list[str]:
    """The strata whose bounds can hold while delta is divided by their number; the one with the fewest documents goes first."""
    left = sorted(held, key=lambda s: (held[s], s))
    while left and held[left[0]] < trials_needed(alpha, delta, len(left)):
        left.pop(0)
    return sorted(left)


def fit(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, cost: int = 5) -> dict[str, dict[str, int]]:
    """stratum -> ratio -> the highest bin that is kept; cost: bad documents that one good document outweighs.

    All labelled rows enter histograms; the driver gets one row for each stratum and bin, of those strata only that have the good
    holdout documents without which no bound can hold."""
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # a trial is a text of a stratum: its bins follow from the text, its label is the worst of its rows', and its half from its hash
    trial = measured.where(~F.col("base_failed")).join(judged, "doc_id").groupBy("stratum", "same").agg(F.min("quality").alias("quality"), F.min("doc_id").alias("doc_id"), *(F.max(r).alias(r) for r in RATIOS))
    # rows of one doc_id with several texts are one document still: its worst text in each respect
    one = trial.groupBy("stratum", "doc_id").agg(F.min("quality").alias("quality"), F.min("same").alias("same"), *(F.max(r).alias(r) for r in RATIOS))
    rows = common.checkpoint(one.select("stratum", (F.pmod(F.xxhash64("same"), F.lit(2)) == 0).alias("holdout"), (F.col("quality") > 0).alias("good"), *RATIOS))
    held = {r.stratum: r.m for r in rows.where("holdout AND good").groupBy("stratum").agg(F.count("*").alias("m")).where(F.col("m") >= trials_needed(alpha, delta, 1)).collect()}
    strata = with_enough(held, alpha, delta)
    if not strata:
        return {}
    out: dict[str, dict[str, int]] = {}
    for ratio in RATIOS:
        # the bound sees all holdout documents, the choice only those of the design half that no ratio before rejects
        left = judge(rows, out).where("holdout OR size(rejected_by) = 0")
        counts: dict[tuple, np.ndarray] = {}
        for r in left.where(F.col("stratum").isin(strata)).groupBy("stratum", "holdout", "good", F.col(ratio).alias("bin")).agg(F.count("*").alias("n")).collect():
            counts.setdefault((r.stratum, r.holdout, r.good), np.zeros(BINS + 1, np.int64))[r.bin] += r.n
        for s in strata:
            none = np.zeros(BINS + 1, np.int64)
            held, good, bad = counts.get((s, True, True), none), counts.get((s, False, True), none), counts.get((s, False, False), none)
            best = (0, BINS)
            for t in range(BINS - 1, -1, -1):
                if upper_bound(int(held[t + 1 :].sum()), int(held.sum()), delta / (len(strata) * len(RATIOS))) > alpha / len(RATIOS):
                    break
                best = max(best, (int(bad[t + 1 :].sum()) - cost * int(good[t + 1 :].sum()), t))
            if best[0] > 0:
                out.setdefault(s, {})[ratio] = best[1]
    return out


def judge(measured: DataFrame, thresholds: dict[str, dict[str, int]]) -> DataFrame:
    """Adds rejected_by, the ratios over their thresholds."""
    over = [F.when(F.coalesce(*(F.when(F.col("stratum") == s, F.lit(t[r])) for s, t in thresholds.items() if r in t), F.lit(BINS)) < F.col(r), F.lit(r)) for r in RATIOS]
    return measured.withColumn("rejected_by", F.array_compact(F.array(*over)))


def report(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of each document; the texts are read once, the counts kept in the shared folder."""
    measured = common.checkpoint(measure(docs))
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return judge(measured, fit(measured, labels, alpha, delta)).withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def clean(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that are kept, with all their columns; texts are measured once to fit and once to filter, and don't move."""
    thresholds = fit(measure(docs), labels, alpha, delta)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(text))
            strata = batch.column(lang).cast(pa.string()).fill_null("").to_pylist()
            for a, b in common.slices(offsets, _SLICE):
                found = counts(data, offsets[a : b + 1])
                most = np.array([[thresholds.get(s, {}).get(r, BINS) for r in RATIOS] for s in strata[a:b]])
                yield batch.slice(a, b - a).filter(pa.array(~base_failed(found) & (bins(found) <= most).all(1)))

    return docs.mapInArrow(run, docs.schema)
