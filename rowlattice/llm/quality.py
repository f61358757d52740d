"""Quality rules: fixed limits, then robust multivariate outliers.

Statistics of each text are transformed to a vector: log mean word length, log
symbol rate, log rate of repeated lines, share of repeated words, log length.
For each language and source, the minimum-covariance-determinant estimate of
centre and scatter is found over all its documents that pass the fixed limits.
It has several starts: medians with median absolute deviations, and small
subsets drawn by hash. Concentration steps, each of which takes the mean and the
covariance of the share `core` of the documents nearest to the current estimate,
go on while the determinant of the covariance falls; of all starts the one with
the least determinant wins. A document is rejected if its squared Mahalanobis
distance is above the chi-squared quantile `quantile`.

Vectors are integers (1/256 steps) and ranks come from binned distances, so all
sums and quantiles are exact and don't depend on partitions. Each step is an
aggregation with partial sums; only one row for each group and start is joined
back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlattice.llm._common import cut, small_side, table
from rowlattice.llm._words import SPACE, blocks

WINDOW = 8
SCALE = 256
STATS = ["word_length", "symbols", "dup_lines", "repeats", "length"]
#: The first statistic is this times the log of the mean word length, so its steps are about letters where natural texts lie.
LETTERS = 5.5
#: Least standard deviation of each statistic, so that a statistic that is constant in a group doesn't reject by itself.
FLOORS = [0.35, 0.6, 0.7, 0.09, 1.2]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches, 1, lower=False):
            n = b.n
            before = lambda marks: np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            ends = b.starts + b.lengths
            chars = before(~SPACE[b.bytes] & ((b.bytes & 0xC0) != 0x80))
            symbols = before(_SYMBOL[b.bytes])
            line_ends = np.flatnonzero(b.bytes == 10)
            line_starts = np.concatenate([[0], line_ends[:-1] + 1]).astype(np.int64)
            doc = np.searchsorted(b.starts, line_starts, side="right") - 1
            filled = chars[line_ends] > chars[line_starts]
            keyed = np.stack([doc[filled].astype(np.uint64), b.hash(line_starts, line_ends)[filled]])
            order = np.lexsort(keyed[::-1])
            same = np.all(keyed[:, order][:, 1:] == keyed[:, order][:, :-1], axis=0)
            dup = np.bincount(doc[filled][order[1:][same]], minlength=n)
            h, at = b.windows(WINDOW)
            order = np.lexsort((h, b.doc[at]))
            hs, ds = h[order], b.doc[at][order]
            eq = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
            twice = np.zeros(len(h), bool)
            twice[order[1:][eq]] = True
            twice[order[:-1][eq]] = True
            cover = np.zeros(len(b.words) + 1, np.int64)
            cover[at[twice]] += 1
            np.subtract.at(cover, at[twice] + WINDOW, 1)
            repeat = np.bincount(b.doc[np.cumsum(cover)[:-1] > 0], minlength=n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *(pa.array(x.astype(np.int64)) for x in (b.n_words, chars[ends] - chars[b.starts], symbols[ends] - symbols[b.starts], dup, repeat))], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def vector(df: DataFrame) -> DataFrame:
    """df with x0 .. x4: the transformed statistics in steps of 1/256; logarithms keep them small without a limit."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    made = [LETTERS * F.log(chars / words), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p(1000 * F.col("n_dup_lines") / words), F.col("n_repeat_words") / words, F.log1p(F.col("n_words"))]
    return df.withColumns({f"x{i}": F.round(c * SCALE).cast("long") for i, c in enumerate(made)})


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1 / math.gamma(k / 2 + 1)
    for i in range(1, 2000):
        term *= x / 2 / (k / 2 + i)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-x / 2) * (x / 2) ** (k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _distance(p: int) -> Column:
    """Squared distance of x0 .. from m0 .. under the precision matrix q_i_j."""
    d = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in range(p)]
    out = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            out = out + d[i] * d[j] * F.col(f"q_{i}_{j}") * (1 if i == j else 2)
    return out


def settled(sums: pd.DataFrame, larger: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, precisions and log determinants from counts h, sums s0 .. and sums of products s_0_0 ..; variances are raised to the floors."""
    p = len(STATS)
    c = sums["h"].to_numpy(float)[:, None]
    mean = np.stack([sums[f"s{i}"].to_numpy(float) for i in range(p)], 1) / SCALE / c
    cov = np.empty((len(sums), p, p))
    for i in range(p):
        for j in range(i, p):
            cov[:, i, j] = cov[:, j, i] = sums[f"s_{i}_{j}"].to_numpy(float) / SCALE**2 / c[:, 0] - mean[:, i] * mean[:, j]
    cov *= larger
    for i in range(p):
        cov[:, i, i] = np.maximum(cov[:, i, i], 0) + FLOORS[i] ** 2 * np.clip(1 - cov[:, i, i] / FLOORS[i] ** 2, 0, 1)
    return mean, np.linalg.pinv(cov), np.linalg.slogdet(cov)[1]


def estimates(rows: DataFrame, core: float = 0.75, starts: int = 4, tries: int = 2, least: int = 30, drawn: int = 24) -> DataFrame:
    """lang_, source_, n, m0 .., q_0_0 .., det: centre, precision and log determinant of each language and source with `least` rows or more.

    One start is medians and median absolute deviations, the others are the
    means and covariances of about `drawn` rows chosen by a hash. All make
    `tries` steps, then the best start of each group goes on until its
    determinant falls no more.
    """
    p = len(STATS)
    keys, known = ["lang", "source"], ["lang_", "source_", "start"]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    names = [f"m{i}" for i in range(p)] + [f"q_{i}_{j}" for i, j in pairs]
    schema = "lang_ string, source_ string, start int, n long, " + ", ".join(f"{c} double" for c in names) + ", det double"
    spread = chi2_quantile(core, p)
    larger = core / chi2_cdf(spread, p + 2)  # what the core's covariance lacks of the whole's
    here = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    sums = [F.count("*").alias("h"), *[F.sum(f"x{i}").cast("double").alias(f"s{i}") for i in range(p)], *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)")).cast("double").alias(f"s_{i}_{j}") for i, j in pairs]]

    def settle(scale: float):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                mean, inv, det = settled(f, scale)
                out = f[["lang_", "source_", "start", "n"]].copy()
                yield out.assign(**{f"m{i}": mean[:, i] for i in range(p)}, **{f"q_{i}_{j}": inv[:, i, j] for i, j in pairs}, det=det)

        return run

    med = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.median(f"x{i}") / SCALE).alias(f"m{i}") for i in range(p)]).filter(F.col("n") >= least)
    med = cut(med.withColumnsRenamed({"lang": "lang_", "source": "source_"}))
    groups = med.count()
    mad = rows.join(small_side(med, groups), here).groupBy("lang_", "source_", "n", *[f"m{i}" for i in range(p)]).agg(*[(F.median(F.abs(F.col(f"x{i}") / SCALE - F.col(f"m{i}"))) * 1.4826).alias(f"s{i}") for i in range(p)])
    params = mad.select("lang_", "source_", F.lit(0).alias("start"), "n", *[f"m{i}" for i in range(p)], *[(1 / F.pow(F.greatest(F.col(f"s{i}"), F.lit(FLOORS[i])), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"q_{i}_{j}") for i, j in pairs], F.lit(math.inf).alias("det"))
    if starts > 1:
        few = rows.join(small_side(med.select("lang_", "source_", "n"), groups), here).withColumn("start", F.explode(F.array(*[F.lit(s) for s in range(1, starts)])))
        few = few.filter(F.pmod(F.xxhash64("start", "doc_id", *[f"x{i}" for i in range(p)]), F.col("n")) < drawn)
        params = params.unionByName(few.groupBy(*known, "n").agg(*sums).filter("h > 1").mapInPandas(settle(1.0), schema).withColumn("det", F.lit(math.inf)))
    params = cut(params)

    def step(params: DataFrame, n: int) -> DataFrame:
        near = rows.join(small_side(params, n), here).withColumn("bin", F.floor(F.log1p(F.greatest(_distance(p), F.lit(0.0))) * 256))
        limit = near.groupBy(*known).agg(F.percentile("bin", core).alias("limit")).withColumnsRenamed({"lang_": "l_", "source_": "o_", "start": "t_"})
        kept = near.join(small_side(limit, n), F.col("lang_").eqNullSafe(F.col("l_")) & F.col("source_").eqNullSafe(F.col("o_")) & (F.col("start") == F.col("t_"))).filter(F.col("bin") <= F.col("limit"))
        return cut(kept.groupBy(*known, "n").agg(*sums).mapInPandas(settle(larger), schema))

    for _ in range(tries):
        params = step(params, groups * starts)
    every = ["start", "n", *names, "det"]
    chosen = cut(params.groupBy("lang_", "source_").agg(F.min_by(F.struct(*every), F.struct("det", "start")).alias("x")).select("lang_", "source_", "x.*"))
    open_ = chosen
    while not open_.isEmpty():
        new = step(open_, groups).select(*[F.col(c).alias(f"{c}1") for c in ("lang_", "source_", *every)])
        both = cut(open_.join(small_side(new, groups), F.col("lang_").eqNullSafe(F.col("lang_1")) & F.col("source_").eqNullSafe(F.col("source_1"))))
        open_ = cut(both.filter(F.col("det1") < F.col("det") - 1e-6).select("lang_", "source_", *[F.col(f"{c}1").alias(c) for c in every]))
        done = open_.select(F.col("lang_").alias("lang_1"), F.col("source_").alias("source_1"))
        stay = chosen.join(small_side(done, groups), F.col("lang_").eqNullSafe(F.col("lang_1")) & F.col("source_").eqNullSafe(F.col("source_1")), "left_anti")
        chosen = cut(stay.unionByName(open_))
    return chosen.drop("start")


def judged(docs: DataFrame, quantile: float = 0.999999, core: float = 0.75, **columns) -> DataFrame:
    """doc_id, the statistics, base_failed, distance and kept for each row of docs.

    A group of fewer than 30 rows that pass the fixed limits is held against the
    estimate of its whole language, and if that has fewer too, its rows have a
    null distance and are kept. Statistics that hardly vary in a group count as
    if they varied by FLOORS, so that the least difference doesn't reject. Equal
    vectors have equal distances and are judged alike; a distance that equals
    the quantile is kept. A null text has no words and fails the limits. A null
    language or source is a value of its own. Repeated rows count as often as
    they are there. Other columns are not read, so their names may clash. An
    empty table gives an empty table. Memory follows the longest text, by about
    a hundred bytes for each of its bytes.
    """
    stats = statistics(docs, **columns)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = cut(vector(stats.withColumn("base_failed", failed)))
    good = rows.filter("NOT base_failed")
    both = rows
    for name, params, same in (("near", estimates(good, core), F.col("source").eqNullSafe(F.col("source_"))), ("wide", estimates(good.withColumn("source", F.lit("")), core), F.lit(True))):
        both = both.join(small_side(params.drop("n", "det"), params.count()), F.col("lang").eqNullSafe(F.col("lang_")) & same, "left")
        both = both.withColumn(name, _distance(len(STATS))).drop(*[c for c in params.columns if c not in ("n", "det")])
    both = both.withColumn("distance", F.coalesce("near", "wide"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(quantile, len(STATS)), F.lit(True))).alias("kept"), "distance")


def op8(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
