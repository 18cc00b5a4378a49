"""Quality rules: fixed limits, then robust multivariate outliers per language and source (minimum covariance determinant)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import PrefixHash, Words, chunks, mix, no_text, texts_of, whole, windows, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
FEATURES = ("log_words", "log_word_chars", "symbol_share", "dup_lines", "repeat_share")
#: Least standard deviation of each feature: below it differences mean nothing.
FLOORS = (0.5, 0.08, 0.03, 0.08, 0.08)
#: Share of rows in the least-determinant subset, concentration steps, and the largest distance.
SUBSET, STEPS, RADIUS = 0.75, 3, 9.0
#: Rows that the language's estimate counts as in a group's own: as many as a centre and a covariance have numbers.
PRIOR_ROWS = len(FEATURES) * (len(FEATURES) + 3) // 2
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[begins])


def repeated_words(words: Words, width: int = WINDOW) -> np.ndarray:
    """Per text, the number of words in a window of `width` words that the text holds twice or more."""
    n = len(words.hash)
    texts = len(words.first) - 1
    keys = windows(words.hash, width, 0xD6E8FEB86659FD93)
    if not len(keys):
        return np.zeros(texts, np.int64)
    text = words.text_of()
    at = np.flatnonzero(whole(words.first, width, len(keys)))
    keys = mix(keys[at] ^ (text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return _per_text(covered, words.first)


def text_statistics(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Base statistics of every whole text, with the columns of `keep`. One Arrow batch at a time, nothing is shuffled."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                words = words_of(texts)
                data, begins = texts.data, texts.begins
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, words.start, 1)
                np.add.at(inside, words.end, -1)
                points = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
                edge = np.zeros(len(data) + 1, dtype=bool)
                edge[begins] = True
                edge[1:][data == 10] = True
                start = np.flatnonzero(edge[:-1])
                end = np.append(start[1:], len(data))
                end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
                has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
                start, end = start[has], end[has]
                owner = np.searchsorted(begins, start, side="right") - 1
                lines = np.bincount(owner, minlength=len(begins) - 1)
                seen = mix(PrefixHash(data).of(start, end) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(start) else np.zeros(0, np.uint64)
                kinds = np.unique(seen, return_index=True)[1]
                different = np.bincount(owner[kinds], minlength=len(begins) - 1)
                found = {
                    "n_words": np.diff(words.first),
                    "word_chars": _per_text(points, begins),
                    "n_symbols": _per_text(_SYMBOL[data], begins),
                    "n_dup_lines": lines - different,
                    "n_repeat_words": repeated_words(words),
                    "n_lines": lines,
                }
                columns = [piece.column(i) for i in range(piece.num_columns) if piece.schema.names[i] != "text"]
                names = [n for n in piece.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, pa.int64()) for v in found.values()]], [*names, *found])

    picked = docs.select(docs[id_col].alias("id"), *[docs[c].alias(f"by_{i}") for i, c in enumerate(keep)], no_text(text_col).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema if f.name != "text")
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    return picked.mapInArrow(measure, f"{schema}, " + ", ".join(f"{m} long" for m in measured))


def features() -> list[Column]:
    """Transformed statistics: logs of sizes, square roots of shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= x / (a + k)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, d) < p else (low, middle)
    return high


MODEL = "grp string, centre array<double>, spread array<double>, inverse array<double>"


def _solved(sums: DataFrame, share: float | None) -> DataFrame:
    """Centre, covariance and its inverse per group from its sums; covariances of a trimmed subset are scaled up to consistency.

    Where a group has a prior (`prior_centre`, `prior_spread`), both are drawn to it with a weight that falls as n grows.
    """
    d = len(FEATURES)
    scale = 1.0 if share is None else share / chi2_cdf(chi2_quantile(share, d), d + 2)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                centre, spread, floor = np.zeros(d), np.zeros((d, d)), np.diag(np.square(FLOORS))
                if row.n:
                    centre = np.asarray(row.first, float) / row.n
                    spread = scale * (np.asarray(row.second, float).reshape(d, d) / row.n - np.outer(centre, centre)) + floor
                if row.prior_centre is not None:
                    own = row.n / (row.n + PRIOR_ROWS)
                    centre = own * centre + (1 - own) * np.asarray(row.prior_centre, float)
                    spread = own * spread + (1 - own) * np.asarray(row.prior_spread, float).reshape(d, d)
                out.append((row.grp, centre.tolist(), spread.ravel().tolist(), np.linalg.inv(spread).ravel().tolist()))
            yield pd.DataFrame(out, columns=["grp", "centre", "spread", "inverse"])

    return sums.mapInPandas(solve, MODEL)


def _sums(rows: DataFrame) -> DataFrame:
    x = [F.col("x")[i] for i in range(len(FEATURES))]
    return rows.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(a) for a in x]).alias("first"),
        F.array(*[F.sum(a * b) for a in x for b in x]).alias("second"),
    )


def _distance() -> Column:
    d = len(FEATURES)
    gap = [F.col("x")[i] - F.col("centre")[i] for i in range(d)]
    return sum((gap[i] * gap[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))


def _estimate(fit: DataFrame, group: str, priors: DataFrame) -> DataFrame:
    """Robust estimate of every group: medians, three concentration steps, one reweighting; `priors` has a row per group."""
    from .shared import written

    d = len(FEATURES)
    fit = fit.select(F.col(group).alias("grp"), "x")
    # Medians and median deviations as sums of a single row each, so that the start is drawn to the prior like the steps.
    half = [F.percentile_approx(F.col("x")[i], 0.5).alias(f"m{i}") for i in range(d)]
    middle = fit.groupBy("grp").agg(F.count("*").alias("n"), *half).select("grp", "n", F.array(*[f"m{i}" for i in range(d)]).alias("middle"))
    away = fit.join(middle, "grp")
    spread = away.groupBy("grp", "n", "middle").agg(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("middle")[i]), 0.5).alias(f"s{i}") for i in range(d)])
    m = [F.col("middle")[i] for i in range(d)]
    second = [F.col("n") * (m[i] * m[j] + (F.pow(F.col(f"s{i}") * 1.4826, 2) if i == j else F.lit(0.0))) for i in range(d) for j in range(d)]
    sums = spread.select("grp", "n", F.array(*[F.col("n") * a for a in m]).alias("first"), F.array(*second).alias("second"))
    for step in range(STEPS + 2):
        # A group none of whose rows is near has its prior alone.
        counted = priors.join(sums, "grp", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        model = written(_solved(counted, None if step == 0 else SUBSET if step <= STEPS else 0.975), "centres")
        if step > STEPS:
            return model
        placed = fit.join(model, "grp").withColumn("distance", _distance())
        if step < STEPS:
            limits = placed.groupBy("grp").agg(F.percentile_approx("distance", SUBSET, 10_000).alias("limit"))
            near = placed.join(limits, "grp").where(F.col("distance") <= F.col("limit"))
        else:
            near = placed.where(F.col("distance") <= chi2_quantile(0.975, d))
        sums = _sums(near)


def quality(
    docs: DataFrame,
    by: tuple[str, ...] = ("lang", "source"),
    radius: float = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: base statistics, `base_failed`, squared robust distance and `kept`.

    Centres and covariances cover every row that passes the base rules: each step aggregates sums per group with map-side
    combining, so a hot group is never gathered. Steps start at medians and median deviations, keep the nearest 75 % of a
    group's rows, and end with one reweighted estimate. Every group has its own estimate, drawn to that of its first column
    (the language) by n / (n + 20), whatever its size. Null texts count as empty (and fail), null group columns form their own
    group, repeated rows count each, an empty table gives no rows.
    """
    from .shared import written

    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    names = [f"by_{i}" for i in range(len(by))]
    rows = text_statistics(docs, id_col, text_col, list(by)).withColumn("base_failed", base).withColumn("x", F.array(*features()))
    rows = rows.withColumn("grp", F.to_json(F.struct(*names)) if names else F.lit("all"))
    rows = rows.withColumn("parent", F.to_json(F.struct(*names[:1])) if names else F.lit("all")).drop(*names)
    rows = written(rows, "statistics")
    fit = rows.where(~F.col("base_failed"))
    none = F.lit(None).cast("array<double>")
    languages = fit.select(F.col("parent").alias("grp")).distinct().select("grp", none.alias("prior_centre"), none.alias("prior_spread"))
    parents = _estimate(fit, "parent", languages).select(F.col("grp").alias("parent"), F.col("centre").alias("prior_centre"), F.col("spread").alias("prior_spread"))
    groups = fit.select("grp", "parent").distinct().join(parents, "parent").drop("parent")
    model = _estimate(fit, "grp", groups)
    final = rows.join(model, "grp", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= radius**2)
    return final.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance"
    )
