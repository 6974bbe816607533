"""Quality rules: document statistics, and robust outliers within each language and source.

Location and scatter of each group come from a minimum covariance determinant search: from the
medians, keep the half of the documents nearest by Mahalanobis distance, estimate anew from them,
repeat until no group's determinant falls. A step is one pass over a narrow table with map-side sums per group and distance bin.
No group is ever gathered in one task, whatever share of the rows it holds.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, map_columns
from evalspark.session import materialize

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# The transformed statistics and the least spread each is given. A statistic that is zero in
# nearly all documents would otherwise turn its first small value into an outlier. Each is small
# enough for its statistic to reject a document alone.
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share")
LEAST_SPREAD = (0.3, 0.3, 0.03, 0.05, 0.07)
P = len(FEATURES)
# Share of a group's documents that the estimates rest on: with half of them, nearly half may be
# junk. The least spreads keep the scatter regular, for which h = (n + p + 1) / 2 adds its p + 1.
SUPPORT = 0.5
# A group rests once a step lowers its determinant by less than this share. Steps at most.
LEAST_FALL = 1e-9
STEPS = 100
# A document is rejected if a document of its group would lie so far out with a smaller chance.
TAIL = 1e-3
# Rows of a group are spread over this many join keys.
SALTS = 64
# Bins per doubling of the squared distance.
BINS = 8
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi_square_quantile(p: float, dof: int) -> float:
    """By the cube-root approximation of Wilson and Hilferty."""
    z = NormalDist().inv_cdf(p)
    return dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3


def statistics_of(text: str) -> tuple[int, int, int, int, int]:
    """The values of ``BASE`` for one text."""
    words = WORD.findall(text)
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup_lines += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        repeated_words(words),
    )


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    once, again = set(), set()
    for w in windows:
        (again if w in once else once).add(w)
    if not again:
        return 0
    covered = end = 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def _measure():
    def work(ids, texts, groups):
        rows = [statistics_of(t or "") for t in texts]
        columns = zip(*rows) if rows else [[] for _ in BASE]
        return {"doc_id": ids, "grp": groups, **dict(zip(BASE, map(list, columns)))}

    return work


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``grp`` (language and source; null is a value of its own) and ``BASE``."""

    def marked(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))

    grp = F.concat_ws("\x1f", marked("lang"), marked("source"))
    schema = "doc_id bigint, grp string, " + ", ".join(f"{c} bigint" for c in BASE)
    return map_columns(docs.select("doc_id", "text", grp.alias("grp")), _measure, schema)


def _features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.col("word_chars") / words,
        F.col("n_symbols") / words,
        F.sqrt(F.col("n_dup_lines") / words),
        F.col("n_repeat_words") / words,
    ]


def _with_features(stats: DataFrame) -> DataFrame:
    salt = F.pmod(F.xxhash64("doc_id", *BASE), F.lit(SALTS)).cast("int")
    return stats.withColumns(dict(zip(FEATURES, _features()))).withColumn("salt", salt)


def _floor() -> np.ndarray:
    return np.diag(np.square(LEAST_SPREAD))


def _parameters(grp: str, center: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    inverse = np.linalg.inv(scatter)
    return pd.DataFrame(
        {
            "grp": [grp],
            "center": [center.tolist()],
            "inverse": [inverse.ravel().tolist()],
            "det": [float(np.linalg.det(scatter))],
        }
    )


_PARAMETERS = "grp string, center array<double>, inverse array<double>, det double"


def _start(data: DataFrame) -> DataFrame:
    """Medians and quartile spreads per group, from counts of values rounded to 1/256."""
    value = F.explode(
        F.array(*(F.struct(F.lit(i).alias("f"), F.round(F.col(c) * 256).alias("v")) for i, c in enumerate(FEATURES)))
    )
    counts = (
        data.select("grp", value.alias("x"))
        .groupBy("grp", F.col("x.f").alias("f"), F.col("x.v").alias("v"))
        .agg(F.count("*").alias("n"))
    )

    def of(key, rows: pd.DataFrame) -> pd.DataFrame:
        center, spread = np.zeros(P), np.zeros(P)
        for f, part in rows.groupby("f"):
            part = part.sort_values("v")
            below = part["n"].cumsum().to_numpy()
            low, mid, high = (
                part["v"].to_numpy()[np.searchsorted(below, q * below[-1])] / 256
                for q in (0.25, 0.5, 0.75)
            )
            center[f], spread[f] = mid, (high - low) / 1.349
        return _parameters(key[0], center, np.diag(spread**2) + _floor())

    # The quartiles' determinant is no step's: the first step always counts.
    return counts.groupBy("grp").applyInPandas(of, _PARAMETERS).withColumn("det", F.lit(math.inf))


def _distance() -> Column:
    """Squared Mahalanobis distance to the group's estimates."""
    d = [F.col(c) - F.col("center")[i] for i, c in enumerate(FEATURES)]
    terms = [
        d[i] * d[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i, j in _PAIRS
    ]
    return sum(terms[1:], terms[0])


def _joined(data: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each row with its group's estimates; the rows of a group go to ``SALTS`` keys."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    copies = parameters.select("grp", "center", "inverse", salt)
    return data.join(copies, ["grp", "salt"]).withColumn("distance", _distance())


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    first = [F.sum(c).alias(f"s{i}") for i, c in enumerate(FEATURES)]
    second = [
        F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in _PAIRS
    ]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *first, *second)


def _estimate(sums: pd.Series | pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Center and scatter from sums, before the least spread is added."""
    n = float(sums["n"])
    center = np.array([sums[f"s{i}"] for i in range(P)]) / n
    scatter = np.zeros((P, P))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = sums[f"q{i}_{j}"] / n - center[i] * center[j]
    return center, scatter


def _concentrate(data: DataFrame, parameters: DataFrame) -> DataFrame:
    """One step: estimates from the nearest ``SUPPORT`` of each group, to the end of a bin."""
    place = F.floor(F.log2(F.greatest(F.col("distance"), F.lit(1e-6))) * BINS).cast("int")
    sums = _sums(_joined(data, parameters).withColumn("bin", place), "grp", "bin")
    consistent = SUPPORT / _share_of_scatter(SUPPORT)

    def of(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        enough = np.searchsorted(rows["n"].cumsum().to_numpy(), SUPPORT * rows["n"].sum())
        center, scatter = _estimate(rows.iloc[: enough + 1].drop(columns=["grp", "bin"]).sum())
        return _parameters(key[0], center, scatter * consistent + _floor())

    return sums.groupBy("grp").applyInPandas(of, _PARAMETERS)


def _improved(before: DataFrame, after: DataFrame) -> DataFrame:
    """The estimates of ``after`` where their determinant is smaller, else those of ``before``."""
    names = ("center", "inverse", "det")
    old = before.select("grp", *(F.col(c).alias(f"old_{c}") for c in names))
    return (
        after.join(old, "grp")
        .withColumn("moved", F.col("det") < F.col("old_det") * (1 - LEAST_FALL))
        .select("grp", *(F.when(F.col("moved"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in names), "moved")
    )


def _share_of_scatter(share: float) -> float:
    """Chance that a chi-square with two more degrees of freedom stays below that quantile."""
    x = chi_square_quantile(share, P)
    dof = P + 2
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return NormalDist().cdf(z)


def _reweighted(data: DataFrame, parameters: DataFrame) -> DataFrame:
    """Estimates from all documents within the 97.5 % ellipsoid of the last step."""
    near = _joined(data, parameters).filter(F.col("distance") <= chi_square_quantile(0.975, P))
    columns = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in _PAIRS]

    def build():
        def work(groups, counts, *sums):
            out = {"grp": [], "center": [], "inverse": [], "det": []}
            for grp, n, *values in zip(groups, counts, *sums):
                center, scatter = _estimate(dict(zip(columns, values), n=n))
                row = _parameters(grp, center, scatter + _floor()).iloc[0]
                for name, column in out.items():
                    column.append(row[name])
            return out

        return work

    return map_columns(_sums(near, "grp").select("grp", "n", *columns), build, _PARAMETERS)


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five base counts, ``base_failed``, ``kept`` and ``distance``.

    ``docs`` has ``doc_id, text, lang, source``; other columns are ignored. One row per input
    row, repeated rows and null ids included. A null text has no words and fails the base rules.
    A null language or source is a group of its own. A group too small or too uniform for
    estimates rests on the least spreads. An empty table gives an empty result.

    The statistics are written once, with no texts, to the shared folder, as are the estimates
    of each step (one row per group).
    """
    data = _with_features(materialize(statistics(docs), "quality-statistics"))
    parameters = materialize(_start(data), "quality-start")
    for _ in range(STEPS):
        parameters = materialize(_improved(parameters, _concentrate(data, parameters)), "quality-step")
        if not parameters.filter("moved").head(1):
            break
    parameters = materialize(_reweighted(data, parameters), "quality-estimates")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    inlier = F.col("distance") <= chi_square_quantile(1 - TAIL, P)
    copies = parameters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = data.join(copies, ["grp", "salt"], "left").withColumn("distance", _distance())
    return judged.select(
        "doc_id",
        *BASE,
        failed.alias("base_failed"),
        (~failed & F.coalesce(inlier, F.lit(True))).alias("kept"),
        F.round("distance", 6).alias("distance"),
    )


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns.

    Of rows that share a ``doc_id``, all stay if one is kept. Rows without an id go.
    """
    kept = quality(docs).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
