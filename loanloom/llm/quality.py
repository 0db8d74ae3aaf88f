"""Quality scores from preference pairs: a Bradley-Terry model on features of the text.

Every pair of a good and a bad document says that the good one should score higher; the chance of that is the logistic
function of the difference of their scores.  Scores are linear in the features, so the fit is a logistic regression on
feature differences without intercept.  The threshold is the score quantile at the share of bad documents, placed at
``CUT`` of the final score.

All labelled rows outside the held-out fifth teach.  They are dealt into groups of bounded size, within which every bad row
draws its good partners; one pass over the groups adds up a Newton step, and the quantile is selected exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loanloom.operators.selection import group_quantiles
from loanloom.session import write_scratch

#: Good partners of each bad document; labelled rows of a group on average; good ones that a group has at least on average.
PARTNERS, GROUP, LEAST_GOOD = 16, 8192, 64
#: The score from which on a document counts as good.
CUT = 0.3
RIDGE = 1e-2

#: Classes of bytes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r", "line": b"\n",
    "stop": b".", "comma": b",", "exclaim": b"!?", "bar": b"|", "symbol": b"#$%&*+=@^~<>\\", "bracket": b"()[]{}", "quote": b"'\"`", "dash": b"-_/:;",
}
FEATURES = (*CLASSES, "wide", "log_words", "word_bytes", "distinct", "repeats")

_SHARES = np.zeros((256, len(CLASSES) + 1))
for _i, _bytes in enumerate(CLASSES.values()):
    _SHARES[list(_bytes), _i] = 1
_SHARES[128:, -1] = 1


def features_of(text: str | None) -> list[float]:
    """Features of a whole text, all finite: shares of byte classes (square roots), count and mean size of words, share of
    distinct words, share of words that repeat the one before.  A null text is an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _SHARES / max(1, len(raw))
    n = max(1, len(words))
    repeats = sum(map(eq, words, words[1:]))
    return [*np.sqrt(counts).tolist(), math.log1p(len(words)), math.log1p(len(raw) / n), len(set(words)) / n, repeats / n]


@F.pandas_udf(ArrayType(DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return texts.map(features_of)


@dataclass(frozen=True)
class Model:
    weights: list[float]
    threshold: float

    def linear(self, found: Column) -> Column:
        return F.aggregate(F.zip_with(found, F.array(*map(F.lit, self.weights)), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)

    def score(self, found: Column) -> Column:
        """The final score of a feature column: above or at ``CUT`` exactly if the linear score reaches the threshold."""
        gap = self.linear(found) - F.lit(self.threshold)
        return F.when(gap >= 0, F.greatest(_logistic(gap), F.lit(CUT))).otherwise(F.least(_logistic(gap), F.lit(math.nextafter(CUT, 0))))


def _logistic(gap: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(gap + F.lit(math.log(CUT / (1 - CUT))))))


def held_out(key: str = "doc_id") -> Column:
    """The fifth of the documents from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _differences(best: np.ndarray, worst: np.ndarray, spread: np.ndarray, seed: int) -> np.ndarray:
    """Scaled features of random good partners less those of every bad row."""
    n = min(PARTNERS, len(best))
    return (best[np.random.default_rng(seed).integers(0, len(best), (len(worst), n))] - worst[:, None]).reshape(-1, best.shape[1]) / spread


def _sums(differences: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, gradient and curvature of the pairs' likelihood, as one flat row."""
    p = 1 / (1 + np.exp(-np.clip(differences @ w, -30, 30)))
    curve = (differences * (p * (1 - p))[:, None]).T @ differences
    return np.concatenate([[len(p)], differences.T @ (1 - p), curve.ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    w = np.zeros(width)
    for _ in range(30):
        total = sums(w)
        pairs, slope, curve = total[0], total[1 : width + 1], total[width + 1 :].reshape(width, width)
        step = np.linalg.solve(curve / pairs + RIDGE * np.eye(width), slope / pairs - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _safe(spread: np.ndarray) -> np.ndarray:
    return np.where(spread < 1e-9, 1.0, spread)


def fit(x: np.ndarray, good: np.ndarray, seed: int = 0) -> Model:
    """The model of some feature rows and their labels; without both labels, one that lets everything pass."""
    if good.all() or not good.any():
        return Model([0.0] * x.shape[1], -1.0)
    spread = _safe(x.std(axis=0))
    differences = _differences(x[good], x[~good], spread, seed)
    weights = _newton(lambda w: _sums(differences, w), x.shape[1]) / spread
    return Model(weights.tolist(), float(np.quantile(x @ weights, (~good).mean(), method="midpoint")))


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    """A group as one row of two matrices, in an order that doesn't depend on how its rows arrived."""
    part = part.sort_values(["_key", "at"])
    each = [np.array(part["features"][part["good"] == g].tolist(), dtype=np.float64).tobytes() for g in (True, False)]
    return pd.DataFrame({"group": part["group"].iloc[:1].to_numpy(), "best": [each[0]], "worst": [each[1]]})


def grouped(rows: DataFrame, n: int, good: int) -> DataFrame:
    """(group, best, worst): all labelled rows in groups by hash.  Where good rows are too few, each serves several groups."""
    groups = max(1, n // GROUP)
    times = min(groups, -(-LEAST_GOOD * groups // good))
    copy = F.explode(F.when(F.col("good"), F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))).alias("copy")
    dealt = rows.select("_key", "features", "good", F.xxhash64("_key", "features").alias("at"), copy)
    dealt = dealt.withColumn("group", F.pmod(F.col("at") + F.col("copy"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInPandas(_packed, "group long, best binary, worst binary")


def _group_sums(w: np.ndarray, spread: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + len(w) + len(w) ** 2)
        for batch in batches:
            for group, *pair in zip(batch["group"], batch["best"], batch["worst"]):
                best, worst = (np.frombuffer(v).reshape(-1, len(w)) for v in pair)
                if len(best) and len(worst):
                    total += _sums(_differences(best, worst, spread, int(group)), w)
        yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    return run


def learn(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """Fit on all labelled documents that aren't held out.

    ``found`` has the key and ``features``; ``labels`` the key and ``quality`` (1 good, 0 bad; others don't count).
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(key)).select(F.col(key).alias("_key"), (F.col("quality") == 1).alias("good"))
    rows = write_scratch(found.select(F.col(key).alias("_key"), "features").join(known, "_key"), "labelled")
    width = len(FEATURES)
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), *[F.stddev_pop(F.col("features")[i]).alias(f"s{i}") for i in range(width)]).first()
    n, good = one["n"], one["good"]
    if not good or good == n:
        return Model([0.0] * width, -1.0)
    spread = _safe(np.array([one[f"s{i}"] for i in range(width)]))
    packed = write_scratch(grouped(rows, n, good), "pairs")

    def sums(w: np.ndarray) -> np.ndarray:
        each = packed.mapInPandas(_group_sums(w, spread), "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        return np.array([r["value"] for r in sorted(each.collect(), key=lambda r: r["at"])])

    weights = (_newton(sums, width) / spread).tolist()
    # the middle of the two scores around the rank
    position = (n - good) / n * (n - 1)
    ends = [math.floor(position) / max(1, n - 1), math.ceil(position) / max(1, n - 1)]
    scores = rows.select(Model(weights, 0.0).linear(F.col("features")).alias("x"))
    low, high = group_quantiles(scores, "x", [], ends).first()["quantiles"]
    return Model(weights, (low + high) / 2)


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``held_out``, ``score`` and ``predicted`` (1 from ``CUT`` on).

    Only the text makes a score; null and empty texts are scored like any other.  Rows with a null key are scored and
    not held out; repeated rows give a row each; other columns are left out.  Without labels of both kinds every
    document is predicted to be good.
    """
    found = write_scratch(docs.select(F.col(key), features(F.col(text)).alias("features")), "features")
    score = learn(found, labels, key).score(F.col("features"))
    scored = found.select(key, held_out(key).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted to be good; the same defined cases."""
    model = learn(docs.select(F.col(key), features(F.col(text)).alias("features")), labels, key)
    return docs.filter(model.score(features(F.col(text))) >= CUT)
