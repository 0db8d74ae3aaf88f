"""Scorecards with one vintage left out, for all vintages and candidate sets at once.

Bands, Weight of Evidence and coefficients are those of a card refitted without the vintage.  Counts by vintage serve
every fold: what a fold trains on is the total less one vintage.  Cut points and WoE of a feature depend on the fold only,
so the sets share them; and one pass over the rows adds up the normal equations of all folds and sets for one Newton step.
A pass hands on a small matrix for each model, so the driver solves systems of as many unknowns as a card has features.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.bands import band_count, is_numeric
from loanloom.functions.stats import safe_ratio
from loanloom.operators import binning
from loanloom.operators.metrics import evaluate, level_table
from loanloom.session import write_scratch

#: Newton steps at most, and the change of a coefficient below which they end.
STEPS, TOLERANCE = 25, 1e-9


@dataclass
class Fold:
    """Bands and WoE of every feature without one vintage (None: with all)."""

    left_out: int | None
    specs: dict[str, dict]
    rows: int = 0
    woe: dict[str, list[float]] = field(default_factory=dict)
    iv: dict[str, float] = field(default_factory=dict)


@dataclass
class Model:
    name: str
    fold: Fold
    features: list[str]
    weights: np.ndarray  # intercept first


def band_numbers(values: pd.Series, spec: Mapping) -> np.ndarray:
    """Band of every value, numbered as ``functions.bands`` does."""
    last = band_count(spec) - 1
    if is_numeric(spec):
        x = pd.to_numeric(values).to_numpy(dtype=np.float64, na_value=np.nan)
        return np.where(np.isnan(x), last, np.searchsorted(np.array(spec["edges"], dtype=np.float64), x, side="left"))
    places = {c: i for i, c in enumerate(spec["categories"])}
    return np.array([last if v is None else places.get(v, last - 1) for v in values.where(values.notna(), None)], dtype=np.int64)


def left_out_categories(df: DataFrame, columns: Sequence[str], folds: Sequence[int | None], vintage: str, cfg: Mapping = S.BINNING) -> dict:
    """(fold, feature) -> categories holding the least share of the fold's rows, from counts by vintage."""
    if not columns:
        return {}
    counts = binning.long_values(df, columns, "string", [vintage]).filter("x IS NOT NULL").groupBy("feature", "x", vintage).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r[vintage]: r["n"] for r in df.groupBy(vintage).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    kept = {f: F.sum("n") - F.coalesce(F.sum(F.when(F.col(vintage) == f, F.col("n"))), F.lit(0)) if f is not None else F.sum("n") for f in folds}
    least = {f: cfg["min_category_share"] * (total - sizes.get(f, 0)) for f in folds}
    wide = counts.groupBy("feature", "x").agg(*[kept[f].alias(f"n_{i}") for i, f in enumerate(folds)])
    some = [F.when(F.col(f"n_{i}") >= F.lit(float(least[f])), F.lit(i)) for i, f in enumerate(folds)]
    out: dict = {(f, c): [] for f in folds for c in columns}
    # one row at most for each fold and 1 / share of categories
    for r in wide.select("feature", "x", F.explode(F.array_compact(F.array(*some))).alias("i")).collect():
        out[folds[r["i"]], r["feature"]].append(r["x"])
    return {k: sorted(v) for k, v in out.items()}


def fold_edges(df: DataFrame, numeric: Sequence[str], folds: Sequence[int | None], y: str, vintage: str) -> dict:
    """Supervised cut points of every fold, searched in the same rounds from one table of (vintage, feature, value) cells."""
    if not numeric:
        return {f: {} for f in folds}
    names = {f: "all" if f is None else str(f) for f in folds}
    cells = binning.value_cells(df, numeric, y, [vintage])
    trains = F.filter(F.array(*[F.struct(F.lit(f).cast("int").alias("out"), F.lit(names[f]).alias("name")) for f in folds]),
                      lambda f: f["out"].isNull() | (f["out"] != F.col(vintage)))
    keyed = cells.withColumn("fold", F.explode(trains)).groupBy(F.concat_ws("|", "fold.name", "feature").alias("feature"), "x").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sizes = {r[vintage]: r["n"] for r in df.groupBy(vintage).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    edges = binning.supervised_edges(keyed, {f"{names[f]}|{c}": total - sizes.get(f, 0) for f in folds for c in numeric})
    return {f: {c: edges.get(f"{names[f]}|{c}", []) for c in numeric} for f in folds}


def _band_counts(folds: Sequence[Fold], vintage: str, y: str):
    """Rows and bads of every (fold, feature, band) that a task trains on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [{f: np.zeros((2, band_count(s)), np.int64) for f, s in fold.specs.items()} for fold in folds]
        for batch in batches:
            bad = batch[y].to_numpy(dtype=np.int64)
            for fold, counts in zip(folds, sums):
                inside = np.ones(len(batch), bool) if fold.left_out is None else (batch[vintage] != fold.left_out).to_numpy(dtype=bool)
                for f, spec in fold.specs.items():
                    bands = band_numbers(batch[f][inside], spec)
                    counts[f] += np.stack([np.bincount(bands, minlength=band_count(spec)), np.bincount(bands, bad[inside], band_count(spec)).astype(np.int64)])
        rows = [(i, f, b, int(c[0, b]), int(c[1, b])) for i, counts in enumerate(sums) for f, c in counts.items() for b in range(c.shape[1])]
        yield pd.DataFrame(rows, columns=["fold", "feature", "band", "n", "bad"])

    return run


def fit_folds(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: Sequence[int | None], y: str, vintage: str) -> list[Fold]:
    """Bands, WoE and information values of all features in every fold."""
    edges = fold_edges(df, numeric, folds, y, vintage)
    kept = left_out_categories(df, categorical, folds, vintage)
    out = [Fold(f, {**{c: {"edges": edges[f][c]} for c in numeric}, **{c: {"categories": kept[f, c]} for c in categorical}}) for f in folds]
    counted = df.mapInPandas(_band_counts(out, vintage, y), "fold int, feature string, band int, n bigint, bad bigint")
    rows = counted.groupBy("fold", "feature", "band").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()
    counts = {(r["fold"], r["feature"], r["band"]): (r["n"], r["bad"]) for r in rows}
    for i, fold in enumerate(out):
        for f, spec in fold.specs.items():
            n, bad = np.array([counts.get((i, f, b), (0, 0)) for b in range(band_count(spec))], dtype=np.float64).T
            good_share, bad_share = ((v + S.WOE_SMOOTH) / (v.sum() + len(v) * S.WOE_SMOOTH) for v in (n - bad, bad))
            woe = np.where(n > 0, np.log(good_share / bad_share), 0.0)
            fold.woe[f], fold.iv[f], fold.rows = woe.tolist(), float(((good_share - bad_share) * woe).sum()), int(n.sum())
    return out


def _inputs(batch: pd.DataFrame, fold: Fold, features: Sequence[str]) -> np.ndarray:
    """Intercept and WoE of every row under a fold's bands."""
    return np.stack([np.ones(len(batch)), *[np.array(fold.woe[f])[band_numbers(batch[f], fold.specs[f])] for f in features]], axis=1)


def _normal_equations(models: Sequence[Model], vintage: str, y: str):
    """Gradient and curvature of every model's likelihood over a task's rows, as flat rows (model, i, j, value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((len(m.weights), len(m.weights) + 1)) for m in models]
        by_fold: dict[int, list[int]] = {}
        for i, m in enumerate(models):
            by_fold.setdefault(id(m.fold), []).append(i)
        for batch in batches:
            for members in by_fold.values():
                fold = models[members[0]].fold
                part = batch if fold.left_out is None else batch[batch[vintage] != fold.left_out]
                if not len(part):
                    continue
                names = sorted({f for i in members for f in models[i].features})
                x, t = _inputs(part, fold, names), part[y].to_numpy(dtype=np.float64)
                for i in members:
                    own = x[:, [0, *[1 + names.index(f) for f in models[i].features]]]
                    p = 1 / (1 + np.exp(-np.clip(own @ models[i].weights, -700, 700)))
                    sums[i][:, 0] += own.T @ (t - p)
                    sums[i][:, 1:] += own.T @ (own * (p * (1 - p))[:, None])
        yield pd.DataFrame([(i, a, b, s[a, b]) for i, s in enumerate(sums) for a in range(s.shape[0]) for b in range(s.shape[1])], columns=["model", "a", "b", "value"])

    return run


def fit_models(df: DataFrame, folds: Sequence[Fold], sets: Mapping[str, Sequence[str]], y: str, vintage: str, min_iv: float,
               allow_constant: bool = False) -> list[Model]:
    """L2 logistic regressions (C = 1 on a summed loss) of every set in every fold, one pass over the rows a Newton step.

    A feature takes part if its information value in the fold reaches ``min_iv``.  A set none of whose features does is an
    error, or with ``allow_constant`` fitted by its constant.
    """
    models = []
    for fold in folds:
        for name, features in sets.items():
            chosen = [f for f in features if fold.iv[f] >= min_iv]
            if not chosen and not allow_constant:
                raise ValueError(f"no feature of {name} reaches an information value of {min_iv}")
            models.append(Model(name, fold, chosen, np.zeros(len(chosen) + 1)))
    open_models = models
    for _ in range(STEPS):
        sums = df.mapInPandas(_normal_equations(open_models, vintage, y), "model int, a int, b int, value double")
        totals = [np.zeros((len(m.weights), len(m.weights) + 1)) for m in open_models]
        for r in sums.groupBy("model", "a", "b").agg(F.sum("value").alias("value")).collect():
            totals[r["model"]][r["a"], r["b"]] = r["value"]
        left = []
        for m, t in zip(open_models, totals):
            penalty = np.append(0.0, np.ones(len(m.features)))
            step = np.linalg.solve(t[:, 1:] + np.diag(penalty + 1e-12), t[:, 0] - penalty * m.weights)
            m.weights = m.weights + step
            if np.abs(step).max() > TOLERANCE:
                left.append(m)
        open_models = left
        if not open_models:
            break
    return models


def _scores(models: Sequence[Model], vintage: str, y: str, held_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in models:
                part = batch[batch[vintage] == m.fold.left_out] if held_only else batch
                if len(part):
                    p = 1 / (1 + np.exp(-np.clip(_inputs(part, m.fold, m.features) @ m.weights, -700, 700)))
                    out = "all" if m.fold.left_out is None else str(m.fold.left_out)
                    yield pd.DataFrame({"candidate": m.name, "left_out": out, "vintage": part[vintage].to_numpy(), "y": part[y].to_numpy(dtype=np.int64), "p": p})

    return run


def _narrow(df: DataFrame, sets: Mapping[str, tuple[Sequence[str], Sequence[str]]], y: str, vintage: str) -> tuple[DataFrame, list[str], list[str]]:
    numeric = list(dict.fromkeys(f for n, _c in sets.values() for f in n))
    categorical = list(dict.fromkeys(f for _n, c in sets.values() for f in c))
    rows = df.select(F.col(vintage).cast("int").alias(vintage), F.col(y).cast("int").alias(y), *[F.col(f).cast("double").alias(f) for f in numeric],
                     *[F.col(f).cast("string").alias(f) for f in categorical])
    return write_scratch(rows, "folds"), numeric, categorical


SCORES = "candidate string, left_out string, vintage int, y bigint, p double"


def leave_one_vintage_out(df: DataFrame, sets: Mapping[str, tuple[Sequence[str], Sequence[str]]], y: str = "y", vintage: str = "vintage_year",
                          min_defaults: int = S.MIN_DEFAULTS_CI, min_iv: float = S.BINNING["min_iv"], allow_constant: bool = False) -> DataFrame:
    """(candidate, vintage) -> defaults, Gini and predicted/observed of the card refitted without that vintage.

    ``sets`` maps a name to (numeric, categorical) features.  Vintages with fewer than ``min_defaults`` bads are not
    held out.
    """
    rows, numeric, categorical = _narrow(df, sets, y, vintage)
    sizes = rows.groupBy(vintage).agg(F.sum(y).alias("bad")).filter(F.col("bad") >= min_defaults).collect()
    folds = fit_folds(rows, numeric, categorical, sorted(r[vintage] for r in sizes), y, vintage)
    models = fit_models(rows, folds, {name: [*n, *c] for name, (n, c) in sets.items()}, y, vintage, min_iv, allow_constant)
    held = rows.mapInPandas(_scores(models, vintage, y, True), SCORES)
    out = evaluate(held, "y", "p", ["candidate", "vintage"], ["defaults", "default_rate", "mean_predicted_pd", "gini"])
    return out.select("candidate", "vintage", "defaults", "gini", safe_ratio(F.col("mean_predicted_pd"), F.col("default_rate")).alias("pred_over_obs"))


def refit_without_vintage(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], left_out: int, y: str = "y", vintage: str = "vintage_year",
                          min_iv: float = S.BINNING["min_iv"], allow_constant: bool = False) -> DataFrame:
    """Level and Gini by vintage of the card fitted on all vintages ("all") and of the one refitted, bands too, without one."""
    sets = {"card": (numeric, categorical)}
    rows, numeric, categorical = _narrow(df, sets, y, vintage)
    folds = fit_folds(rows, numeric, categorical, [None, left_out], y, vintage)
    models = fit_models(rows, folds, {"card": [*numeric, *categorical]}, y, vintage, min_iv, allow_constant)
    scored = write_scratch(rows.mapInPandas(_scores(models, vintage, y, False), SCORES), "refit")
    by = ["left_out", "vintage"]
    return level_table(scored, "y", "p", by).join(evaluate(scored, "y", "p", by, ["gini"]), by)
