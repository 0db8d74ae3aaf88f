"""Fitting the WoE scorecard and turning it into points."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.bands import band_index
from loanloom.functions.stats import expit
from loanloom.operators import binning, scoring


def scaling_factors(scaling: Mapping = S.SCALING) -> tuple[float, float]:
    factor = scaling["points_to_double_odds"] / math.log(2)
    return factor, scaling["base_score"] - factor * math.log(scaling["base_odds"])


@dataclass
class Scorecard:
    specs: dict[str, dict]
    woe: dict[str, list[float]]
    iv: dict[str, float]
    selected: list[str]
    coefficients: list[float]
    intercept: float
    bands: list[dict] = field(default_factory=list)

    def woe_columns(self) -> list[Column]:
        return [binning.woe_column(f, self.specs[f], self.woe[f]).alias(f"woe_{f}") for f in self.selected]

    def log_odds(self) -> Column:
        total = F.lit(self.intercept)
        for f, w in zip(self.selected, self.coefficients):
            total = total + w * binning.woe_column(f, self.specs[f], self.woe[f])
        return total

    def predict_pd(self, df: DataFrame, out: str = "pd") -> DataFrame:
        return df.withColumn(out, expit(self.log_odds()))

    def score_points(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Total points; higher is safer."""
        factor, offset = scaling_factors()
        return df.withColumn(out, offset - factor * self.log_odds())

    def points(self) -> dict[str, list[float]]:
        factor, offset = scaling_factors()
        share = (offset - factor * self.intercept) / max(1, len(self.selected))
        return {f: [share - factor * w * x for x in self.woe[f]] for f, w in zip(self.selected, self.coefficients)}

    def sign_violations(self) -> list[str]:
        """A safer band must never raise the risk, so every coefficient has to be negative."""
        return [f for f, w in zip(self.selected, self.coefficients) if w > 0]

    def points_rows(self) -> list[tuple]:
        points = self.points()
        return [(r["feature"], r["band"], r["label"], r["n"], r["defaults"], r["default_rate"], r["woe"], points[r["feature"]][r["band"]])
                for r in self.bands if r["feature"] in points]

    def export(self, name: str, training_ranges: Mapping | None = None) -> dict:
        factor, offset = scaling_factors()
        points = self.points()
        features = {f: {**self.specs[f], "points": points[f]} for f in self.selected}
        populated = {f: [False] * len(points[f]) for f in self.selected}
        for r in self.bands:
            if r["feature"] in populated:
                populated[r["feature"]][r["band"]] = r["n"] > 0
        scaling = {"factor": factor, "offset": offset}
        if not features:  # no band can carry the constant's points
            scaling["constant_points"] = offset - factor * self.intercept
        return scoring.validate_model(scoring.model_record(name, features, scaling, training_ranges, populated))


POINTS_SCHEMA = "feature string, band int, label string, loans bigint, defaults bigint, default_rate double, woe double, points double"


def fit_logistic(cells: DataFrame, inputs: Sequence[str], y: str, weight: str, penalty_rows: float | None, tol: float = 1e-7):
    """L2 logistic regression on weighted rows; the penalty follows C = 1 on a summed loss (None: no penalty)."""
    assembled = VectorAssembler(inputCols=list(inputs), outputCol="_x").transform(cells)
    reg = 0.0 if penalty_rows is None else 1.0 / penalty_rows
    return LogisticRegression(featuresCol="_x", labelCol=y, weightCol=weight, regParam=reg, elasticNetParam=0.0, standardization=False,
                              maxIter=200, tol=tol).fit(assembled)


def constant_log_odds(df: DataFrame, y: str) -> float:
    """Log-odds of the default rate: the intercept of a fit without inputs (infinite if one class is absent)."""
    r = df.agg(F.count_if(F.col(y) == 0).alias("good"), F.count_if(F.col(y) == 1).alias("bad")).first()
    if not r["good"] or not r["bad"]:
        return math.inf if r["bad"] else -math.inf
    return math.log(r["bad"] / r["good"])


def fit_scorecard(df: DataFrame, y: str = "y", numeric: Sequence[str] = tuple(S.NUMERIC_FEATURES),
                  categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES), cfg: Mapping = S.BINNING,
                  specs: dict[str, dict] | None = None, min_iv: float | None = None, allow_constant: bool = False) -> Scorecard:
    """Bands -> WoE -> selection by information value -> logistic regression.

    Rows sharing all bands and the outcome are identical to the regression, so it runs on (bands, y) -> n cells.  If no
    feature reaches the bound, that is an error, or with ``allow_constant`` the card of the constant alone: the same fit
    without inputs, whose PD is the default rate.
    """
    specs = binning.fit_bins(df, y, numeric, categorical, cfg) if specs is None else specs
    rows = binning.woe_table(df, specs, y).collect()
    woe = binning.woe_by_band(rows, specs)
    iv = {f: sum(r["iv_part"] for r in rows if r["feature"] == f) for f in specs}
    bound = cfg["min_iv"] if min_iv is None else min_iv
    selected = [f for f in specs if iv[f] >= bound]
    if not selected:
        if not allow_constant:
            raise ValueError(f"no feature reaches an information value of {bound}")
        return Scorecard(specs, woe, iv, [], [], constant_log_odds(df, y), [r.asDict() for r in rows])
    cells = df.select(F.col(y).cast("double").alias("_y"), *[band_index(f, specs[f]).alias(f"b_{f}") for f in selected])
    cells = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    inputs = [F.element_at(F.array(*[F.lit(float(w)) for w in woe[f]]), F.col(f"b_{f}") + 1).alias(f"woe_{f}") for f in selected]
    model = fit_logistic(cells.select("_y", "_n", *inputs), [f"woe_{f}" for f in selected], "_y", "_n", float(df.count()))
    return Scorecard(specs, woe, iv, selected, [float(c) for c in model.coefficients], float(model.intercept), [r.asDict() for r in rows])
