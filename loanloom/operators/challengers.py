"""Challenger models, calibration and resampling of training rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import hashing
from loanloom.functions.stats import expit, logit
from loanloom.operators.binning import long_values, value_cells
from loanloom.operators.isotonic import Isotonic, isotonic_calibrate  # noqa: F401
from loanloom.operators.neighbours import nearest_neighbours
from loanloom.operators.ranks import hash_cut, within_cut
from loanloom.operators.selection import exact_medians
from loanloom.session import discard, write_scratch

RARE_ROWS = 50


@dataclass
class Preparation:
    """Learned once on training rows, applied unchanged anywhere: (name, original feature, expression) per model column."""

    columns: list[tuple[str, str, Column]]

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        wide = df.select(*keep, *[e.alias(n) for n, _f, e in self.columns])
        return VectorAssembler(inputCols=[n for n, _f, _e in self.columns], outputCol="features").transform(wide)


def prep_features(train: DataFrame, y: str, numeric: Sequence[str] = tuple(S.NUMERIC_FEATURES),
                  categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES)) -> Preparation:
    """Median fill plus missing flag, population-standardised; one-hot categories with rare and unseen ones grouped."""
    cells = value_cells(train, numeric, y)
    medians = {r["feature"]: r["median"] for r in exact_medians(cells.filter("x IS NOT NULL"), ["feature"]).collect()}
    missing = {r["feature"] for r in cells.filter("x IS NULL").select("feature").distinct().collect()}
    raw = {f"num_{f}": (f, F.coalesce(F.col(f).cast("double"), F.lit(medians[f]))) for f in numeric}
    raw |= {f"flag_{f}": (f, F.col(f).isNull().cast("double")) for f in numeric if f in missing}
    one = train.agg(*[F.struct(F.avg(e), F.stddev_pop(e)).alias(n) for n, (_f, e) in raw.items()]).first()
    columns = [(n, f, (e - one[n][0]) / (one[n][1] or 1.0)) for n, (f, e) in raw.items()]
    rows = (long_values(train, categorical, "string", []).groupBy("feature", F.coalesce("x", F.lit("missing")).alias("x"))
            .agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(
                F.sort_array(F.collect_list(F.when(F.col("n") >= RARE_ROWS, F.col("x")))).alias("kept"),
                F.bool_or(F.col("n") < RARE_ROWS).alias("rare")).collect()) if categorical else []
    for r in rows:
        level = F.coalesce(F.col(r["feature"]).cast("string"), F.lit("missing"))
        columns += [(f"cat_{r['feature']}_{i}", r["feature"], (level == c).cast("double")) for i, c in enumerate(r["kept"])]
        if r["rare"]:
            columns.append((f"cat_{r['feature']}_rare", r["feature"], (~level.isin(*r["kept"])).cast("double")))
    return Preparation(columns)


def standardise(train: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Zero-mean unit-variance expressions learned on ``train`` (population variance)."""
    one = train.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]).first()
    return {c: (F.col(c) - one[c][0]) / (one[c][1] or 1.0) for c in columns}


def label_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, label, code): the 0-based place of every label among its column's, in sorted order.

    The distinct labels are written in value ranges; a label's code is its place in its range plus what the earlier
    ranges hold, so no column is numbered in one task and no label comes to the driver.
    """
    labels = long_values(df, columns, "string", []).filter("x IS NOT NULL").groupBy("feature", F.col("x").alias("label")).agg(F.lit(0).alias("_")).drop("_")
    ranged = write_scratch(labels.repartitionByRange("feature", "label").withColumn("range", F.spark_partition_id()), "labels")
    inside = F.row_number().over(Window.partitionBy("feature", "range").orderBy("label"))
    earlier = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("feature", "range").agg(F.count(F.lit(1)).alias("n")).select("feature", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranged.withColumn("place", inside).join(held, ["feature", "range"]).select("feature", "label", (F.col("place") + F.col("before") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], dictionary: DataFrame | None = None) -> DataFrame:
    """Adds ``<column>_code``: 0-based integers by sorted order; NULL and labels that a given dictionary lacks come after the last."""
    codes = write_scratch(label_dictionary(df, columns) if dictionary is None else dictionary, "codes")
    for c in columns:
        own = codes.filter(F.col("feature") == c)
        known = own.select(F.col("label").alias("_label"), F.col("code").alias(f"{c}_code"))
        count = own.agg(F.count(F.lit(1)).cast("int"))
        df = df.join(known, F.col(c).cast("string") == F.col("_label"), "left").drop("_label").withColumn(f"{c}_code", F.coalesce(f"{c}_code", count.scalar()))
    return df


@dataclass
class Fitted:
    preparation: Preparation
    model: object

    def predict(self, df: DataFrame, keep: Sequence[str], out: str = "p") -> DataFrame:
        scored = self.model.transform(self.preparation.transform(df, keep))
        return scored.select(*keep, vector_to_array("probability")[1].alias(out))

    def contributions(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Exact linear contributions coef * (x - mean) summed by original feature (inputs are centred or one-hot)."""
        prepared = df.select(*keep, *[e.alias(n) for n, _f, e in self.preparation.columns])
        names = [n for n, _f, _e in self.preparation.columns]
        means = prepared.agg(*[F.avg(n).alias(n) for n in names]).first()
        parts: dict[str, Column] = {}
        for (n, f, _e), w in zip(self.preparation.columns, self.model.coefficients):
            term = float(w) * (F.col(n) - float(means[n]))
            parts[f] = term if f not in parts else parts[f] + term
        return prepared.select(*keep, *[v.alias(f) for f, v in parts.items()])


def fit_logistic_baseline(train: DataFrame, y: str = "y", preparation: Preparation | None = None, weight: Column | None = None, **features) -> Fitted:
    preparation = preparation or prep_features(train, y, **features)
    rows = train.withColumn("_y", F.col(y).cast("double")).withColumn("_w", F.lit(1.0) if weight is None else weight)
    ready = preparation.transform(rows, ["_y", "_w"]).persist()
    n = ready.count()
    model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", regParam=1.0 / n, standardization=False, maxIter=100).fit(ready)
    ready.unpersist()
    return Fitted(preparation, model)


def stratified_split(df: DataFrame, y: str, key: str, share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rest, held-out) with exactly the rounded share of every class held out, in hash order."""
    cuts = hash_cut(df.select(y, key), key, seed, F.round(F.col("total") * share), by=[y])
    tagged = df.join(cuts, y)
    inside = within_cut(key, seed, F.col("cut"))
    return tagged.filter(~inside).drop("cut").select(df.columns), tagged.filter(inside).drop("cut").select(df.columns)


@dataclass
class Boosted(Fitted):
    """Boosted trees cut at the round of least hold-out loss; ``losses`` holds the loss after every round tried."""

    losses: list[float]

    @property
    def rounds(self) -> int:
        return self.losses.index(min(self.losses)) + 1


def boosted_classifier(trees: int, step: float = S.TREES["step"]) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="_y", weightCol="_w", maxDepth=S.TREES["depth"], maxIter=trees, stepSize=step,
                         subsamplingRate=S.TREES["row_share"], featureSubsetStrategy=str(S.TREES["column_share"]),
                         minInstancesPerNode=S.TREES["least_rows"], seed=S.TREES["seed"])


def fit_boosted_trees(train: DataFrame, y: str = "y", key: str = "loan_seq", trees: int = S.TREES["limit"], step: float = S.TREES["step"],
                      patience: int = S.TREES["patience"], weight: Column | None = None, seed: str = "inner", **features) -> Boosted:
    """Gradient boosting of shallow trees, as many as serve a stratified 15 % inner hold-out best.

    The fit grows in stages of doubling length and looks at the hold-out loss after every round.  It ends when the best
    round lies ``patience`` rounds back, or at ``trees`` rounds.  Rounds don't depend on how many follow, so the
    model is then cut after the best round, without another fit.
    """
    inner, held = stratified_split(train, y, key, S.TREES["held_share"], seed)
    inner = write_scratch(inner, "inner")  # preparing takes several jobs, each of which would split the rows again
    preparation = prep_features(inner, y, **features)
    fit_on, watch = (_written(df, y, preparation, weight) for df in (inner, held))
    discard(inner)
    stage, losses = min(trees, 2 * (patience + 10)), []
    while True:
        model = boosted_classifier(stage, step).fit(fit_on)
        losses = [float(x) for x in model.evaluateEachIteration(watch)]
        best = losses.index(min(losses)) + 1
        if stage >= trees or best + patience <= stage:
            break
        stage = min(trees, 2 * stage)
    discard(fit_on)
    discard(watch)
    return Boosted(preparation, first_trees(model, best), losses[:min(stage, best + patience)])


def _written(df: DataFrame, y: str, preparation: Preparation, weight: Column | None) -> DataFrame:
    """Label, weight and vector of the rows, written once: a tree takes several jobs, whose tasks then carry a scan instead
    of the whole plan."""
    rows = df.withColumn("_y", F.col(y).cast("double")).withColumn("_w", F.lit(1.0) if weight is None else weight)
    return write_scratch(preparation.transform(rows, ["_y", "_w"]).select("_y", "_w", "features"), "boosting")


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The model of the first ``count`` trees, by the public constructor of Spark's model."""
    jvm, gateway = model._java_obj, SparkContext._gateway
    ensemble = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(ensemble.regression.DecisionTreeRegressionModel, count), gateway.new_array(gateway.jvm.double, count)
    for i, (tree, weight) in enumerate(zip(jvm.trees()[:count], model.treeWeights)):
        trees[i], weights[i] = tree, weight
    cut = ensemble.classification.GBTClassificationModel(model.uid, trees, weights)
    for name in ("featuresCol", "labelCol", "weightCol"):
        cut.set(cut.getParam(name), model.getOrDefault(name))
    return model._copyValues(GBTClassificationModel(cut))


def fit_trees(train: DataFrame, trees: int, y: str = "y", preparation: Preparation | None = None, weight: Column | None = None, **features) -> Fitted:
    """Boosting of a given number of trees on all training rows."""
    preparation = preparation or prep_features(train, y, **features)
    ready = _written(train, y, preparation, weight)
    model = boosted_classifier(trees).fit(ready)
    discard(ready)
    return Fitted(preparation, model)


# ---- calibration --------------------------------------------------------------------------------
def _probability_cells(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.groupBy(F.col(p).alias("x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_n"))


@dataclass
class Platt:
    slope: float
    offset: float

    def apply(self, p: Column) -> Column:
        return expit(self.slope * logit(p, S.PROBABILITY_EPS) + self.offset)


def platt_calibrate(df: DataFrame, p: str, y: str) -> Platt:
    """Unpenalised logistic fit on clipped log-odds, on (p, y) -> n cells."""
    from loanloom.operators.scorecard import fit_logistic

    cells = _probability_cells(df, p, y).withColumn("z", logit(F.col("x"), S.PROBABILITY_EPS))
    model = fit_logistic(cells, ["z"], "_y", "_n", None)
    return Platt(float(model.coefficients[0]), float(model.intercept))


# ---- class balance ------------------------------------------------------------------------------
def class_weight(df: DataFrame, y: str) -> float:
    """Weight of the positive class that balances goods and bads."""
    r = df.agg(F.count_if(F.col(y) == 0).alias("good"), F.count_if(F.col(y) == 1).alias("bad")).first()
    return r["good"] / r["bad"]


def smote_oversample(train: DataFrame, y: str, key: str, columns: Sequence[str], k: int = 5, seed: str = "smote") -> DataFrame:
    """Training rows plus interpolated minority rows until both classes are equal in size.

    Every minority row gives the same number of new rows, the first ones in hash order one more.  A new row lies a
    hash-uniform fraction of the way to a hash-chosen one of its k nearest minority neighbours.
    """
    r = train.agg(F.count_if(F.col(y) == 0).alias("good"), F.count_if(F.col(y) == 1).alias("bad")).first()
    need = max(r["good"] - r["bad"], 0)
    minority = train.filter(F.col(y) == 1)
    vectors = minority.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    near = nearest_neighbours(vectors, key, "v", k)
    cut = hash_cut(minority.select(key), key, seed, F.lit(need % r["bad"]))
    copies = need // r["bad"] + within_cut(key, seed, F.col("_cut")).cast("int")
    mates_of = near.select(F.col("key").alias("_of"), "neighbours")
    based = vectors.withColumn("_cut", cut.scalar()).withColumn("_copies", copies).join(mates_of, F.col("_of") == F.col(key))
    each = based.filter("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    salt = F.concat(F.lit(seed + "|"), F.col("copy").cast("string"))
    chosen = F.get("neighbours", (hashing.uniform32(F.col(key), salt) % F.size("neighbours")).cast("int"))
    mixed = each.select(F.col(key).alias("base"), "copy", F.col("v").alias("a"), chosen.alias("mate"),
                        hashing.uniform(F.col(key), F.concat(salt, F.lit("|gap"))).alias("t"))
    mates = vectors.select(F.col(key).alias("mate"), F.col("v").alias("b"))
    new = mixed.join(mates, "mate").select(
        F.concat(F.col("base").cast("string"), F.lit("#"), F.col("copy").cast("string")).alias(key), F.lit(1).alias(y), F.lit(True).alias("synthetic"),
        *[(F.col("a")[i] + F.col("t") * (F.col("b")[i] - F.col("a")[i])).alias(c) for i, c in enumerate(columns)])
    real = train.select(F.col(key).cast("string").alias(key), F.col(y).cast("int").alias(y), F.lit(False).alias("synthetic"),
                        *[F.col(c).cast("double").alias(c) for c in columns])
    return real.unionByName(new)


# ---- ablation -----------------------------------------------------------------------------------
ARMS = ("unweighted", "class_weights", "smote")


def arm_rows(train: DataFrame, arm: str, y: str, key: str, preparation: Preparation) -> DataFrame:
    """The rows that an arm is fitted on, written once: label, weight and vector.

    "class_weights" lets a bad count as goods / bads; "smote" balances the classes in the space of the prepared columns.
    """
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm}")
    if arm == "unweighted":
        return _written(train, y, preparation, None)
    if arm == "class_weights":
        return _written(train, y, preparation, F.when(F.col(y) == 1, class_weight(train, y)).otherwise(1.0))
    prepared = write_scratch(train.select(key, y, *[e.cast("double").alias(n) for n, _f, e in preparation.columns]), "prepared")
    balanced = write_scratch(smote_oversample(prepared, y, key, [n for n, _f, _e in preparation.columns]), "smote")
    ready = _written(balanced, y, Preparation([(n, f, F.col(n)) for n, f, _e in preparation.columns]), None)
    discard(prepared, balanced)
    return ready


def fit_arm(train: DataFrame, arm: str, trees: int | Callable[[], int], y: str = "y", key: str = "loan_seq", preparation: Preparation | None = None, **features) -> Fitted:
    """Boosted trees of one number for every arm, so that only the treatment of the imbalance differs.

    A number still to be found is asked for once the rows of the arm (``arm_rows``) are written.
    """
    preparation = preparation or prep_features(train, y, **features)
    ready = arm_rows(train, arm, y, key, preparation)
    model = boosted_classifier(trees() if callable(trees) else trees).fit(ready)
    discard(ready)
    return Fitted(preparation, model)


@dataclass
class CalibratedArm:
    arm: str
    model: Fitted
    platt: Platt
    isotonic: Isotonic

    def versions(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` with the raw, Platt and isotonic probability of every row."""
        raw = self.model.predict(df, keep, "raw").withColumn("platt", self.platt.apply(F.col("raw")))
        return self.isotonic.apply(raw, "raw", "isotonic")


def imbalance_ablation(train: DataFrame, calibration: DataFrame, trees: int | Callable[[], int], y: str = "y", key: str = "loan_seq", **features) -> list[CalibratedArm]:
    """Every arm fitted on the training rows, its calibrators on the calibration rows.

    A tree is a row of short jobs, so the arms are fitted at the same time.  ``trees`` may be a function that finds their
    number: it runs while the rows of the arms are prepared, made-up ones included.
    """
    on = inheritable_thread_target(train.sparkSession)
    with ThreadPoolExecutor(len(ARMS) + 1) as pool:
        number = pool.submit(on(trees if callable(trees) else lambda: trees))
        preparation = prep_features(train, y, **features)

        def one(arm: str) -> CalibratedArm:
            model = fit_arm(train, arm, number.result, y, key, preparation)
            p = write_scratch(model.predict(calibration, [y]), "arm")
            return CalibratedArm(arm, model, platt_calibrate(p, "p", y), isotonic_calibrate(p, "p", y))

        running = [pool.submit(on(one), arm) for arm in ARMS]
        return [r.result() for r in running]
