"""Binning, scorecard fitting, challengers, calibration, stability and bootstrap on the shared tables."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.stats import logit
from loanloom.operators import binning, bootstrap, challengers, folds, metrics, neighbours, nested, scorecard, scoring, stability
from loanloom.plans import loans
from loanloom.plans.oracle import ADOPTED, band_index_case, register, uniform32
from loanloom.plans.preparation import rounded
from loanloom.plans.registry import query
from loanloom.session import staged_once, write_scratch
from loanloom.sources.readers import load_split_guarded

NUMERIC = ["credit_score", "dti", "rate_spread", "ltv", "cltv", "several_borrowers", "mi_pct", "orig_term"]
CATEGORICAL = ["purpose", "channel"]
MIN_IV = 0.0005  # the shared tables carry almost no signal, so features are kept at a far lower information value


def inputs(spark, sf):
    return loans.with_borrower_flag(loans.features(spark, sf)).withColumn("y", F.col(S.TARGET))


def train_rows(spark, sf):
    return load_split_guarded(inputs(spark, sf), "train")


register("train", "SELECT * FROM inputs WHERE split='train'")

# fixed bands for the queries whose result is checked by SQL
CHANNEL = {"categories": ["B", "C", "R", "T"]}
SPECS = {**{f: {k: v for k, v in s.items() if k != "points"} for f, s in ADOPTED.items()}, "channel": CHANNEL}


@query("supervised_bins_numeric")
def _(spark, sf):
    """Cut points of every numeric feature with the loans and defaults of the resulting bands."""
    train = train_rows(spark, sf)
    n = train.count()
    edges = binning.supervised_edges(binning.value_cells(train, NUMERIC, "y"), {c: n for c in NUMERIC})
    table = binning.woe_table(train, {c: {"edges": e} for c, e in edges.items()}, "y")
    return rounded(table, "woe", "iv_part", "default_rate")


@query("category_bands", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST({c} AS varchar) AS category, CAST(count(*) AS bigint) AS n FROM train WHERE {c} IS NOT NULL GROUP BY 2
        HAVING count(*) >= 0.01::double*(SELECT count(*) FROM train)""" for c in S.CATEGORICAL_FEATURES))
def _(spark, sf):
    train = train_rows(spark, sf)
    columns = S.CATEGORICAL_FEATURES
    kept = binning.category_bands(train, columns)
    pairs = binning.long_values(train, columns, "string", [])
    keep = F.coalesce(*[F.when(F.col("feature") == c, F.col("x").isin(*kept[c])) for c in columns])
    return pairs.filter(keep).groupBy("feature", F.col("x").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _band_union(source, extra=""):
    return " UNION ALL ".join(f"SELECT {extra}'{f}' AS feature, {band_index_case(f, s)} AS band, y FROM {source}" for f, s in SPECS.items())


def _grid():
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS band, {len(s.get('edges', s.get('categories'))) + 2} AS k FROM (SELECT 1)"
                              for f, s in SPECS.items() for i in range(len(s.get("edges", s.get("categories"))) + 2))


register("woe_cells", f"SELECT feature, band, count(*) AS n, sum(y) AS bad FROM ({_band_union('train')}) GROUP BY 1,2")
register("woe_rows", f"""SELECT g.feature, g.band, CAST(coalesce(n,0) AS bigint) AS n, CAST(coalesce(bad,0) AS bigint) AS defaults,
      (coalesce(n-bad,0)+0.5::double)/(sum(coalesce(n-bad,0)) OVER w + 0.5::double*k) AS gs, (coalesce(bad,0)+0.5::double)/(sum(coalesce(bad,0)) OVER w + 0.5::double*k) AS bs
    FROM ({_grid()}) g LEFT JOIN woe_cells c USING (feature, band) WINDOW w AS (PARTITION BY g.feature)""")
register("woe", """SELECT feature, band, n, defaults, CASE WHEN n>0 THEN ln(gs/bs) ELSE 0 END AS woe, CASE WHEN n>0 THEN (gs-bs)*ln(gs/bs) ELSE 0 END AS iv_part FROM woe_rows""")


@query("woe_table", "SELECT feature, CAST(band AS integer) AS band, n, defaults, round(woe,6) AS woe, round(iv_part,6) AS iv_part FROM woe")
def _(spark, sf):
    return rounded(binning.woe_table(train_rows(spark, sf), SPECS, "y").select("feature", "band", "n", "defaults", "woe", "iv_part"), "woe", "iv_part")


@query("information_value", f"SELECT feature, round(sum(iv_part),6) AS iv, sum(iv_part)>={MIN_IV} AS kept FROM woe GROUP BY 1")
def _(spark, sf):
    return rounded(binning.information_value(binning.woe_table(train_rows(spark, sf), SPECS, "y"), min_iv=MIN_IV), "iv")


@query("woe_transform", "SELECT loan_seq, " + ", ".join(f"round(w_{f}.woe,6) AS woe_{f}" for f in SPECS) + " FROM inputs i " + " ".join(
    f"JOIN woe w_{f} ON w_{f}.feature='{f}' AND w_{f}.band={band_index_case('i.' + f, SPECS[f])}" for f in SPECS))
def _(spark, sf):
    rows = binning.woe_table(train_rows(spark, sf), SPECS, "y").collect()
    woe = binning.woe_by_band(rows, SPECS)
    return inputs(spark, sf).select("loan_seq", *[F.round(binning.woe_column(f, SPECS[f], woe[f]), 6).alias(f"woe_{f}") for f in SPECS])


def card(spark, sf, rows=None, specs=None):
    return scorecard.fit_scorecard(train_rows(spark, sf) if rows is None else rows, "y", NUMERIC, CATEGORICAL, specs=specs, min_iv=MIN_IV,
                                   allow_constant=True)


def table_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("fit_scorecard")
def _(spark, sf):
    c = card(spark, sf)
    return table_of(spark, [("intercept", c.intercept, None)] + [(f, w, c.iv[f]) for f, w in zip(c.selected, c.coefficients)], "feature string, coefficient double, iv double")


@query("sign_violations")
def _(spark, sf):
    c = card(spark, sf)
    bad = set(c.sign_violations())
    return table_of(spark, [(f, w, f in bad) for f, w in zip(c.selected, c.coefficients)], "feature string, coefficient double, violation boolean")


@query("points_table")
def _(spark, sf):
    return rounded(table_of(spark, card(spark, sf).points_rows(), scorecard.POINTS_SCHEMA), "woe", "points", "default_rate")


@query("score_points")
def _(spark, sf):
    """Scores of every loan by the fitted card; the points of the bands add up to the same score."""
    c = card(spark, sf)
    summed = scoring.score_column(c.export("fitted"))
    scored = c.score_points(inputs(spark, sf)).withColumn("summed", summed)
    return rounded(scored.select("loan_seq", "score", "summed", (F.abs(F.col("score") - F.col("summed")) < 1e-6).alias("adds_up")), "score", "summed")


@query("export_model")
def _(spark, sf):
    record = card(spark, sf).export("fitted")
    return table_of(spark, [(record["model_id"], f, record["features"][f]["type"], len(record["features"][f]["points"]), record["best_points"][f])
                            for f in record["feature_order"]], "model_id string, feature string, type string, bands int, best_points double")


@query("validate_model")
def _(spark, sf):
    """The fitted record is valid; damaged copies are named with their problem."""
    c = card(spark, sf)
    record = c.export("fitted")
    # a card of the constant alone has no points to damage: a neutral feature is
    whole = record if c.selected else scoring.model_record("fitted", {f: {**s, "points": [0.0] * len(c.woe[f])} for f, s in [next(iter(c.specs.items()))]}, record["scaling"])
    first = whole["feature_order"][0]
    broken = {**whole, "features": {**whole["features"], first: {**whole["features"][first], "points": whole["features"][first]["points"][:-1]}}}
    cases = {"fitted": record, "short points": broken, "no scaling": {k: v for k, v in record.items() if k != "scaling"}}
    return table_of(spark, [(n, len(scoring.model_problems(r)), "; ".join(scoring.model_problems(r))) for n, r in cases.items()], "model string, n int, problems string")


# ---- challengers --------------------------------------------------------------------------------
FEATS = {"numeric": NUMERIC, "categorical": CATEGORICAL}


@query("prep_features")
def _(spark, sf):
    """Means and spreads of the prepared training columns: 0 and 1 for numbers and flags."""
    train = train_rows(spark, sf)
    p = challengers.prep_features(train, "y", NUMERIC, CATEGORICAL)
    one = train.agg(*[F.struct(F.avg(e).alias("mean"), F.stddev_pop(e).alias("sd")).alias(n) for n, _f, e in p.columns])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(f).alias("feature"), F.round(F.col(n)["mean"], 6).alias("mean"),
                                        F.round(F.col(n)["sd"], 6).alias("sd")) for n, f, _e in p.columns]))
    return one.select(each.alias("c")).select("c.*")


@query("standardise", "SELECT loan_seq, " + ", ".join(f"round(({c}-(SELECT avg({c}) FROM train))/(SELECT stddev_pop({c}) FROM train),6) AS {c}" for c in NUMERIC) + " FROM inputs")
def _(spark, sf):
    e = challengers.standardise(train_rows(spark, sf), NUMERIC)
    return rounded(inputs(spark, sf).select("loan_seq", *[x.alias(c) for c, x in e.items()]), *NUMERIC)


_ENCODED = ", ".join(f"{c}, CAST((SELECT count(DISTINCT {c}) FROM features g WHERE f.{c} IS NULL OR g.{c} < f.{c}) AS integer) AS {c}_code" for c in S.CATEGORICAL_FEATURES)


@query("label_encode", f"SELECT loan_seq, {_ENCODED} FROM features f")
def _(spark, sf):
    """Codes of every categorical input."""
    return challengers.label_encode(loans.features(spark, sf).select("loan_seq", *S.CATEGORICAL_FEATURES), S.CATEGORICAL_FEATURES)


@query("class_weights", "SELECT round(count_if(y=0)/count_if(y=1)::double,6) AS weight FROM train")
def _(spark, sf):
    w = challengers.class_weight(train_rows(spark, sf), "y")
    return train_rows(spark, sf).agg(F.round(F.max(F.lit(w)), 6).alias("weight"))


@query("stratified_split", f"""SELECT loan_seq, y, r <= round(0.15::double*n) AS held FROM (SELECT loan_seq, y, count(*) OVER (PARTITION BY y) AS n,
    row_number() OVER (PARTITION BY y ORDER BY {uniform32("loan_seq || 'strat'")}, loan_seq) AS r FROM train)""")
def _(spark, sf):
    rest, held = challengers.stratified_split(train_rows(spark, sf).select("loan_seq", "y"), "y", "loan_seq", 0.15, "strat")
    return rest.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


@query("fit_logistic_baseline")
def _(spark, sf):
    m = challengers.fit_logistic_baseline(train_rows(spark, sf), **FEATS)
    return rounded(table_of(spark, [(n, f, float(w)) for (n, f, _e), w in zip(m.preparation.columns, m.model.coefficients)],
                            "column_name string, feature string, coefficient double"), "coefficient")


_BOOSTED = {}


def boosted(spark, sf):
    """The boosted model of the training loans, fitted once an application."""
    slot = (spark.sparkContext.applicationId, sf)
    if slot not in _BOOSTED:
        narrow = train_rows(spark, sf).select("loan_seq", "y", *NUMERIC, *CATEGORICAL)
        _BOOSTED[slot] = challengers.fit_boosted_trees(narrow, **FEATS)
    return _BOOSTED[slot]


@query("fit_boosted_trees")
def _(spark, sf):
    """Validation measures of the boosted model, with the rounds that early stopping kept."""
    m = boosted(spark, sf)
    valid = load_split_guarded(inputs(spark, sf), "validation")
    table = metrics.evaluate(m.predict(valid, ["loan_seq", "y"]), "y", "p").withColumn("trees", F.lit(m.rounds)).withColumn("rounds_tried", F.lit(len(m.losses)))
    return rounded(table, "auc", "gini", "ks", "pr_auc", "brier", "default_rate", "mean_predicted_pd")


@query("predict_pd")
def _(spark, sf):
    """PD of every validation loan by scorecard, logistic and boosted model, long format.

    Each fit is a row of short jobs, so the three are fitted at the same time.
    """
    train, valid = train_rows(spark, sf), load_split_guarded(inputs(spark, sf), "validation")
    fits = [("scorecard", lambda: card(spark, sf, train).predict_pd(valid, "p").select("loan_seq", "y", "p")),
            ("logistic", lambda: challengers.fit_logistic_baseline(train, **FEATS).predict(valid, ["loan_seq", "y"])),
            ("boosted", lambda: boosted(spark, sf).predict(valid, ["loan_seq", "y"]))]
    with ThreadPoolExecutor(len(fits)) as pool:
        running = [(name, pool.submit(inheritable_thread_target(spark)(fit))) for name, fit in fits]
        parts = [(name, r.result()) for name, r in running]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("model"), "loan_seq", "y", "p")
        out = df if out is None else out.unionByName(df)
    return rounded(out, "p")


@query("smote_oversample")
def _(spark, sf):
    """Rows per class and origin after balancing."""
    train = train_rows(spark, sf)
    e = challengers.standardise(train, ["ltv", "orig_upb", "orig_term"])
    ready = train.select("loan_seq", "y", *[x.alias(c) for c, x in e.items()])
    out = challengers.smote_oversample(ready, "y", "loan_seq", ["ltv", "orig_upb", "orig_term"])
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ltv"), 4).alias("mean_ltv"))


@query("nearest_neighbours", """
    WITH vectors AS (SELECT vec_id, embedding FROM embeddings), dist AS (SELECT a.vec_id AS key, b.vec_id AS neighbour,
      list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda z: (z[1]::double-z[2]::double)*(z[1]::double-z[2]::double))) AS g FROM vectors a JOIN vectors b ON a.vec_id<>b.vec_id)
    SELECT key, max(round(g,4)) AS fifth, CAST(count(*) AS bigint) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY g, neighbour) AS r FROM dist) WHERE r<=5 GROUP BY 1""")
def _(spark, sf):
    """Neighbours of every embedding: the distance of the fifth one found (exact on tables of one leaf)."""
    vectors = loans.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = neighbours.nearest_neighbours(vectors, "vec_id", "v", 5)
    each = near.select("key", F.explode("neighbours").alias("neighbour"))
    a, b = vectors.select(F.col("vec_id").alias("key"), F.col("v").alias("a")), vectors.select(F.col("vec_id").alias("neighbour"), F.col("v").alias("b"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, z: (x - z) * (x - z)), F.lit(0.0), lambda s, x: s + x)
    return each.join(a, "key").join(b, "neighbour").groupBy("key").agg(F.max(F.round(gap, 4)).alias("fifth"), F.count(F.lit(1)).alias("n"))


_LOG_ODDS = "ln(greatest(least(pd, 1 - 1e-6), 1e-6) / (1 - greatest(least(pd, 1 - 1e-6), 1e-6)))"


@query("platt_calibrate", f"""SELECT round(avg(y), 6) AS observed, round(avg(y), 6) AS calibrated, round(avg(y * z), 5) AS observed_by_odds, round(avg(y * z), 5) AS calibrated_by_odds
    FROM (SELECT y, {_LOG_ODDS} AS z FROM scored WHERE split='calibration')""")
def _(spark, sf):
    """An unpenalised fit is where both slopes of its likelihood vanish: mean rate and mean rate by log-odds are kept."""
    cal = loans.scored(spark, sf).filter("split = 'calibration'")
    platt = challengers.platt_calibrate(cal, "pd", "y")
    out = cal.withColumn("q", platt.apply(F.col("pd"))).withColumn("z", logit(F.col("pd"), S.PROBABILITY_EPS))
    return out.agg(F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg("q"), 6).alias("calibrated"),
                   F.round(F.avg(F.col("y") * F.col("z")), 5).alias("observed_by_odds"), F.round(F.avg(F.col("q") * F.col("z")), 5).alias("calibrated_by_odds"))


@query("isotonic_calibrate", """
    WITH cells AS (SELECT pd, sum(y) AS bad, count(*) AS n, row_number() OVER (ORDER BY pd) AS i FROM scored WHERE split='calibration' GROUP BY pd),
    sums AS (SELECT *, sum(bad) OVER (ORDER BY i) AS bads, sum(n) OVER (ORDER BY i) AS rows FROM cells),
    means AS (SELECT a.i AS a, b.i AS b, (b.bads - a.bads + a.bad)::double / (b.rows - a.rows + a.n) AS m FROM sums a JOIN sums b ON b.i >= a.i),
    lowest AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM means),
    fit AS (SELECT i, max(m) AS q FROM lowest WHERE a <= i GROUP BY i)
    SELECT pd, CAST(n AS bigint) AS n, round(greatest(least(q, 1 - 1e-6), 1e-6), 9) AS q FROM fit JOIN cells USING (i)""")
def _(spark, sf):
    """The staircase at every distinct PD of its own rows (in SQL the largest least mean over all spans that hold it)."""
    cal = loans.scored(spark, sf).filter("split = 'calibration'")
    cells = cal.groupBy("pd").agg(F.count(F.lit(1)).alias("n"))
    return challengers.isotonic_calibrate(cal, "pd", "y").apply(cells, "pd", "q").withColumn("q", F.round("q", 9))


VERSIONS = ("raw", "platt", "isotonic")


@query("imbalance_ablation")
def _(spark, sf):
    """Boosted arms of as many trees as early stopping kept, raw and calibrated: measures on all validation rows (vintage NULL)
    and levels by vintage."""
    rows = inputs(spark, sf)
    valid = load_split_guarded(rows, "validation")
    fitted = challengers.imbalance_ablation(train_rows(spark, sf), load_split_guarded(rows, "calibration"), lambda: boosted(spark, sf).rounds, **FEATS)
    keep = ["loan_seq", "vintage_year", "y"]
    wide = write_scratch(functools.reduce(DataFrame.unionByName, [a.versions(valid, keep).withColumn("arm", F.lit(a.arm)) for a in fitted]), "ablation")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("p")) for v in VERSIONS]))
    long = wide.select("arm", "y", each.alias("e")).select("arm", "y", "e.*")

    def gap(a, v):
        found = metrics.ece(wide.filter(F.col("arm") == a.arm), "y", v, "loan_seq")
        return found.select(F.lit(a.arm).alias("arm"), F.lit(v).alias("version"), "ece", F.lit(a.platt.slope).alias("platt_slope"), F.lit(a.platt.offset).alias("platt_offset"))

    with ThreadPoolExecutor(len(VERSIONS)) as pool:  # short jobs each
        running = [pool.submit(inheritable_thread_target(spark)(gap), a, v) for a in fitted for v in VERSIONS]
        gaps, levels = [r.result() for r in running], []
    for a in fitted:
        own = wide.filter(F.col("arm") == a.arm)
        by_vintage = metrics.reliability_by_vintage(own, "y", VERSIONS)
        levels.append(by_vintage.select(F.lit(a.arm).alias("arm"), "version", F.col("vintage_year").cast("int").alias("vintage"), "n",
                                        F.col("defaults").cast("bigint").alias("defaults"), F.col("observed").alias("default_rate"), "mean_predicted_pd", "brier"))
    whole = metrics.evaluate(long, "y", "p", ["arm", "version"]).join(functools.reduce(DataFrame.unionByName, gaps), ["arm", "version"])
    table = whole.withColumn("vintage", F.lit(None).cast("int")).unionByName(functools.reduce(DataFrame.unionByName, levels), allowMissingColumns=True)
    return rounded(table, "default_rate", "mean_predicted_pd", "auc", "gini", "ks", "pr_auc", "brier", "ece", "platt_slope", "platt_offset")


@query("stratified_kfold")
def _(spark, sf):
    """Five stratified folds, three seeds and three variants, raw and calibrated by inner folds: mean and spread over seeds."""
    rows = train_rows(spark, sf)
    p = nested.stratified_kfold(rows, "y", "loan_seq", challengers.prep_features(rows, "y", **FEATS))
    per_seed = metrics.evaluate(write_scratch(p, "folds"), "y", "p", ["variant", "kind", "seed"], ["auc", "brier", "mean_predicted_pd"])
    return rounded(per_seed.groupBy("variant", "kind").agg(F.avg("brier").alias("brier"), F.stddev("brier").alias("brier_sd"), F.avg("auc").alias("auc"),
                                                           F.avg("mean_predicted_pd").alias("mean_pd")), "brier", "brier_sd", "auc", "mean_pd")


# ---- explanation of challengers -----------------------------------------------------------------
def _contributions(spark, sf):
    m = challengers.fit_logistic_baseline(train_rows(spark, sf), **FEATS)
    valid = load_split_guarded(inputs(spark, sf), "validation")
    return m.contributions(valid, ["loan_seq", "y"]), [f for f in NUMERIC + CATEGORICAL]


@query("mean_abs_contribution")
def _(spark, sf):
    df, names = _contributions(spark, sf)
    one = df.agg(*[F.avg(F.abs(f)).alias(f) for f in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 6).alias("mean_abs")) for f in names])).alias("c")).select("c.*")


def overlap(reasons, ranked, k):
    """Share of the top-k reasons that are among the challenger's top-k features, and whether the first one is."""
    mine, theirs = F.slice(reasons, 1, k), F.slice(ranked, 1, k)
    return F.size(F.array_intersect(mine, theirs)) / F.size(mine), F.array_contains(theirs, F.get(reasons, F.lit(0)))


def _with_reasons(spark, sf):
    df, names = _contributions(spark, sf)
    ranked = F.transform(F.sort_array(F.array(*[F.struct((-F.col(f)).alias("s"), F.lit(f).alias("f")) for f in names])), lambda s: s["f"])
    reasons = F.transform(scoring.reasons_column(scoring.adopted_model()), lambda r: r["feature"])
    mine = loans.scored(spark, sf).select("loan_seq", reasons.alias("reasons"))
    return df.select("loan_seq", ranked.alias("ranked")).join(mine, "loan_seq").filter(F.size("reasons") > 0)


@query("reason_challenger_overlap")
def _(spark, sf):
    """Agreement of the first one and the first three reasons with the challenger's features."""
    each = [F.struct(F.lit(k).alias("k"), *[e.alias(n) for n, e in zip(("share", "first"), overlap(F.col("reasons"), F.col("ranked"), k))]) for k in (1, 3)]
    df = _with_reasons(spark, sf).select(F.explode(F.array(*each)).alias("o")).select("o.*")
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("loans"), F.round(F.avg("share"), 6).alias("mean_overlap_top_k"), F.round(F.avg(F.col("first").cast("int")), 6).alias("top1_in_top_k"))


@query("key_overlap", """SELECT loan_seq, round(len(list_filter(a, lambda z: list_contains(b,z)))/len(a)::double,6) AS share FROM (
    SELECT loan_seq, list(feature ORDER BY rank) FILTER (WHERE rank<=3) AS a, ['dti','credit_score','ltv'] AS b FROM reason_rows GROUP BY 1)""")
def _(spark, sf):
    reasons = F.transform(scoring.reasons_column(scoring.adopted_model()), lambda r: r["feature"])
    df = loans.scored(spark, sf).select("loan_seq", reasons.alias("r")).filter(F.size("r") > 0)
    share, _first = overlap(F.col("r"), F.array(*[F.lit(f) for f in ("dti", "credit_score", "ltv")]), 3)
    return df.select("loan_seq", F.round(share, 6).alias("share"))


# ---- stability ----------------------------------------------------------------------------------
@query("within_vintage_iv")
def _(spark, sf):
    return rounded(stability.within_vintage_iv(inputs(spark, sf), SPECS), "iv", "noise_floor", "excess")


_SG = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, vintage_year, coalesce({f}::double, median({f}::double) OVER (PARTITION BY vintage_year)) AS x, y FROM inputs""" for f in NUMERIC)


@query("signed_gini_by_vintage", f"""SELECT feature, CAST(vintage_year AS integer) AS vintage, round(2*sum(bad*(bg+0.5::double*(n-bad)))/(max(tb)*max(tn-tb))-1,6) AS signed_gini FROM (
    SELECT *, coalesce(sum(n-bad) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS bg, sum(n) OVER (PARTITION BY feature, vintage_year)::double AS tn,
      sum(bad) OVER (PARTITION BY feature, vintage_year)::double AS tb FROM (SELECT feature, vintage_year, x, count(*) AS n, sum(y) AS bad FROM ({_SG}) GROUP BY 1,2,3)
    WINDOW w AS (PARTITION BY feature, vintage_year ORDER BY x)) GROUP BY 1,2 HAVING max(tb)>=30""")
def _(spark, sf):
    return rounded(stability.signed_gini_by_vintage(inputs(spark, sf), NUMERIC), "signed_gini")


LEVELS = S.CATEGORICAL_FEATURES


@query("level_shares", f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, coalesce({c},'missing') AS level, vintage_year FROM features" for c in LEVELS)}),
    s AS (SELECT feature, level, vintage_year, count(*)/(SELECT count(*) FROM features f WHERE f.vintage_year=c.vintage_year)::double AS share FROM c GROUP BY 1,2,3),
    r AS (SELECT feature, level, max(share) AS mx, CASE WHEN count(*)=(SELECT count(DISTINCT vintage_year) FROM features) THEN min(share) ELSE 0 END AS mn FROM s GROUP BY 1,2)
    SELECT feature, level, round(mx,6) AS max_share, round(mn,6) AS min_share, mx>=0.02::double AND (mn<0.002::double OR mx/greatest(mn,1e-6::double)>=8) AS vanishing FROM r""")
def _(spark, sf):
    return rounded(stability.level_shares(loans.features(spark, sf), LEVELS), "max_share", "min_share")


@query("feature_stability_report")
def _(spark, sf):
    return rounded(stability.feature_stability_report(inputs(spark, sf), SPECS), "pooled_iv", "median_excess_iv", "min_excess_iv", "keep_ratio")


@query("leave_one_vintage_out")
def _(spark, sf):
    """Every candidate set with every vintage left out."""
    return rounded(folds.leave_one_vintage_out(inputs(spark, sf), stability.CANDIDATE_SETS, min_iv=MIN_IV, allow_constant=True), "gini", "pred_over_obs")


@query("refit_without_vintage")
def _(spark, sf):
    """Level and rank per vintage of the card refitted without the oldest vintage, bands included, next to the full refit."""
    rows = inputs(spark, sf)
    oldest = rows.agg(F.min("vintage_year")).first()[0]
    table = folds.refit_without_vintage(rows, S.V2_NUMERIC, S.V2_CATEGORICAL, oldest, min_iv=MIN_IV, allow_constant=True)
    return rounded(table, "predicted_defaults", "observed_rate", "predicted_rate", "ratio", "level_error", "default_count_miss", "gini")


# ---- arms and intervals -------------------------------------------------------------------------
def arms(spark, sf):
    """The adopted card, the same card without income information, and one refitted on the development rows; later vintages."""
    rows = loans.scored(spark, sf)
    less = {f: s for f, s in ADOPTED.items() if f != "dti"}
    refit = scorecard.fit_scorecard(rows.filter(F.col("vintage_year") <= loans.DEV_MAX_VINTAGE), "y", S.V2_NUMERIC, S.V2_CATEGORICAL,
                                    specs={f: {k: v for k, v in s.items() if k != "points"} for f, s in ADOPTED.items()}, min_iv=0.0)
    share = S.ADOPTED_SCALING["offset"] / len(ADOPTED)
    reduced = scoring.model_record("no_income", less, {**S.ADOPTED_SCALING, "offset": S.ADOPTED_SCALING["offset"] - share})
    late = rows.filter(F.col("vintage_year") > loans.DEV_MAX_VINTAGE)
    late = refit.predict_pd(late.withColumn("v2", F.col("pd")), "v1b")
    v1 = scoring.pd_column(reduced, scoring.score_column(reduced))
    return write_scratch(late.select("loan_seq", "vintage_year", "y", v1.alias("v1"), "v1b", "v2"), "arms")


ARMS = ("v1", "v1b", "v2")
PAIRS = (("v2", "v1"), ("v2", "v1b"), ("v1b", "v1"))
RESAMPLES = 1000


@query("model_arms_compare")
def _(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("p")) for a in ARMS]))
    long = arms(spark, sf).select("vintage_year", "y", each.alias("e")).select("vintage_year", "y", "e.*")
    return rounded(metrics.evaluate(long, "y", "p", ["arm", "vintage_year"]), "default_rate", "mean_predicted_pd", "auc", "gini", "ks", "pr_auc", "brier")


def replicates(spark, sf):
    """All resamples of every vintage, drawn once an application."""
    return staged_once(spark, f"{sf}/replicates", lambda: bootstrap.paired_bootstrap(arms(spark, sf), "y", ARMS, RESAMPLES, by=("vintage_year",)))


@query("paired_bootstrap")
def _(spark, sf):
    return rounded(replicates(spark, sf), "gini", "ks", "brier", "pred_over_obs")


@query("percentile_ci", """SELECT split, round(quantile_cont(pd,0.025),6) AS low, round(quantile_cont(pd,0.975),6) AS high FROM scored GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.percentile_ci(loans.scored(spark, sf), "pd", ["split"]), "low", "high")


@query("bootstrap_intervals")
def _(spark, sf):
    return rounded(bootstrap.interval_table(replicates(spark, sf), by=["vintage_year", "arm"]), "low", "high")


@query("gini_difference_ci")
def _(spark, sf):
    return rounded(bootstrap.gini_difference_ci(replicates(spark, sf), PAIRS, ["vintage_year"]), "low", "high")


@query("mean_difference_verdict")
def _(spark, sf):
    return rounded(bootstrap.mean_difference_verdict(replicates(spark, sf), PAIRS, "vintage_year"), "low", "high", "mean_difference")
