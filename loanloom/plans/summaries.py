"""Ranking metrics, calibration tables, scoring and explanation on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import stats
from loanloom.functions.bands import band_index, band_labels
from loanloom.operators import metrics, ranks, scoring
from loanloom.plans import loans
from loanloom.plans.oracle import ADOPTED, band_case, band_index_case, register, uniform32
from loanloom.plans.preparation import rounded
from loanloom.plans.registry import query

MEASURES = ("n", "defaults", "default_rate", "mean_predicted_pd", "auc", "gini", "ks", "pr_auc", "brier")


def validation(spark, sf):
    return loans.scored(spark, sf).filter(F.col("split") == "validation")


register("v", "SELECT * FROM scored WHERE split = 'validation'")


def evaluate_sql(source: str, by: str = "", p: str = "pd", y: str = "y", having: str = "") -> str:
    """The metric row per group, written with running totals over distinct scores."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {lead}CAST(sum(n) AS bigint) AS n, CAST(sum(bad) AS bigint) AS defaults, round(sum(bad)/sum(n)::double,6) AS default_rate,
      round(sum(n*x)/sum(n),6) AS mean_predicted_pd,
      round(sum(bad*(bg+0.5::double*(n-bad)))/(max(tb)::double*max(tn-tb)),6) AS auc,
      round(2*sum(bad*(bg+0.5::double*(n-bad)))/(max(tb)::double*max(tn-tb))-1,6) AS gini,
      round(greatest(max(bg/(tn-tb)::double - bb/tb::double),0.0::double),6) AS ks,
      round(sum(bad/tb::double*(tb-bb)/(tn-bb-bg)::double),6) AS pr_auc,
      round(sum(bad*(1-x)*(1-x)+(n-bad)*x*x)/sum(n),6) AS brier
    FROM (SELECT *, coalesce(sum(n-bad) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS bg,
            coalesce(sum(bad) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::double AS bb,
            sum(n) OVER ({part})::double AS tn, sum(bad) OVER ({part})::double AS tb
          FROM (SELECT {lead}{p} AS x, count(*) AS n, sum({y}) AS bad FROM {source} GROUP BY {lead}{p}) c
          WINDOW w AS ({part} ORDER BY x)) {group} {having}"""


def pick_sql(columns: str, inner: str) -> str:
    return f"SELECT {columns} FROM ({inner})"


def one_metric(name):
    @query(f"metric_{name}", pick_sql(name, evaluate_sql("v")))
    def _(spark, sf):
        return rounded(metrics.evaluate(validation(spark, sf), "y", "pd", names=[name]), name)


for _m in ("auc", "gini", "ks", "pr_auc", "brier"):
    one_metric(_m)


@query("evaluate", evaluate_sql("v"))
def _(spark, sf):
    return rounded(metrics.evaluate(validation(spark, sf), "y", "pd"), *MEASURES[2:])


@query("evaluate_by_vintage", evaluate_sql("scored", "vintage_year", having="HAVING sum(bad) >= 20"))
def _(spark, sf):
    return rounded(metrics.evaluate_by_vintage(loans.scored(spark, sf), "y", "pd"), *MEASURES[2:])


@query("cumulative_curve", """
    SELECT round(x,10) AS threshold, CAST(sum(bad) OVER w AS bigint) AS cum_bad, CAST(sum(n-bad) OVER w AS bigint) AS cum_good,
      round(sum(bad) OVER w/(sum(bad) OVER ())::double,6) AS tpr, round(sum(n-bad) OVER w/(sum(n-bad) OVER ())::double,6) AS fpr
    FROM (SELECT pd AS x, count(*) AS n, sum(y) AS bad FROM v GROUP BY 1) WINDOW w AS (ORDER BY x DESC)""")
def _(spark, sf):
    return rounded(metrics.cumulative_curve(validation(spark, sf), "y", "pd"), "tpr", "fpr")


def ranked_sql(source: str, bins: int) -> str:
    return f"""SELECT *, CAST(greatest(0, ceil((r-1)*{bins}.0::double/(nn-1))-1) AS integer) AS bin FROM (
      SELECT *, row_number() OVER (ORDER BY pd, {uniform32("loan_seq || 'tie'")}, loan_seq) AS r, count(*) OVER () AS nn FROM {source})"""


@query("equal_size_bins", f"SELECT loan_seq, bin FROM ({ranked_sql('v', 10)})")
def _(spark, sf):
    return ranks.equal_size_bins(validation(spark, sf).select("loan_seq", "pd"), "pd", "loan_seq", 10).select("loan_seq", "bin")


CALIBRATION_SQL = f"""SELECT bin, CAST(count(*) AS bigint) AS loans, round(avg(pd),6) AS predicted, round(avg(y),6) AS observed
    FROM ({ranked_sql('v', 10)}) GROUP BY bin"""


@query("calibration_table", CALIBRATION_SQL)
def _(spark, sf):
    return rounded(metrics.calibration_table(validation(spark, sf), "y", "pd", "loan_seq"), "predicted", "observed")


@query("metric_ece", f"""SELECT round(sum(loans*abs(p-o))/sum(loans),6) AS ece FROM (
    SELECT bin, count(*) AS loans, avg(pd) AS p, avg(y) AS o FROM ({ranked_sql('v', 10)}) GROUP BY bin)""")
def _(spark, sf):
    return rounded(metrics.ece(validation(spark, sf), "y", "pd", "loan_seq"), "ece")


_EDGES = ", ".join(f"quantile_cont(pd,{i}/8.0)" for i in range(1, 8))


@query("reliability_curve_quantile", f"""
    WITH e AS (SELECT [{_EDGES}] AS edges FROM v)
    SELECT CAST(len(list_filter(edges, lambda z: z < pd)) AS integer) AS bin, CAST(count(*) AS bigint) AS loans, round(avg(pd),6) AS predicted,
      round(avg(y),6) AS observed FROM v, e GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.reliability_curve_quantile(validation(spark, sf), "y", "pd"), "predicted", "observed")


@query("reliability_by_vintage", """
    WITH z AS (SELECT vintage_year, y, pd, 1.0/(1.0+exp(-(ln(pd/(1-pd))+0.5::double))) AS q FROM scored),
    u AS (SELECT vintage_year, y, 'pd' AS version, pd AS p FROM z UNION ALL SELECT vintage_year, y, 'shifted', q FROM z)
    SELECT vintage_year, version, CAST(count(*) AS bigint) AS n, CAST(sum(y) AS bigint) AS defaults, round(avg(y),6) AS observed,
      round(avg(p),6) AS mean_predicted_pd, round(avg((p-y)*(p-y)),6) AS brier FROM u GROUP BY 1,2 HAVING sum(y)>=20""")
def _(spark, sf):
    df = loans.scored(spark, sf).withColumn("shifted", stats.logit_shift(F.col("pd"), 0.5))
    return rounded(metrics.reliability_by_vintage(df, "y", ["pd", "shifted"]), "observed", "mean_predicted_pd", "brier")


@query("pooled_and_by_vintage", """SELECT vintage_year, CAST(grouping(vintage_year) AS integer) AS pooled, CAST(count(*) AS bigint) AS loans,
    CAST(sum(y) AS bigint) AS defaults, round(avg(y),6) AS observed, round(avg(pd),6) AS predicted FROM scored
    GROUP BY GROUPING SETS ((vintage_year),()) HAVING grouping(vintage_year)=1 OR sum(y)>=20""")
def _(spark, sf):
    return rounded(metrics.pooled_and_by_vintage(loans.scored(spark, sf), "y", "pd"), "observed", "predicted")


LEVEL_SQL = """CAST(count(*) AS bigint) AS loans, CAST(sum(y) AS bigint) AS defaults, round(sum(pd),4) AS predicted_defaults,
    round(avg(y),6) AS observed_rate, round(avg(pd),6) AS predicted_rate, round(avg(y)/avg(pd),6) AS ratio,
    round(abs(ln(avg(pd)/avg(y))),6) AS level_error, round(abs(sum(pd)-sum(y)),4) AS default_count_miss"""


def _level(df):
    out = rounded(df, "observed_rate", "predicted_rate", "ratio", "level_error")
    return out.withColumn("predicted_defaults", F.round("predicted_defaults", 4)).withColumn(
        "default_count_miss", F.round("default_count_miss", 4))


@query("vintage_level_table", f"SELECT vintage, {LEVEL_SQL} FROM frame GROUP BY 1")
def _(spark, sf):
    return _level(metrics.level_table(loans.monitor_frame(spark, sf), "y", "pd", ["vintage"]))


@query("level_ratio", "SELECT round(avg(y),6) AS observed_rate, round(avg(pd),6) AS predicted_rate, round(avg(y)/avg(pd),6) AS ratio FROM scored")
def _(spark, sf):
    return rounded(metrics.level_table(loans.scored(spark, sf), "y", "pd").select("observed_rate", "predicted_rate", "ratio"),
                   "observed_rate", "predicted_rate", "ratio")


@query("level_error", "SELECT split, round(abs(ln(avg(pd)/avg(y))),6) AS level_error FROM scored GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.level_table(loans.scored(spark, sf), "y", "pd", ["split"]).select("split", "level_error"), "level_error")


@query("spearman_scores", """
    WITH r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2.0 AS a,
                      rank() OVER (ORDER BY credit_score) + (count(*) OVER (PARTITION BY credit_score)-1)/2.0 AS b
               FROM scored WHERE credit_score IS NOT NULL)
    SELECT round(corr(a,b),6) AS spearman FROM r""")
def _(spark, sf):
    df = loans.scored(spark, sf).filter(F.col("credit_score").isNotNull())
    return rounded(metrics.spearman(df, "score", "credit_score"), "spearman")


@query("wilson_interval", """
    SELECT vintage_year, CAST(s AS bigint) AS defaults, CAST(n AS bigint) AS loans,
      round(greatest(0,(s/n+z*z/(2*n)-z*sqrt(s/n*(1-s/n)/n+z*z/(4*n*n)))/(1+z*z/n)),6) AS low,
      round(least(1,(s/n+z*z/(2*n)+z*sqrt(s/n*(1-s/n)/n+z*z/(4*n*n)))/(1+z*z/n)),6) AS high
    FROM (SELECT vintage_year, sum(default_24m)::double AS s, count(*)::double AS n, 1.96::double AS z FROM features GROUP BY 1)""")
def _(spark, sf):
    g = loans.features(spark, sf).groupBy("vintage_year").agg(F.sum(S.TARGET).alias("defaults"), F.count(F.lit(1)).alias("loans"))
    band = stats.wilson_interval(F.col("defaults"), F.col("loans"))
    return rounded(g.select("vintage_year", "defaults", "loans", band["low"].alias("low"), band["high"].alias("high")), "low", "high")


@query("confusion_matrix", """
    SELECT *, round((tp+tn)/(tp+tn+fp+fn)::double,6) AS accuracy, round(tp/nullif(tp+fp,0)::double,6) AS precision_bad,
      round(tp/nullif(tp+fn,0)::double,6) AS recall_bad, round(2*tp/nullif(2*tp+fp+fn,0)::double,6) AS f1_bad,
      round(tn/nullif(tn+fn,0)::double,6) AS precision_good, round(tn/nullif(tn+fp,0)::double,6) AS recall_good,
      round(2*tn/nullif(2*tn+fp+fn,0)::double,6) AS f1_good
    FROM (SELECT CAST(count_if(y=0 AND pd<=0.2::double) AS bigint) AS tn, CAST(count_if(y=0 AND pd>0.2::double) AS bigint) AS fp,
            CAST(count_if(y=1 AND pd<=0.2::double) AS bigint) AS fn, CAST(count_if(y=1 AND pd>0.2::double) AS bigint) AS tp FROM scored)""")
def _(spark, sf):
    df = loans.scored(spark, sf).withColumn("flagged", (F.col("pd") > 0.2).cast("int"))
    return rounded(metrics.confusion_matrix(df, "y", "flagged"), "accuracy", "precision_bad", "recall_bad", "f1_bad",
                   "precision_good", "recall_good", "f1_good")


@query("class_balance", """SELECT target, CAST(count(*) AS bigint) AS n, round(100.0*count(*)/sum(count(*)) OVER (),2) AS pct
    FROM (SELECT CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS target FROM orders) GROUP BY 1""")
def _(spark, sf):
    target = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target")
    counts = loans.table(spark, sf, "orders").groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return metrics.running_share(counts, "n").select("target", "n", F.round(100 * F.col("share"), 2).alias("pct"))


@query("score_range", "SELECT split, round(min(score),6) AS low, round(max(score),6) AS high FROM scored GROUP BY 1")
def _(spark, sf):
    return rounded(loans.scored(spark, sf).groupBy("split").agg(F.min("score").alias("low"), F.max("score").alias("high")), "low", "high")


@query("training_ranges", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(CAST(min({c}) AS double),6) AS low, round(CAST(max({c}) AS double),6) AS high FROM inputs WHERE vintage_year<=1998"
    for c in S.V2_NUMERIC))
def _(spark, sf):
    df = loans.with_borrower_flag(loans.features(spark, sf)).filter(F.col("vintage_year") <= loans.DEV_MAX_VINTAGE)
    return rounded(training_ranges(df, S.V2_NUMERIC), "low", "high")


def training_ranges(df, columns):
    """Minimum and maximum of every numeric input, long format, one aggregate."""
    one = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"low_{c}").alias("low"),
                                                   F.col(f"high_{c}").alias("high")) for c in columns])).alias("r")).select("r.*")


# ---- scoring and explanation --------------------------------------------------------------------
@query("assign_band", "SELECT loan_seq, " + ", ".join(f"{band_index_case(f, s)} AS {f}_band" for f, s in ADOPTED.items()) + " FROM inputs")
def _(spark, sf):
    df = loans.with_borrower_flag(loans.features(spark, sf))
    return df.select("loan_seq", *[band_index(f, s).alias(f"{f}_band") for f, s in ADOPTED.items()])


def _labels(spec):
    return band_labels(spec)


@query("band_labels", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {band_case(f, s, _labels(s))} AS band, CAST(count(*) AS bigint) AS loans FROM inputs GROUP BY 1,2"
    for f, s in ADOPTED.items()))
def _(spark, sf):
    """Loans per labelled band of every feature, one shuffle for all features."""
    from loanloom.functions.bands import band_lookup
    df = loans.with_borrower_flag(loans.features(spark, sf))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), band_lookup(f, s, _labels(s)).alias("band"))
                                for f, s in ADOPTED.items()])).alias("b")
    return df.select(pairs).groupBy("b.feature", "b.band").agg(F.count(F.lit(1)).alias("loans"))


@query("score_batch", "SELECT loan_seq, round(score,6) AS score, round(pd,6) AS pd FROM scored")
def _(spark, sf):
    return rounded(loans.scored_view(spark, sf).select("loan_seq", "score", "pd"), "score", "pd")


@query("join_points_lookup", " UNION ALL ".join(
    f"SELECT loan_seq, '{f}' AS feature, round(CAST({band_case(f, s, s['points'])} AS double),6) AS points FROM inputs" for f, s in ADOPTED.items()))
def _(spark, sf):
    record = scoring.adopted_model()
    df = loans.with_borrower_flag(loans.features(spark, sf))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(scoring.feature_points(record, f), 6).alias("points"))
                                for f in record["feature_order"]])).alias("p")
    return df.select("loan_seq", pairs).select("loan_seq", "p.*")


register("lost", " UNION ALL ".join(
    f"SELECT loan_seq, pd, y, '{f}' AS feature, {i} AS pos, '{S.REASON_CODES[f][0]}' AS code, "
    f"{max(s['points'])!r}::double - CAST({band_case(f, s, s['points'])} AS double) AS lost, {band_case(f, s, _labels(s))} AS band FROM scored"
    for i, (f, s) in enumerate(ADOPTED.items())))
register("reason_rows", """SELECT *, row_number() OVER (PARTITION BY loan_seq ORDER BY lost DESC, pos) AS rank FROM lost
    QUALIFY row_number() OVER (PARTITION BY loan_seq ORDER BY lost DESC, pos) <= 4 AND lost >= 5""")


@query("explain_batch", """SELECT loan_seq, CAST(rank AS integer) AS rank, code, feature, band, round(lost,6) AS points_lost FROM reason_rows""")
def _(spark, sf):
    df = scoring.explain_batch(scoring.adopted_model(), loans.scored(spark, sf))
    each = df.select("loan_seq", F.posexplode("reasons").alias("pos", "r"))
    return each.select("loan_seq", (F.col("pos") + 1).alias("rank"), "r.code", "r.feature", "r.band",
                       F.round("r.points_lost", 6).alias("points_lost"))


@query("rank_top_k_reasons", """SELECT loan_seq, string_agg(code, ',' ORDER BY rank) AS codes FROM reason_rows WHERE rank <= 3 GROUP BY 1""")
def _(spark, sf):
    record = scoring.adopted_model()
    codes = F.transform(scoring.reasons_column(record, top_k=3), lambda r: r["code"])
    return loans.scored(spark, sf).select("loan_seq", F.array_join(codes, ",").alias("codes")).filter("codes <> ''")


@query("first_reason_counts", "SELECT feature, CAST(count(*) AS bigint) AS loans FROM reason_rows WHERE rank=1 GROUP BY 1")
def _(spark, sf):
    first = F.get(scoring.reasons_column(scoring.adopted_model(), 1), F.lit(0))["feature"]
    return (loans.scored(spark, sf).select(first.alias("feature")).filter("feature IS NOT NULL").groupBy("feature")
            .agg(F.count(F.lit(1)).alias("loans")))


@query("best_points", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(max(p),6) AS best FROM (SELECT CAST({band_case(f, s, s['points'])} AS double) AS p FROM inputs)"
    for f, s in ADOPTED.items()))
def _(spark, sf):
    """Best attained points per feature: only bands that hold at least one loan count."""
    record = scoring.adopted_model()
    df = loans.with_borrower_flag(loans.features(spark, sf))
    one = df.agg(*[F.max(scoring.feature_points(record, f)).alias(f) for f in record["feature_order"]])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 6).alias("best"))
                                          for f in record["feature_order"]])).alias("b")).select("b.*")


register("requests", """SELECT loan_seq, credit_score, CASE WHEN dti>60 THEN dti+10 ELSE dti END::double AS dti, ltv::double AS ltv,
    cltv::double AS cltv, int_rate AS interest_rate, round(int_rate-rate_spread,6) AS reference_rate,
    CASE WHEN n_borrowers=3 AND state='NATION_7' THEN 11 ELSE n_borrowers END AS number_of_borrowers, mi_pct::double AS mi_pct,
    CASE WHEN vintage_quarter=4 AND state='NATION_3' THEN 700 ELSE orig_term END AS term_months,
    CASE WHEN occupancy='S' THEN 'Z' ELSE purpose END AS purpose FROM features""")


def requests(spark, sf):
    """Feature rows as scoring requests, some of them outside the request contract."""
    c = F.col
    return loans.features(spark, sf).select(
        "loan_seq", "credit_score", F.when(c("dti") > 60, c("dti") + 10).otherwise(c("dti")).cast("double").alias("dti"),
        c("ltv").cast("double").alias("ltv"), c("cltv").cast("double").alias("cltv"), c("int_rate").alias("interest_rate"),
        F.round(c("int_rate") - c("rate_spread"), 6).alias("reference_rate"),
        F.when((c("n_borrowers") == 3) & (c("state") == "NATION_7"), 11).otherwise(c("n_borrowers")).alias("number_of_borrowers"),
        c("mi_pct").cast("double").alias("mi_pct"),
        F.when((c("vintage_quarter") == 4) & (c("state") == "NATION_3"), 700).otherwise(c("orig_term")).alias("term_months"),
        F.when(c("occupancy") == "S", "Z").otherwise(c("purpose")).alias("purpose"))


_VIOLATIONS = " || ".join([f"CASE WHEN {f} < {lo} OR {f} > {hi} THEN '{f},' ELSE '' END" for f, (lo, hi) in S.REQUEST_RANGES.items()]
                          + ["CASE WHEN purpose NOT IN ('P','C','N','R') THEN 'purpose,' ELSE '' END"])


@query("validate_application", f"SELECT loan_seq, rtrim(v,',') AS violations, v='' AS accepted FROM (SELECT loan_seq, {_VIOLATIONS} AS v FROM requests)")
def _(spark, sf):
    df = scoring.validate_application(requests(spark, sf))
    return df.select("loan_seq", F.array_join("violations", ",").alias("violations"), "accepted")


@query("derive_model_input", """SELECT loan_seq, round(interest_rate-reference_rate,6) AS rate_spread,
    CASE WHEN number_of_borrowers IS NOT NULL THEN CAST(number_of_borrowers>=2 AS integer)::double END AS several_borrowers,
    term_months::double AS orig_term, credit_score::double AS credit_score FROM requests""")
def _(spark, sf):
    df = scoring.derive_model_input(requests(spark, sf))
    return rounded(df.select("loan_seq", "rate_spread", "several_borrowers", "orig_term", "credit_score"), "rate_spread")


_OUTSIDE = " || ".join(f"CASE WHEN {f} < {lo!r} OR {f} > {hi!r} THEN '{f},' ELSE '' END" for f, (lo, hi) in S.ADOPTED_TRAINING_RANGES.items())


@query("outside_training_range", f"SELECT loan_seq, rtrim({_OUTSIDE},',') AS outside FROM inputs")
def _(spark, sf):
    names = scoring.outside_training_range(scoring.adopted_model())
    return loans.with_borrower_flag(loans.features(spark, sf)).select("loan_seq", F.array_join(names, ",").alias("outside"))


@query("policy_decision", "SELECT loan_seq, CASE WHEN pd<0.02::double THEN 'approve' WHEN pd>0.05::double THEN 'decline' ELSE 'refer' END AS decision FROM scored")
def _(spark, sf):
    return loans.scored(spark, sf).select("loan_seq", scoring.policy_decision(F.col("pd")).alias("decision"))


@query("decision_counts", """SELECT split, CASE WHEN pd<0.02::double THEN 'approve' WHEN pd>0.05::double THEN 'decline' ELSE 'refer' END AS decision,
    CAST(count(*) AS bigint) AS loans FROM scored GROUP BY 1,2""")
def _(spark, sf):
    return loans.scored(spark, sf).groupBy("split", scoring.policy_decision(F.col("pd")).alias("decision")).agg(F.count(F.lit(1)).alias("loans"))


@query("riskiest_and_safest", """
    (SELECT 'riskiest' AS side, loan_seq, round(pd,6) AS pd, y, (SELECT string_agg(code, ',' ORDER BY rank) FROM reason_rows r WHERE r.loan_seq=v.loan_seq) AS codes
     FROM v ORDER BY pd DESC, loan_seq LIMIT 3)
    UNION ALL (SELECT 'safest', loan_seq, round(pd,6), y, (SELECT string_agg(code, ',' ORDER BY rank) FROM reason_rows r WHERE r.loan_seq=v.loan_seq)
     FROM v ORDER BY pd, loan_seq LIMIT 2)""")
def _(spark, sf):
    """Two TakeOrdered passes; reasons are computed only for the five rows kept."""
    rows = validation(spark, sf)
    ends = [("riskiest", F.col("pd").desc(), 3), ("safest", F.col("pd").asc(), 2)]
    picked = [rows.orderBy(order, "loan_seq").limit(n).withColumn("side", F.lit(side)) for side, order, n in ends]
    codes = F.transform(scoring.reasons_column(scoring.adopted_model()), lambda r: r["code"])
    both = picked[0].unionByName(picked[1])
    return rounded(both.select("side", "loan_seq", "pd", "y", F.nullif(F.array_join(codes, ","), F.lit("")).alias("codes")), "pd")


@query("monitor_frame", "SELECT loan_seq, CAST(vintage AS integer) AS vintage, in_sample, y, round(pd,6) AS pd FROM frame")
def _(spark, sf):
    return rounded(loans.monitor_frame(spark, sf).select("loan_seq", "vintage", "in_sample", "y", "pd"), "pd")


@query("logit_shift", "SELECT loan_seq, round(1.0/(1.0+exp(-(ln(pd/(1-pd))+0.3::double))),6) AS shifted FROM scored")
def _(spark, sf):
    return rounded(loans.scored(spark, sf).select("loan_seq", stats.logit_shift(F.col("pd"), 0.3).alias("shifted")), "shifted")


@query("theory_cutoff", """SELECT margin, loss, round(margin/(margin+loss),6) AS cutoff, CAST((SELECT count(*) FROM scored WHERE pd<=margin/(margin+loss)) AS bigint) AS approved
    FROM (SELECT unnest([0.005,0.01,0.02,0.03])::double AS margin), (SELECT unnest([0.01,0.05,0.1,0.2])::double AS loss)""")
def _(spark, sf):
    """Loans under the theoretical line of every assumption pair: one pass counts all lines."""
    pairs = [(m, k) for m in S.MONEY["margin_grid"] for k in S.MONEY["loss_grid"]]
    one = loans.scored(spark, sf).agg(*[F.count_if(F.col("pd") <= m / (m + k)).alias(f"c{i}") for i, (m, k) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.lit(k).alias("loss"), F.col(f"c{i}").alias("approved"))
                               for i, (m, k) in enumerate(pairs)])).alias("r")
    return rounded(one.select(each).select("r.*").withColumn("cutoff", stats.theory_cutoff(F.col("margin"), F.col("loss"))), "cutoff")
