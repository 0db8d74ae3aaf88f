"""Money, fairness, drift, drills and recalibration on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import hashing
from loanloom.operators import fairness, metrics, monitoring, money, scoring
from loanloom.plans import loans
from loanloom.plans.oracle import ADOPTED, PD_SQL, SCORE_SQL, band_index_case, register, uniform32
from loanloom.plans.preparation import rounded
from loanloom.plans.registry import query

MARGIN, LOSS = S.MONEY["margin"], S.MONEY["loss"]
LINE = 0.15  # an approval line inside the PD range of the shared tables
LINE_SQL = "0.15::double"
M_SQL, L_SQL = "0.02::double", "0.1::double"

register("money_rows", "SELECT *, orig_upb AS ead FROM scored")
register("vm", "SELECT * FROM money_rows WHERE split='validation'")


def money_rows(spark, sf):
    return loans.scored(spark, sf).withColumn("ead", F.col("orig_upb"))


def money_validation(spark, sf):
    return money_rows(spark, sf).filter(F.col("split") == "validation")


def cents(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 2))
    return df


@query("realised_profit", f"""SELECT split, round(sum(CASE WHEN pd<={LINE_SQL} THEN CASE WHEN y=0 THEN {M_SQL}*ead ELSE -({L_SQL}*ead) END ELSE 0 END),2) AS profit
    FROM money_rows GROUP BY 1""")
def _(spark, sf):
    return cents(money.realised_profit(money_rows(spark, sf), F.col("pd") <= LINE, MARGIN, LOSS, ["split"]), "profit")


register("thresholds", """SELECT DISTINCT unnest(quantile_cont(pd, list_transform(range(0,101), lambda i: 0.5::double + 0.5::double*i/100))) AS threshold FROM vm""")
CURVE_SQL = f"""SELECT threshold, avg((pd<=threshold)::integer) AS approval_rate,
    sum(CASE WHEN pd<=threshold THEN CASE WHEN y=0 THEN {M_SQL}*ead ELSE -({L_SQL}*ead) END ELSE 0 END) AS profit FROM vm CROSS JOIN thresholds GROUP BY 1"""


@query("profit_curve", f"SELECT round(threshold,6) AS threshold, round(approval_rate,6) AS approval_rate, round(profit,2) AS profit FROM ({CURVE_SQL})")
def _(spark, sf):
    return cents(rounded(money.profit_curve(money_validation(spark, sf), MARGIN, LOSS), "threshold", "approval_rate"), "profit")


BEST_SQL = f"SELECT round(threshold,6) AS threshold, round(approval_rate,6) AS approval_rate, round(profit,2) AS profit FROM ({CURVE_SQL}) ORDER BY round(profit,2) DESC, threshold LIMIT 1"


@query("best_cutoff", BEST_SQL)
def _(spark, sf):
    return cents(rounded(money.best_cutoff(money_validation(spark, sf), MARGIN, LOSS), "threshold", "approval_rate"), "profit")


@query("best_threshold", f"""SELECT loss, arg_max(threshold, (round(profit,2), -threshold)) AS threshold, max(round(profit,2)) AS profit FROM (
    SELECT loss, round(threshold,6) AS threshold, sum(CASE WHEN pd<=threshold THEN CASE WHEN y=0 THEN {M_SQL}*ead ELSE -(loss*ead) END ELSE 0 END) AS profit
    FROM vm CROSS JOIN thresholds CROSS JOIN (SELECT unnest([0.01,0.05,0.1,0.2])::double AS loss) GROUP BY loss, thresholds.threshold) GROUP BY 1""")
def _(spark, sf):
    grid = F.explode(F.array(*[F.lit(k) for k in S.MONEY["loss_grid"]]))
    curve = money.threshold_totals(money_validation(spark, sf)).withColumn("loss", grid).select(
        "loss", "threshold", F.lit(0.0).alias("approval_rate"),
        F.round(MARGIN * F.col("ead_good") - F.col("loss") * F.col("ead_bad"), 2).alias("profit"))
    return rounded(money.best_row(curve, ["loss"]).drop("approval_rate"), "threshold")


@query("sensitivity_grid", f"""
    WITH c AS (SELECT margin, loss, threshold, avg((pd<=threshold)::integer) AS approval_rate,
        sum(CASE WHEN pd<=threshold THEN CASE WHEN y=0 THEN margin*ead ELSE -(loss*ead) END ELSE 0 END) AS profit,
        sum(CASE WHEN y=0 THEN margin*ead ELSE -(loss*ead) END) AS base, sum(ead) AS exposure
      FROM vm CROSS JOIN thresholds, (SELECT unnest([0.005,0.01,0.02,0.03])::double AS margin), (SELECT unnest([0.01,0.05,0.1,0.2])::double AS loss) GROUP BY 1,2,3),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY margin, loss ORDER BY round(profit,2) DESC, threshold)=1)
    SELECT margin, loss, round(margin/(margin+loss),6) AS theory_cutoff, round(threshold,6) AS best_cutoff, round(approval_rate,6) AS approval_rate,
      round(profit-base,2) AS profit_gain_vs_approve_all, round((profit-base)/exposure,6) AS gain_pct_of_exposure FROM b""")
def _(spark, sf):
    df = money.sensitivity_grid(money_validation(spark, sf), S.MONEY["margin_grid"], S.MONEY["loss_grid"])
    return cents(rounded(df, "theory_cutoff", "best_cutoff", "approval_rate", "gain_pct_of_exposure"), "profit_gain_vs_approve_all")


PROFIT_SQL = f"CASE WHEN y=0 THEN {M_SQL}*ead ELSE -({L_SQL}*ead) END"


@query("decision_report", f"""SELECT split, round(avg((pd<={LINE_SQL})::integer),6) AS approval_rate, round(avg(y),6) AS default_rate_all,
    round(avg(y) FILTER (WHERE pd<={LINE_SQL}),6) AS default_rate_approved, round(sum(CASE WHEN pd<={LINE_SQL} THEN 0 ELSE y END)/nullif(sum(y),0)::double,6) AS defaults_refused_share,
    round(count_if(y=0 AND pd>{LINE_SQL})/greatest(count_if(y=0),1)::double,6) AS good_loans_refused_share,
    round(sum(CASE WHEN pd<={LINE_SQL} THEN {PROFIT_SQL} ELSE 0 END),2) AS profit_with_line, round(sum({PROFIT_SQL}),2) AS profit_approve_all,
    0.0::double AS profit_refuse_all, round(sum(ead),2) AS total_exposure FROM money_rows GROUP BY 1""")
def _(spark, sf):
    df = money.decision_report(money_rows(spark, sf), LINE, MARGIN, LOSS, ["split"])
    df = rounded(df, "approval_rate", "default_rate_all", "default_rate_approved", "defaults_refused_share", "good_loans_refused_share")
    return cents(df, "profit_with_line", "profit_approve_all", "total_exposure")


@query("loss_scenarios", f"""SELECT split, loss,
    round(sum(CASE WHEN pd<={LINE_SQL} THEN CASE WHEN y=0 THEN {M_SQL}*ead ELSE -(loss*ead) END ELSE 0 END)/sum(ead),6) AS with_line_pct,
    round(sum(CASE WHEN y=0 THEN {M_SQL}*ead ELSE -(loss*ead) END)/sum(ead),6) AS approve_all_pct,
    round((sum(CASE WHEN pd<={LINE_SQL} THEN CASE WHEN y=0 THEN {M_SQL}*ead ELSE -(loss*ead) END ELSE 0 END)
      -sum(CASE WHEN y=0 THEN {M_SQL}*ead ELSE -(loss*ead) END))/sum(ead),6) AS gain_pct
    FROM money_rows, (SELECT unnest([0.01,0.05,0.1,0.2])::double AS loss) GROUP BY 1,2""")
def _(spark, sf):
    df = money.loss_scenarios(money_rows(spark, sf), LINE, MARGIN, S.MONEY["loss_grid"], ["split"])
    return rounded(df, "with_line_pct", "approve_all_pct", "gain_pct")


@query("el_by_band", f"""SELECT CAST(greatest(0, ceil((r-1)*10.0::double/(nn-1))-1) AS integer)+1 AS band, CAST(count(*) AS bigint) AS loans, round(avg(pd),6) AS mean_pd,
    round(avg(y),6) AS default_rate, round(sum(ead),2) AS exposure, round(sum(pd*{L_SQL}*ead),2) AS predicted_el, round(sum(y*{L_SQL}*ead),2) AS observed_el,
    round(sum(pd*{L_SQL}*ead)/nullif(sum(y*{L_SQL}*ead),0),6) AS el_ratio
    FROM (SELECT *, row_number() OVER (ORDER BY pd, {uniform32("loan_seq || 'tie'")}, loan_seq) AS r, count(*) OVER () AS nn FROM vm) GROUP BY 1""")
def _(spark, sf):
    df = money.el_by_band(money_validation(spark, sf), LOSS, "loan_seq")
    return cents(rounded(df, "mean_pd", "default_rate", "el_ratio"), "exposure", "predicted_el", "observed_el")


register("amounts", """SELECT loan_seq, zero_balance_code AS code, try_cast(actual_loss AS double) AS lost, try_cast(zero_balance_removal_upb AS double) AS owed FROM raw_perf""")
register("ends", "SELECT loan_seq, lost AS actual_loss, owed AS upb_at_end FROM amounts WHERE list_contains(['02', '03', '09', '15'], code)")
register("losses", "SELECT loan_seq, sum(coalesce(try_cast(actual_loss AS double),0)) AS lifetime_loss FROM raw_perf GROUP BY 1")
register("lgd_rows", """SELECT loan_seq, vintage_year, orig_upb, default_24m, true AS loss_event, actual_loss, upb_at_end FROM ends JOIN kept USING (loan_seq)
    UNION ALL SELECT loan_seq, vintage_year, orig_upb, default_24m, false, NULL, NULL FROM kept ANTI JOIN ends USING (loan_seq)""")


def loss_inputs(spark, sf):
    """Kept loans and the four performance columns that losses need."""
    kept = loans.kept(spark, sf).select("loan_seq", "vintage_year", "orig_upb", "default_24m")
    perf = loans.raw_performance(spark, sf).select("loan_seq", "zero_balance_code", "actual_loss", "zero_balance_removal_upb")
    return kept, perf


@query("lgd_inputs", """SELECT vintage_year, CAST(count(*) AS bigint) AS loans, CAST(sum(orig_upb) AS double) AS upb, CAST(sum(n) AS bigint) AS months,
    CAST(sum(events) AS bigint) AS events FROM kept JOIN (SELECT loan_seq, count(*) AS n, count_if(zero_balance_code='03') AS events FROM raw_perf GROUP BY 1) USING (loan_seq) GROUP BY 1""")
def _(spark, sf):
    kept, perf = loss_inputs(spark, sf)
    months = perf.groupBy("loan_seq").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("zero_balance_code") == "03").alias("events"))
    return kept.join(months, "loan_seq").groupBy("vintage_year").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("orig_upb").alias("upb"), F.sum("n").alias("months"), F.sum("events").alias("events"))


@query("join_loss_events_left", "SELECT loan_seq, loss_event, actual_loss, upb_at_end FROM lgd_rows")
def _(spark, sf):
    return money.join_loss_events(*loss_inputs(spark, sf)).select("loan_seq", "loss_event", "actual_loss", "upb_at_end")


@query("duplicate_events", """SELECT CAST(count(*) AS bigint) AS loans_with_event, CAST(count_if(n>1) AS bigint) AS loans_with_several, CAST(sum(n) AS bigint) AS event_rows
    FROM (SELECT loan_seq, count(*) AS n FROM ends GROUP BY 1)""")
def _(spark, sf):
    return money.duplicate_events(loans.raw_performance(spark, sf))


@query("lgd_summary", """
    WITH flagged AS (SELECT vintage_year, count(*) AS n, sum(CAST(loss_event AS integer)) AS ended, sum(coalesce(actual_loss, 0)) AS lost, sum(orig_upb) AS lent
                     FROM lgd_rows WHERE default_24m = 1 GROUP BY 1),
         ended AS (SELECT vintage_year, count(*) AS n FROM lgd_rows WHERE loss_event GROUP BY 1),
         known AS (SELECT vintage_year, count(*) AS n, sum(actual_loss) AS lost, sum(upb_at_end) AS owed, sum(CASE WHEN actual_loss > 0 THEN 0 ELSE 1 END) AS none,
                     quantile_cont(CASE WHEN upb_at_end <> 0 THEN actual_loss / upb_at_end END, 0.5) AS middle
                   FROM lgd_rows WHERE actual_loss IS NOT NULL GROUP BY 1)
    SELECT v.vintage_year, CAST(coalesce(f.n, 0) AS bigint) AS flagged_defaults, CAST(coalesce(f.ended, 0) AS bigint) AS flagged_with_loss_event,
      CAST(coalesce(e.n, 0) AS bigint) AS loss_event_loans, CAST(coalesce(k.n, 0) AS bigint) AS loss_event_with_amount,
      round(CASE WHEN k.owed <> 0 THEN k.lost / k.owed END, 4) AS lgd_loss_events, round(k.middle, 4) AS median_loss_share,
      round(k.none / k.n, 4) AS share_no_loss_or_gain, round(CASE WHEN f.lent <> 0 THEN f.lost / f.lent END, 4) AS loss_per_flag
    FROM (SELECT DISTINCT vintage_year FROM lgd_rows) v LEFT JOIN flagged f USING (vintage_year) LEFT JOIN ended e USING (vintage_year) LEFT JOIN known k USING (vintage_year)""")
def _(spark, sf):
    return money.lgd_summary(*loss_inputs(spark, sf))


@query("lifetime_loss", "SELECT loan_seq, lifetime_loss FROM losses")
def _(spark, sf):
    return money.lifetime_loss(loans.raw_performance(spark, sf))


@query("join_loss_lookup", "SELECT s.loan_seq, coalesce(l.lifetime_loss,0) AS lifetime_loss FROM scored s LEFT JOIN losses l ON s.loan_seq=l.loan_seq")
def _(spark, sf):
    df = loans.features(spark, sf).select("loan_seq")
    return money.join_loss_lookup(df, money.lifetime_loss(loans.raw_performance(spark, sf)))


@query("realised_loss_share", """SELECT split, sum(coalesce(l.lifetime_loss,0)) AS loss, sum(ead) AS exposure, round(sum(coalesce(l.lifetime_loss,0))/sum(ead),6) AS loss_pct_of_exposure
    FROM money_rows s LEFT JOIN losses l ON s.loan_seq=l.loan_seq GROUP BY 1""")
def _(spark, sf):
    df = loans.features(spark, sf).select("loan_seq", "split", F.col("orig_upb").alias("ead"))
    return rounded(money.realised_loss_share(df, money.lifetime_loss(loans.raw_performance(spark, sf)), ["split"]), "loss_pct_of_exposure")


# ---- fairness -----------------------------------------------------------------------------------
register("sets", """SELECT CASE WHEN vintage_year<=1998 THEN 'development' ELSE 'later' END AS "set", * FROM scored""")
register("top_states", """SELECT "set", coalesce(state,'missing') AS state FROM sets GROUP BY 1,2
    QUALIFY row_number() OVER (PARTITION BY "set" ORDER BY count(*) DESC, coalesce(state,'missing')) <= 10""")
register("slice_rows", " UNION ALL ".join(
    f"""SELECT "set", '{v}' AS variable, coalesce({v},'missing') AS "group", pd, y FROM sets""" for v in S.SLICE_VARIABLES if v != "state")
    + """ UNION ALL SELECT s."set", 'state', CASE WHEN t.state IS NOT NULL THEN s.state ELSE 'other states' END, pd, y
          FROM sets s LEFT JOIN top_states t ON s."set"=t."set" AND coalesce(s.state,'missing')=t.state""")
register("slices", f"""SELECT *, expected/nullif(defaults,0) AS pred_over_obs,
      approval_rate/nullif(max(approval_rate) OVER (PARTITION BY "set",variable),0) AS adverse_impact_ratio,
      (1-approval_rate)/greatest(min(1-approval_rate) OVER (PARTITION BY "set",variable),0.001::double) AS refusal_ratio_vs_lowest,
      CASE WHEN defaults>=30 THEN expected/(defaults+1.96::double*sqrt(greatest(defaults,1))) END AS ratio_low,
      CASE WHEN defaults>=30 THEN expected/greatest(defaults-1.96::double*sqrt(greatest(defaults,1)),0.5::double) END AS ratio_high
    FROM (SELECT "set", variable, "group", count(*) AS loans, sum(y) AS defaults, sum(pd) AS expected, avg((pd<={LINE_SQL})::integer) AS approval_rate,
            avg(pd) AS mean_pd FROM slice_rows GROUP BY 1,2,3 HAVING count(*)>=500)""")
SLICE_SELECT = """variable, "group", CAST(loans AS bigint) AS loans, CAST(defaults AS bigint) AS defaults, round(approval_rate,6) AS approval_rate,
    round(mean_pd,6) AS mean_pd, round(defaults/loans::double,6) AS default_rate, round(adverse_impact_ratio,6) AS adverse_impact_ratio,
    round(refusal_ratio_vs_lowest,6) AS refusal_ratio_vs_lowest, round(pred_over_obs,6) AS pred_over_obs, round(ratio_low,6) AS ratio_low,
    round(ratio_high,6) AS ratio_high, coalesce(adverse_impact_ratio<0.8::double,false) AS flag_approval,
    coalesce(defaults>=30 AND (ratio_low>1 OR ratio_high<1),false) AS flag_calibration"""
SLICE_ROUND = ("approval_rate", "mean_pd", "default_rate", "adverse_impact_ratio", "refusal_ratio_vs_lowest", "pred_over_obs", "ratio_low", "ratio_high")


def sets(spark, sf):
    name = F.when(F.col("vintage_year") <= loans.DEV_MAX_VINTAGE, "development").otherwise("later")
    return loans.scored(spark, sf).withColumn("set", name)


@query("fairness_slice", f"""SELECT {SLICE_SELECT} FROM slices WHERE "set"='later' """)
def _(spark, sf):
    return rounded(fairness.fairness_slice(sets(spark, sf).filter("set = 'later'"), LINE), *SLICE_ROUND)


@query("fairness_report", f"""SELECT "set", {SLICE_SELECT} FROM slices""")
def _(spark, sf):
    return rounded(fairness.fairness_slice(sets(spark, sf), LINE, by=["set"]), *SLICE_ROUND)


@query("top_n_groups_plus_other", """SELECT CASE WHEN t.state IS NOT NULL THEN s.state ELSE 'other states' END AS state, CAST(count(*) AS bigint) AS loans
    FROM sets s LEFT JOIN top_states t ON s."set"=t."set" AND coalesce(s.state,'missing')=t.state WHERE s."set"='development' GROUP BY 1""")
def _(spark, sf):
    df = sets(spark, sf).filter("set = 'development'").select("state")
    return fairness.top_n_plus_other(df, "state").groupBy("state").agg(F.count(F.lit(1)).alias("loans"))


@query("share_of_group_max", """SELECT channel, round(rate/max(rate) OVER (),6) AS share_of_max FROM (SELECT coalesce(channel,'missing') AS channel, avg(default_24m) AS rate FROM features GROUP BY 1)""")
def _(spark, sf):
    from pyspark.sql import Window
    rates = loans.features(spark, sf).groupBy(F.coalesce("channel", F.lit("missing")).alias("channel")).agg(F.avg("default_24m").alias("rate"))
    return rates.select("channel", F.round(F.col("rate") / F.max("rate").over(Window.partitionBy()), 6).alias("share_of_max"))


@query("group_calibration_spread", """SELECT "set", variable, round(CASE WHEN count(*)>=2 THEN max(pred_over_obs)/min(pred_over_obs) END,6) AS spread
    FROM slices WHERE defaults>=30 GROUP BY 1,2""")
def _(spark, sf):
    slices = fairness.fairness_slice(sets(spark, sf), LINE, by=["set"])
    return rounded(fairness.group_calibration_spread(slices, ["set"]), "spread")


@query("spread_comparison", """
    WITH s AS (SELECT variable, max(CASE WHEN "set"='later' THEN spread END) AS n, max(CASE WHEN "set"='development' THEN spread END) AS o FROM (
      SELECT "set", variable, CASE WHEN count(*)>=2 THEN max(pred_over_obs)/min(pred_over_obs) END AS spread FROM slices WHERE defaults>=30 GROUP BY 1,2) GROUP BY 1)
    SELECT CAST(count_if(coalesce(n<o,false)) AS bigint) AS better, CAST(count(*) AS bigint) AS variables, 4 AS needed, count_if(coalesce(n<o,false))>=4 AS met FROM s""")
def _(spark, sf):
    slices = fairness.fairness_slice(sets(spark, sf), LINE, by=["set"])
    return fairness.spread_comparison(fairness.group_calibration_spread(slices, ["set"]), "set", "later", "development")


# ---- monitors -----------------------------------------------------------------------------------
def counts_sql(source: str, by: str) -> str:
    lead = f"{by}, " if by else ""
    parts = [f"SELECT {lead}'score' AS monitor, CAST(floor(score/20.0::double) AS bigint) AS band FROM {source}"]
    parts += [f"SELECT {lead}'{f}', CAST({band_index_case(f, s)} AS bigint) FROM {source}" for f, s in ADOPTED.items()]
    return f"SELECT {lead}monitor, band, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def monitors_sql(ref: str, cur: str, batch: str, rows: str) -> str:
    """(batch, monitor, value, flag) written with plain joins."""
    return f"""
    SELECT {batch}, monitor, value, CASE WHEN value>=0.25::double THEN 'alert' WHEN value>=0.1::double THEN 'warn' ELSE 'ok' END AS flag FROM (
      SELECT {batch}, monitor, sum((c-r)*ln(c/r)) AS value FROM (
        SELECT b.{batch}, g.monitor, CASE WHEN sum(coalesce(rc.n,0)) OVER w>0 THEN greatest(coalesce(rc.n,0)/(sum(coalesce(rc.n,0)) OVER w)::double,0.0001::double) END AS r,
               greatest(coalesce(cc.n,0)/(sum(coalesce(cc.n,0)) OVER w)::double,0.0001::double) AS c
        FROM (SELECT DISTINCT monitor, band FROM (SELECT monitor, band FROM {ref} UNION ALL SELECT monitor, band FROM {cur})) g
          CROSS JOIN (SELECT DISTINCT {batch} FROM {cur}) b LEFT JOIN {ref} rc ON rc.monitor=g.monitor AND rc.band=g.band
          LEFT JOIN {cur} cc ON cc.monitor=g.monitor AND cc.band=g.band AND cc.{batch}=b.{batch}
        WINDOW w AS (PARTITION BY b.{batch}, g.monitor)) GROUP BY 1,2)
    UNION ALL SELECT {batch}, 'level_ratio', ratio, CASE WHEN ratio IS NULL OR ratio<0.67::double OR ratio>1.5::double THEN 'alert'
      WHEN ratio<0.8::double OR ratio>1.25::double THEN 'warn' ELSE 'ok' END FROM (SELECT {batch}, avg(y)/nullif(avg(pd),0) AS ratio FROM {rows} GROUP BY 1)"""


register("in_sample_rows", "SELECT * FROM frame WHERE in_sample")
register("ref_counts", counts_sql("in_sample_rows", ""))
register("vintage_counts", counts_sql("frame", "vintage"))
register("monitors", monitors_sql("ref_counts", "vintage_counts", "vintage", "frame"))


def vintage_monitors(spark, sf):
    frame = loans.monitor_frame(spark, sf)
    return monitoring.compare_batches(scoring.adopted_model(), frame.filter("in_sample"), frame, "vintage")


def report_sql(source: str, batch: str) -> str:
    label = "CASE WHEN monitor='score' THEN 'score_psi' WHEN monitor='level_ratio' THEN monitor ELSE 'csi:'||monitor END"
    is_input = "monitor NOT IN ('score','level_ratio')"
    return f"""SELECT {batch}, round(max(value) FILTER (WHERE monitor='score'),6) AS score_psi, round(max(value) FILTER (WHERE {is_input}),6) AS max_csi,
      arg_max(monitor,value) FILTER (WHERE {is_input}) AS max_csi_feature, round(max(value) FILTER (WHERE monitor='level_ratio'),6) AS level_ratio,
      coalesce(string_agg({label},',' ORDER BY {label}) FILTER (WHERE flag='alert'),'') AS alert_monitors,
      coalesce(string_agg({label},',' ORDER BY {label}) FILTER (WHERE flag<>'ok'),'') AS warn_or_worse_monitors FROM {source} GROUP BY 1"""


@query("join_drift_universe", f"""SELECT CAST(b.vintage AS integer) AS vintage, g.monitor, g.band, CAST(coalesce(rc.n,0) AS bigint) AS ref_n, CAST(coalesce(cc.n,0) AS bigint) AS cur_n
    FROM (SELECT DISTINCT monitor, band FROM vintage_counts) g CROSS JOIN (SELECT DISTINCT vintage FROM vintage_counts) b
    LEFT JOIN ref_counts rc ON rc.monitor=g.monitor AND rc.band=g.band LEFT JOIN vintage_counts cc ON cc.monitor=g.monitor AND cc.band=g.band AND cc.vintage=b.vintage""")
def _(spark, sf):
    frame, record = loans.monitor_frame(spark, sf), scoring.adopted_model()
    return monitoring.drift_universe(monitoring.monitor_counts(frame.filter("in_sample"), record),
                                     monitoring.monitor_counts(frame, record, ["vintage"]), "vintage")


MON = "SELECT CAST(vintage AS integer) AS vintage, monitor, round(value,6) AS value, flag FROM monitors"


@query("drift_flags", MON)
def _(spark, sf):
    return rounded(vintage_monitors(spark, sf), "value")


@query("psi", f"SELECT monitor, value AS psi FROM ({MON}) WHERE vintage=2001 AND monitor<>'level_ratio'")
def _(spark, sf):
    frame, record = loans.monitor_frame(spark, sf), scoring.adopted_model()
    late = frame.filter("vintage = 2001")
    both = monitoring.drift_universe(monitoring.monitor_counts(frame.filter("in_sample"), record),
                                     monitoring.monitor_counts(late, record, ["vintage"]), "vintage")
    return rounded(monitoring.psi(both), "psi")


@query("score_psi", f"SELECT vintage, value AS score_psi FROM ({MON}) WHERE monitor='score'")
def _(spark, sf):
    """Only the score: its bands need no input columns beyond the score itself."""
    frame = loans.monitor_frame(spark, sf)
    band = F.floor(F.col("score") / S.MONITORING["score_band_points"]).alias("band")
    one = lambda df, *by: df.groupBy(*by, F.lit("score").alias("monitor"), band).agg(F.count(F.lit(1)).alias("n"))
    both = monitoring.drift_universe(one(frame.filter("in_sample")), one(frame, "vintage"), "vintage")
    return rounded(monitoring.psi(both, ["vintage"]).withColumnRenamed("psi", "score_psi"), "score_psi")


@query("csi_per_input", f"SELECT vintage, monitor AS feature, value AS csi FROM ({MON}) WHERE monitor NOT IN ('score','level_ratio')")
def _(spark, sf):
    df = vintage_monitors(spark, sf).filter(~F.col("monitor").isin("score", "level_ratio"))
    return rounded(df.select("vintage", F.col("monitor").alias("feature"), F.col("value").alias("csi")), "csi")


@query("drift_profile_compare", report_sql("(SELECT CAST(vintage AS integer) AS vintage, monitor, value, flag FROM monitors WHERE vintage=2000)", "vintage"))
def _(spark, sf):
    frame = loans.monitor_frame(spark, sf)
    one = monitoring.compare_batches(scoring.adopted_model(), frame.filter("in_sample"), frame.filter("vintage = 2000"), "vintage")
    return rounded(monitoring.batch_report(one, "vintage"), "score_psi", "max_csi", "level_ratio")


@query("drift_by_vintage", f"SELECT *, vintage<=1998 AS in_sample FROM ({report_sql('(SELECT CAST(vintage AS integer) AS vintage, monitor, value, flag FROM monitors)', 'vintage')})")
def _(spark, sf):
    df = monitoring.batch_report(vintage_monitors(spark, sf), "vintage")
    return rounded(df, "score_psi", "max_csi", "level_ratio").withColumn("in_sample", F.col("vintage").isin(*loans.REFERENCE_VINTAGES))


@query("alert_list", f"SELECT vintage, alert_monitors, warn_or_worse_monitors FROM ({report_sql('(SELECT CAST(vintage AS integer) AS vintage, monitor, value, flag FROM monitors)', 'vintage')})")
def _(spark, sf):
    return monitoring.alert_list(vintage_monitors(spark, sf), "vintage")


# ---- perturbations and drills -------------------------------------------------------------------
@query("perturb_shift", """SELECT loan_seq, CASE WHEN credit_score-30<300 THEN 300 WHEN credit_score-30>850 THEN 850 ELSE credit_score-30 END::double AS credit_score,
    CASE WHEN dti+10<0 THEN 0 WHEN dti+10>65 THEN 65 ELSE dti+10 END::double AS dti FROM inputs""")
def _(spark, sf):
    df = loans.features(spark, sf).select("loan_seq", "credit_score", "dti")
    return monitoring.perturb_shift(monitoring.perturb_shift(df, ["credit_score"], -30.0), ["dti"], 10.0)


def unit(seed: str) -> str:
    return f"{uniform32(chr(108) + f'oan_seq || {seed!r}')}/4294967296.0::double"


@query("perturb_missing", f"SELECT loan_seq, CASE WHEN {unit('m')}>=0.1::double THEN credit_score END AS credit_score FROM inputs")
def _(spark, sf):
    return monitoring.perturb_missing(loans.features(spark, sf).select("loan_seq", "credit_score"), "credit_score", 0.1, "loan_seq", "m")


@query("perturb_new_category", f"SELECT loan_seq, CASE WHEN {unit('c')}<0.2::double THEN 'X' ELSE purpose END AS purpose FROM inputs")
def _(spark, sf):
    return monitoring.perturb_new_category(loans.features(spark, sf).select("loan_seq", "purpose"), "purpose", "X", 0.2, "loan_seq", "c")


@query("perturb_default_rate", f"""SELECT loan_seq, CASE WHEN y=1 OR r <= (SELECT least(round_even(sum(y)*1.25::double,0),count(*))-sum(y) FROM inputs) THEN 1 ELSE 0 END AS y FROM (
    SELECT loan_seq, y, CASE WHEN y=0 THEN row_number() OVER (PARTITION BY y ORDER BY {uniform32("loan_seq || 'd'")}, loan_seq) ELSE 1000000000 END AS r FROM inputs)""")
def _(spark, sf):
    df = loans.features(spark, sf).select("loan_seq", F.col("default_24m").alias("y"))
    return monitoring.perturb_default_rate(df, 1.25, "loan_seq", "d")


#: Loans in a drill batch, as configured.  A pool that holds no more is the whole batch, and its reference is empty.
DRILL_BATCH = S.MONITORING["drill_batch"]

register("pool", f"""SELECT *, row_number() OVER (ORDER BY {uniform32("loan_seq || '20261012'")}, loan_seq) AS place FROM inputs""")
register("drill_ref0", f"SELECT *, {SCORE_SQL} AS score FROM pool WHERE place>{DRILL_BATCH}")
register("drill_ref", counts_sql("drill_ref0", ""))
_SH = "20261012-shift"
register("drill_batch", f"""SELECT loan_seq, credit_score::double AS credit_score, dti::double AS dti, rate_spread, ltv::double AS ltv, cltv::double AS cltv, several_borrowers,
    mi_pct::double AS mi_pct, orig_term::double AS orig_term, purpose, y, {unit(_SH)} AS u,
    row_number() OVER (PARTITION BY y ORDER BY {uniform32(f"loan_seq || '{_SH}'")}, loan_seq) AS zr FROM pool WHERE place<={DRILL_BATCH}""")


def _drill_sql() -> str:
    base = {c: c for c in [*ADOPTED, "y"]}
    parts = [dict(base, drill="'C0'")]
    for d, spec in S.MONITORING["drills"].items():
        row = dict(base, drill=f"'{d}'")
        if spec["kind"] == "shift":
            for f in spec["features"]:
                moved = f"{f}+({spec['delta']!r}::double)"
                lo, hi = S.MONITORING["valid_range"].get(f, (None, None))
                row[f] = moved if lo is None else f"CASE WHEN {moved}<{lo!r} THEN {lo!r} WHEN {moved}>{hi!r} THEN {hi!r} ELSE {moved} END"
        elif spec["kind"] == "missing":
            row[spec["feature"]] = f"CASE WHEN u>={spec['share']!r}::double THEN {spec['feature']} END"
        elif spec["kind"] == "new_category":
            row[spec["feature"]] = f"CASE WHEN u<{spec['share']!r}::double THEN '{spec['value']}' ELSE {spec['feature']} END"
        else:
            row["y"] = (f"CASE WHEN y=1 OR zr<=(SELECT least(round_even(sum(y)*{spec['factor']!r}::double,0),count(*))-sum(y) FROM drill_batch) "
                        "THEN 1 ELSE 0 END")
        parts.append(row)
    return " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {c}" for c, e in p.items()) + " FROM drill_batch" for p in parts)


register("drill_rows0", _drill_sql())
register("drill_rows1", f"SELECT *, {SCORE_SQL} AS score FROM drill_rows0")
register("drill_rows", f"SELECT *, {PD_SQL} AS pd FROM drill_rows1")
register("drill_counts", counts_sql("drill_rows", "drill"))
register("drill_monitors", monitors_sql("drill_ref", "drill_counts", "drill", "drill_rows"))


def drill_report(spark, sf):
    pool = loans.with_borrower_flag(loans.features(spark, sf))
    return monitoring.drift_drill_grid(scoring.adopted_model(), pool.withColumn("y", F.col("default_24m")))


@query("drift_drill_grid", report_sql("drill_monitors", "drill"))
def _(spark, sf):
    return rounded(drill_report(spark, sf), "score_psi", "max_csi", "level_ratio")


@query("drill_verdict", f"""SELECT bool_and(drill<>'C0' OR warn_or_worse_monitors='') AS control_clean,
    coalesce(string_agg(drill,',' ORDER BY drill) FILTER (WHERE e AND alert_monitors<>''),'') AS caught,
    coalesce(string_agg(drill,',' ORDER BY drill) FILTER (WHERE e AND alert_monitors=''),'') AS missed,
    CAST(count_if(e AND alert_monitors<>'') AS bigint) AS n_caught, count_if(e AND alert_monitors<>'')>=6 AS enough_alerts
    FROM (SELECT *, drill IN ('S1','S3','S4','S5','S6','S7','S9') AS e FROM ({report_sql("drill_monitors", "drill")}))""")
def _(spark, sf):
    return monitoring.drill_verdict(drill_report(spark, sf))


# ---- recalibration ------------------------------------------------------------------------------
@query("known_vintages", """SELECT DISTINCT CAST(a.vintage AS integer) AS target, CAST(b.vintage AS integer) AS known FROM
    (SELECT DISTINCT vintage FROM frame) a JOIN (SELECT DISTINCT vintage FROM frame) b ON b.vintage<=a.vintage-3""")
def _(spark, sf):
    return monitoring.known_vintages(loans.monitor_frame(spark, sf).select("vintage"), "vintage")


@query("solve_shift", """SELECT CAST(vintage AS integer) AS vintage, round(avg(y),6) AS target_rate, round(avg(y),6) AS shifted_mean FROM frame GROUP BY 1""")
def _(spark, sf):
    """The mean of the shifted PDs must come back as the observed rate of every vintage."""
    from loanloom.functions.stats import logit_shift
    from loanloom.operators.ranks import score_cells
    cells = score_cells(loans.monitor_frame(spark, sf), "pd", "y", ["vintage"]).withColumnRenamed("vintage", "grp")
    rates = {r["grp"]: r["rate"] for r in cells.groupBy("grp").agg((F.sum("bad") / F.sum("n")).alias("rate")).collect()}
    deltas = monitoring.solve_shifts(cells, rates)
    delta = F.coalesce(*[F.when(F.col("grp") == g, d) for g, d in deltas.items()])
    q = logit_shift(F.col("x"), delta)
    return rounded(cells.groupBy(F.col("grp").alias("vintage")).agg((F.sum("bad") / F.sum("n")).alias("target_rate"),
                                                                    (F.sum(F.col("n") * q) / F.sum("n")).alias("shifted_mean")),
                   "target_rate", "shifted_mean")


@query("recalibration_arms")
def _(spark, sf):
    return monitoring.recalibration_arms(loans.monitor_frame(spark, sf))


@query("recalibration_verdict")
def _(spark, sf):
    return monitoring.recalibration_verdict(monitoring.recalibration_arms(loans.monitor_frame(spark, sf)))


@query("prediction_scoring", f"""
    WITH r AS ({report_sql('(SELECT CAST(vintage AS integer) AS vintage, monitor, value, flag FROM monitors)', 'vintage')}),
    f AS (SELECT vintage, max(flag) FILTER (WHERE monitor='level_ratio') AS level_flag FROM monitors GROUP BY 1)
    SELECT 'A1' AS id, (SELECT count(*)=2 FROM f WHERE vintage IN (1999,2000) AND level_flag='alert') AS hit
    UNION ALL SELECT 'A2', (SELECT arg_max(vintage,score_psi) IN (1995,2001) FROM r)
    UNION ALL SELECT 'A3', (SELECT bool_and(score_psi<0.1::double) FROM r)
    UNION ALL SELECT 'A4', (SELECT bool_and(max_csi_feature<>'purpose') FROM r)""")
def _(spark, sf):
    """Pre-registered expectations as rules over the monitor report: one row per rule."""
    monitors = vintage_monitors(spark, sf)
    table = monitoring.batch_report(monitors, "vintage").join(
        monitors.filter("monitor = 'level_ratio'").select("vintage", F.col("flag").alias("level_flag")), "vintage")
    rules = {"A1": "count_if(vintage IN (1999, 2000) AND level_flag = 'alert') = 2",
             "A2": "max_by(vintage, score_psi) IN (1995, 2001)",
             "A3": "bool_and(score_psi < 0.1)",
             "A4": "bool_and(max_csi_feature <> 'purpose')"}
    return score_rules(table, rules)


def score_rules(table, rules):
    """Evaluate aggregate boolean rules over a report table; a NULL outcome is a miss."""
    one = table.agg(*[F.expr(e).alias(i) for i, e in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.coalesce(F.col(i), F.lit(False)).alias("hit")) for i in rules]))
                      .alias("r")).select("r.*")
