"""Data checks, control queries, parity and log summaries on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.operators import features as feat
from loanloom.operators import monitoring, parity, quality, scoring
from loanloom.plans import loans
from loanloom.plans.oracle import SCORE_SQL, register
from loanloom.plans.preparation import FCOLS, FEATURE_COLS, _path, rounded
from loanloom.plans.registry import query
from loanloom.plans.risk import drill_report
from loanloom.sources import logs, sinks

# ---- data checks --------------------------------------------------------------------------------
_O = {"orig_not_empty": ("count(*)", "count(*)>0"), "orig_key_unique": ("count(*)-count(DISTINCT loan_seq)", "count(*)=count(DISTINCT loan_seq)")}
_OZ = {"key_pattern": "vintage_year IS NULL OR vintage_quarter IS NULL", "orig_upb_positive": "orig_upb IS NULL OR orig_upb<=0",
       "int_rate_range": "int_rate IS NULL OR int_rate<0 OR int_rate>20", "orig_term_range": "orig_term IS NULL OR orig_term<60 OR orig_term>600",
       "dti_range": "dti<0 OR dti>65", "credit_score_range": "credit_score<300 OR credit_score>850"}
_LZ = {"label_complete": "observable_24m AND default_24m IS NULL", "label_domain": "default_24m NOT IN (0,1)"}


def _check(name, value, ok, source, by=""):
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {lead}'{name}' AS "check", round(CAST({value} AS double),6) AS value, {ok} AS passed FROM {source} {group}"""


def staging_sql(o: str, g: str, by: str = "", missing: float = 0.01) -> str:
    parts = [_check(n, v, ok, o, by) for n, (v, ok) in _O.items()]
    parts += [_check(n, f"count_if({c})", f"count_if({c})=0", o, by) for n, c in _OZ.items()]
    parts += [_check("score_missing_share", "avg((credit_score IS NULL)::integer)", f"avg((credit_score IS NULL)::integer)<={missing}", o, by)]
    parts += [_check("label_key_unique", "count(*)-count(DISTINCT loan_seq)", "count(*)=count(DISTINCT loan_seq)", g, by)]
    parts += [_check(n, f"count_if({c})", f"count_if({c})=0", g, by) for n, c in _LZ.items()]
    parts += [_check("default_rate_sane", "avg(default_24m) FILTER (WHERE observable_24m)", "coalesce(avg(default_24m) FILTER (WHERE observable_24m) <= 0.2,true)", g, by)]
    parts += [_check("no_orphans", f"count_if(loan_seq NOT IN (SELECT loan_seq FROM {o}))", f"count_if(loan_seq NOT IN (SELECT loan_seq FROM {o}))=0", g, by)]
    parts += [_check("no_label_like_columns", "0*count(*)", "true", o, by)]
    return " UNION ALL ".join(parts)


@query("dq_staging_checks", staging_sql("orig", "label"))
def _(spark, sf):
    return rounded(quality.dq_staging_checks(loans.staged_origination(spark, sf), loans.staged_label(spark, sf)), "value")


register("label_year", "SELECT l.*, o.vintage_year FROM label l JOIN orig o USING (loan_seq)")


@query("dq_recheck_written", staging_sql("orig", "label_year", "vintage_year"))
def _(spark, sf):
    """The same checks on the files as written, all years in one pass."""
    path = _path(spark, "written")
    orig = loans.staged_origination(spark, sf)
    sinks.sink_parquet_year(orig.withColumn("source_year", F.col("vintage_year")), f"{path}/orig")
    label = loans.staged_label(spark, sf).withColumn("source_year", loans.T.vintage_year(F.col("loan_seq")))
    sinks.sink_parquet_year(label, f"{path}/label")
    read = lambda kind: spark.read.parquet(f"{path}/{kind}")
    written = read("orig").drop("source_year")
    checked = quality.dq_staging_checks(written, read("label").withColumnRenamed("source_year", "vintage_year"), by=["vintage_year"])
    return rounded(checked, "value")


@query("dq_feature_checks", """SELECT 'expected_columns' AS "check", 0.0::double AS value, true AS passed UNION ALL SELECT 'no_banned_names', 0.0::double, true
    UNION ALL SELECT 'label_and_split_present', CAST(count_if(default_24m IS NULL OR split IS NULL) AS double), count_if(default_24m IS NULL OR split IS NULL)=0 FROM features
    UNION ALL SELECT 'key_unique', CAST(count(*)-count(DISTINCT loan_seq) AS double), count(*)=count(DISTINCT loan_seq) FROM features
    UNION ALL SELECT 'no_development_in_oot', CAST(count_if(split LIKE 'test_oot%' AND vintage_year<=1998) AS double), count_if(split LIKE 'test_oot%' AND vintage_year<=1998)=0 FROM features
    UNION ALL SELECT 'no_oot_in_development', CAST(count_if(split NOT LIKE 'test_oot%' AND vintage_year>1998) AS double), count_if(split NOT LIKE 'test_oot%' AND vintage_year>1998)=0 FROM features""")
def _(spark, sf):
    return quality.dq_feature_checks(loans.features(spark, sf), loans.DEV_MAX_VINTAGE)


@query("dq_fresh_checks", """SELECT 'expected_columns' AS "check", 0.0::double AS value, true AS passed
    UNION ALL SELECT 'label_present', CAST(count_if(default_24m IS NULL) AS double), count_if(default_24m IS NULL)=0 FROM fresh
    UNION ALL SELECT 'key_unique', CAST(count(*)-count(DISTINCT loan_seq) AS double), count(*)=count(DISTINCT loan_seq) FROM fresh""")
def _(spark, sf):
    return quality.dq_fresh_checks(loans.fresh_features(spark, sf))


@query("dq_raw_checks", """SELECT CAST(y AS integer) AS year, kind FROM (SELECT unnest(range(1994,2003)) AS y), (SELECT unnest(['orig','perf']) AS kind)
    WHERE (y, kind) NOT IN (SELECT 1900+CAST(substr(loan_seq,2,2) AS bigint)+CASE WHEN substr(loan_seq,2,2)<'90' THEN 100 ELSE 0 END, 'orig' FROM raw_orig
      UNION SELECT 1900+CAST(substr(loan_seq,2,2) AS bigint)+CASE WHEN substr(loan_seq,2,2)<'90' THEN 100 ELSE 0 END, 'perf' FROM raw_perf)""")
def _(spark, sf):
    def part(df, kind):
        return df.select(loans.T.vintage_year(F.col("loan_seq")).alias("year"), F.lit(kind).alias("kind"))

    files = part(loans.raw_origination(spark, sf), "orig").unionByName(part(loans.raw_performance(spark, sf), "perf"))
    return quality.dq_raw_checks(files, range(1994, 2003))


NOT_NULL = ["loan_seq", "credit_score", "dti", "channel", "orig_upb"]
RANGES = {"ltv": (1.0, 95.0), "dti": (0.0, 60.0), "int_rate": (0.0, 20.0)}
ACCEPTED = {"occupancy": ["P", "S"], "purpose": ["P", "C", "N", "R"], "n_units": [1, 2]}


def _zero(name, cond, source="orig"):
    return f"""SELECT '{name}' AS "check", CAST(count_if({cond}) AS double) AS value, count_if({cond})=0 AS passed FROM {source}"""


@query("dq_not_null", " UNION ALL ".join(_zero(f"not_null:{c}", f"{c} IS NULL") for c in NOT_NULL))
def _(spark, sf):
    return quality.dq_not_null(loans.staged_origination(spark, sf), NOT_NULL)


@query("dq_in_range", " UNION ALL ".join(_zero(f"in_range:{c}", f"{c}<{lo} OR {c}>{hi}") for c, (lo, hi) in RANGES.items()))
def _(spark, sf):
    return quality.dq_in_range(loans.staged_origination(spark, sf), RANGES)


@query("dq_accepted_values", " UNION ALL ".join(
    _zero(f"accepted_values:{c}", f"{c} NOT IN ({', '.join(repr(v) for v in vals)})") for c, vals in ACCEPTED.items()))
def _(spark, sf):
    return quality.dq_accepted_values(loans.staged_origination(spark, sf), ACCEPTED)


@query("dq_unique", " UNION ALL ".join(
    f"""SELECT 'unique:{c}' AS "check", CAST(count(*) AS double) AS value, count(*)=0 AS passed FROM (SELECT {c} FROM raw_perf WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*)>1)"""
    for c in ("loan_seq", "loan_age")))
def _(spark, sf):
    return quality.dq_unique(loans.raw_performance(spark, sf), ["loan_seq", "loan_age"])


@query("dq_relationships", """SELECT 'relationships:loan_seq' AS "check", CAST(count(*) AS double) AS value, count(*)=0 AS passed FROM raw_orig WHERE loan_seq NOT IN (SELECT loan_seq FROM raw_perf)""")
def _(spark, sf):
    return quality.dq_relationships(loans.raw_origination(spark, sf).select("loan_seq"), loans.raw_performance(spark, sf), "loan_seq")


@query("dq_blocking_gate", """SELECT 'passing' AS gate, false AS raised, CAST(6 AS bigint) AS checks UNION ALL SELECT 'failing', true, CAST(3 AS bigint)""")
def _(spark, sf):
    good = quality.dq_feature_checks(loans.features(spark, sf), loans.DEV_MAX_VINTAGE)
    bad = quality.dq_in_range(loans.staged_origination(spark, sf), RANGES)

    def outcome(name, checks):
        try:
            quality.dq_blocking_gate(checks)
            raised = False
        except quality.DataCheckError:
            raised = True
        return checks.agg(F.count(F.lit(1)).alias("checks")).select(F.lit(name).alias("gate"), F.lit(raised).alias("raised"), "checks")

    return outcome("passing", good).unionByName(outcome("failing", bad))


@query("column_set_check", """SELECT column_name, false AS in_table, true AS in_contract, CAST((SELECT count(*) FROM features) AS bigint) AS n_rows FROM (VALUES ('several_borrowers')) t(column_name)""")
def _(spark, sf):
    """The development table against the holdout contract: one column is missing there."""
    df = loans.features(spark, sf)
    contract = [*S.META, *S.FEATURES, *S.FRESH_EXTRA, *S.LABELS, "split"]
    odd = quality.column_set_check(df, contract)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("in_table"),
                                        F.lit(c in contract).alias("in_contract")) for c in odd]))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", each.alias("c")).select("c.*", "n_rows")


_GOLDEN = ", ".join(f"'{v}' AS {f}" if isinstance(v, str) else f"{v!r}::double AS {f}" for f, v in S.GOLDEN_LOAN.items())
register("golden", f"SELECT {SCORE_SQL} AS g FROM (SELECT {_GOLDEN})")


@query("golden_loan_check", """SELECT round(g,2) AS golden_score, abs(g-553.3::double)<=0.2::double AS passed, CAST(count_if(score<g) AS bigint) AS loans_below
    FROM scored CROSS JOIN golden GROUP BY g""")
def _(spark, sf):
    """The golden loan still scores as agreed; its place among the table's loans is reported with it."""
    record = scoring.adopted_model()
    one = spark.range(1).select(*[F.lit(v).alias(f) for f, v in S.GOLDEN_LOAN.items()])
    golden = scoring.score_batch(record, one).select(F.col("score").alias("g"))
    below = loans.scored(spark, sf).select("score").withColumn("g", golden.scalar()).groupBy("g").agg(
        F.count_if(F.col("score") < F.col("g")).alias("loans_below"))
    return below.select(F.round("g", 2).alias("golden_score"),
                        (F.abs(F.col("g") - S.GOLDEN_SCORE) <= S.GOLDEN_TOLERANCE).alias("passed"), "loans_below")


@query("monitoring_self_check")
def _(spark, sf):
    """The monitors' own self-test: problems of the drill report and of the recalibration, for the current model."""
    record = scoring.adopted_model()
    drills = monitoring.drill_verdict(drill_report(spark, sf))
    recal = monitoring.recalibration_verdict(monitoring.recalibration_arms(loans.monitor_frame(spark, sf)))
    a = drills.select(F.explode(F.array(
        F.struct(F.lit("control raised a warning").alias("problem"), F.col("control_clean").alias("ok")),
        F.struct(F.lit("monitors missed drills").alias("problem"), F.col("enough_alerts").alias("ok")))).alias("p"))
    b = recal.agg(F.bool_and("gini_unchanged").alias("ok")).select(
        F.struct(F.lit("recalibration changed the ranking").alias("problem"), F.col("ok")).alias("p"))
    return a.unionByName(b).select("p.problem", F.col("p.ok").alias("passed"), F.lit(record["model_id"]).alias("model_id"))


# ---- control queries ----------------------------------------------------------------------------
_CONTROLS = {}


def _control(name, sql):
    _CONTROLS[name] = sql

    def add(fn):
        return query(f"control_{name}", sql)(fn)
    return add


@_control("dev_split_counts", "SELECT split, CAST(count(*) AS bigint) AS loans, CAST(sum(default_24m) AS bigint) AS defaults FROM features GROUP BY 1")
def dev_split_counts(spark, sf):
    return loans.features(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("loans"), F.sum("default_24m").alias("defaults"))


@_control("dev_totals", "SELECT CAST(count(*) AS bigint) AS loans, CAST(sum(default_24m) AS bigint) AS defaults FROM features")
def dev_totals(spark, sf):
    return loans.features(spark, sf).agg(F.count(F.lit(1)).alias("loans"), F.sum("default_24m").alias("defaults"))


@_control("dev_vintage_sums", """SELECT vintage_year, CAST(count(*) AS bigint) AS loans, CAST(sum(credit_score) AS bigint) AS sum_score, CAST(sum(dti) AS bigint) AS sum_dti,
    CAST(sum(orig_term) AS bigint) AS sum_term, round(avg(rate_spread),6) AS avg_spread FROM features GROUP BY 1""")
def dev_vintage_sums(spark, sf):
    return loans.features(spark, sf).groupBy("vintage_year").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("credit_score").alias("sum_score"), F.sum("dti").alias("sum_dti"),
        F.sum("orig_term").alias("sum_term"), F.round(F.avg("rate_spread"), 6).alias("avg_spread"))


@_control("fresh_structure", """SELECT vintage_year, CAST(count(*) AS bigint) AS loans, CAST(count(DISTINCT loan_seq) AS bigint) AS distinct_loans,
    CAST(sum(credit_score) AS bigint) AS sum_score, min(first_payment_date) AS first_payment_min FROM fresh GROUP BY 1""")
def fresh_structure(spark, sf):
    return loans.fresh_features(spark, sf).groupBy("vintage_year").agg(
        F.count(F.lit(1)).alias("loans"), F.countDistinct("loan_seq").alias("distinct_loans"), F.sum("credit_score").alias("sum_score"),
        F.min("first_payment_date").alias("first_payment_min"))


@_control("raw_orig_loans", "SELECT CAST(count(*) AS bigint) AS n_rows, CAST(count(DISTINCT loan_seq) AS bigint) AS loans FROM raw_orig")
def raw_orig_loans(spark, sf):
    return loans.raw_origination(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("loan_seq").alias("loans"))


@_control("raw_perf_rows", "SELECT CAST(count(*) AS bigint) AS monthly_rows FROM raw_perf")
def raw_perf_rows(spark, sf):
    return loans.raw_performance(spark, sf).agg(F.count(F.lit(1)).alias("monthly_rows"))


@_control("raw_perf_loans", "SELECT CAST(count(DISTINCT loan_seq) AS bigint) AS loans FROM raw_perf")
def raw_perf_loans(spark, sf):
    return loans.raw_performance(spark, sf).agg(F.countDistinct("loan_seq").alias("loans"))


_LONG = """SELECT '{q}' AS query, {row} AS "row", {i} AS col, '{c}' AS name, CAST({value} AS varchar) AS value FROM ({sql})"""
GOLDEN = {"dev_split_counts": (dev_split_counts, "split"), "dev_totals": (dev_totals, None), "dev_vintage_sums": (dev_vintage_sums, "vintage_year"),
          "fresh_structure": (fresh_structure, "vintage_year"), "raw_orig_loans": (raw_orig_loans, None), "raw_perf_rows": (raw_perf_rows, None),
          "raw_perf_loans": (raw_perf_loans, None)}
_GOLDEN_COLUMNS = {"dev_split_counts": "split loans defaults", "dev_totals": "loans defaults",
                   "dev_vintage_sums": "vintage_year loans sum_score sum_dti sum_term avg_spread",
                   "fresh_structure": "vintage_year loans distinct_loans sum_score first_payment_min", "raw_orig_loans": "n_rows loans",
                   "raw_perf_rows": "monthly_rows", "raw_perf_loans": "loans"}


def _golden_sql():
    parts = []
    for name, (_fn, order) in GOLDEN.items():
        row = f"CAST({f'row_number() OVER (ORDER BY {order})' if order else 1} AS integer)"
        for i, c in enumerate(_GOLDEN_COLUMNS[name].split()):
            value = f"CAST({c} AS decimal(38,6))" if c == "avg_spread" else c
            parts.append(_LONG.format(q=name, row=row, i=i, c=c, value=value, sql=_CONTROLS[name]))
    return " UNION ALL ".join(parts)


@query("golden_answers", _golden_sql())
def _(spark, sf):
    return parity.golden_answers({name: (fn(spark, sf), [order] if order else []) for name, (fn, order) in GOLDEN.items()})


# ---- parity -------------------------------------------------------------------------------------
_CHANGED = "CASE WHEN state='NATION_1' AND vintage_quarter=2 THEN dti+1 ELSE dti END AS dti"
register("altered", f"""SELECT {", ".join(_CHANGED if c == "dti" else c for c in FEATURE_COLS)}
    FROM features WHERE NOT (state='NATION_2' AND vintage_quarter=3)""")


def altered(spark, sf):
    c = F.col
    df = loans.features(spark, sf).filter(~((c("state") == "NATION_2") & (c("vintage_quarter") == 3)))
    dti = F.when((c("state") == "NATION_1") & (c("vintage_quarter") == 2), c("dti") + 1).otherwise(c("dti"))
    return df.withColumn("dti", dti).select(*FEATURE_COLS)


def whole(spark, sf):
    return loans.features(spark, sf).select(*FEATURE_COLS)


@query("union_all_by_name", """SELECT source, CAST(count(*) AS bigint) AS loans, CAST(count(several_borrowers) AS bigint) AS with_flag FROM (
    SELECT 'dev' AS source, NULL::double AS several_borrowers FROM features WHERE vintage_year<=1998 UNION ALL SELECT 'fresh', several_borrowers FROM fresh) GROUP BY 1""")
def _(spark, sf):
    dev = loans.features(spark, sf).filter(F.col("vintage_year") <= loans.DEV_MAX_VINTAGE).withColumn("source", F.lit("dev"))
    both = dev.unionByName(loans.fresh_features(spark, sf).withColumn("source", F.lit("fresh")), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("loans"), F.count("several_borrowers").alias("with_flag"))


_ALL = ", ".join(FEATURE_COLS)


@query("symmetric_difference", f"""SELECT side, {FCOLS} FROM (SELECT 'left' AS side, * FROM (SELECT {_ALL} FROM features EXCEPT SELECT {_ALL} FROM altered)
    UNION ALL SELECT 'right', * FROM (SELECT {_ALL} FROM altered EXCEPT SELECT {_ALL} FROM features))""")
def _(spark, sf):
    """Whole rows that only one of the tables has."""
    return rounded(parity.symmetric_difference(whole(spark, sf), altered(spark, sf)), "rate_spread")


_DOUBLES = ("int_rate", "orig_upb", "rate_spread")
_TEXTS = ", ".join(f"CAST({f'CAST(round({c},6) AS decimal(38,6))' if c in _DOUBLES else c} AS varchar) AS {c}" for c in FEATURE_COLS)


@query("multiset_difference", f"""WITH a AS (SELECT {_TEXTS}, 1 AS side FROM features),
    b AS (SELECT {_TEXTS}, -1 AS side FROM (SELECT * FROM altered UNION ALL SELECT * FROM altered WHERE state='NATION_3')), both_sides AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT CASE WHEN sum(side) > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(sum(side)) AS bigint) AS copies, {_ALL} FROM both_sides GROUP BY {_ALL} HAVING sum(side) <> 0""")
def _(spark, sf):
    """Whole rows that one table has more often than the other."""
    other = altered(spark, sf)
    return parity.multiset_difference(whole(spark, sf), other.unionByName(other.filter("state = 'NATION_3'")))


@query("table_parity", """SELECT f.loan_seq, CASE WHEN a.loan_seq IS NULL THEN '*' ELSE 'dti' END AS "column", CASE WHEN a.loan_seq IS NULL THEN 'present' ELSE CAST(f.dti AS varchar) END AS "left",
    CASE WHEN a.loan_seq IS NOT NULL THEN CAST(a.dti AS varchar) END AS "right" FROM features f LEFT JOIN altered a USING (loan_seq) WHERE a.loan_seq IS NULL OR a.dti IS DISTINCT FROM f.dti""")
def _(spark, sf):
    nudged = altered(spark, sf).withColumn("rate_spread", F.col("rate_spread") + 1e-8)  # inside the tolerance
    return parity.table_parity(whole(spark, sf), nudged, ["loan_seq"])


@query("parity_full_compare", """WITH a AS (SELECT row_number() OVER (ORDER BY split) AS r, split, count(*) AS loans FROM features GROUP BY split),
    b AS (SELECT row_number() OVER (ORDER BY split) AS r, split, count(*) AS loans FROM altered GROUP BY split)
    SELECT CAST(a.r AS integer) AS "row", 'loans' AS "column", CAST(a.loans AS varchar) AS "left", CAST(b.loans AS varchar) AS "right" FROM a JOIN b USING (r) WHERE a.loans<>b.loans""")
def _(spark, sf):
    count = lambda df: df.groupBy("split").agg(F.count(F.lit(1)).alias("loans"))
    return parity.parity_full_compare(count(whole(spark, sf)), count(altered(spark, sf)), ["split"])


def _prefixed(c):
    text = f"CAST({f'CAST(round({c},6) AS decimal(38,6))' if c in _DOUBLES else c} AS varchar)"
    return f"coalesce(CAST(length({text}) AS varchar) || ':' || {text}, 'N')"


_TEXT = " || ".join(_prefixed(c) for c in sorted(FEATURE_COLS) if c != "vintage_year")


def print_sql(source):
    return f"""SELECT vintage_year, CAST(count(*) AS bigint) AS n_rows, CAST(sum(CAST('0x'||substr(md5({_TEXT}),1,8) AS bigint)) AS varchar) AS hash_a,
      CAST(sum(CAST('0x'||substr(md5({_TEXT}),9,8) AS bigint)) AS varchar) AS hash_b FROM {source} GROUP BY 1"""


def printed(df):
    """Prints by vintage of all columns; fractions in a form that engines write alike."""
    return parity.table_fingerprint(df.withColumns({c: F.round(c, 6).cast("decimal(38,6)") for c in _DOUBLES}), by=["vintage_year"])


@query("table_fingerprint", print_sql("features"))
def _(spark, sf):
    return printed(whole(spark, sf))


@query("manifest_compare", f"""SELECT vintage_year, CASE WHEN b.n_rows IS NULL THEN 'removed' WHEN a.hash_a<>b.hash_a OR a.hash_b<>b.hash_b OR a.n_rows<>b.n_rows THEN 'changed' ELSE 'same' END AS state
    FROM ({print_sql('features')}) a LEFT JOIN ({print_sql('(SELECT * FROM altered WHERE vintage_year<>1997)')}) b USING (vintage_year)""")
def _(spark, sf):
    return parity.manifest_compare(printed(whole(spark, sf)), printed(altered(spark, sf).filter("vintage_year <> 1997")), "vintage_year")


@query("config_tables", """SELECT name, value, CAST((SELECT count(*) FROM scored WHERE pd<value) AS bigint) AS loans_below FROM (VALUES
    ('policy.approve_below',0.02::double),('policy.decline_above',0.05::double),('monitoring.psi_warn',0.1::double),('monitoring.psi_alert',0.25::double),
    ('money.margin',0.02::double),('money.loss',0.1::double)) t(name,value)""")
def _(spark, sf):
    """Settings read from the configuration file and validated, each next to the number of loans with a PD below it."""
    from loanloom.config import load_config
    cfg = load_config()
    named = {"policy.approve_below": cfg["policy"]["approve_below"], "policy.decline_above": cfg["policy"]["decline_above"],
             "monitoring.psi_warn": cfg["monitoring"]["psi_warn"], "monitoring.psi_alert": cfg["monitoring"]["psi_alert"],
             "money.margin": cfg["money"]["margin"], "money.loss": cfg["money"]["loss"]}
    one = loans.scored(spark, sf).agg(*[F.count_if(F.col("pd") < v).alias(f"c{i}") for i, v in enumerate(named.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value"), F.col(f"c{i}").alias("loans_below"))
                                          for i, (n, v) in enumerate(named.items())])).alias("r")).select("r.*")


# ---- log lines ----------------------------------------------------------------------------------
register("calls", """SELECT event_type AS grp, value AS duration_ms, ceil(value) AS billed_ms, event_id%37=0 AS cold_start,
    CASE WHEN event_id%37=0 THEN round(value*3,2) END AS init_ms, CAST(60+event_id%40 AS double) AS max_memory_used_mb FROM events WHERE event_id%5<>4""")


def _log_lines(spark, sf):
    e = loans.table(spark, sf, "events")
    num = lambda c: c.cast("string")
    cold = F.when(F.col("event_id") % 37 == 0, F.concat(F.lit("\tInit Duration: "), num(F.round(F.col("value") * 3, 2)), F.lit(" ms"))).otherwise("")
    report = F.concat(F.lit("REPORT RequestId: "), F.col("event_type"), F.lit("\tDuration: "), num(F.col("value")), F.lit(" ms\tBilled Duration: "),
                      num(F.ceil("value")), F.lit(" ms\tMemory Size: 512 MB\tMax Memory Used: "), num(60 + F.col("event_id") % 40), F.lit(" MB"), cold)
    return e.select(F.when(F.col("event_id") % 5 == 4, F.concat(F.lit("START RequestId: "), F.col("event_type"))).otherwise(report).alias("value"))


_STATS = """CAST(count({c}) AS bigint) AS n, round(min({c}),4) AS min, round(quantile_cont({c},0.5),4) AS median, round(quantile_disc({c},0.95),4) AS p95, round(max({c}),4) AS max"""


@query("latency_summary", " UNION ALL ".join(
    f"SELECT '{m}' AS measure, {_STATS.format(c=c)}, (SELECT round(sum(billed_ms)/1000*512/1024,4) FROM calls) AS billed_gb_seconds FROM calls WHERE {w}"
    for m, c, w in (("init_ms", "init_ms", "cold_start"), ("duration_ms_warm", "duration_ms", "NOT cold_start"), ("duration_ms_cold", "duration_ms", "cold_start"),
                    ("billed_ms", "billed_ms", "true"), ("max_memory_used_mb", "max_memory_used_mb", "true"))))
def _(spark, sf):
    path = f"{_path(spark, 'logs')}"
    _log_lines(spark, sf).write.text(path)
    return logs.latency_summary(logs.parse_report_lines(spark.read.text(path)))
