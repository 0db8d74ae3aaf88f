"""Sources, typing, cleaning, joins and the feature build on the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import hashing, typing as T
from loanloom.operators import features as feat
from loanloom.operators import staging
from loanloom.plans import loans
from loanloom.plans.oracle import register, split_case, uniform32
from loanloom.plans.registry import query
from loanloom.session import scratch_dir, write_scratch
from loanloom.sources import readers, sinks

ORIG = ", ".join(S.ORIGINATION_COLUMNS)
PERF = ", ".join(S.PERFORMANCE_COLUMNS)
FEATURE_COLS = S.META + S.FEATURES + S.LABELS + ["split"]
SPREAD6 = "round(rate_spread, 6) AS rate_spread"


def _path(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


# ---- sources and sinks --------------------------------------------------------------------------
EMPTY_AS_NULL = ", ".join(f"nullif({c},'') AS {c}" for c in S.ORIGINATION_COLUMNS)


def _totals(*keys: str) -> str:
    return f"(SELECT {', '.join(keys)}, CAST(count(*) AS bigint) AS n, CAST(count(nullif(default_24m, 0)) AS bigint) AS bad FROM features GROUP BY ALL)"


@query("scan_delimited_text", f"SELECT {EMPTY_AS_NULL} FROM raw_orig")
def _(spark, sf):
    path = _path(spark, "orig-text")
    sinks.sink_text(loans.raw_origination(spark, sf), path)
    return readers.scan_delimited_text(spark, path, S.ORIGINATION_COLUMNS)


def _zip_lines(spark, sf):
    """Both kinds as (archive, kind, line); archives are salted so that no year is one task."""
    def part(df, kind):
        line = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns])
        name = F.concat(F.lit("sample_"), F.substring("loan_seq", 2, 2), F.lit("_"),
                        F.format_string("%02d", F.pmod(F.xxhash64("loan_seq"), F.lit(16))))
        return df.select(name.alias("archive"), F.lit(kind).alias("kind"), line.alias("line"))

    return part(loans.raw_origination(spark, sf), "orig").unionByName(part(loans.raw_performance(spark, sf), "perf"))


@query("scan_zip_members", """SELECT loan_seq, loan_age, delinq_status, zero_balance_code, borrower_assist_code, actual_loss
                              FROM raw_perf""")
def _(spark, sf):
    folder = _path(spark, "zips")
    sinks.sink_zip(_zip_lines(spark, sf), folder).count()
    lines = readers.scan_zip_members(spark, f"{folder}/*.zip", {"orig": "{stem}_orig.txt", "perf": "{stem}_perf.txt"})
    return readers.lines_to_columns(lines.filter("kind = 'perf'").select("line"), S.PERFORMANCE_COLUMNS).select(
        "loan_seq", "loan_age", "delinq_status", "zero_balance_code", "borrower_assist_code", "actual_loss")


@query("scan_parquet_by_name", """
    SELECT loan_seq, CASE WHEN vintage_year >= 1999 THEN n_borrowers END AS n_borrowers, credit_score FROM orig""")
def _(spark, sf):
    path = _path(spark, "by-name")
    staged = loans.staged_origination(spark, sf)
    staged.filter("vintage_year < 1999").select("loan_seq", "credit_score").write.parquet(f"{path}/early")
    staged.filter("vintage_year >= 1999").select("credit_score", "n_borrowers", "loan_seq").write.parquet(f"{path}/late")
    return readers.scan_parquet_by_name(spark, [f"{path}/early", f"{path}/late"])


register("consumer_lines", """
    SELECT 'A' || CAST(11 + k%4 AS varchar) || ' ' || CAST(6 + k%60 AS varchar) || ' A' || CAST(30 + k%5 AS varchar) || ' A' ||
      CAST(40 + k%11 AS varchar) || ' ' || CAST(CAST(floor(o_totalprice/100) AS bigint) AS varchar) || ' A' || CAST(61 + k%5 AS varchar)
      || ' A' || CAST(71 + k%5 AS varchar) || ' ' || CAST(1 + k%4 AS varchar) || ' A' || CAST(91 + k%4 AS varchar) || ' A' ||
      CAST(101 + k%3 AS varchar) || ' ' || CAST(1 + (k*3)%4 AS varchar) || ' A' || CAST(121 + k%4 AS varchar) || ' ' ||
      CAST(19 + k%56 AS varchar) || ' A' || CAST(141 + k%3 AS varchar) || ' A' || CAST(151 + k%3 AS varchar) || ' ' ||
      CAST(1 + (k*7)%4 AS varchar) || ' A' || CAST(171 + k%4 AS varchar) || ' ' || CAST(1 + k%2 AS varchar) || ' A' ||
      CAST(191 + k%2 AS varchar) || ' A' || CAST(201 + k%2 AS varchar) || ' ' || CASE WHEN o_orderstatus='F' THEN '2' ELSE '1' END AS v
    FROM base""")


@query("scan_space_delimited", f"""
    SELECT {', '.join(f"coalesce(nullif(split_part(v,' ',{i + 1}),''),'') AS {c}" for i, c in enumerate(S.CONSUMER_COLUMNS))}
    FROM consumer_lines""")
def _(spark, sf):
    path = _path(spark, "consumer")
    sinks.sink_text(_consumer(spark, sf), path, sep=" ")
    return readers.scan_space_delimited(spark, path)


def _consumer(spark, sf):
    """The orders as 21-column consumer-credit rows."""
    k = F.col("o_orderkey")

    def code(base, modulus):
        return F.concat(F.lit("A"), (base + k % modulus).cast("string"))

    def number(base, modulus, factor=1):
        return (base + (k * factor) % modulus).cast("string")

    values = [code(11, 4), number(6, 60), code(30, 5), code(40, 11), F.floor(F.col("o_totalprice") / 100).cast("string"),
              code(61, 5), code(71, 5), number(1, 4), code(91, 4), code(101, 3), number(1, 4, 3), code(121, 4),
              number(19, 56), code(141, 3), code(151, 3), number(1, 4, 7), code(171, 4), number(1, 2), code(191, 2),
              code(201, 2), F.when(F.col("o_orderstatus") == "F", "2").otherwise("1")]
    return loans.table(spark, sf, "orders").select(*[v.alias(c) for v, c in zip(values, S.CONSUMER_COLUMNS)])


@query("tag_source_year", """SELECT CAST(year(d) AS integer) AS source_year, CAST(count(*) AS bigint) AS loans,
    CAST(count(DISTINCT k) AS bigint) AS distinct_loans FROM base GROUP BY 1""")
def _(spark, sf):
    raw = loans.raw_origination(spark, sf)
    yy = F.substring("loan_seq", 2, 2)
    found = sorted(r[0] for r in raw.select(yy.alias("yy")).distinct().collect())  # two digits: a hundred at most
    parts = {int(y) + (1900 if int(y) >= S.CENTURY_PIVOT else 2000): raw.filter(yy == y) for y in found}
    return readers.tag_source_year(parts).groupBy("source_year").agg(
        F.count(F.lit(1)).alias("loans"), F.countDistinct("loan_seq").alias("distinct_loans"))


@query("sink_parquet_year", "SELECT vintage_year AS source_year, CAST(count(*) AS bigint) AS loans, CAST(sum(orig_upb) AS double) AS upb FROM orig GROUP BY 1")
def _(spark, sf):
    path = _path(spark, "by-year")
    sinks.sink_parquet_year(loans.staged_origination(spark, sf).withColumn("source_year", F.col("vintage_year")), path)
    return spark.read.parquet(path).groupBy("source_year").agg(F.count(F.lit(1)).alias("loans"), F.sum("orig_upb").alias("upb"))


@query("sink_table_overwrite", "SELECT CAST(count(*) AS bigint) AS loans, CAST(sum(credit_score) AS bigint) AS sum_score FROM features")
def _(spark, sf):
    path = _path(spark, "managed")
    name = f"features_{uuid.uuid4().hex[:12]}"
    sinks.sink_table_overwrite(loans.features(spark, sf).limit(0).withColumn("old", F.lit(1)), name, path)
    sinks.sink_table_overwrite(loans.features(spark, sf), name, path)
    return spark.table(name).agg(F.count(F.lit(1)).alias("loans"), F.sum("credit_score").alias("sum_score"))


@query("schema_enforced_append", """SELECT vintage_year, CAST(2*count(*) AS bigint) AS loans, false AS wrong_shape_accepted
    FROM features GROUP BY 1""")
def _(spark, sf):
    path, name = _path(spark, "append"), f"append_{uuid.uuid4().hex[:12]}"
    df = loans.features(spark, sf).select("loan_seq", "vintage_year", "credit_score")
    df.write.option("path", path).format("parquet").saveAsTable(name)
    sinks.schema_enforced_append(df, name)
    try:
        sinks.schema_enforced_append(df.withColumn("extra", F.lit(1)), name)
        accepted = True
    except ValueError:
        accepted = False
    spark.catalog.refreshTable(name)
    return spark.table(name).groupBy("vintage_year").agg(F.count(F.lit(1)).alias("loans")).withColumn(
        "wrong_shape_accepted", F.lit(accepted))


@query("external_table_ddl", """
    SELECT column_name, column_type, CAST((SELECT count(*) FROM orders) AS bigint) AS n_rows FROM (VALUES
      ('o_orderkey','bigint'),('o_custkey','bigint'),('o_orderstatus','string'),('o_totalprice','double'),
      ('o_orderdate','timestamp_ntz'),('o_orderpriority','string')) t(column_name, column_type)""")
def _(spark, sf):
    orders = loans.table(spark, sf, "orders")
    ddl = sinks.external_table_ddl(orders, "lake.orders", f"{sf}/orders.parquet")
    pairs = F.regexp_extract_all(F.lit(ddl), F.lit(r"`\w+` \w+"), F.lit(0))
    parts = F.split(F.replace("pair", F.lit("`"), F.lit("")), " ")
    return (orders.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(pairs).alias("pair"))
            .select(parts[0].alias("column_name"), parts[1].alias("column_type"), "n_rows"))


@query("register_lake_views", """SELECT 'orders' AS name, CAST(count(*) AS bigint) AS n_rows FROM orders
    UNION ALL SELECT 'lineitem', CAST(count(*) AS bigint) FROM lineitem""")
def _(spark, sf):
    sinks.register_lake_views(spark, {f"lake_{t}": f"{sf}/{t}.parquet" for t in ("orders", "lineitem")})
    return spark.sql("SELECT 'orders' AS name, count(*) AS n_rows FROM lake_orders "
                     "UNION ALL SELECT 'lineitem', count(*) FROM lake_lineitem")


@query("file_manifest_diff")
def _(spark, sf):
    local = sinks.file_manifest(spark, f"{sf}/*.parquet")
    name = F.col("name")
    remote = (local.filter(name != "part.parquet")
              .withColumn("sha256", F.when(name == "orders.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")))
              .withColumn("size", F.when(name == "nation.parquet", F.col("size") + 1).otherwise(F.col("size")))
              .withColumn("name", F.when(name == "region.parquet", F.lit("stray.parquet")).otherwise(name)))
    return sinks.file_manifest_diff(local, remote)


FCOLS = ", ".join("round(rate_spread,6) AS rate_spread" if c == "rate_spread" else c for c in FEATURE_COLS)


@query("load_split_guarded", f"SELECT {FCOLS} FROM features WHERE split IN ('validation','test_in_time')")
def _(spark, sf):
    return rounded(readers.load_split_guarded(loans.features(spark, sf), ["validation", "test_in_time"], allow_test=True),
                   "rate_spread")


@query("load_fresh_guarded", """SELECT loan_seq, vintage_year, several_borrowers, split, round(rate_spread,6) AS rate_spread
    FROM fresh WHERE split IN ('fresh_1999','fresh_2001')""")
def _(spark, sf):
    df = readers.load_fresh_guarded(loans.fresh_features(spark, sf), [1999, 2001], allow_exam=True)
    return rounded(df.select("loan_seq", "vintage_year", "several_borrowers", "split", "rate_spread"), "rate_spread")


@query("report_sink", f"SELECT split, n AS loans, bad AS defaults, round(100.0 * bad / n, 2) AS default_rate_pct FROM {_totals('split')}")
def _(spark, sf):
    path = _path(spark, "report")
    summary = feat.split_summary(loans.features(spark, sf))
    sinks.report_sink(summary, path)
    return spark.read.schema(summary.schema).json(path)


# ---- typing and cleaning ------------------------------------------------------------------------
@query("int_or_null", """SELECT loan_seq, try_cast(nullif(nullif(dti,''),'999') AS integer) AS dti,
    try_cast(nullif(nullif(mi_pct,''),'999') AS integer) AS mi_pct FROM raw_orig""")
def _(spark, sf):
    return loans.raw_origination(spark, sf).select("loan_seq", T.int_or_null(F.col("dti"), "999").alias("dti"),
                                                   T.int_or_null(F.col("mi_pct"), "999").alias("mi_pct"))


@query("allow_list", """SELECT loan_seq, CASE WHEN channel IN ('R','B','C','T') THEN channel END AS channel,
    CASE WHEN first_time_homebuyer IN ('Y','N') THEN first_time_homebuyer END AS first_time_homebuyer FROM raw_orig""")
def _(spark, sf):
    return loans.raw_origination(spark, sf).select(
        "loan_seq", T.allow_list(F.col("channel"), "RBCT").alias("channel"),
        T.allow_list(F.col("first_time_homebuyer"), "YN").alias("first_time_homebuyer"))


@query("month_start", """SELECT loan_seq, CAST(try_strptime(first_payment_date||'01','%Y%m%d') AS date) AS first_payment_date,
    CAST(try_strptime(zip3||'01','%Y%m%d') AS date) AS not_a_month FROM raw_orig""")
def _(spark, sf):
    return loans.raw_origination(spark, sf).select(
        "loan_seq", T.month_start(F.col("first_payment_date")).alias("first_payment_date"),
        T.month_start(F.col("zip3")).alias("not_a_month"))


@query("range_or_null", "SELECT loan_seq, credit_score FROM orig")
def _(spark, sf):
    return loans.raw_origination(spark, sf).select(
        "loan_seq", T.range_or_null(T.int_or_null(F.col("credit_score")), 300, 850).alias("credit_score"))


@query("parse_loan_key", "SELECT loan_seq, vintage_year, vintage_quarter FROM orig")
def _(spark, sf):
    key = F.col("loan_seq")
    return loans.raw_origination(spark, sf).select("loan_seq", T.vintage_year(key).alias("vintage_year"),
                                                   T.vintage_quarter(key).alias("vintage_quarter"))


@query("stage_origination", "SELECT * FROM orig")
def _(spark, sf):
    return loans.staged_origination(spark, sf)


@query("seasoning_flag", "SELECT loan_seq, months_after_vintage, is_seasoned_or_modified FROM orig")
def _(spark, sf):
    return loans.staged_origination(spark, sf).select("loan_seq", "months_after_vintage", "is_seasoned_or_modified")


@query("performance_flags", """SELECT loan_seq, CAST(loan_age AS integer) AS age,
    list_contains(['RA', '3', '4', '5', '6', '7', '8', '9'], ltrim(delinq_status, '0')) IS TRUE AS late90,
    list_contains(['02', '03', '09', '15'], zero_balance_code) IS TRUE AS credit_event,
    zero_balance_code > '' IS TRUE AS ended, borrower_assist_code > '' IS TRUE AS assist, CAST(count(*) AS bigint) AS months
    FROM raw_perf GROUP BY ALL""")
def _(spark, sf):
    flags = staging.performance_flags(loans.raw_performance(spark, sf))
    return flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("months"))


@query("exclusion_filter", "SELECT loan_seq, vintage_year, default_24m FROM kept")
def _(spark, sf):
    return loans.kept(spark, sf).select("loan_seq", "vintage_year", "default_24m")


@query("several_borrowers", "SELECT loan_seq, n_borrowers, several_borrowers FROM spread")
def _(spark, sf):
    return loans.with_borrower_flag(loans.kept(spark, sf)).select("loan_seq", "n_borrowers", "several_borrowers")


@query("term_class", "SELECT vintage_year, orig_term>180 AS long_term, CAST(count(*) AS bigint) AS loans FROM orig GROUP BY 1,2")
def _(spark, sf):
    return loans.staged_origination(spark, sf).groupBy("vintage_year", T.term_class(F.col("orig_term")).alias("long_term")).agg(
        F.count(F.lit(1)).alias("loans"))


@query("hash_split", f"SELECT loan_seq, {split_case('loan_seq')} AS split FROM orig")
def _(spark, sf):
    return loans.staged_origination(spark, sf).select("loan_seq", hashing.split_name(
        F.col("loan_seq"), F.col("vintage_year"), loans.DEV_MAX_VINTAGE, loans.OOT_1_MAX_VINTAGE).alias("split"))


@query("fresh_split_name", "SELECT split, CAST(count(*) AS bigint) AS loans FROM fresh GROUP BY 1")
def _(spark, sf):
    return loans.fresh_features(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("loans"))


@query("nearest_vintage", """SELECT vintage_year, CAST(CASE WHEN vintage_year<=1995 THEN 1995 WHEN vintage_year<=1997 THEN 1996 ELSE 1998 END AS integer)
    AS vintage, CAST(count(*) AS bigint) AS loans FROM orig GROUP BY 1""")
def _(spark, sf):
    year = F.col("vintage_year")
    return (loans.staged_origination(spark, sf).groupBy(year).agg(F.count(F.lit(1)).alias("loans"))
            .withColumn("vintage", T.nearest_reference(year, loans.REFERENCE_VINTAGES)))


@query("target_map", "SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS target FROM orders")
def _(spark, sf):
    risk = F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    return loans.table(spark, sf, "orders").select("o_orderkey", T.target_map(risk).alias("target"))


@query("select_model_inputs", f"SELECT {', '.join(SPREAD6 if c == 'rate_spread' else c for c in S.FEATURES)}, default_24m FROM features")
def _(spark, sf):
    return rounded(feat.select_model_inputs(loans.features(spark, sf)), "rate_spread")


@query("fill_missing_level", "SELECT coalesce(channel,'missing') AS level, vintage_year, CAST(count(*) AS bigint) AS loans FROM orig GROUP BY 1,2")
def _(spark, sf):
    return loans.staged_origination(spark, sf).groupBy(T.fill_missing_level(F.col("channel")).alias("level"), "vintage_year").agg(
        F.count(F.lit(1)).alias("loans"))


# ---- joins and the feature build ----------------------------------------------------------------
@query("join_orig_label", "SELECT loan_seq, vintage_year, max_age, observable_24m, default_24m FROM joined")
def _(spark, sf):
    return loans.labelled(spark, sf).select(
        "loan_seq", "vintage_year", "max_age", "observable_24m", "default_24m")


@query("join_median_nullsafe", """SELECT loan_seq, round(m.med,6) AS median_rate FROM kept k LEFT JOIN (
      SELECT vintage_year y, vintage_quarter q, (orig_term>180) t, quantile_cont(int_rate,0.5) AS med FROM kept GROUP BY 1,2,3) m
    ON k.vintage_year IS NOT DISTINCT FROM m.y AND k.vintage_quarter IS NOT DISTINCT FROM m.q AND (k.orig_term>180) IS NOT DISTINCT FROM m.t""")
def _(spark, sf):
    tagged = loans.kept(spark, sf).withColumn("long_term", T.term_class(F.col("orig_term")))
    medians = feat.group_medians(tagged, "int_rate", feat.SPREAD_KEYS, "median_rate")
    return rounded(feat.join_nullsafe(tagged, medians, feat.SPREAD_KEYS).select("loan_seq", "median_rate"), "median_rate")


@query("orphan_rows", "SELECT l.loan_seq FROM (SELECT loan_seq FROM raw_orig) l WHERE l.loan_seq NOT IN (SELECT loan_seq FROM raw_perf)")
def _(spark, sf):
    """The shared tables have no performance row without origination, so the anti join runs the other way round."""
    return orphan_rows(loans.raw_origination(spark, sf), loans.raw_performance(spark, sf))


def orphan_rows(left, right):
    """Keys of ``left`` without a row in ``right``."""
    return left.select("loan_seq").join(right.select("loan_seq"), "loan_seq", "left_anti")


@query("label_per_loan", "SELECT * FROM label")
def _(spark, sf):
    return loans.staged_label(spark, sf)


@query("rate_spread", f"SELECT loan_seq, vintage_year, vintage_quarter, orig_term, int_rate, {SPREAD6} FROM spread")
def _(spark, sf):
    return rounded(feat.rate_spread(loans.kept(spark, sf)).select(
        "loan_seq", "vintage_year", "vintage_quarter", "orig_term", "int_rate", "rate_spread"), "rate_spread")


@query("feature_table", f"SELECT {FCOLS} FROM features")
def _(spark, sf):
    """The whole build from the raw text layer: staging, labels, exclusions, spread and split, no staged table reused."""
    kept = feat.exclusion_filter(loans.labelled(spark, sf))
    return rounded(feat.build_features(write_scratch(kept, "kept"), loans.DEV_MAX_VINTAGE, loans.OOT_1_MAX_VINTAGE),
                   "rate_spread")


@query("fresh_feature_table", f"""SELECT {', '.join(SPREAD6 if c == 'rate_spread' else c
       for c in S.META + S.FEATURES + S.FRESH_EXTRA + S.LABELS + ['split'])} FROM fresh""")
def _(spark, sf):
    return rounded(loans.fresh_features(spark, sf), "rate_spread")


@query("exclusion_waterfall", """
    SELECT vintage_year, CAST(count(reason) AS bigint) AS start, CAST(sum(CAST(reason = 1 AS integer)) AS bigint) AS removed_relief_refi,
      CAST(sum(CAST(reason = 2 AS integer)) AS bigint) AS removed_seasoned_or_modified,
      CAST(sum(CAST(reason = 3 AS integer)) AS bigint) AS removed_not_observable,
      CAST(sum(CAST(reason = 0 AS integer)) AS bigint) AS kept, CAST(sum(CAST(reason = 9 AS integer)) AS bigint) AS unaccounted
    FROM (SELECT vintage_year, CASE WHEN relief_refi THEN 1 WHEN is_seasoned_or_modified THEN 2 WHEN NOT observable_24m THEN 3
                 WHEN observable_24m AND NOT is_seasoned_or_modified AND NOT relief_refi THEN 0 ELSE 9 END AS reason FROM joined)
    GROUP BY vintage_year""")
def _(spark, sf):
    return feat.exclusion_waterfall(loans.joined(spark, sf))


@query("split_summary", f"""SELECT split, n AS loans, bad AS defaults, round(100.0 * bad / n, 2) AS default_rate_pct
    FROM {_totals("split")}""")
def _(spark, sf):
    return feat.split_summary(loans.features(spark, sf))


@query("default_rates_mart", f"""SELECT vintage_year, split, n AS loans, bad AS defaults, round(100.0 * bad / n, 2) AS default_rate_pct
    FROM {_totals("vintage_year", "split")}""")
def _(spark, sf):
    return feat.split_summary(loans.features(spark, sf), "vintage_year", "split")


@query("split_share", """SELECT split, CAST(count(*) AS bigint) AS loans, round(100.0*count(*)/sum(count(*)) OVER (),1) AS pct
    FROM features WHERE vintage_year <= 1998 GROUP BY 1""")
def _(spark, sf):
    return feat.split_share(loans.features(spark, sf).filter(F.col("vintage_year") <= loans.DEV_MAX_VINTAGE))


@query("stage_year_report", """SELECT vintage_year, CAST(count(*) AS bigint) AS loans, CAST(count_if(relief_refi) AS bigint) AS relief_refi,
    CAST(count_if(is_seasoned_or_modified) AS bigint) AS seasoned_or_modified, CAST(count_if(NOT observable_24m) AS bigint) AS not_observable_24m,
    CAST(coalesce(sum(default_24m),0) AS bigint) AS defaults_b, CAST(coalesce(sum(default_24m_all_late),0) AS bigint) AS defaults_a_all_late,
    CAST(coalesce(sum(default_24m_loss_only),0) AS bigint) AS defaults_c_loss_only
    FROM orig LEFT JOIN label USING (loan_seq) GROUP BY 1""")
def _(spark, sf):
    return staging.stage_report(loans.staged_origination(spark, sf), loans.staged_label(spark, sf))


@query("order_report", "SELECT vintage_year, split, CAST(count(*) AS bigint) AS loans FROM features GROUP BY 1,2 ORDER BY 1,2")
def _(spark, sf):
    return loans.features(spark, sf).groupBy("vintage_year", "split").agg(F.count(F.lit(1)).alias("loans")).orderBy("vintage_year", "split")


@query("simple_slice", f"""SELECT split, CAST(count(*) AS bigint) AS loans, CAST(sum(default_24m) AS bigint) AS defaults_b,
    CAST(sum(default_24m_all_late) AS bigint) AS defaults_a FROM (SELECT *, {split_case("CAST(CAST(substr(loan_seq,6) AS bigint) AS varchar)")}
    AS split FROM joined WHERE observable_24m) GROUP BY 1""")
def _(spark, sf):
    return loans.split_by_order_number(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("default_24m").alias("defaults_b"), F.sum("default_24m_all_late").alias("defaults_a"))


@query("seeded_sample", f"""SELECT loan_seq, split FROM features WHERE split='validation'
    ORDER BY {uniform32("loan_seq || 'sample-42'")}, loan_seq LIMIT 2000""")
def _(spark, sf):
    """Exact-size sample: TakeOrderedAndProject keeps 2,000 rows per task, never a global sort."""
    rows = readers.load_split_guarded(loans.features(spark, sf), "validation")
    return rows.orderBy(hashing.uniform32(F.col("loan_seq"), "sample-42"), "loan_seq").limit(2000).select("loan_seq", "split")
