"""Bands, Weight of Evidence and Information Value from (feature, value) cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.bands import band_count, band_index, band_labels, band_lookup
from loanloom.operators.ranks import running_before
from loanloom.session import write_scratch


def long_values(df: DataFrame, columns: Sequence[str], kind: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, x) rows: wide to long, so that all features share one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("x")) for c in columns]))
    rows = df.select(*keep, pairs.alias("v"))
    return rows.select(*[c for c in rows.columns if c != "v"], "v.*")


def value_cells(df: DataFrame, columns: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value) -> n, bad for numeric columns; NULL and NaN values keep a cell with x NULL."""
    rows = long_values(df, columns, "double", [*by, F.col(y).cast("bigint").alias("_y")])
    return rows.groupBy(*by, "feature", F.when(~F.isnan("x"), F.col("x")).alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("bad"))


def _gini(n: Column, bad: Column) -> Column:
    """Twice the Gini impurity mass of a node."""
    return bad * (n - bad) / n


def supervised_edges(cells: DataFrame, totals: Mapping[str, int], cfg: Mapping = S.BINNING) -> dict[str, list[float]]:
    """Cut points per feature by best-first impurity splitting, all features together.

    ``cells`` holds (feature, x, n, bad); ``totals`` the row count of each feature including missing values.  The
    cells are ranked once; a leaf is then a value interval with known counts at its start, and one round evaluates
    every candidate cut of all new leaves with a single aggregation that returns two rows per feature.
    """
    ranked = write_scratch(running_before(cells.filter(F.col("x").isNotNull()), ["n", "bad"], ["feature"])
                           .select("feature", "x", "n", "bad", "before_n", "before_bad", "total_n", "total_bad"), "ranked-cells")
    smallest = {f: max(cfg["min_bin_rows"], int(cfg["min_bin_share"] * n)) for f, n in totals.items()}
    spans = {r["feature"]: r for r in ranked.groupBy("feature").agg(
        F.max("total_n").alias("n"), F.max("total_bad").alias("bad"), F.count(F.lit(1)).alias("values")).collect()}
    # a leaf: (low, high] in value space, counts before it and inside it
    fresh = {f: [(None, None, 0, 0, s["n"], s["bad"])] for f, s in spans.items() if s["values"] > 1}
    open_leaves: dict[str, list] = {f: [] for f in fresh}
    cuts: dict[str, list[float]] = {f: [] for f in spans}
    while any(fresh.values()):
        for f, found in _best_splits(ranked, fresh, smallest).items():
            open_leaves[f] += found
        fresh = {}
        for f, leaves in open_leaves.items():
            if not leaves or len(cuts[f]) >= cfg["max_bins_per_numeric"] - 1:
                continue
            best = max(leaves, key=lambda leaf: leaf[1])
            leaves.remove(best)
            (low, high, n0, bad0, n, bad), _gain, x, left_n, left_bad = best
            cuts[f].append(x)
            if len(cuts[f]) < cfg["max_bins_per_numeric"] - 1:
                fresh[f] = [(low, x, n0, bad0, left_n, left_bad), (x, high, n0 + left_n, bad0 + left_bad, n - left_n, bad - left_bad)]
    return _midpoints(ranked, cuts)


def _best_splits(ranked: DataFrame, leaves: Mapping[str, list], smallest: Mapping[str, int]) -> dict[str, list]:
    c = F.col
    # the few open leaves are expressions, so a round is one scan of the cells and one shuffle of their best splits
    found = []
    for f, items in leaves.items():
        for i, (low, high, n0, bad0, n, bad) in enumerate(items):
            inside = c("feature") == f
            inside = inside if low is None else inside & (c("x") > F.lit(low))
            inside = inside if high is None else inside & (c("x") <= F.lit(high))
            values = {"leaf": i, "n0": n0, "bad0": bad0, "ln": n, "lbad": bad, "least": smallest[f]}
            found.append(F.when(inside, F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in values.items()))))
    if not found:
        return {}
    counted = ranked.withColumn("_leaf", F.coalesce(*found)).filter("_leaf is not null").select(
        "feature", F.col("_leaf.leaf").alias("leaf"), "x", F.col("_leaf.ln").alias("ln"), F.col("_leaf.lbad").alias("lbad"), F.col("_leaf.least").alias("least"),
        (c("before_n") + c("n") - c("_leaf.n0")).alias("left_n"), (c("before_bad") + c("bad") - c("_leaf.bad0")).alias("left_bad"))
    right_n, right_bad = c("ln") - c("left_n"), c("lbad") - c("left_bad")
    allowed = (c("left_n") >= c("least")) & (right_n >= c("least")) & (c("lbad") > 0) & (c("lbad") < c("ln"))
    scored = counted.filter(allowed).withColumn("gain", _gini(c("ln"), c("lbad")) - _gini(c("left_n"), c("left_bad")) - _gini(right_n, right_bad))
    best = F.max_by(F.struct("x", "left_n", "left_bad", "gain"), F.struct(c("gain"), -c("x")))
    rows = scored.groupBy("feature", "leaf").agg(best.alias("b")).collect()
    out: dict[str, list] = {}
    for r in rows:
        b = r["b"]
        out.setdefault(r["feature"], []).append((leaves[r["feature"]][r["leaf"]], b["gain"], b["x"], b["left_n"], b["left_bad"]))
    return out


def _midpoints(ranked: DataFrame, cuts: Mapping[str, list[float]]) -> dict[str, list[float]]:
    """Half way between the last value of a band and the next value present."""
    wanted = [(f, x) for f, xs in cuts.items() for x in xs]
    if not wanted:
        return {f: [] for f in cuts}
    above = [F.min(F.when((F.col("feature") == f) & (F.col("x") > F.lit(x)), F.col("x"))) for f, x in wanted]
    nexts = dict(zip(wanted, ranked.agg(*above).first(), strict=True))
    out: dict[str, list[float]] = {f: [] for f in cuts}
    for f, x in wanted:
        out[f].append((x + nexts[f, x]) / 2)
    return {f: sorted(v) for f, v in out.items()}


def category_bands(df: DataFrame, columns: Sequence[str], cfg: Mapping = S.BINNING) -> dict[str, list[str]]:
    """Categories holding at least the minimum share of all rows; there can be at most 1 / share of them."""
    n = df.count()
    rows = (long_values(df, columns, "string", []).filter("x IS NOT NULL").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= cfg["min_category_share"] * n).collect()) if columns else []
    return {c: sorted(r["x"] for r in rows if r["feature"] == c) for c in columns}


def fit_bins(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str], cfg: Mapping = S.BINNING) -> dict[str, dict]:
    n = df.count()
    edges = supervised_edges(value_cells(df, numeric, y), {c: n for c in numeric}, cfg) if numeric else {}
    kept = category_bands(df, categorical, cfg)
    return {**{c: {"edges": edges.get(c, [])} for c in numeric}, **{c: {"categories": kept[c]} for c in categorical}}


def band_cells(df: DataFrame, specs: Mapping[str, Mapping], y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, band) -> n, bad; one shuffle for all features."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), band_index(f, s).alias("band")) for f, s in specs.items()]))
    rows = df.select(*by, F.col(y).cast("bigint").alias("_y"), pairs.alias("b"))
    return rows.groupBy(*by, "b.feature", "b.band").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("bad"))


def woe_table(df: DataFrame, specs: Mapping[str, Mapping], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, default rate, WoE and IV part of every band; a band without rows is neutral."""
    return woe_from_cells(band_cells(df, specs, y, by), specs, by)


def woe_from_cells(cells: DataFrame, specs: Mapping[str, Mapping], by: Sequence[str] = ()) -> DataFrame:
    # every band of a feature is listed by the feature itself, so that empty bands appear without a cross product
    full = F.coalesce(*[F.when(F.col("feature") == f, F.array(*[F.struct(F.lit(i).alias("band"), F.lit(lab).alias("label"))
                                                              for i, lab in enumerate(band_labels(s))])) for f, s in specs.items()])
    have = cells.groupBy(*by, "feature").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("n", "bad")))).alias("_m"))
    each = have.select(*by, "feature", "_m", F.explode(full).alias("g"))
    zero = F.lit(0).cast("bigint")
    got = each.select(*by, "feature", F.col("g.band").alias("band"), F.col("g.label").alias("label"),
                      F.coalesce(F.col("_m")[F.col("g.band")]["n"], zero).alias("n"),
                      F.coalesce(F.col("_m")[F.col("g.band")]["bad"], zero).alias("defaults"))
    group = Window.partitionBy(*by, "feature")
    bad, good = F.col("defaults"), F.col("n") - F.col("defaults")
    k = F.count(F.lit(1)).over(group) * S.WOE_SMOOTH
    good_share = (good + S.WOE_SMOOTH) / (F.sum(good).over(group) + k)
    bad_share = (bad + S.WOE_SMOOTH) / (F.sum(bad).over(group) + k)
    woe = F.log(good_share / bad_share)
    return got.select(*by, "feature", "band", "label", "n", "defaults", F.when(F.col("n") > 0, bad / F.col("n")).alias("default_rate"),
                      F.when(F.col("n") > 0, woe).otherwise(0.0).alias("woe"),
                      F.when(F.col("n") > 0, (good_share - bad_share) * woe).otherwise(0.0).alias("iv_part"))


def information_value(table: DataFrame, by: Sequence[str] = (), min_iv: float = S.BINNING["min_iv"]) -> DataFrame:
    return table.groupBy(*by, "feature").agg(F.sum("iv_part").alias("iv")).withColumn("kept", F.col("iv") >= min_iv)


def woe_column(feature: str, spec: Mapping, woe: Sequence[float]) -> Column:
    return band_lookup(feature, spec, [float(w) for w in woe])


def woe_by_band(table_rows, specs: Mapping[str, Mapping]) -> dict[str, list[float]]:
    """Collected WoE rows (a few bands per feature) as one list per feature."""
    out = {f: [0.0] * band_count(s) for f, s in specs.items()}
    for r in table_rows:
        out[r["feature"]][r["band"]] = r["woe"]
    return out
