"""Stability indices, level monitors, fire drills and level recalibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import hashing
from loanloom.functions.stats import clip, level_error, level_flag, logit_shift, psi_flag, psi_term, safe_ratio
from loanloom.operators.metrics import evaluate_cells
from loanloom.operators.ranks import hash_cut, score_cells, within_cut
from loanloom.operators.scoring import band_columns, score_batch
from loanloom.session import write_scratch

SCORE = "score"


def monitor_counts(df: DataFrame, record: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """(group, monitor, band) -> n for the score and every input of the model, in one aggregation."""
    width = S.MONITORING["score_band_points"]
    keys = {SCORE: F.floor(F.col("score") / width), **band_columns(record)}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("monitor"), b.cast("bigint").alias("band")) for m, b in keys.items()]))
    return df.select(*by, pairs.alias("k")).groupBy(*by, "k.monitor", "k.band").agg(F.count(F.lit(1)).alias("n"))


def drift_universe(reference: DataFrame, current: DataFrame, batch: str) -> DataFrame:
    """Every band seen on either side, for every batch, with zero fill.

    Works on band counts only: the batches of a band are held in one map, whose size is the number of batches.
    """
    per_band = current.groupBy("monitor", "band").agg(F.map_from_entries(F.collect_list(F.struct(batch, "n"))).alias("_by"))
    batches = current.select(batch).distinct().agg(F.collect_list(batch))
    both = reference.select("monitor", "band", F.col("n").alias("ref_n")).join(per_band, ["monitor", "band"], "full_outer")
    each = both.withColumn("_all", batches.scalar()).select("*", F.explode("_all").alias(batch))
    return each.select(batch, "monitor", "band", F.coalesce("ref_n", F.lit(0)).alias("ref_n"),
                       F.coalesce(F.col("_by")[F.col(batch)], F.lit(0)).alias("cur_n"))


def psi(universe: DataFrame, by: Sequence[str] = ("monitor",), floor: float = S.MONITORING["share_floor"], needed: bool = True) -> DataFrame:
    """Stability index per group; a side without observations stops the job, or gives NULL if it isn't ``needed``."""
    group = Window.partitionBy(*by)

    def share(n):
        total = F.sum(n).over(group)
        nothing = F.raise_error(F.lit("no observations")) if needed else F.lit(None)
        return F.when(total > 0, F.col(n) / total).otherwise(nothing.cast("double"))

    shares = universe.withColumn("_r", share("ref_n")).withColumn("_c", share("cur_n"))
    known = F.col("_r").isNotNull() & F.col("_c").isNotNull()
    return shares.groupBy(*by).agg(F.sum(F.when(known, psi_term(F.col("_r"), F.col("_c"), floor))).alias("psi"))


def drift_flags(values: DataFrame) -> DataFrame:
    return values.withColumn("flag", psi_flag(F.col("psi")))


def compare_batches(record: Mapping, reference: DataFrame, batches: DataFrame, batch: str, needed: bool = True) -> DataFrame:
    """(batch, monitor) -> psi and flag for all batches against one reference, plus the level monitor.

    An empty reference stops the job; if it isn't ``needed``, the indices are NULL and raise no flag.
    """
    universe = drift_universe(monitor_counts(reference, record), monitor_counts(batches, record, [batch]), batch)
    indices = drift_flags(psi(universe, [batch, "monitor"], needed=needed))
    level = batches.groupBy(batch).agg(F.avg("y").alias("observed"), F.avg("pd").alias("predicted"))
    ratio = safe_ratio(F.col("observed"), F.col("predicted"))
    level = level.select(batch, F.lit("level_ratio").alias("monitor"), ratio.alias("psi"), level_flag(ratio).alias("flag"))
    return indices.unionByName(level).withColumnRenamed("psi", "value")


def batch_report(monitors: DataFrame, batch: str) -> DataFrame:
    """One row per batch: score index, worst input, level ratio, names at alert and at warn or worse."""
    m, value, flag = F.col("monitor"), F.col("value"), F.col("flag")
    is_input = ~m.isin(SCORE, "level_ratio")
    label = F.when(m == SCORE, "score_psi").when(is_input, F.concat(F.lit("csi:"), m)).otherwise(m)
    names = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, label))), ",")
    return monitors.groupBy(batch).agg(
        F.max(F.when(m == SCORE, value)).alias("score_psi"), F.max(F.when(is_input, value)).alias("max_csi"),
        F.max_by(F.when(is_input, m), F.when(is_input, value)).alias("max_csi_feature"),
        F.max(F.when(m == "level_ratio", value)).alias("level_ratio"),
        names(flag == "alert").alias("alert_monitors"), names(flag != "ok").alias("warn_or_worse_monitors"))


def alert_list(monitors: DataFrame, batch: str) -> DataFrame:
    return batch_report(monitors, batch).select(batch, "alert_monitors", "warn_or_worse_monitors")


# ---- controlled damage --------------------------------------------------------------------------
def perturb_shift(df: DataFrame, features: Sequence[str], delta: float) -> DataFrame:
    for f in features:
        moved = F.col(f).cast("double") + delta
        df = df.withColumn(f, clip(moved, *S.MONITORING["valid_range"][f]) if f in S.MONITORING["valid_range"] else moved)
    return df


def perturb_missing(df: DataFrame, feature: str, share: float, key: str, seed: str) -> DataFrame:
    return df.withColumn(feature, F.when(hashing.uniform(F.col(key), seed) >= share, F.col(feature)))


def perturb_new_category(df: DataFrame, feature: str, value: str, share: float, key: str, seed: str) -> DataFrame:
    return df.withColumn(feature, F.when(hashing.uniform(F.col(key), seed) < share, F.lit(value)).otherwise(F.col(feature)))


def perturb_default_rate(df: DataFrame, factor: float, key: str, seed: str) -> DataFrame:
    """Flip zeros to one, in hash order, until the defaults reach ``factor`` times their number (half-even rounding)."""
    bad = df.agg(F.sum("y"), F.count(F.lit(1)))
    sums = bad.toDF("bad", "n").select((F.least(F.bround(F.col("bad") * F.lit(float(factor))).cast("bigint"), F.col("n")) - F.col("bad")).alias("extra"))
    zeros = df.filter(F.col("y") == 0).select(key)
    cut = hash_cut(zeros, key, seed, sums.scalar())
    flip = (F.col("y") == 0) & within_cut(key, seed, F.col("_cut"))
    return df.withColumn("_cut", cut.scalar()).withColumn("y", F.when(flip, 1).otherwise(F.col("y"))).drop("_cut")


def perturb(df: DataFrame, spec: Mapping, key: str, seed: str) -> DataFrame:
    kind = spec["kind"]
    if kind == "shift":
        return perturb_shift(df, spec["features"], spec["delta"])
    if kind == "missing":
        return perturb_missing(df, spec["feature"], spec["share"], key, seed)
    if kind == "new_category":
        return perturb_new_category(df, spec["feature"], spec["value"], spec["share"], key, seed)
    if kind == "default_rate":
        return perturb_default_rate(df, spec["factor"], key, seed)
    raise ValueError(f"unknown drill {kind}")


def sample_and_rest(df: DataFrame, size: int, key: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """Exactly ``size`` rows in hash order, and all the others: one comparison with the last sampled row."""
    tagged = df.withColumn("_cut", hash_cut(df.select(key), key, seed, F.lit(size)).scalar())
    inside = within_cut(key, seed, F.col("_cut"))
    return tagged.filter(inside).drop("_cut"), tagged.filter(~inside).drop("_cut")


def drift_drill_grid(record: Mapping, pool: DataFrame, key: str = "loan_seq", size: int | None = None,
                     drills: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Control and every drill through the monitors: one union keyed by drill, one comparison.

    ``pool`` has the model inputs and ``y``.  The sampled batch is written once because ten drills read it.  A pool that
    holds no more than the batch leaves no reference: then only the level is judged, and the indices are NULL.
    """
    seed = S.MONITORING["drill_seed"]
    size = S.MONITORING["drill_batch"] if size is None else size
    drills = S.MONITORING["drills"] if drills is None else drills
    columns = [key, *record["feature_order"], "y"]
    batch, rest = sample_and_rest(pool.select(*[F.col(c).cast("double") if c in _numeric(record) else F.col(c) for c in columns]),
                                  size, key, seed)
    batch = write_scratch(batch, "drill-batch")
    parts = [batch.withColumn("drill", F.lit("C0"))]
    parts += [perturb(batch, spec, key, seed + "-shift").withColumn("drill", F.lit(d)) for d, spec in drills.items()]
    damaged = score_batch(record, reduce(lambda a, b: a.unionByName(b), parts))
    return batch_report(compare_batches(record, score_batch(record, rest), damaged, "drill", needed=False), "drill")


def _numeric(record: Mapping) -> list[str]:
    return [f for f in record["feature_order"] if record["features"][f]["type"] == "numeric"]


def drill_verdict(report: DataFrame) -> DataFrame:
    """Whether the control stayed clean and which expected drills were caught or missed."""
    expected = F.col("drill").isin(*S.MONITORING["expect_alert"])
    alert = F.col("alert_monitors") != ""
    names = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("drill")))), ",")
    out = report.agg(F.bool_and((F.col("drill") != "C0") | (F.col("warn_or_worse_monitors") == "")).alias("control_clean"),
                     names(expected & alert).alias("caught"), names(expected & ~alert).alias("missed"),
                     F.count_if(expected & alert).alias("n_caught"))
    return out.withColumn("enough_alerts", F.col("n_caught") >= S.MONITORING["min_alerts"])


# ---- recalibration ------------------------------------------------------------------------------
def known_vintages(vintages: DataFrame, vintage: str, lag: int = S.RECALIBRATION["label_lag_years"]) -> DataFrame:
    """(target, known) pairs: a vintage is known when it is at least ``lag`` years older.  Works on distinct years."""
    years = vintages.select(F.col(vintage).alias("target")).distinct()
    listed = years.agg(F.sort_array(F.collect_list("target")))
    return years.withColumn("_all", listed.scalar()).select(
        "target", F.explode(F.filter("_all", lambda v: v <= F.col("target") - lag)).alias("known"))


def solve_shifts(cells: DataFrame, targets: Mapping, group: str = "grp", tol: float = 1e-12, passes: int = 60) -> dict:
    """Log-odds constants that make each group's mean PD equal its target rate.

    ``cells`` holds (group, x, n).  Each pass is one aggregation returning two numbers per group (the mean and its
    slope); Newton steps are kept inside a shrinking bracket, so every group converges whatever its PDs look like.
    """
    wrong = [g for g, t in targets.items() if not 0 < t < 1]
    if wrong:
        raise ValueError(f"target rates must lie strictly between 0 and 1: {wrong}")
    low, high = {g: -30.0 for g in targets}, {g: 30.0 for g in targets}
    at, done = {g: 0.0 for g in targets}, {}
    for _ in range(passes):
        active = [g for g in targets if g not in done]
        if not active:
            break
        delta = F.coalesce(*[F.when(F.col(group) == g, at[g]) for g in active])
        q = logit_shift(F.col("x"), delta)
        rows = cells.filter(F.col(group).isin(active)).groupBy(group).agg(
            (F.sum(F.col("n") * q) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * q * (1 - q)) / F.sum("n")).alias("slope")).collect()
        for row in rows:
            g, gap = row[group], row["mean"] - targets[row[group]]
            low[g], high[g] = (at[g], high[g]) if gap < 0 else (low[g], at[g])
            step = at[g] - gap / row["slope"] if row["slope"] > 0 else float("nan")
            step = step if low[g] < step < high[g] else (low[g] + high[g]) / 2
            if gap == 0 or abs(step - at[g]) < tol or high[g] - low[g] < tol:
                done[g] = at[g] if gap == 0 else step
            at[g] = step
    return {g: done.get(g, at[g]) for g in targets}


ARMS = ("A_static", "B_last", "C_pooled")


def recalibration_arms(frame: DataFrame, vintage: str = "vintage", lag: int = S.RECALIBRATION["label_lag_years"]) -> DataFrame:
    """Static, last-vintage and pooled level corrections for every target vintage.

    Rows are reduced once to (vintage, PD) -> (n, bad) cells; solving and evaluating only touch the cells.
    """
    cells = write_scratch(score_cells(frame, "pd", "y", [vintage]), "pd-cells")
    levels = {r[vintage]: (r["n"], r["bad"]) for r in cells.groupBy(vintage).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()}
    known = {v: sorted(k for k in levels if k <= v - lag) for v in sorted(levels)}
    sets = {}
    for v, ks in known.items():
        if ks:
            sets[f"{v}|B_last"], sets[f"{v}|C_pooled"] = ks[-1:], ks
    targets = {g: sum(levels[k][1] for k in ks) / sum(levels[k][0] for k in ks) for g, ks in sets.items()}
    member = F.coalesce(*[F.when(F.col(vintage) == v, F.array(*[F.lit(g) for g, ks in sets.items() if v in ks]))
                          for v in levels if any(v in ks for ks in sets.values())])
    deltas = solve_shifts(cells.withColumn("grp", F.explode(member)), targets) if sets else {}
    arms = {v: [("A_static", 0.0), ("B_last", deltas[f"{v}|B_last"]), ("C_pooled", deltas[f"{v}|C_pooled"])]
            for v, ks in known.items() if ks}
    pick = F.coalesce(*[F.when(F.col(vintage) == v, F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(d).alias("delta")) for a, d in row]))
                        for v, row in arms.items()])
    shifted = cells.withColumn("a", F.explode(pick)).select(
        F.col(vintage).alias("target"), "a.arm", "a.delta", "n", "bad",
        F.when(F.col("a.delta") == 0, F.col("x")).otherwise(logit_shift(F.col("x"), F.col("a.delta"))).alias("x"))
    out = evaluate_cells(shifted, ["target", "arm", "delta"], ["n", "default_rate", "mean_predicted_pd", "gini", "brier"])
    static = F.max(F.when(F.col("arm") == "A_static", F.col("gini"))).over(Window.partitionBy("target"))
    return out.select("target", "arm", "delta", "n", F.col("default_rate").alias("observed"),
                      F.col("mean_predicted_pd").alias("mean_predicted"),
                      level_error(F.col("mean_predicted_pd"), F.col("default_rate")).alias("level_error"),
                      safe_ratio(F.col("default_rate"), F.col("mean_predicted_pd")).alias("ratio_observed_over_predicted"),
                      "brier", "gini", (F.abs(F.col("gini") - static) < 1e-9).alias("gini_unchanged"))


def recalibration_verdict(arms: DataFrame) -> DataFrame:
    """Whether each corrected arm beats the static one by the agreed rules."""
    rules = S.RECALIBRATION
    base = F.max(F.when(F.col("arm") == "A_static", F.col("level_error"))).over(Window.partitionBy("target"))
    pairs = arms.withColumn("base", base).withColumn("all_same", F.bool_and("gini_unchanged").over(Window.partitionBy()))
    out = pairs.filter(F.col("arm") != "A_static").groupBy("arm").agg(
        F.avg("base").alias("mean_error_static"), F.avg("level_error").alias("mean_error"),
        F.count_if(F.col("level_error") < F.col("base")).alias("targets_improved"),
        F.max(F.col("level_error") - F.col("base")).alias("worst_worsening"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("level_error") < F.col("base"), F.col("target").cast("string")))), ",").alias("improved_targets"),
        F.bool_and("all_same").alias("gini_unchanged"))
    improvement = 1 - F.col("mean_error") / F.col("mean_error_static")
    return out.withColumn("mean_improvement", improvement).withColumn(
        "recommended", (F.col("mean_improvement") >= rules["min_mean_improvement"])
        & (F.col("targets_improved") >= rules["min_targets_improved"]) & (F.col("worst_worsening") <= rules["max_single_worsening"]))
