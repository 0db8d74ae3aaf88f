"""Scoring and explaining with a model record: pure column expressions, usable in batch and stream."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.bands import band_count, band_index, band_labels, band_lookup, is_numeric
from loanloom.functions.stats import clip


def model_record(name: str, features: Mapping[str, Mapping], scaling: Mapping[str, float],
                 training_ranges: Mapping[str, tuple] | None = None, populated: Mapping[str, list[bool]] | None = None) -> dict:
    """The nested model record; labels and best points follow from edges, categories and points.

    ``populated`` says which bands hold training rows; a best score is only taken from such bands.
    """
    missing = [f for f in features if f not in S.REASON_CODES]
    if missing:
        raise ValueError(f"no approved reason sentence for {missing}")
    record = {
        "schema_version": 1, "model": name, "scaling": {**S.SCALING, **scaling}, "feature_order": list(features),
        "features": {f: {"type": "numeric" if is_numeric(spec) else "categorical", "labels": band_labels(spec), **spec}
                     for f, spec in features.items()},
        "best_points": {f: max(p for i, p in enumerate(spec["points"]) if populated is None or populated[f][i])
                        for f, spec in features.items()},
        "reason_codes": {f: dict(zip(("code", "phrase", "reportable"), S.REASON_CODES[f])) for f in features},
        "known_limits": ["Through-the-cycle model: it cannot see the economic climate.",
                         "Probability of a flagged serious delinquency within 24 months, not a probability of loss."],
    }
    record["model_id"] = model_id(record)
    if training_ranges:
        record["training_ranges"] = {f: list(r) for f, r in training_ranges.items()}
    return record


def model_id(record: Mapping) -> str:
    """First twelve hex digits of the hash of what the model computes, independent of descriptive fields."""
    core = {k: record[k] for k in ("feature_order", "features", "scaling")}
    return hashlib.sha256(json.dumps(core, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def adopted_model() -> dict:
    return model_record("woe_scorecard_v2", S.ADOPTED_FEATURES, S.ADOPTED_SCALING, S.ADOPTED_TRAINING_RANGES)


def model_problems(record: Mapping) -> list[str]:
    """Structural problems of a model record; an empty list means it can be scored."""
    def finite(values):
        return all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in values)

    required = ("schema_version", "model", "scaling", "feature_order", "features", "best_points", "reason_codes", "known_limits")
    absent = [f"missing key: {k}" for k in required if k not in record]
    if absent:
        return absent
    found = [] if record["schema_version"] == 1 else [f"unsupported schema_version {record['schema_version']}"]
    scaling = record["scaling"]
    if not finite(scaling.get(k) for k in ("base_score", "base_odds", "points_to_double_odds", "factor", "offset")):
        found.append("scaling must hold finite numbers")
    elif scaling["factor"] <= 0:
        found.append("scaling.factor must be positive")
    if sorted(record["feature_order"]) != sorted(record["features"]):
        found.append("feature_order and features disagree")
    for f, spec in record["features"].items():
        if spec.get("type") not in ("numeric", "categorical"):
            found.append(f"{f}: unknown type {spec.get('type')}")
            continue
        if spec["type"] == "numeric":
            edges = spec.get("edges", [])
            if not finite(edges) or any(b <= a for a, b in zip(edges, edges[1:])):
                found.append(f"{f}: edges must be finite and strictly increasing")
        points = spec.get("points") or []
        if not finite(points) or len(points) != band_count(spec):
            found.append(f"{f}: expected {band_count(spec)} finite points")
        if len(spec.get("labels", [])) != len(points):
            found.append(f"{f}: labels and points differ in length")
        if f not in record["best_points"] or f not in record["reason_codes"]:
            found.append(f"{f}: missing best_points or reason_codes")
    return found


def validate_model(record: Mapping) -> Mapping:
    problems = model_problems(record)
    if problems:
        raise ValueError("; ".join(problems))
    return record


def feature_points(record: Mapping, name: str) -> Column:
    spec = record["features"][name]
    return band_lookup(name, spec, [float(p) for p in spec["points"]])


def score_column(record: Mapping) -> Column:
    if not record["feature_order"]:
        return F.lit(float(record["scaling"].get("constant_points", 0.0)))
    total = feature_points(record, record["feature_order"][0])
    for name in record["feature_order"][1:]:
        total = total + feature_points(record, name)
    return total


def pd_column(record: Mapping, score: Column) -> Column:
    scaling = record["scaling"]
    return 1.0 / (1.0 + F.exp(clip((score - scaling["offset"]) / scaling["factor"], -700.0, 700.0)))


def score_batch(record: Mapping, df: DataFrame) -> DataFrame:
    """Add ``score`` (higher is safer) and ``pd``: one narrow, code-generated projection."""
    return df.withColumn("score", score_column(record)).withColumn("pd", pd_column(record, F.col("score")))


def band_columns(record: Mapping) -> dict[str, Column]:
    return {f: band_index(f, record["features"][f]) for f in record["feature_order"]}


def reasons_column(record: Mapping, top_k: int = S.TOP_REASONS, min_points: float = S.MIN_POINTS_LOST) -> Column:
    """Up to ``top_k`` reasons, biggest loss first, ties in model order, only reportable losses of enough points."""
    entries = []
    for pos, f in enumerate(record["feature_order"]):
        code = record["reason_codes"][f]
        if code.get("reportable", True):
            lost = F.lit(float(record["best_points"][f])) - feature_points(record, f)
            entries.append(F.struct((-lost).alias("sort"), F.lit(pos).alias("pos"), F.lit(code["code"]).alias("code"),
                                    F.lit(f).alias("feature"), F.lit(code["phrase"]).alias("phrase"),
                                    band_lookup(f, record["features"][f], record["features"][f]["labels"]).alias("band"),
                                    lost.alias("points_lost")))
    ordered = F.slice(F.sort_array(F.array(*entries)), 1, top_k)
    kept = F.filter(ordered, lambda r: r["points_lost"] >= min_points)
    return F.transform(kept, lambda r: F.struct(r["code"].alias("code"), r["feature"].alias("feature"), r["phrase"].alias("phrase"),
                                                r["band"].alias("band"), r["points_lost"].alias("points_lost")))


def explain_batch(record: Mapping, df: DataFrame, top_k: int = S.TOP_REASONS, min_points: float = S.MIN_POINTS_LOST) -> DataFrame:
    """Score, PD, points and band per feature, and the reasons of every row."""
    order = record["feature_order"]
    points = F.create_map(*[c for f in order for c in (F.lit(f), feature_points(record, f))])
    bands = F.create_map(*[c for f in order for c in (
        F.lit(f), band_lookup(f, record["features"][f], record["features"][f]["labels"]))])
    return (score_batch(record, df).withColumn("points", points).withColumn("bands", bands)
            .withColumn("reasons", reasons_column(record, top_k, min_points)))


def derive_model_input(requests: DataFrame) -> DataFrame:
    """Request fields -> model features: the spread and the borrower flag are derived here."""
    from loanloom.functions.typing import several_borrowers

    return (requests.withColumn("rate_spread", F.col("interest_rate") - F.col("reference_rate"))
            .withColumn("several_borrowers", several_borrowers(F.col("number_of_borrowers")))
            .withColumn("orig_term", F.col("term_months").cast("double"))
            .withColumn("credit_score", F.col("credit_score").cast("double")))


def request_violations() -> Column:
    """Names of the request fields outside their valid range; NULL is allowed everywhere."""
    bad = [F.when(~F.col(f).between(low, high) | F.isnan(F.col(f).cast("double")), f)
           for f, (low, high) in S.REQUEST_RANGES.items()]
    bad.append(F.when(~F.col("purpose").isin(*S.REQUEST_PURPOSES), "purpose"))
    return F.array_compact(F.array(*bad))


def validate_application(requests: DataFrame) -> DataFrame:
    """Requests with their violations; an empty list may be scored, the rest goes to quarantine."""
    return requests.withColumn("violations", request_violations()).withColumn("accepted", F.size("violations") == 0)


def outside_training_range(record: Mapping) -> Column:
    ranges = record.get("training_ranges", {})
    return F.array_compact(F.array(*[F.when(~F.col(f).between(low, high), f) for f, (low, high) in ranges.items()]))


def policy_decision(pd: Column, approve_below: float = S.POLICY["approve_below"],
                    decline_above: float = S.POLICY["decline_above"]) -> Column:
    """approve below the first line, decline above the second, refer otherwise; an invalid probability stops the job."""
    valid = (pd >= 0) & (pd <= 1)
    return (F.when(~F.coalesce(valid, F.lit(False)), F.raise_error(F.lit("a probability must be between 0 and 1")).cast("string"))
            .when(pd < approve_below, "approve").when(pd > decline_above, "decline").otherwise("refer"))
