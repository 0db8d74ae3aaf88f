import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from cases import documents, prose, texts
from loanloom.llm import mixing, quality


def labelled(spark, n=240):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        text = prose(rnd, rnd.randint(20, 90))
        good = i % 4 != 0
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "s"))
        labels.append((i, int(good), 0, "?"))
    rows += [(None, "text", "s"), (9000, None, "s"), (9001, "", "s"), (9001, "", "s")]
    labels += [(9000, None, 0, "?"), (None, 1, 0, "?"), (7777, 1, 0, "?")]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_documents_are_judged_well_and_teach_nothing(spark):
    rows, labels = labelled(spark)
    found = quality.score_quality(documents(spark, rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 240]
    assert len(held) > 20 and all(r.predicted == int(r.doc_id % 4 != 0) for r in held)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_quality(documents(spark, rows), turned).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in found)


def test_filter_keeps_columns_and_agrees_with_the_scores(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    kept = quality.keep_good(docs, labels)
    good = [r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted]
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, good))


def test_without_labels_everything_passes(spark):
    _, labels = labelled(spark)
    for some in (labels.filter("false"), labels.filter("quality = 1")):
        assert {r.predicted for r in quality.score_quality(documents(spark), some).collect()} == {1}
    assert quality.score_quality(documents(spark).filter("false"), labels).count() == 0


def test_fit_is_a_ranking_model():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 3))
    good = rng.random(4000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0])))
    model = quality.fit(x, good)
    w = np.array(model.weights)
    assert w[0] > 0.5 and w[1] < -0.2 and abs(w[2]) < 0.2
    assert abs((x @ w < model.threshold).mean() - (~good).mean()) < 0.01


def test_all_labelled_rows_teach(spark, monkeypatch):
    """Many groups, few good rows: sums over the groups and the threshold are those of all rows."""
    monkeypatch.setattr(quality, "GROUP", 50)
    rng = np.random.default_rng(5)
    n = 24_000
    x = rng.standard_normal((n, len(quality.FEATURES))).round(3)
    good = rng.random(n) < 1 / (1 + np.exp(3 - 2 * x[:, 0]))
    found = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "doc_id long, features array<double>").repartition(4)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    taught = np.array([crc32(str(i).encode()) % 5 != 0 for i in range(n)])
    rows = found.join(labels, "doc_id").filter(~quality.held_out()).select(quality.F.col("doc_id").alias("_key"), "features", (quality.F.col("quality") == 1).alias("good"))
    groups = quality.grouped(rows, int(taught.sum()), int((taught & good).sum())).collect()
    width = 8 * len(quality.FEATURES)
    assert len(groups) == taught.sum() // 50
    assert sum(len(g.worst) for g in groups) == width * (taught & ~good).sum() and sum(len(g.best) for g in groups) >= width * (taught & good).sum()
    assert all(len(g.best) for g in groups)
    model = quality.learn(found, labels)
    whole = quality.fit(x[taught], good[taught])
    assert np.abs(np.array(model.weights) - whole.weights).max() < 0.05
    w = np.zeros(x.shape[1])
    for v, weight in enumerate(model.weights):
        w[v] = weight
    assert model.threshold == pytest.approx(np.quantile(x[taught] @ w, (~good[taught]).mean(), method="midpoint"), abs=1e-9)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


def rows_of(n=1500):
    rnd = random.Random(6)
    out = texts()
    for i in range(n):
        source = rnd.choice(["hot", "hot", "b", "ß", "Z", None, "tiny"]) if i % 50 else "rare"
        out.append((10_000 + i, " ".join(["w"] * rnd.randint(0, 400 if source != "rare" else 20)), source))
    return out


@pytest.mark.parametrize("block", [mixing.BLOCK, 64])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = rows_of()
    found = mixing.mix(documents(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in found) == sorted((str(i), size(t)) for i, t, _ in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    goal = brute_targets(sizes)
    largest = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(largest[s], 0.02 * goal[s]), s
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted((str(r.doc_id), str(r.source), r["size"], r.copies) for r in found) == sorted((str(r.doc_id), str(r.source), r["size"], r.copies) for r in again)


def test_mixed_rows_repeat_as_drawn(spark):
    rows = rows_of(300)
    docs = documents(spark, rows)
    out = mixing.mixed(docs)
    copies = sum(r.copies for r in mixing.mix(docs).collect())
    assert out.columns == docs.columns and abs(out.count() - copies) <= 20


def test_flight_keeps_both_totals():
    rnd = random.Random(1)
    size, chance = [rnd.randint(1, 500) for _ in range(400)], [rnd.random() for _ in range(400)]
    totals = sum(chance), sum(p * s for p, s in zip(chance, size, strict=True))
    left = mixing.flight(size, chance, list(range(400)), random.Random(2))
    assert len(left) <= 2 and all(p in (0.0, 1.0) for k, p in enumerate(chance) if k not in left)
    assert (sum(chance), sum(p * s for p, s in zip(chance, size, strict=True))) == pytest.approx(totals, rel=1e-6)


def test_draws_follow_the_probabilities():
    chance = [0.2, 0.5, 0.7, 0.35, 0.6, 0.65, 0.4, 0.6]
    hits = np.zeros(8)
    for seed in range(3000):
        p, rng = list(chance), random.Random(seed)
        left = mixing.flight([5, 9, 3, 7, 7, 2, 8, 1], p, list(range(8)), rng)
        hits += [p[k] if k not in left else chance[k] * 0 + p[k] for k in range(8)]
    assert np.abs(hits / 3000 - chance).max() < 0.04


def test_no_words_no_targets(spark):
    found = mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.target, r["size"]) for r in found] == [(0.0, 0)] * 2
    assert mixing.mix(documents(spark).filter("false")).count() == 0
