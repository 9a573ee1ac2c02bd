"""Scaler, sequences, splits, evaluation and models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.ordered import forward_fill, order_breaks, running_totals
from tidegauge.operators import evaluate, prep
from tidegauge.operators.models import ensemble
from tidegauge.operators.models.boundary import fit_boundary
from tidegauge.operators.models.forest import fit_forest, sample_for_trees
from tidegauge.operators.models.recon import fit_reconstruction
from tidegauge.plans import jobs

KEY = "src_ip string, dst_ip string, protocol string, window_size int, window_start bigint"


def vectors(spark, flows: dict[str, list[list[float]]]):
    rows = [
        (src, "b", "modbus", 60, 60 * i, [float(x) for x in v])
        for src, series in flows.items() for i, v in enumerate(series)
    ]
    return spark.createDataFrame(rows, KEY + ", scaled array<double>")


def test_scaler(spark):
    frame = spark.createDataFrame([(1.0, 100.0), (2.0, 200.0), (3.0, 300.0)], "a double, b double")
    scaler = prep.fit_scaler(frame)
    assert scaler.names == ("a", "b") and scaler.means == (2.0, 200.0)
    got = np.array([r.scaled for r in prep.scale(frame, scaler).collect()])
    assert np.allclose(got.mean(axis=0), 0) and np.allclose(got.std(axis=0), 1)
    restored = prep.inverse_scale(prep.scale(frame, scaler), scaler).collect()
    assert all(np.allclose(r.restored, [r.a, r.b]) for r in restored)


def test_scaler_constant_missing_and_unfitted(spark, folder):
    frame = spark.createDataFrame([(3.0, None), (3.0, 6.0)], "c double, m double")
    scaler = prep.fit_scaler(frame)
    assert scaler.stats() == {"c": (3.0, 1.0), "m": (3.0, 3.0)}
    prep.save_scaler(spark, scaler, folder + "/scaler")
    assert prep.load_scaler(spark, folder + "/scaler") == scaler
    with pytest.raises(RuntimeError):
        prep.scale(frame, None)
    clipped = prep.scale(spark.createDataFrame([(900.0, 3.0)], "c double, m double"), scaler, 5.0).first()
    assert clipped.scaled == [5.0, 0.0]


def test_feature_names(spark):
    frame = spark.createDataFrame([("a", "b", "modbus", 60, 0, 60, 3, "x")],
                                  KEY + ", window_size_seconds int, message_count int, label string")
    assert prep.feature_names(frame) == ["message_count", "window_size_seconds"]
    aligned = prep.align_features(frame, ["zzz", "message_count"]).first()
    assert aligned.features == [0.0, 3.0]


def test_sequences(spark):
    frame = vectors(spark, {"a": [[1, 1], [2, 2], [3, 3]], "c": [[9, 9]]})
    got = {(r.src_ip, r.window_start): r.sequence for r in prep.rolling_sequences(frame, 3).collect()}
    assert got["a", 120] == [[1, 1], [2, 2], [3, 3]]
    assert got["c", 0] == [[0, 0], [0, 0], [9, 9]]
    unpadded = prep.rolling_sequences(frame, 3, pad=False).collect()
    assert [(r.src_ip, r.window_start) for r in unpadded] == [("a", 120)]
    long = prep.rolling_sequences(vectors(spark, {"a": [[7, 8]]}), 5).first().sequence
    assert long == [[0, 0]] * 4 + [[7, 8]]


def test_training_sequences_and_stats(spark):
    frame = vectors(spark, {"a": [[i] for i in range(6)], "c": [[9]]})
    got = sorted((r.src_ip, r.window_start) for r in prep.training_sequences(frame, 3, 2).collect())
    assert got == [("a", 120), ("a", 240), ("c", 0)]
    stats = prep.sequence_stats(frame, 3).first()
    assert tuple(stats) == (2, 1, 2.0, 3)
    assert prep.prune_short(frame, 2).select("src_ip").distinct().collect()[0][0] == "a"


def test_splits(spark):
    frame = vectors(spark, {"a": [[i] for i in range(100)], "c": [[i] for i in range(100)]})
    train, held = prep.random_split(frame, 0.2, seed=5)
    assert train.count() + held.count() == 200 and 20 <= held.count() <= 60
    parts = prep.temporal_split(frame).groupBy("part").count().collect()
    assert {r[0]: r[1] for r in parts} == {"train": 140, "validation": 40, "test": 20}
    odd = prep.temporal_split(frame.limit(0).unionByName(vectors(spark, {"a": [[i] for i in range(7)]})))
    assert {r[0]: r[1] for r in odd.groupBy("part").count().collect()} == {"train": 4, "validation": 2, "test": 1}


def test_running_totals_match_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x), int(rng.integers(0, 5))) for g in "ab" for x in rng.permutation(500)]
    frame = spark.createDataFrame(rows, "g string, x double, n int")
    got = {(r.g, r.x): r.running_n for r in running_totals(frame, "x", ["n"], by=["g"], pieces=7).collect()}
    for g in "ab":
        total = 0
        for _, x, n in sorted(r for r in rows if r[0] == g):
            total += n
            assert got[g, x] == total


def test_forward_fill_and_order_breaks(spark):
    values = [None, 1.0, None, None, 4.0, None, None, None, None, 9.0, None]
    frame = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "g string, t int, v double")
    filled = [r.v for r in forward_fill(frame, ["v"], ["g"], "t", 3).orderBy("t").collect()]
    assert filled == [None, 1, 1, 1, 4, 4, 4, 4, 4, 9, 9]
    steps = spark.createDataFrame([("s", i, v) for i, v in enumerate([1, 5, 4, 6, 2, 2, 7])], "g string, t int, v int")
    assert order_breaks(steps, "v", ["g"], "t", 2).first().order_breaks == 2


def test_labelled_metrics_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    got = evaluate.labelled_metrics(
        spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int"), "s", "y"
    ).first()
    wins = sum((p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0])
    assert got.roc_auc == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()))
    best = max(
        (2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + (y == 1).sum()), -t) for t in np.unique(s)
    )
    assert got.optimal_threshold == pytest.approx(-best[1]) and got.f1 == pytest.approx(best[0], abs=1e-6)
    assert got.score_p95 == pytest.approx(np.percentile(s, 95))


def test_ks_statistic_against_brute_force(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 300), rng.normal(0.5, 1, 200)
    one = spark.createDataFrame([(float(x), 1.0) for x in a], "u double, v double")
    two = spark.createDataFrame([(float(x), 1.0) for x in b], "u double, v double")
    got = {r.feature: r for r in evaluate.ks_drift(one, two, ["u", "v"]).collect()}
    points = np.concatenate([a, b])
    expected = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert got["u"].ks_statistic == pytest.approx(expected) and got["u"].drift_detected
    assert got["v"].ks_statistic == 0 and got["v"].p_value == 1 and not got["v"].drift_detected


def cloud(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 1, (n, 4)).tolist() + [[12.0, -12.0, 12.0, 12.0]]
    return vectors(spark, {"a": rows})


def test_forest_finds_the_outlier(spark, folder):
    frame = cloud(spark)
    model = fit_forest(frame, trees=25, sample=64, seed=1)
    scores = {r.window_start: r.s for r in frame.select("window_start", model.score(F.col("scaled")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert max(scores, key=scores.get) == 400 * 60
    assert model.nodes.groupby("tree").size().max() <= 2 * 64 - 1
    model.save(spark, folder + "/forest")
    again = type(model).load(spark, folder + "/forest")
    assert again.nodes.equals(model.nodes.astype(again.nodes.dtypes.to_dict()))
    assert fit_forest(frame, trees=25, sample=64, seed=1).nodes.equals(model.nodes)


def test_forest_samples_are_bounded(spark):
    frame = spark.range(20000).select(
        F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit("m").alias("protocol"),
        F.lit(60).alias("window_size"), F.col("id").alias("window_start"), F.array(F.rand(1)).alias("scaled"),
    )
    sizes = [r["count"] for r in sample_for_trees(frame, 20, 64).groupBy("tree").count().collect()]
    assert len(sizes) == 20 and max(sizes) == 64 and min(sizes) > 40


def test_boundary_scores_the_outlier_highest(spark, folder):
    frame = cloud(spark)
    model = fit_boundary(frame, width=64, steps=10, seed=1)
    scored = frame.select("window_start", model.score(F.col("scaled")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scored)
    far = next(r.s for r in scored if r.window_start == 400 * 60)
    assert far > np.median([r.s for r in scored])
    model.save(spark, folder + "/boundary")
    again = type(model).load(spark, folder + "/boundary")
    assert np.allclose(again.decision(np.ones((1, 4))), model.decision(np.ones((1, 4))))


def test_reconstruction(spark, folder):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 1, (300, 1))
    usual = base @ np.array([[1.0, 2.0, -1.0]]) + rng.normal(0, 0.05, (300, 3))
    frame = prep.rolling_sequences(vectors(spark, {"a": [*usual.tolist(), [5.0, -9.0, 5.0]]}), 2)
    model = fit_reconstruction(frame.filter(F.col("window_start") < 300 * 60), components=2)
    scored = [r.s for r in frame.orderBy("window_start").select(model.score(F.col("sequence")).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scored) and int(np.argmax(scored)) == 300
    model.save(spark, folder + "/recon")
    assert np.allclose(type(model).load(spark, folder + "/recon").components, model.components)


def test_ensemble(spark):
    frame = spark.createDataFrame([(0.2, 0.4, 0.6), (0.2, None, None), (None, None, None)], "a double, b double, c double")
    scores = {"isolation_forest": F.col("a"), "lstm_autoencoder": F.col("b"), "one_class_svm": F.col("c")}
    rows = frame.select(
        ensemble.ensemble_score(scores).alias("e"), ensemble.confidence(scores).alias("c"),
        ensemble.model_scores(scores).alias("m"),
    ).collect()
    assert rows[0].e == pytest.approx(0.3 * 0.2 + 0.5 * 0.4 + 0.2 * 0.6)
    assert rows[1].e == pytest.approx(0.2) and rows[1].c == 1
    assert (rows[2].e, rows[2].c, rows[2].m) == (None, None, [])
    assert [m.model_name for m in rows[0].m] == list(scores)


def test_train_score_and_reload(spark, folder):
    rng = np.random.default_rng(7)
    rows = [("a", "b", "modbus", 60, 60 * i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(5, 1, (200, 2)))]
    frame = spark.createDataFrame(rows, KEY + ", bytes_mean double, iat_mean double")
    artifacts, figures = jobs.train(frame, seed=2, trees=10, steps=3, sequence_length=3)
    assert set(figures.columns) == {f"{m}_{k}_score" for m in jobs.MODELS for k in ("mean", "std")}
    scored = jobs.score_features(frame, artifacts)
    row = scored.agg(F.min("ensemble_score"), F.max("ensemble_score"), F.min("confidence"), F.count("*")).first()
    assert 0 <= row[0] <= row[1] <= 1 and 0 <= row[2] and row[3] == 200
    artifacts.save(spark, folder)
    again = jobs.Artifacts.load(spark, folder, 3)
    both = scored.select("window_start", F.col("ensemble_score").alias("x")).join(
        jobs.score_features(frame, again).select("window_start", F.col("ensemble_score").alias("y")), "window_start"
    )
    assert both.filter(F.abs(F.col("x") - F.col("y")) > 1e-9).count() == 0


def test_boundary_follows_its_plain_steps(spark):
    """Against the same steps in one process; rows of all tasks take part."""
    from tidegauge.operators.models import boundary

    x = np.random.default_rng(3).normal(0, 1, (3000, 5)) * [1, 2, 1, 1, 3]
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "scaled array<double>").repartition(7)
    model = fit_boundary(frame, nu=0.2, width=32, steps=6, seed=4)
    z = boundary._lift(x, model.directions, model.phases)
    weights = z.mean(axis=0)
    offset = 0.5 * weights @ weights
    for step in range(1, 7):
        bad, rate = z @ weights < offset, 1 / (step + 1)
        weights = weights - rate * (weights - z[bad].sum(axis=0) / (0.2 * len(x)))
        offset = offset - rate * (bad.sum() / (0.2 * len(x)) - 1) * float(weights @ weights)
    assert np.allclose(model.weights, weights) and np.isclose(model.offset, offset)
    assert np.isclose(model.spread, (z @ weights).std())
    scores = [r.s for r in frame.select(model.score(F.col("scaled")).alias("s")).collect()]
    assert np.allclose(sorted(scores), sorted(1 / (1 + np.exp(((z @ weights) - offset) / model.spread))))


def test_boundary_reads_vectors_in_place():
    """A batch is a view of Arrow's buffer, also where it starts inside it: no object a vector."""
    import pyarrow as pa

    from tidegauge.operators.models import boundary

    batch = pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]])
    found = boundary._matrix(batch.slice(1))
    assert found.tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert np.shares_memory(found, batch.values.to_numpy())


def test_boundary_refuses_vectors_it_cannot_stack(spark):
    for rows in ([[1.0, 2.0], None], [[1.0, 2.0], [1.0]]):
        frame = spark.createDataFrame([(r,) for r in rows], "scaled array<double>").coalesce(1)
        with pytest.raises(Exception, match="one length"):
            fit_boundary(frame, width=8, steps=2)
