from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidegauge.llm import clusters, queries


def brute(rows, k=8, rounds=10, scale=1024):
    """(vec_id, cluster, distance) of every vector in plain Python, and the centroids."""
    x = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(x, key=lambda r: (name(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v: min((distance(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        chosen = [nearest(v)[1] for _, v in x]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(x, chosen) if c == n]
            if mine:
                centroids[n] = [sum(column) // len(mine) for column in zip(*mine)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in x], centroids


def check(found, rows, **options):
    wanted, centroids = brute(rows, **options)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=key) == sorted(wanted, key=key)
    for r in found:
        assert r["cluster_inertia"] == sum(d for _, c, d in wanted if c == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d in wanted)
        text = ",".join(map(str, centroids[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.QUERIES["op12_clusters"](spark, sf).collect(), rows)


def test_bad_repeated_and_tied_rows_with_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(4))]) for i in range(120)]
    rows += rows[:7] + [(500, [0.5, 0.5, 0.5, 0.5])] * 60 + [(None, [1.0, 0.0, 0.0, -1.0])] * 2
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [float("nan")] * 4), (903, [float("-inf")] * 4), (904, [1.0] * 5), (905, [])]
    schema = "vec_id long, embedding array<float>, x int, cluster string, far int"
    df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows + bad], schema)
    check(clusters.cluster(df, size=4).collect(), rows)


def test_few_or_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters.cluster(make([])).collect() == []
    assert clusters.cluster(make([(1, None), (2, [1.0])])).collect() == []
    rows = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-0.5] * 64)]
    check(clusters.cluster(make(rows)).collect(), rows)


def test_entries_too_large_for_exact_distances_end_the_job(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="must not exceed"):
        clusters.cluster(df).collect()


def test_bounds_never_exceed_exact_distances():
    rng = np.random.default_rng(4)
    for spread in (3, 1000, clusters.MOST):
        x, centroids, pivots = (rng.integers(-spread, spread + 1, (n, 6)) for n in (400, 8, 8))
        x[:8], x[8:16] = centroids, pivots  # distances of nothing and exact Ptolemaic equalities
        assign = clusters.Assigner(centroids, pivots)
        bounds = clusters.lower_bounds(clusters.to_points(x, pivots), assign.centroid_far, assign.pivot_far, assign.pairs)
        exact = np.stack([clusters.exact_distance(x, c) for c in centroids], axis=1)
        assert np.all(bounds <= exact)
        chosen, least = assign(x, clusters.to_points(x, pivots))
        assert np.array_equal(least, exact.min(axis=1)) and np.array_equal(chosen, exact.argmin(axis=1))


def test_bounds_rule_centroids_out():
    rng = np.random.default_rng(6)
    centres = rng.integers(-100_000, 100_000, (8, 16))
    x = centres[rng.integers(0, 8, 500)] + rng.integers(-50, 50, (500, 16))
    assign = clusters.Assigner(centres, centres)
    bounds = clusters.lower_bounds(clusters.to_points(x, centres), assign.centroid_far, assign.pivot_far, assign.pairs)
    assert (bounds > assign(x, clusters.to_points(x, centres))[1][:, None]).mean() > 0.8
