"""Whitening, mixing and clustering against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellkit.llm import centroids, mixing, whitening
from dwellkit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, [], [1.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [None, 0.0, 0.0], [0.0] * 4]


def vector_rows(n=400, seed=5):
    """Vectors with copies, a hot one, and others that differ below the scale."""
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1), rng.gauss(0, 0.5), rng.gauss(1, 0.1)] for _ in range(n // 2)]
    rows = base + [list(base[i % 40]) for i in range(n // 4)] + [list(base[0])] * (n // 4)
    return [[v + 1e-9 if i % 7 == 0 else v for v in r] for i, r in enumerate(rows)]


def frame(spark, vectors):
    """Extra columns have the names that the operators use inside."""
    rows = [(i if i % 50 else None, v, "x", 1, "y") for i, v in enumerate(vectors)]
    names = "vec_id long, embedding array<double>, x string, cluster int, total string"
    return spark.createDataFrame(rows, names)


# Whitening


def slow_whiten(vectors, scale, components, by_count):
    x = [tuple(math.floor(scale * c) for c in v) for v in vectors]
    times = Counter(x)
    fit = sorted(times)
    w = [times[v] if by_count else 1 for v in fit]
    n, d = sum(w), len(fit[0])
    s = [sum(a * v[i] for a, v in zip(w, fit)) for i in range(d)]
    centred = np.array(fit, float) - np.array([a / n for a in s])
    cov = (centred * np.array(w)[:, None]).T @ centred / n
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    axes = vectors_[:, order] / np.sqrt(values[order])
    y = (np.array(x, float) - np.array([a / n for a in s])) @ axes
    deviation = [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in x]
    return n, deviation, y, values[order] / values.sum()


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_brute_force(spark, weights):
    vectors = vector_rows()
    df = frame(spark, vectors + ODD).withColumn("place", F.monotonically_increasing_id())
    df = df.repartition(5).withColumn("keep", F.struct("place", "embedding"))
    got = whitening.whiten(df, components=3, scale=256, dimensions=3, weights=weights, carry="keep").collect()
    got = sorted(got, key=lambda r: r.keep.place)
    n, deviation, y, explained = slow_whiten([r.keep.embedding for r in got], 256, 3, weights == "count")
    assert len(got) == len(vectors) and {r.n for r in got} == {n}
    assert [int(r.deviation) for r in got] == deviation
    mine = np.array([r.whitened for r in got])
    signs = np.sign((mine * y).sum(axis=0))
    assert np.allclose(mine, y * signs, atol=1e-9)
    assert np.allclose(got[0].explained, explained, rtol=1e-9)
    assert 0 <= got[0].identity_error < 1e-9


def test_whitened_query_on_the_table(spark):
    rows = QUERIES["op11_weighted_whitening"](spark, SF).collect()
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(table)
    n, deviation, y, explained = slow_whiten([table[i] for i in ids], 256, 4, False)
    by_key = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by_key) == 4 * len(ids)
    mine = np.array([[by_key[i, c].whitened for c in range(1, 5)] for i in ids])
    assert np.allclose(np.abs(mine), np.abs(y), atol=1e-6)
    assert [by_key[i, 1].deviation for i in ids] == deviation and rows[0].n == n
    assert np.allclose([by_key[ids[0], c].explained for c in range(1, 5)], explained, rtol=1e-9)
    centred = mine - mine.mean(axis=0)
    assert np.abs(centred.T @ centred / n - np.eye(4)).max() < 1e-9


def test_no_vectors_flat_directions_and_far_entries(spark):
    df = frame(spark, ODD)
    empty = whitening.whiten(df, dimensions=3)
    assert empty.collect() == []
    full = whitening.whiten(frame(spark, [[1.0, 2.0, 3.0]]), dimensions=3)
    assert full.dtypes == empty.dtypes
    one = full.first()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [None] * 3, [0.0] * 3, 0.0)
    line = whitening.whiten(frame(spark, [[float(i), 0.0, 5.0] for i in range(9)] * 2), dimensions=3).collect()
    assert {r.n for r in line} == {9} and len(line) == 18
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in line)
    assert line[0].explained[0] == pytest.approx(1) and line[0].identity_error < 1e-9
    with pytest.raises(Exception, match="an entry beyond"):
        whitening.whiten(frame(spark, [[1e300, 0.0, 0.0]]), dimensions=3).collect()
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="none")


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 39, -(1 << 39)], [3, 4]], np.int64)
    sums = [(1 << 39) + 3, 4 - (1 << 39)]
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 2, sums) == want


# Mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def documents(spark, n=3000):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice([None, "", "é", "Z", "a", "\U0001f600", "￿", "void"])
        words = [] if source == "void" else ["w"] * rng.choice([1, 5, 20, 60])
        text = None if i % 97 == 0 else rng.choice([" ", "\n", "\t\x0b"]).join(words)
        rows.append((i if i % 31 else None, text, source, 7, "s", 0.5))
    rows += [rows[5]] * 4 + [(n, "long " * 300_000, "huge", 1, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, size int, source_key string, draw double"
    )


def test_mix_equals_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    target = slow_targets(sizes)
    sized = mixing.sized(docs)
    plan = mixing.planned(sized, mixing.source_targets(sized)).collect()
    assert len(plan) == len(rows)
    taken = defaultdict(int)
    for r in plan:
        source = None if r.no_source else r.source_key
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source], rel=1e-12)
        rate = target[source] / sizes[source] if sizes[source] else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate) <= 2
        taken[source] += r.copies * r.size
    assert any(target[s] == 2 * sizes[s] for s in sizes) and target['huge'] > 1.3 * sizes['huge']
    near = [s for s in sizes if sizes[s] and s != "huge"]
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in near)
    again = mixing.planned(sized, mixing.source_targets(sized)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


def test_emitted_copies(spark):
    docs = documents(spark, 600)
    sized = mixing.sized(docs)
    plan = mixing.planned(sized, mixing.source_targets(sized))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    told = Counter((r.doc_id, r.size) for r in out.collect())
    assert max(told.values()) >= 2 and {s for _, s in told} <= {1, 7}


def test_limits_of_the_mix(spark):
    docs = documents(spark, 300)
    sized = mixing.sized(docs)
    for share, most in ((9.0, 2.0), (0.25, 2.0), (1.5, 1.5)):
        sizes = {(None if r.no_source else r.source_key): r.source_size for r in mixing.source_targets(sized).collect()}
        got = {
            (None if r.no_source else r.source_key): r.target
            for r in mixing.source_targets(sized, share=share, most=most).collect()
        }
        assert got == pytest.approx(slow_targets(sizes, share=share, most=most))
    empty = docs.limit(0)
    assert mixing.mixed(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    plan = mixing.planned(mixing.sized(blank), mixing.source_targets(mixing.sized(blank))).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in plan] == [(0, 0, 0.0, 0)] * 2


def test_places_of_many_sources(spark):
    names = [f"s{i * 7919 % 5000:05d}" for i in range(5000)]
    rows = spark.createDataFrame([(s, False, 1) for s in names] + [("", True, 1)], "source_key string, no_source boolean, size int")
    ranked = mixing._ranked(rows.repartition(7)).collect()
    assert [r.source_key for r in sorted(ranked, key=lambda r: r.place)] == [*sorted(names), ""]
    assert sorted(r.place for r in ranked) == list(range(5001))


# Clustering


def slow_cluster(ids, vectors, k, rounds, scale):
    x = [[math.floor(scale * c) for c in v] for v in vectors]
    key = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i in ids]
    centres = [x[j] for j in sorted(range(len(x)), key=lambda j: (key[j], x[j]))[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for v in x]
        for c in range(len(centres)):
            mine = [v for v, o in zip(x, own) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [nearest(v) for v in x], centres


@pytest.mark.parametrize("k,scale", [(1, 64), (5, 64), (12, 2)])
def test_clusters_equal_brute_force(spark, k, scale):
    vectors = vector_rows(600)
    df = frame(spark, vectors + ODD).withColumn("place", F.monotonically_increasing_id()).repartition(6)
    got, centres = centroids.cluster(df, clusters=k, rounds=4, scale=scale, dimensions=3, carry="place")
    got = sorted(got.collect(), key=lambda r: r.place)
    want, final = slow_cluster([r.vec_id for r in got], vectors, k, 4, scale)
    assert centres.tolist() == final
    assert [(r.cluster, r.distance) for r in got] == want
    assert any(not r.scanned for r in got)


def test_fewer_vectors_than_clusters_and_none(spark):
    got, centres = centroids.cluster(frame(spark, [[1.0, 2.0, 3.0]] * 3), clusters=5, dimensions=3)
    assert len(centres) == 3 and {(r.cluster, r.distance) for r in got.collect()} == {(0, 0)}
    nothing, centres = centroids.cluster(frame(spark, ODD), dimensions=3)
    assert nothing.collect() == [] and len(centres) == 0 and nothing.columns == got.columns
    assert centroids.with_inertia(nothing, 0).collect() == []
    sums = centroids.with_inertia(spark.createDataFrame([(0, 5), (0, 1), (2, 4)], "cluster int, distance long"), 3)
    assert sorted((r.cluster, r.cluster_inertia, r.inertia) for r in sums.collect()) == [(0, 6, 10), (0, 6, 10), (2, 4, 10)]
    with pytest.raises(Exception, match="an entry beyond"):
        centroids.cluster(frame(spark, [[1e30, 0.0, 0.0]]), dimensions=3)


def test_drift_is_bounded_and_tighter():
    rng = np.random.default_rng(3)
    tighter = 0
    for _ in range(300):
        d = int(rng.integers(2, 9))
        centre, old = rng.normal(size=d), 3 * rng.normal(size=d)
        new = old + rng.normal(size=d) * rng.choice([0.0, 0.1, 1.0, 4.0])
        radius = float(rng.choice([0.0, 0.3, 1.0, 5.0]))
        points = rng.normal(size=(400, d))
        points = centre + radius * points / np.linalg.norm(points, axis=1)[:, None]
        fall = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        bound, drift = centroids.tight_drift(centre, radius, old, new), np.linalg.norm(new - old)
        assert fall.max() <= bound + 1e-9 <= drift + 2e-9
        tighter += bound < 0.9 * drift
    assert tighter > 100


def test_exact_distances_of_far_vectors():
    x = np.array([[1 << 27, -(1 << 27)], [5, 7]], np.int64)
    centres = np.array([[-(1 << 27), 1 << 27], [5, 8]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centres] for v in x]
    assert centroids._squares(x, centres).tolist() == want
