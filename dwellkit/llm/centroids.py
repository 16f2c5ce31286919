"""Exact centroid clustering that rescans few vectors.

Each vector keeps its cluster and a lower bound on its distance to any other centroid. When
centroids move, the bound must fall by as much as the distance to a moved centroid can fall.
That is at most the centroid's drift, and less for vectors known to lie in a sphere around
their own centroid: the fall is the drift times the mean cosine of the angle at which the
vector is seen from the path, and in the plane of the path and the sphere's centre the
smallest such angle is known. A vector whose exact distance to its own centroid is below the
loosened bound stays without a look at the others; all others are scanned exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.columns import lookup
from dwellkit.llm.store import stored
from dwellkit.llm.vectors import matrix, whole_numbers

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Largest whole number that an entry may become: squared distances of 64 such entries fit 64 bits.
MOST = 1 << 27
#: The path of a centroid is cut into so many stretches.
STRETCHES = 16
#: What bounds must be apart to count, against rounding.
SLACK = 1e-9


def tight_drift(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """Most that the distance to a point moving from ``old`` to ``new`` falls, over the sphere.

    The distance falls at the rate of the cosine between the direction of travel and the
    direction to the vector, which shrinks along the way; so its value at the start of a
    stretch bounds the stretch. Never more than the drift; below zero where the path leads
    away from the whole sphere.
    """
    path = new - old
    drift = float(np.sqrt(path @ path))
    if drift == 0.0:
        return 0.0
    to_centre = centre - old
    along = float(to_centre @ path) / drift
    aside = float(np.sqrt(max(to_centre @ to_centre - along * along, 0.0)))
    ahead = along - drift * np.arange(STRETCHES) / STRETCHES
    far = np.hypot(ahead, aside)
    outside = far > radius
    half = np.arcsin(np.divide(radius, far, out=np.ones_like(far), where=outside))
    angle = np.where(outside, np.maximum(np.arctan2(aside, ahead) - half, 0.0), 0.0)
    return drift * float(np.cos(angle).mean())


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, the most that any other centroid's distance falls within its sphere."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    return np.array(
        [
            max((tight_drift(old[i], radius[i], old[j], new[j]) for j in range(len(old)) if j != i), default=0.0)
            for i in range(len(old))
        ]
    )


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 1 << 52:  # whole numbers that doubles hold exactly
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _scan(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre, the smaller number on ties; its squared distance; distance of the next."""
    d = _squares(x, centres)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    nearest = d[rows, best]
    if len(centres) == 1:
        return best, nearest, np.full(len(x), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    return best, nearest, np.sqrt(d.min(axis=1).astype(np.float64))


def _step(centres: np.ndarray, loose: np.ndarray | None, keep_vectors: bool) -> Callable:
    """Assign a batch; ``loose`` is None where nothing is known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = np.sqrt(_squares(centres, centres).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        gap = gaps.min(axis=1)
        for batch in batches:
            x = matrix(batch.column("x"), centres.shape[1])
            n = len(x)
            if loose is None:
                cluster, distance, lower = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
                unsure = np.ones(n, bool)
            else:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                distance = ((x - centres[cluster]) ** 2).sum(axis=1)
                own = np.sqrt(distance.astype(np.float64))
                lower = batch.column("lower").to_numpy(zero_copy_only=False) - loose[cluster]
                lower = np.maximum(lower, gap[cluster] - own)
                slack = SLACK * (1 + own + np.abs(np.where(np.isfinite(lower), lower, 0.0)))
                unsure = ~(own + slack < lower)
            if unsure.any():
                cluster[unsure], distance[unsure], lower[unsure] = _scan(x[unsure], centres)
            names = [c for c in ("id", "carried") if c in batch.schema.names] + (["x"] if keep_vectors else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(cluster, pa.int32()),
                    pa.array(distance, pa.int64()),
                    pa.array(lower, pa.float64()),
                    pa.array(unsure, pa.bool_()),
                ],
                names=[*names, "cluster", "distance", "lower", "scanned"],
            )

    return run


def _sums(clusters: int, dimensions: int) -> Callable:
    """Sums of each cluster's vectors, their number and the farthest one, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, far = np.zeros((clusters, dimensions), np.int64), [0] * clusters, [0] * clusters
        for batch in batches:
            x = matrix(batch.column("x"), dimensions)
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            distance = batch.column("distance").to_numpy(zero_copy_only=False)
            for c in np.unique(cluster):
                mine = cluster == c
                sums[c] += x[mine].sum(axis=0)
                n[c] += int(mine.sum())
                far[c] = max(far[c], int(distance[mine].max()))
        seen = [c for c in range(clusters) if n[c]]
        columns = list(zip(*[(c, d, int(sums[c, d]), n[c], far[c]) for c in seen for d in range(dimensions)]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns or [()] * 5, kinds)], names=["cluster", "dim", "total", "n", "far"]
        )

    return run


def _moved(state: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after their vectors' floored means, empty ones as they were, and the radius
    of each cluster around its old centroid. clusters x dimensions numbers come to the driver."""
    totals = (
        state.select("x", "cluster", "distance")
        .mapInArrow(_sums(*centres.shape), "cluster int, dim int, total long, n long, far long")
        .groupBy("cluster", "dim")
        .agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
            F.sum("n").alias("n"),
            F.max("far").alias("far"),
        )
        .collect()
    )
    new, radius = centres.copy(), np.zeros(len(centres))
    for r in totals:
        new[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        radius[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + SLACK)
    return new, radius


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dimensions: int = DIMENSIONS,
    seed: str = "1",
    carry: str | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, lower, scanned) for each row with a whole vector, and the centroids.

    Entries c become floor(scale * c). Centroids start as the vectors with the smallest
    sha256 of ``seed:id``; each round assigns all vectors to the nearest centroid (ties: the
    smaller number) and moves non-empty centroids to the floored mean; vectors are assigned
    once more at the end. distance is squared and exact, lower bounds the distance to any
    other centroid, scanned tells whether the last assignment looked at all centroids.

    Rows go whose vector is null, has another number of entries, or a null or non-finite
    one. Fewer rows than clusters give fewer centroids, an empty table none and no row.
    Repeated rows are rows of their own and may start as equal centroids, of which the
    larger number then stays empty. A null id counts as empty text in the hash; equal hashes
    are ordered by vector. An entry beyond 2^27 / scale is an error. Only the named columns
    are read, whatever the others are called.

    Vectors never move between tasks: a round is one pass that writes the next state to the
    shared folder, and one grouped sum. Many equal vectors are rows like any others.
    """
    rows = whole_numbers(df, id_col, vector_col, dimensions, scale, MOST, carry)
    rows = rows.withColumn("x", F.col("x").cast("array<int>"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = rows.select("x", key.alias("start_key")).orderBy("start_key", "x").limit(clusters).collect()
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "x")
    result = "cluster int, distance long, lower double, scanned boolean"
    if not start:
        centres = np.zeros((0, dimensions), np.int64)
        state = rows.limit(0).selectExpr(
            *[c for c in rows.columns if c != "x"],
            "0 AS cluster",
            "0L AS distance",
            "0D AS lower",
            "false AS scanned",
        )
        return _named(state, id_col, carry), centres
    centres = np.array([r["x"] for r in start], np.int64)
    state, loose = rows, None
    for _ in range(rounds):
        state = stored(
            state.mapInArrow(_step(centres, loose, True), f"{kinds}x array<int>, {result}"), "clusters"
        )
        new, radius = _moved(state, centres)
        loose, centres = loosening(centres, new, radius), new
    out = stored(state.mapInArrow(_step(centres, loose, False), f"{kinds}{result}"), "clusters")
    return _named(out, id_col, carry), centres


def _named(state: DataFrame, id_col: str, carry: str | None) -> DataFrame:
    kept = [F.col("id").alias(id_col)] + ([F.col("carried").alias(carry)] if carry else [])
    return state.select(*kept, "cluster", "distance", "lower", "scanned")


def with_inertia(assigned: DataFrame, n_clusters: int) -> DataFrame:
    """Adds the sum of squared distances of each row's cluster, and of all rows. One number
    for each cluster comes to the driver."""
    sums = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    if not sums:
        return assigned.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long")})
    own = lookup(F.col("cluster"), [int(sums.get(c, 0)) for c in range(n_clusters)])
    return assigned.withColumns(
        {"cluster_inertia": own.cast("long"), "inertia": F.lit(sum(sums.values())).cast("long")}
    )
