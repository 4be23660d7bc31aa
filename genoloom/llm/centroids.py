"""Centroid clustering (k-means) on integer vectors, with geometric drift tightening.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of the distance to all others.
When the centroids have moved, the lower bounds of a cluster are loosened only by what a moved centroid can have gained on
some point of the cluster's sphere: sphere, old and new centroid lie in a plane, and the gain is the move times the cosine of
the angle under which the move runs towards the sphere. Vectors whose bounds no longer tell are scanned exactly, in integers.
Sums change by the vectors that changed their cluster, so a round reads only those. State lies in one table a round in the
shared folder; the driver holds the centroids (a fixed number), never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.session import drop_materialized, materialize

LARGEST = 2**27  # components below this size have squared distances in 64 bits
_EXACT = 2**20  # below this size they are exact in doubles too
_STEPS = 8


def geometric_drift(old: np.ndarray, new: np.ndarray, radius: np.ndarray, steps: int = _STEPS) -> np.ndarray:
    """(i, j): the most by which centroid j can have come nearer, from old to new, to a point within radius[i] of old[i].

    Along the move, the distance to a point shrinks at the rate of the cosine of the angle between the move and the
    direction to the point. The least such angle over a sphere is that of its tangent on the move's side, and it grows on
    the way; so the mean over ``steps`` places, each taken at the start of its stretch, bounds the gain from above. Spheres
    that the move's line touches are given the full drift. Negative values are points that the centroid left behind.
    """
    move = new - old
    drift = np.sqrt((move**2).sum(axis=1))
    out = np.repeat(drift[None, :], len(old), axis=0)
    for j in np.flatnonzero(drift > 0):
        to = old - old[j]
        along = to @ (move[j] / drift[j])
        aside = np.sqrt(np.maximum(0.0, (to**2).sum(axis=1) - along**2))
        r = radius * (1 + 1e-9) + 1e-6
        clear = aside > r * (1 + 1e-6) + 1e-6
        h = along[:, None] - drift[j] * (np.arange(steps) / steps)[None, :]
        far = h**2 + aside[:, None] ** 2
        with np.errstate(invalid="ignore", divide="ignore"):
            tangent = np.sqrt(np.maximum(0.0, far - r[:, None] ** 2))
            gain = drift[j] * ((h * tangent + aside[:, None] * r[:, None]) / far).mean(axis=1)
        out[clear, j] = np.minimum(drift[j], gain[clear] + 1e-6)
    return out


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vector, centroid) squared distances of integer vectors, exact."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT and v.shape[1] <= 1024:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return np.rint((x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((v.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids.astype(np.int64)], axis=1)


class Tighten:
    """One round's assignment of a batch, from the bounds that the rounds before left."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None, radius: np.ndarray | None = None):
        self.now, self.first = centroids, before is None
        k, c = len(centroids), centroids.astype(np.float64)
        apart = np.sqrt(squared_distances(centroids, centroids)) + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.half = apart.min(axis=1) / 2
        if before is not None:
            old = before.astype(np.float64)
            self.drift = np.sqrt(((c - old) ** 2).sum(axis=1))
            gain = geometric_drift(old, c, radius)
            np.fill_diagonal(gain, -np.inf)
            self.loosen = gain.max(axis=1)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower, how many were scanned). Ties go to the smaller number."""
        if self.first:
            todo = np.arange(len(v))
            cluster, upper, lower = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
        else:
            upper, lower, cluster = upper + self.drift[cluster], lower - self.loosen[cluster], cluster.copy()
            sure = np.maximum(lower, self.half[cluster])
            todo = np.flatnonzero(~(upper * (1 + 1e-9) + 1e-6 < sure))
        if len(todo):
            d = squared_distances(v[todo], self.now)
            near = d.argmin(axis=1)
            own = np.take_along_axis(d, near[:, None], 1)
            cluster[todo], upper[todo] = near, np.sqrt(own[:, 0])
            np.put_along_axis(d, near[:, None], np.iinfo(np.int64).max, 1)
            lower[todo] = np.sqrt(d.min(axis=1).astype(np.float64)) if d.shape[1] > 1 else np.inf
        return cluster, upper, lower, len(todo)


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def integer_vectors(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of every vector with exactly ``dim`` components, none null or non-finite; others go."""
    x = F.col(vector_col).cast("array<double>")
    fine = (F.size(x) == dim) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    most = float(LARGEST) / scale
    told = F.raise_error(F.lit(f"a component is not below {most:g} in size: squared distances would pass 64 bits"))
    whole = F.when(F.forall(x, lambda y: F.abs(y) < most), F.transform(x, lambda y: F.floor(y * scale).cast("int"))).otherwise(told.cast("array<int>"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))


def _round(state: DataFrame, dim: int, step: Tighten, last: bool) -> DataFrame:
    """The table (id, v, cluster, was, upper, lower) after one assignment; after the last one (id, cluster, distance), the distances exact."""
    fields = [state.schema["id"], state.schema["v"], *(T.StructField(c, T.IntegerType()) for c in ("cluster", "was")), *(T.StructField(c, T.DoubleType()) for c in ("upper", "lower"))]
    if last:
        fields = [fields[0], fields[2], T.StructField("distance", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            was = np.full(b.num_rows, -1, np.int32) if step.first else b.column("cluster").to_numpy()
            bounds = (None, None) if step.first else (b.column("upper").to_numpy(), b.column("lower").to_numpy())
            v = _flat(b.column("v"), dim)
            cluster, upper, lower, _ = step.assign(v, was, *bounds)
            if last:
                d = ((v.astype(np.int64) - step.now[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], names=[f.name for f in fields])
                continue
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)], names=[f.name for f in fields])

    return state.mapInArrow(run, T.StructType(fields))


def _moved(state: DataFrame, dim: int, k: int) -> tuple[list[int], list[list[int]]]:
    """What this round's changes of cluster add to each cluster's count and sums; a row for each task and cluster leaves Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            v = _flat(b.column("v"), dim).astype(np.int64)
            for column, sign in (("cluster", 1), ("was", -1)):
                of = b.column(column).to_numpy()
                for c in np.unique(of[of >= 0]):
                    rows = of == c
                    n[c] += sign * int(rows.sum())
                    sums[c] += sign * v[rows].sum(axis=0)
        some = np.flatnonzero(n.astype(bool) | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, n long, sums array<long>")
    flat = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    for r in flat.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k * (dim + 1) rows at most
        if r.at == 0:
            counts[r.cluster] = int(r.x)
        else:
            sums[r.cluster][r.at - 1] = int(r.x)
    return counts, sums


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that ``integer_vectors`` keeps.

    Centroids start as the k kept vectors with the smallest sha256 of ``<seed>:<id>``; fewer if fewer have an id. Each of
    ``rounds`` rounds assigns all vectors (nearest by squared Euclidean distance, the smaller number at a tie) and moves each
    centroid that has vectors to the floor of their mean; then all are assigned once more. Repeated rows count each; rows
    with a null id are clustered but don't start a cluster. Without kept vectors with an id the result is empty. Components
    of 2**27 / scale or more in size raise an error, since their distances don't fit a long.
    """
    kept = materialize(integer_vectors(vectors, dim, scale, id_col, vector_col), "centroids-kept")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = kept.where("id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    fields = [T.StructField(id_col, kept.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())]
    if not seeds:
        return kept.sparkSession.createDataFrame([], T.StructType(fields))
    now = np.array([r.v for r in seeds], np.int64)
    counts, sums = [0] * len(now), [[0] * dim for _ in now]
    state, step = kept, Tighten(now)
    for i in range(rounds + 1):
        before, state = state, materialize(_round(state, dim, step, i == rounds), f"centroids-{i}")
        drop_materialized(before)
        if i == rounds:
            break
        radius = np.zeros(len(now))
        for r in state.groupBy("cluster").agg(F.max("upper").alias("r")).collect():  # k rows at most
            radius[r.cluster] = r.r
        n, s = _moved(state, dim, len(now))
        counts = [a + b for a, b in zip(counts, n)]
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, s)]
        old, now = now, np.array([[x // c for x in sm] if c else list(at) for c, sm, at in zip(counts, sums, now.tolist())], np.int64)
        step = Tighten(now, old, radius)
    told = state.withColumnRenamed("id", id_col)
    inertia = {r.cluster: int(r.x) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    at = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster"))
    per = [inertia.get(c, 0) for c in range(len(now))]
    return told.select(id_col, "cluster", "distance", at(per).cast("long").alias("cluster_inertia"), F.lit(sum(per)).cast("long").alias("inertia"), at(digests).alias("centroid_sha256"))
