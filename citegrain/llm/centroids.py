"""Exact centroid clustering of integer vectors, with bounds that planar geometry loosens.

Every vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound
of the distances to all others. When centroids move, the upper bound grows by the move of the own
centroid. The lower bound would shrink by the greatest move of any other; but the vectors of a
cluster lie in a sphere around their centroid, and seen from a sphere off the path, a centroid comes
closer by less than it moves. In the plane through the path and the centre of the sphere, a point at
s along the path (from its middle) and h beside it comes closer by
hypot(s + move / 2, h) - hypot(s - move / 2, h), which grows with s and, for s > 0, falls with h. So
the most is taken on the arc of the sphere that faces the path, and pieces of that arc bound it. Only
vectors whose bounds overlap are compared with centroids, in whole numbers.

Each round is one Arrow pass over the state (vector, cluster, bounds), which is written again and
replaces the one before; sums of centroids change by the vectors that moved alone, added up in tasks
and then by (cluster, dimension). The driver holds the centroids, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import Scratch, arrow_pass, bounded_batches, parts_of, stored

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
# Pieces of the arc on which the loosening is bounded; of bounds, the part that rounding may cost.
PIECES = 64
MARGIN = 1e-9
# Beyond, squared distances of 64 dimensions leave a long.
LARGEST = 1 << 27


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x): vectors of that many finite components, as floor(scale * component)."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return rows.where((F.size(c) == dimensions) & finite).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; rows without id come last, ties by vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.orderBy(key.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    return np.array([r.x for r in found], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """How much closer a centroid moving from old to new can come to a point of the sphere, at most."""
    path = (new - old).astype(float)
    move = float(np.sqrt(path @ path))
    if move == 0:
        return 0.0
    off = centre - (old + new) / 2
    along = off @ path / move
    beside = np.sqrt(max(0.0, off @ off - along * along))
    arc = np.linspace(0, np.pi / 2, PIECES + 1)
    s = along + radius * np.cos(arc[:-1])
    h = np.maximum(0.0, beside - radius * np.sin(arc[1:]))
    closer = np.hypot(s + move / 2, h) - np.hypot(s - move / 2, h)
    slack = MARGIN * (move + abs(along) + beside + radius)
    return min(move, max(0.0, float(closer[s > -slack].max(initial=0.0)))) + slack


class Moves:
    """The centroids and, for each cluster, how far its bounds loosen since they were taken."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None, radii: np.ndarray | None = None):
        k = len(centroids)
        self.centroids, self.own, self.rest = centroids, np.zeros(k), np.zeros(k)
        if before is None:
            return
        self.own = np.sqrt(((centroids - before).astype(float) ** 2).sum(1)) * (1 + MARGIN)
        for i in range(k):
            self.rest[i] = max(
                (loosening(before[j], centroids[j], before[i], radii[i]) for j in range(k) if j != i), default=0.0
            )


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster (the smaller number on ties), distance to its centroid and to the next nearest one."""
    found = squared(x, centroids)
    best = found.argmin(1)
    own = np.sqrt(found[np.arange(len(x)), best])
    if len(centroids) == 1:
        return best, own, np.full(len(x), np.inf)
    return best, own, np.sqrt(np.partition(found, 1, axis=1)[:, 1])


def reassigned(
    x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: Moves
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and bounds after the moves, and which rows were compared with all centroids."""
    cluster, upper, lower = cluster.copy(), upper + moves.own[cluster], lower - moves.rest[cluster]
    unsure = np.flatnonzero(upper * (1 + MARGIN) >= lower * (1 - MARGIN))
    own = moves.centroids[cluster[unsure]]
    upper[unsure] = np.sqrt(((x[unsure] - own) ** 2).sum(1))
    unsure = unsure[upper[unsure] * (1 + MARGIN) >= lower[unsure] * (1 - MARGIN)]
    cluster[unsure], upper[unsure], lower[unsure] = nearest(x[unsure], moves.centroids)
    return cluster, upper, lower, unsure


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST}: squared distances would leave a long")
    return x


def assigned(state: DataFrame, moves: Moves, dimensions: int) -> DataFrame:
    """The state after one assignment: (vec_id, x, was, cluster, upper, lower)."""
    shared = state.sparkSession.sparkContext.broadcast(moves)
    fresh = "cluster" not in state.columns
    kind = dict(state.dtypes)["vec_id"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        moves, x = shared.value, _matrix(batch.column("x"), dimensions)
        if fresh:
            was = np.full(len(x), -1, np.int32)
            cluster, upper, lower = nearest(x, moves.centroids)
        else:
            was, upper, lower = (batch.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, _ = reassigned(x, was, upper, lower, moves)
        flat = pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1, dtype=np.int32) * dimensions), pa.array(x.reshape(-1))
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), flat, pa.array(was), pa.array(cluster.astype(np.int32)), pa.array(upper),
             pa.array(lower)],
            ["vec_id", "x", "was", "cluster", "upper", "lower"],
        )

    return arrow_pass(
        state, step, f"vec_id {kind}, x array<long>, was int, cluster int, upper double, lower double"
    )


def changes(state: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """What the vectors that moved add to (and take from) each cluster: its sums, then its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((clusters + 1, dimensions + 1), np.int64)
        for batch in batches:
            for part in parts_of(batch):
                x = _matrix(part.column("x"), dimensions)
                rows = np.column_stack([x, np.ones(len(x), np.int64)])
                np.add.at(totals, part.column("cluster").to_numpy(), rows)
                np.subtract.at(totals, part.column("was").to_numpy(), rows)  # -1: the spare last row
        cell = np.flatnonzero(totals[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(totals[:-1].reshape(-1)[cell])], ["cell", "total"])

    bounded_batches(state.sparkSession)
    moved = state.where("cluster <> was").select("x", "was", "cluster").mapInArrow(run, "cell long, total long")
    found = np.zeros(clusters * (dimensions + 1), object)
    for r in moved.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found[r.cell] = int(r.total)
    return found.reshape(clusters, dimensions + 1)


def radii(state: DataFrame, clusters: int) -> np.ndarray:
    """Greatest distance of a vector from its own centroid, for each cluster."""
    found = np.zeros(clusters)
    for r in state.groupBy("cluster").agg(F.max("upper").alias("radius")).collect():
        found[r.cluster] = r.radius
    return found * (1 + MARGIN)


def cluster_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector.

    Vectors of another length, and those that are null or hold null or non-finite entries, are left
    out. Repeated rows count and come out as often as they occur; with fewer vectors than clusters
    there are fewer clusters; no vectors give no rows. A row without vec_id is clustered like any
    other, but starts a cluster only where rows with one are too few. Inertias beyond a long are
    null; components beyond LARGEST / scale are an error. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, vec_id, vector, dimensions, scale)
    kind = dict(vectors.dtypes)["vec_id"]
    centroids = first_centroids(vectors, clusters, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    with Scratch(spark) as tables:
        state, moves = vectors, Moves(centroids)
        totals = np.zeros((k, dimensions + 1), object)
        for _ in range(rounds):
            after = tables.keep(assigned(state, moves, dimensions))
            if state is not vectors:
                tables.free(state)
            state = after
            totals = totals + changes(state, k, dimensions)
            moved = centroids.copy()
            for j in np.flatnonzero(totals[:, -1] > 0):
                moved[j] = [s // totals[j, -1] for s in totals[j, :-1]]
            moves, centroids = Moves(moved, centroids, radii(state, k)), moved
        final = stored(_distances(assigned(state, moves, dimensions), centroids))
    sums = {
        r.cluster: int(r.total)
        for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    within = lambda n: n if n < 1 << 63 else None
    prints = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame(
        [(j, within(sums.get(j, 0)), within(sum(sums.values())), prints[j]) for j in range(k)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return final.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the exact squared distance to the own centroid."""
    shared = state.sparkSession.sparkContext.broadcast(centroids)
    kind = dict(state.dtypes)["vec_id"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, cluster = _matrix(batch.column("x"), shared.value.shape[1]), batch.column("cluster")
        distance = ((x - shared.value[cluster.to_numpy()]) ** 2).sum(1)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, pa.array(distance)], ["vec_id", "cluster", "distance"])

    return arrow_pass(state.select("vec_id", "x", "cluster"), step, f"vec_id {kind}, cluster int, distance long")


def oracle_sql() -> str:
    """The contract in DuckDB SQL: one assignment and one replacement for each round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid,
         [CAST(floor(CAST(e AS DOUBLE) * {SCALE}) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND list_bool_and([e IS NOT NULL AND isfinite(e) FOR e IN embedding])
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS cluster, x AS c FROM v
  ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {CLUSTERS}
)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""d{k} AS MATERIALIZED (
  SELECT v.rid, c{k}.cluster,
         CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x, c)]) AS BIGINT) AS distance
  FROM v CROSS JOIN c{k}
), a{k} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, distance * 16 + cluster) AS cluster, min(distance) AS distance FROM d{k} GROUP BY rid
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""s{k} AS (
  SELECT cluster, place, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(x) AS e, unnest(range({DIMENSIONS})) AS place FROM a{k} JOIN v USING (rid)) GROUP BY cluster, place
), m{k} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM s{k} GROUP BY cluster
), c{k + 1} AS MATERIALIZED (
  SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster)
)"""
            )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN c{ROUNDS} USING (cluster)"""
    )
