"""Centroid clustering by Exponion search: exact k-means over integer vectors that scans few centroids a vector.

A vector carries an upper bound of the distance to its centroid and a lower bound of that to any other.  After a round
both move by what the centroids have moved.  A vector keeps its centroid unseen where the upper bound is less than the
lower one, or than half the distance of its centroid to the next.  Otherwise the nearest centroid, and the second nearest,
lie in a ball around the vector's current centroid, of radius twice the (tightened) upper bound plus the distance to the
centroid's next neighbour.  Centroids are listed by distance from each other, so the ball is the beginning of a list; it
is scanned in blocks that double, and the radius is inclusive, which keeps ties.  Distances are whole numbers, computed
exactly; bounds are floating-point numbers, widened by SLACK.

One pass a round: tasks read the last state (vector, centroid, bounds), write the new one and end with the sums of their
clusters; what reaches the driver is a sum a centroid.  States are written in the shared folder, so a lost executor costs
the tasks it ran.  Nothing is shuffled but the sums.

Edge cases: vectors of another length, null ones and ones with a null or non-finite component are left out; fewer vectors
than k are as many centroids; a null vec_id counts as an empty text in the hash, equal hashes are ordered by the vector;
rows that repeat a vec_id are vectors of their own; components beyond LARGEST count as LARGEST (squares then still fit
into a long); sums of distances beyond a long are held at the largest long; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, materialize, table

LARGEST = 1 << 27
#: Up to here squared distances are exact in floating-point products.
_IN_FLOATS = 1 << 22
SLACK = 1e-9
_LONG = 2**63 - 1
_STATE = "vec_id long, q array<int>, cluster int, upper double, lower double, distance long, sums array<long>, n long, inertia decimal(38,0)"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x from each of c (whole numbers)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _IN_FLOATS:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c.astype(np.int64)):
        d = x - row
        out[:, j] = (d * d).sum(1)
    return out


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x from the same row of c."""
    d = x.astype(np.int64) - c
    return (d * d).sum(1)


@dataclass
class Search:
    """Centroids, their neighbours by distance, and how far they have moved since the bounds were made."""

    centroids: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self) -> None:
        gaps = np.sqrt(squared(self.centroids, self.centroids).astype(np.float64)) * (1 - SLACK)
        self.order = np.argsort(gaps, 1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        np.fill_diagonal(gaps, np.inf)
        self.next = gaps.min(1, initial=np.inf)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
        self._scan(x, np.arange(len(x)), np.arange(len(self.centroids)), label, upper, lower)
        return label, upper, lower

    def again(self, x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New labels and bounds, and how many distances were computed."""
        label = label.copy()
        most = np.sort(self.moved)[::-1]
        other = np.where(self.moved == most[0], most[min(1, len(most) - 1)] if (self.moved == most[0]).sum() == 1 else most[0], most[0])
        upper, lower = upper + self.moved[label], lower - other[label]
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.next[label] / 2))
        upper[open_] = np.sqrt(own_squared(x[open_], self.centroids[label[open_]]).astype(np.float64)) * (1 + SLACK)
        looked = len(open_)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], self.next[label[open_]] / 2)]
        for a in np.unique(label[open_]):
            rows = open_[label[open_] == a]
            near = self.next[a] * (1 + 4 * SLACK) if np.isfinite(self.next[a]) else 0.0
            inside = np.searchsorted(self.gaps[a], 2 * upper[rows] + near, "right")  # inclusive: ties stay
            block = np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64)
            for b in np.unique(block):
                some, listed = rows[block == b], np.sort(self.order[a][: 1 << int(b)])
                self._scan(x, some, listed, label, upper, lower)
                looked += len(some) * len(listed)
        return label, upper, lower, looked

    def _scan(self, x: np.ndarray, rows: np.ndarray, listed: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        for k in range(0, len(rows), 4096):
            r = rows[k : k + 4096]
            d = squared(x[r], self.centroids[listed])
            best = d.argmin(1)  # the smallest number of equally near ones, for listed is sorted
            label[r], upper[r] = listed[best], np.sqrt(d[np.arange(len(r)), best].astype(np.float64)) * (1 + SLACK)
            d[np.arange(len(r)), best] = _LONG
            lower[r] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if len(listed) > 1 else np.inf


def kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and q, the whole numbers floor(scale * component), of the vectors that count."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = lambda x: F.least(F.greatest(F.floor(scale * x.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return vectors.where((F.size("embedding") == dims) & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("q"))


def starts(state: DataFrame, k: int, seed: str) -> np.ndarray:
    """The first centroids: the k vectors with the least hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = state.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()  # k vectors
    return np.array([r["q"] for r in rows], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _pass(state: DataFrame, search: Search, dims: int, first: bool) -> DataFrame:
    """The state after an assignment, and rows with each task's sums by cluster."""
    k = len(search.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.decimal128(38, 0)]
        names = [x.split()[0] for x in _STATE.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            if first:
                label, upper, lower = search.first(x)
            else:
                label, upper, lower, _ = search.again(x, *(np.asarray(batch.column(i)).astype(t) for i, t in ((2, np.int64), (3, np.float64), (4, np.float64))))
            distance = own_squared(x, search.centroids[label])
            for c in np.unique(label):
                own = label == c
                sums[c] += x[own].sum(0, dtype=np.int64)
                n[c] += own.sum()
                inertia[c] += (int((distance[own] >> 32).sum()) << 32) + int((distance[own] & 0xFFFFFFFF).sum())
            none = [pa.nulls(batch.num_rows, t) for t in kinds[6:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(kinds[1]), pa.array(label.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), *none], names)
        if some := np.flatnonzero(n).tolist():
            blank = [pa.nulls(len(some), t) for t in (*kinds[:2], *kinds[3:6])]
            yield pa.RecordBatch.from_arrays([*blank[:2], pa.array(some, pa.int32()), *blank[2:], pa.array([sums[c] for c in some], kinds[6]), pa.array(n[some]), pa.array([decimal.Decimal(inertia[c]) for c in some], kinds[8])], names)

    return state.select("vec_id", "q", "cluster", "upper", "lower").mapInArrow(run, _STATE)


def _totals(state: DataFrame, dims: int) -> list[tuple[int, list[int], int, int]]:
    """cluster, sums, n and inertia of every cluster that has vectors; summed in decimals."""
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = state.where("sums IS NOT NULL").groupBy("cluster").agg(*wide, F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).collect()  # a row a centroid
    return [(r["cluster"], [int(r[f"s{i}"]) for i in range(dims)], int(r["n"]), int(r["inertia"])) for r in rows]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """vec_id, cluster and distance (squared) of every vector (vec_id, embedding) that counts, the centroids, and each cluster's inertia."""
    with Steps(vectors.sparkSession) as step:
        state = step(kept(vectors, dims, scale), "vectors")
        search = Search(starts(state, k, seed).reshape(-1, dims))
        state = state.withColumns({"cluster": F.lit(0), "upper": F.lit(0.0), "lower": F.lit(0.0)})
        for r in range(rounds + 1 if len(search.centroids) else 0):
            state = step(_pass(state, search, dims, r == 0), f"round{r}")
            totals, state = _totals(state, dims), state.where("sums IS NULL")
            if r < rounds:
                now = search.centroids.copy()
                for c, sums, n, _ in totals:
                    now[c] = [s // n for s in sums]
                search = Search(now, np.sqrt(own_squared(now, search.centroids).astype(np.float64)) * (1 + SLACK))
        if not len(search.centroids):
            state, totals = state.withColumn("distance", F.lit(0).cast("long")), []
        return materialize(state.select("vec_id", "cluster", "distance"), "clusters"), search.centroids, {c: inertia for c, _, _, inertia in totals}


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, inertia = cluster(table(spark, sf_dir, "embeddings"))
    total = min(sum(inertia.values()), _LONG)
    rows = [(c, min(inertia.get(c, 0), _LONG), total, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS i, unnest(q) AS x FROM v)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS i, unnest(q) AS y FROM first)",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, (min({{'d': d, 'c': c}})).c AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{r} USING (i) GROUP BY ALL) GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c{r} o LEFT JOIN s{r} USING (c, i))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h USING (c)"


ORACLE = _oracle()
