"""Centroid clustering by Yinyang grouping: bounds decide which centroids a vector has to be compared with."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of a vector, centroids, rounds of assignment and update, centroids to a group.
DIMENSION, CENTROIDS, ROUNDS, TO_A_GROUP = 64, 40, 5, 10
#: Integer components beyond this are set to it, so that a squared distance fits 64 bits.
LIMIT = 1 << 26
#: Components up to this give squared distances that doubles hold exactly.
_DOUBLE = 1 << 20
_SLACK = 1e-6
STATE = "vec_id bigint, v array<int>, cluster int, was int, upper float, lower array<float>"
SCHEMA = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def whole(e: Column) -> Column:
    """floor(256 x) of every component x, taken as a double and kept within LIMIT."""
    return F.transform(e, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))


def finite(e: Column) -> Column:
    """Whether an array is there and none of its components is null, infinite or no number."""
    return e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def ints(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows and integer centroids, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _DOUBLE:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - row) ** 2).sum(1) for row in c.astype(np.int64)], axis=1)


def groups_of(centroids: np.ndarray, to_a_group: int = TO_A_GROUP) -> np.ndarray:
    """The group of each centroid: a few rounds of plain clustering among the centroids themselves."""
    t = max(1, len(centroids) // to_a_group)
    middle = centroids[:: max(1, len(centroids) // t)][:t].astype(np.float64)
    for _ in range(5):
        nearest = ((centroids[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(t):
            if (nearest == g).any():
                middle[g] = centroids[nearest == g].mean(0)
    return nearest


@dataclass
class Step:
    """The centroids of a round, their groups, and how far each has moved since the bounds were set (None: there are none)."""

    centroids: np.ndarray
    group: np.ndarray
    drift: np.ndarray | None = None

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper bound and one lower bound a group, from all distances."""
        return self._settle(squared(x, self.centroids), np.full((len(x), self.group.max() + 1), np.inf))

    def next(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the bounds of the round before, and how many distances were taken.

        A vector whose upper bound lies under all its lower bounds stays where it is; so it does if that holds after its own
        distance was taken; of what is left, only the groups whose lower bound does not exceed that distance are scanned.
        """
        most = np.zeros(lower.shape[1])
        np.maximum.at(most, self.group, self.drift)
        upper, lower, cluster = upper + self.drift[cluster], lower - most, cluster.copy()
        rows = np.flatnonzero(upper * (1 + _SLACK) >= lower.min(1))
        taken = len(rows)
        own = self.own(x[rows], cluster[rows])
        upper[rows] = np.sqrt(own)
        left = upper[rows] * (1 + _SLACK) >= lower[rows].min(1)
        rows, own = rows[left], own[left]
        if len(rows):
            far = np.iinfo(np.int64).max
            d = np.full((len(rows), len(self.centroids)), far)
            d[np.arange(len(rows)), cluster[rows]] = own
            open_ = lower[rows] <= (upper[rows] * (1 + _SLACK))[:, None]
            for g in range(lower.shape[1]):
                members, at = np.flatnonzero(self.group == g), np.flatnonzero(open_[:, g])
                if len(at) and len(members):
                    d[np.ix_(at, members)] = squared(x[rows[at]], self.centroids[members])
                    taken += len(at) * len(members)
            kept = np.where(open_, np.inf, lower[rows])
            cluster[rows], upper[rows], lower[rows] = self._settle(d, kept)
        return cluster, upper, lower, taken

    def _settle(self, d: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid (of equals the first); a group's lower bound is the least known distance to another centroid of it."""
        rows, best = np.arange(len(d)), d.argmin(1)
        root = np.sqrt(np.where(d == np.iinfo(np.int64).max, np.inf, d))
        upper = root[rows, best]
        root[rows, best] = np.inf
        lower = lower.copy()
        for g in range(lower.shape[1]):
            members = self.group == g
            if members.any():
                lower[:, g] = np.minimum(lower[:, g], root[:, members].min(1))
        return best, upper, lower

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The squared distance of each row to its centroid."""
        return ((x.astype(np.int64) - self.centroids[cluster]) ** 2).sum(1)


def _rows(batch: pa.RecordBatch, x: np.ndarray, cluster: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    """The state's rows; bounds are rounded outwards to floats."""
    low = pa.array((np.maximum(lower, 0) * (1 - _SLACK)).astype(np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, low.__len__() + 1, lower.shape[1]), pa.int32()), low)
    return pa.RecordBatch.from_pydict(
        {
            "vec_id": batch.column("vec_id"),
            "v": batch.column("v"),
            "cluster": pa.array(cluster.astype(np.int32)),
            "was": pa.array(was.astype(np.int32)),
            "upper": pa.array((upper * (1 + _SLACK)).astype(np.float32)),
            "lower": lists,
        }
    )


def _moved(state: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """What each centroid's sum and count change by: vectors that moved are added to where they went and taken from where they were."""
    ends = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    changes = state.where("cluster <> was").select("v", F.explode(ends).alias("end")).where("end.c >= 0")
    sums = [F.sum(F.col("v")[i].cast("bigint") * F.col("end.sign")).alias(f"s{i}") for i in range(d)]
    found = changes.groupBy(F.col("end.c").alias("c")).agg(F.sum("end.sign").alias("n"), *sums).collect()  # one row a centroid
    total, count = np.zeros((k, d), object), np.zeros(k, object)
    for row in found:
        count[row["c"]] = row["n"]
        total[row["c"]] = [row[f"s{i}"] for i in range(d)]
    return total, count


def cluster(embeddings: DataFrame, dimension: int = DIMENSION, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Part take the rows whose embedding has exactly `dimension` components, none null or non-finite; each component x counts as
    floor(256 x), kept within LIMIT. Repeated rows and repeated ids count as often as they stand. The first centroids are the
    vectors with the least SHA-256 of "2:<vec_id>" (nothing after the colon for a null id; equal hashes by the vector), all if
    there are fewer. Ties of distance go to the smaller number. A sum of distances beyond 64 bits is null. An empty table, or one
    without such vectors, gives no rows.

    Groups of centroids are made once. Every vector carries an upper bound and a lower bound for each group from round to round,
    in a table written to the shared folder; a centroid's sum is changed only by the vectors that moved. The driver holds the
    centroids.
    """
    spark = embeddings.sparkSession
    e = F.col("embedding")
    rows = embeddings.select("vec_id", "embedding").where(finite(e) & (F.size(e) == dimension)).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole(e).alias("v"))
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = rows.orderBy(name, "v").limit(centroids).collect()
    if not seeds:
        return spark.createDataFrame([], SCHEMA)
    now = np.array([list(r["v"]) for r in seeds], np.int64)
    step = Step(now, groups_of(now))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = ints(batch.column("v"), dimension)
                found, upper, lower = step.first(x)
                yield _rows(batch, x, found, np.full(len(x), -1), upper, lower)

    state = common.saved(rows.mapInArrow(begin, STATE), "yinyang")
    total, count = np.zeros((len(now), dimension), object), np.zeros(len(now), object)
    for _ in range(rounds):
        more, n = _moved(state, len(now), dimension)
        total, count = total + more, count + n
        new = np.array([total[c] // count[c] if count[c] else step.centroids[c] for c in range(len(now))], np.int64)
        drift = np.sqrt(((new - step.centroids).astype(np.float64) ** 2).sum(1)) * (1 + _SLACK)
        step = Step(new, step.group, drift)

        def go_on(batches: Iterator[pa.RecordBatch], step: Step = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, was = ints(batch.column("v"), dimension), batch.column("cluster").to_numpy()
                    found, upper, lower, _ = step.next(x, was, batch.column("upper").to_numpy().astype(np.float64), ints(batch.column("lower"), step.group.max() + 1).astype(np.float64))
                    yield _rows(batch, x, found, was, upper, lower)

        before, state = state, common.saved(state.mapInArrow(go_on, STATE), "yinyang")
        common.discard(before)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": batch.column("cluster"), "distance": pa.array(step.own(ints(batch.column("v"), dimension), at))})

    found = state.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id bigint, cluster int, distance bigint")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda s: s if s < 1 << 63 else None
    named = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, step.centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    ends = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(ends, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
