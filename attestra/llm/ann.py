"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked exactly."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

#: Neighbours returned, hash tables, recall aimed at, and rows aimed at in a bucket.
K, TABLES, TARGET, BUCKET = 20, 12, 0.96, 256
#: Width of a hash cell, in units of the largest norm.
WIDTH = 2.0
#: Most rows of a block of a large bucket; sampled vectors that bound scores from below; queries that tune the probes.
BLOCK, SAMPLE, TUNERS = 2048, 4096, 96
#: The share of the probes that come first, to bound what the rest sends on.
FIRST = 1 / 8
#: At most so many coordinates are perturbed at once, and so many buckets visited in a table.
PERTURBED, MOST_PROBES = 4, 4096
#: Queries that are compared with all rows at a time, where the buckets do not do.
EXACT = 4096
SEED = 5


@dataclass
class Hashes:
    """Random directions and shifts of each table over vectors lengthened to one common norm."""

    directions: np.ndarray
    shifts: np.ndarray
    norm: float
    probes: int

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Real-valued cell positions, row x table x hash. Rows get a further component that lifts them to the largest norm, queries are scaled to it: then the nearest is the one of largest inner product."""
        size = np.linalg.norm(x, axis=1)
        unit = x / (size if query else np.full(len(x), self.norm))[:, None]
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (size / self.norm) ** 2))
        tables, k, _ = self.directions.shape
        flat = np.column_stack([unit, extra]) @ self.directions.reshape(tables * k, -1).T
        return (flat.reshape(len(x), tables, k) + self.shifts) / WIDTH

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each row of cells (... x table x hash)."""
        out = np.broadcast_to(np.arange(1, cells.shape[-2] + 1, dtype=np.uint64), cells.shape[:-1]).copy()
        for j in range(cells.shape[-1]):
            out = words.mix(out + (cells[..., j].astype(np.int64) + 1000).view(np.uint64))
        return out.view(np.int64)


def perturbations(k: int, most: int = PERTURBED) -> np.ndarray:
    """Every vector of steps -1, 0, 1 with at most `most` that are not 0."""
    out = []
    for n in range(min(k, most) + 1):
        for at in itertools.combinations(range(k), n):
            for signs in itertools.product((-1, 1), repeat=n):
                v = np.zeros(k, np.int64)
                v[list(at)] = signs
                out.append(v)
    return np.array(out)


def probe_order(places: np.ndarray, steps: np.ndarray, probes: int) -> np.ndarray:
    """The cells to visit, in order of the estimated chance to hold a neighbour: by the sum of squared distances to the crossed walls."""
    cell = np.floor(places)
    up, down = 1 - (places - cell), places - cell
    cost = (up**2) @ (steps == 1).T + (down**2) @ (steps == -1).T
    probes = min(probes, len(steps))
    best = np.argpartition(cost, probes - 1, axis=-1)[..., :probes]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, -1), axis=-1, kind="stable"), -1)
    return cell[..., None, :] + steps[best]


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def usable(embeddings: DataFrame) -> tuple[DataFrame, int, float]:
    """vec_id and e of the rows that take part (distinct), the dimension and the largest norm.

    Out are null ids, null or zero vectors, those with null or non-finite components, and those of another than the commonest length.
    """
    e = F.col("embedding")
    fine = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine).select("vec_id", e.alias("e"))
    sizes = rows.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return rows, 0, 1.0
    d = sizes[0]["d"]
    rows = common.saved(rows.where(F.size("e") == d).dropDuplicates(["vec_id", "e"]), "ann-vectors")
    norm = rows.agg(F.max(F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).alias("m")).first()["m"]
    return rows, d, float(norm)


def best_of(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best rows whose score is not below its bound; a row of the query's id is none."""
    rough = q @ x.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    edge = bound.copy()
    if len(ids) > k:
        edge = np.maximum(edge, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k])
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
    i, j = np.nonzero((rough >= (edge - slack)[:, None]) & np.isfinite(rough))
    score = (q[i] * x[j]).sum(axis=1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
    keep = rank < k
    return i[keep], ids[j[keep]], score[keep]


def _true(rows: DataFrame, queries: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a bounded set of queries, which are compared with all rows, block by block; then query number and vector of each true neighbour."""
    n = queries.count()
    few = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, TUNERS / max(n, 1)) * (1 << 20)) + 1).toArrow()
    if not few.num_rows:
        return np.zeros((0, d)), np.zeros(0, np.int64), np.zeros((0, d))
    q_ids, q = few["vec_id"].to_numpy()[: 4 * TUNERS], matrix(few["e"].combine_chunks(), d)[: 4 * TUNERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("e"), d)
            i, near, score = best_of(ids, x, q_ids, q, np.full(len(q), -np.inf), k)
            at = np.argsort(ids, kind="stable")
            row = at[np.searchsorted(ids[at], near)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int64()), "score": pa.array(score), "e": batch.column("e").take(pa.array(row))})

    top = Window.partitionBy("i").orderBy(F.desc("score"))
    true = rows.mapInArrow(run, "i bigint, score double, e array<float>").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("i", "e").toArrow()
    if not true.num_rows:
        return q, np.zeros(0, np.int64), np.zeros((0, d))
    return q, true["i"].to_numpy(), matrix(true["e"].combine_chunks(), d)


def _tuned(q: np.ndarray, owner: np.ndarray, near: np.ndarray, hashes: Hashes, steps: np.ndarray, target: float) -> int | None:
    """How many buckets a table must be probed for, so that the share `target` of the true neighbours is met; None if more than MOST_PROBES."""
    if not len(owner):
        return 1
    want = hashes.keys(np.floor(hashes.places(near, False)))
    visited = hashes.keys(np.moveaxis(probe_order(hashes.places(q, True), steps, MOST_PROBES), -2, -3))  # query x probe x table
    hit = visited[owner] == want[:, None, :]
    first = np.where(hit.any(axis=1), hit.argmax(axis=1), 1 << 30).min(axis=1)
    need = np.sort(first)[min(len(first) - 1, math.ceil(target * len(first)) - 1)]
    return int(need) + 1 if need < 1 << 30 else None


def _exact(rows: DataFrame, queries: DataFrame, n: int, d: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best rows of each of n queries, compared with all rows, EXACT queries at a time."""
    spark = rows.sparkSession
    out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    blocks = -(-n // EXACT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(blocks)) == block).select("vec_id", "e").toArrow()
        if not some.num_rows:
            continue
        shared = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), matrix(some["e"].combine_chunks(), d)))  # about EXACT vectors

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for batch in batches:
                ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("e"), d)
                most = k if len(np.unique(ids)) == len(ids) else len(ids)
                for at in range(0, len(q), 64):
                    i, near, score = best_of(ids, x, q_ids[at : at + 64], q[at : at + 64], np.full(len(q[at : at + 64]), -np.inf), most)
                    if most > k:  # the best of each id, then the best ids
                        best = np.lexsort((-score, near, i))
                        best = best[np.append(True, (i[best][1:] != i[best][:-1]) | (near[best][1:] != near[best][:-1]))] if len(best) else best
                        best = best[np.lexsort((near[best], -score[best], i[best]))]
                        best = best[np.arange(len(best)) - np.searchsorted(i[best], i[best], "left") < k]
                        i, near, score = i[best], near[best], score[best]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[at + i], pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

        found = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        out = out.unionByName(common.saved(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "ann-exact"))
    return out


def search(embeddings: DataFrame, is_query: Column | None = None, k: int = K, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest rows found, by inner product in double precision.

    Queries are the rows for which is_query holds (vec_id divisible by 20 by default); ties go to the smaller vec_id; a query
    has fewer rows if there are fewer candidates. Null, zero and non-finite vectors and null ids take no part; rows of one
    vec_id are one point. All rows are indexed in every table. The number of buckets probed is set so that the share `target`
    of the true neighbours of a bounded sample of queries is met; where MOST_PROBES are too few for that, vectors are hashed to
    fewer cells. A query left with fewer than k rows, or than there are candidates, is compared with all rows. Scores below a query's k-th best of a bounded sample of rows,
    and later below its k-th best of the first probes, are not sent on. Large buckets are cut into blocks of rows and of queries.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    rows, d, norm = usable(embeddings)
    spark = embeddings.sparkSession
    if not d:
        return spark.createDataFrame([], schema)
    n = rows.count()
    size = max(2, min(20, round(math.log2(max(n, 2) / BUCKET) / 1.3)))
    queries = rows.where(is_query)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    true = _true(rows, queries, d, k)
    while True:
        rng = np.random.default_rng(SEED)
        hashes = Hashes(rng.normal(size=(tables, size, d + 1)), rng.uniform(0, WIDTH, (tables, size)), norm, 1)
        steps = perturbations(size)
        probes = _tuned(*true, hashes, steps, target)
        if probes:
            break
        if size == 1:
            return ranked(_exact(rows, queries, queries.count(), d, k))
        size -= 1
    hashes.probes = probes
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / n) * (1 << 20)) + 1).toArrow()
    s_ids, s_rows = sample["vec_id"].to_numpy()[: 2 * SAMPLE], matrix(sample["e"].combine_chunks(), d)[: 2 * SAMPLE] if sample.num_rows else np.zeros((0, d))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hashes.keys(np.floor(hashes.places(matrix(batch.column("e"), d), False)))
            for t in range(keys.shape[1]):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys[:, t]), "id": batch.column("vec_id"), "e": batch.column("e"), "bound": pa.nulls(len(keys), pa.float64())})

    def probe(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = matrix(part.column("e"), d)
                bound = np.full(len(q), -np.inf)
                score = q @ s_rows.T
                score[part.column("vec_id").to_numpy()[:, None] == s_ids[None, :]] = -np.inf
                if len(s_ids) > k:
                    bound = np.partition(score, len(s_ids) - k, axis=1)[:, len(s_ids) - k]
                bound = np.maximum(bound, part.column("floor").to_numpy(zero_copy_only=False))
                bound = np.where(np.isfinite(bound), bound - 1e-9 * (1 + np.abs(bound)), -np.inf)
                order = probe_order(hashes.places(q, True), steps, hi)[:, :, lo:hi]
                keys = hashes.keys(np.moveaxis(order, -2, -3)).reshape(len(q), -1)
                row = np.repeat(np.arange(len(q)), keys.shape[1])
                take = pa.array(row)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys.ravel()), "id": part.column("vec_id").take(take), "e": part.column("e").take(take), "bound": pa.array(bound[row])})

    columns = "bucket bigint, id bigint, e array<float>, bound double"
    indexed = rows.mapInArrow(index, columns)
    large = common.saved(indexed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "ann-large")

    def scored(part: pa.Table, starts: np.ndarray) -> pa.Table:
        is_row = part["bound"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids, x = part["id"].to_numpy(), matrix(part["e"].combine_chunks(), d)
        bound = part["bound"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in itertools.pairwise(starts.tolist()):
            at = np.arange(a, b)
            r, q = at[is_row[a:b]], at[~is_row[a:b]]
            if not len(r):
                continue
            for first in range(0, len(q), 1024):
                some = q[first : first + 1024]
                i, near, score = best_of(ids[r], x[r], ids[some], x[some], bound[some], k)
                out.append((ids[some][i], near, score))
        cat = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    def visited(asked: DataFrame, lo: int, hi: int) -> DataFrame:
        """query_id, vec_id, score of what the probes lo..hi of each query (with its floor) find above its bound."""
        dealt = indexed.unionByName(asked.mapInArrow(lambda batches: probe(batches, lo, hi), columns)).join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int")
        cells = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        is_row = F.col("bound").isNull()
        cells = cells.withColumn("left", F.when(is_row, F.col("own")).otherwise(F.col("other"))).withColumn("right", F.when(is_row, F.col("other")).otherwise(F.col("own")))
        found = common.map_groups(cells.select("bucket", "left", "right", "id", "e", "bound"), ["bucket", "left", "right"], scored, "query_id bigint, vec_id bigint, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    low = F.lit(float("-inf"))
    few = max(1, math.ceil(hashes.probes * FIRST))
    once = visited(queries.withColumn("floor", low), 0, few)
    if few < hashes.probes:
        once = common.saved(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-first")
        floors = once.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        rest = visited(queries.join(floors, "vec_id", "left").select("vec_id", "e", F.coalesce("floor", low).alias("floor")), few, hashes.probes)
        once = once.drop("rank").unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    once = common.saved(ranked(once), "ann-found")
    least = min(k, rows.select("vec_id").distinct().count() - 1)
    full = once.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("query_id").alias("vec_id"))
    short = common.saved(queries.join(full, "vec_id", "left_anti").select("vec_id", "e"), "ann-short") if least else queries.limit(0)
    n_short = short.count()
    if not n_short:
        return once
    return ranked(once.drop("rank").unionByName(_exact(rows, short, n_short, d, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
