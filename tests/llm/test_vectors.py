"""Clustering, hard negatives and the quality classifier against brute force and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import quality, queries, vafile, yinyang

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, score string"


def vectors(n=400, seed=0, d=64):
    """Clusters with near and exact copies, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, d))
    rows = [(i, (middle[i % 6] + 0.3 * rng.normal(size=d)).astype(np.float32), int(rng.integers(0, 10))) for i in range(n)]
    hot = rows[0][1]
    rows += [(n + i, hot, i % 3) for i in range(n // 2)] + [(2 * n + i, hot + np.float32(1e-4 * i), i % 2) for i in range(100)]
    out = [(int(i), [float(x) for x in v], y, "clash", "clash") for i, v, y in rows]
    odd = [(5000, None, 1), (5100, [], 1), (5200, [1.0] * (d - 1), 1), (5300, [float("nan")] + [0.0] * (d - 1), 1), (5400, [float("inf")] * d, 2), (5500, [None] + [0.5] * (d - 1), 2), (5600, [0.0] * d, 3), (5700, out[3][1], None), (None, out[4][1], 4), (5800, [-0.001] * d, 0), (5900, [3e38] * d, 1)]
    return out + [(i, v, y, None, None) for i, v, y in odd] + [out[0], out[0], (100, out[7][1], 5, None, None)]


def whole(v, d=None):
    if v is None or (d is not None and len(v) != d) or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(max(-yinyang.LIMIT, min(yinyang.LIMIT, np.floor(256 * float(np.float32(x)))))) for x in v]


def brute_clusters(rows, k, rounds):
    rows = [(i, whole(v, 64)) for i, v, *_ in rows]
    rows = [(i, v) for i, v in rows if v is not None]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(rows, key=name)[:k]]
    x = np.array([v for _, v in rows], object)
    for turn in range(rounds + 1):
        c = np.array(centroids, object)
        d = np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)
        best = [min(range(len(c)), key=lambda j: (r[j], j)) for r in d]
        if turn < rounds:
            for j in range(len(c)):
                own = [x[i] for i, b in enumerate(best) if b == j]
                if own:
                    centroids[j] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    dist = [d[i][b] for i, b in enumerate(best)]
    total = sum(dist)
    by = {j: sum(v for v, b in zip(dist, best, strict=True) if b == j) for j in set(best)}
    fits = lambda s: s if s < 1 << 63 else None
    return sorted(map(str, [(i, b, v, fits(by[b]), fits(total), hashlib.sha256(",".join(map(str, centroids[b])).encode()).hexdigest()) for (i, _), b, v in zip(rows, best, dist, strict=True)]))


@pytest.mark.parametrize("k,rounds", [(40, 5), (7, 3), (2000, 1)])
def test_clusters_match_brute_force(spark, k, rounds):
    rows = vectors(120 if k > 100 else 300)
    got = yinyang.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), centroids=k, rounds=rounds).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_clusters(rows, k, rounds)


def test_clusters_of_nothing(spark):
    assert yinyang.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert yinyang.cluster(spark.createDataFrame([(1, [1.0], 1, None, None), (2, None, 1, None, None)], SCHEMA)).count() == 0


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 64)) * 300
    x = (middle[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 64)) * 40).astype(np.int64)
    c = x[:40]
    step = yinyang.Step(c, yinyang.groups_of(c))
    assert len(np.unique(step.group)) > 1
    cluster, upper, lower = step.first(x)
    for _ in range(6):
        new = np.array([x[cluster == j].mean(0) if (cluster == j).any() else c[j] for j in range(40)]).astype(np.int64)
        step = yinyang.Step(new, step.group, np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-6))
        cluster, upper, lower, taken = step.next(x, cluster, upper, lower)
        d = yinyang.squared(x, new)
        assert (cluster == d.argmin(1)).all() and (upper * (1 + 1e-6) >= np.sqrt(d.min(1))).all()
        c = new
    assert taken < 0.1 * d.size


def brute_negatives(rows):
    seen = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(whole(v))) for i, v, y, *_ in rows if i is not None and y is not None and whole(v)}
    out = []
    for a, ya, va in seen:
        if a % 100:
            continue
        alike = [(i, y, sum(p * q for p, q in zip(va, v, strict=True))) for i, y, v in seen if len(v) == len(va)]
        for p, _, ps in sorted((r for r in alike if r[1] == ya and r[0] != a), key=lambda r: (-r[2], r[0]))[:5]:
            fit = sorted((r for r in alike if r[1] != ya and 80 * ps <= 100 * r[2] <= 100 * ps), key=lambda r: (-r[2], r[0]))[:5]
            out += [(a, p, k + 1, n, ps, ns) for k, (n, _, ns) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("d", [64, 7])
def test_negatives_match_brute_force(spark, monkeypatch, d):
    monkeypatch.setattr(vafile, "BLOCK", 3)
    monkeypatch.setattr(vafile, "FLOORS", 50)
    monkeypatch.setattr(vafile, "TASK", 97)
    rows = vectors(400, 1, d)
    got = vafile.mine(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_negatives_of_nothing(spark):
    assert vafile.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vafile.mine(spark.createDataFrame([(100, [1.0, 2.0], 1, None, None), (100, None, 1, None, None)], SCHEMA)).count() == 0


def test_bounds_hold_every_score_and_spare_most():
    rng = np.random.default_rng(2)
    of = rng.integers(0, 4, 8000)
    x = (rng.normal(size=(8000, 64)) * 32 * np.exp(rng.normal(size=8000) * 0.3)[:, None]).astype(np.int64)
    cells = vafile.Cells.of(x[:1000], x.min(0), x.max(0))
    lower, upper = cells.bounds(x[:50], cells.codes(x))
    score = x[:50] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    n = np.arange(50)
    windows = vafile.Windows(n, of[:50], x[:50], n, np.full(50, vafile.LEAST + 1), np.full(50, vafile.MOST), True, 5)
    found = vafile.Found(windows)
    found.scan(cells, np.arange(8000), of, cells.codes(x), x)
    assert found.scored < 0.3 * score.size / 4  # a part of the rows of the anchor's label


def test_quality_of_held_out_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.queries()["op13_quality"](spark, sf_dir).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    rows = [(r.quality, got[r.doc_id]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = ([g.score for q, g in rows if q == v] for v in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([q == g.predicted for q, g in rows]) > 0.95


def test_quality_does_not_read_labels_or_layout(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    one = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    blind = docs.select("doc_id", "text", F.lit("x").alias("lang"), F.lit(1).alias("score"), F.lit(0).alias("x"), F.lit(2).alias("y"))
    kept = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    two = {r.doc_id: r.score for r in quality.score(blind.repartition(7), kept.withColumn("x", F.lit(1))).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-5


def test_quality_edges(spark):
    rng = random.Random(1)
    make = lambda: " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(30))
    docs = [(i, make() if i % 2 else make().upper().replace(" ", "!! ")) for i in range(80)] + [(None, make()), (7, None), (8, ""), (9, " \n"), (9, "word " * 400_000), (10, "x" * 2_000_000), (3, docs_text := make()), (3, docs_text)]
    labels = [(i, i % 2) for i in range(60)] + [(5, 1), (6, None), (None, 1), (4, 7), (999, 0)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score(d, y).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (7, 8)} & {r.score for r in got if r.doc_id == 9}) == 1  # null, empty and blank texts alike
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and 60 <= r.doc_id < 80]) > 0.9
    assert {r.score for r in quality.score(d, y.where("false")).collect()} == {0.5}
    assert quality.score(d.where("false"), y).count() == 0


def test_word_vectors_are_sums_over_both_sides(spark):
    texts = ["a b c d e, f", "b a a", None, "", "q", "c " * 5000]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    place, sign = quality.index_vectors()
    sums = np.zeros((quality.IDS, quality.LENGTH))
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ids, counts = quality.word_ids(raw, np.array([0, len(raw)]))
        assert counts.sum() == len(ids)
        for i in range(len(ids)):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    np.add.at(sums[ids[i]], place[ids[j]], sign[ids[j]])
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-6)


def test_temperature_is_the_best_on_the_rows_kept_back():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 10))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, y)
    at = slice(1600, None)
    assert quality.loss(net.logits(x[at]) / net.temperature, y[at]) <= min(quality.loss(net.logits(x[at]) / t, y[at]) for t in (0.5, 1, 2, 4)) + 1e-6
    assert 0.75 < np.mean((net.score(x[at]) > 0.5) == y[at]) and abs(net.score(x[at]).mean() - y[at].mean()) < 0.06
