"""Hard negatives by a vector-approximation file: bounds looked up from quantised cells leave few rows to be scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .yinyang import finite, ints, whole

#: Cells of a dimension: two dimensions share a byte of the approximation.
CELLS = 16
#: Rows that the inner cell edges are taken from, and rows that give a first floor to every window.
SAMPLE, FLOORS = 16384, 2048
#: Anchors sent to all tasks at once, anchors and rows whose bounds are held at once, rows of a task.
BLOCK, ANCHORS, ROWS, TASK = 8192, 32, 4096, 4096
#: Positives of an anchor, negatives of a positive, and the share of the positive's score, in hundredths, that a negative has at least.
POSITIVES, NEGATIVES, SHARE = 5, 5, 80
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass
class Cells:
    """The least and greatest integer of every cell, dimension by cell; an odd last dimension is paired with zeros."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> Cells:
        """Cut halfway between equal shares of the sample and equal widths, so that neither crowded nor far cells are wide; the outer cells reach to the least and greatest of all rows."""
        d = len(least)
        low, high = np.empty((d, CELLS), np.int64), np.empty((d, CELLS), np.int64)
        at = np.arange(1, CELLS) / CELLS
        even = least + np.outer(at, greatest - least)
        cuts = np.floor((np.quantile(sample, at, axis=0) + even) / 2 if len(sample) else even).astype(np.int64)
        low[:, 0], high[:, -1] = least, greatest
        low[:, 1:] = np.clip(cuts.T, least[:, None], greatest[:, None])
        high[:, :-1] = np.maximum(low[:, 1:] - 1, low[:, :-1])  # a cell that two equal cuts leave empty holds no row
        return cls(low, high)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The approximation of rows: a byte for every two dimensions."""
        cell = np.stack([np.searchsorted(self.low[j, 1:], x[:, j], "right") for j in range(x.shape[1])], axis=1).astype(np.uint8)
        if cell.shape[1] % 2:
            cell = np.column_stack([cell, np.zeros(len(cell), np.uint8)])
        return cell[:, ::2] * CELLS + cell[:, 1::2]

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the approximation and each of its values, what it adds to the lower and the upper bound of the anchors' scores."""
        ends = q[:, :, None] * self.low, q[:, :, None] * self.high
        out = []
        for side in (np.minimum(*ends), np.maximum(*ends)):
            if side.shape[1] % 2:
                side = np.concatenate([side, np.zeros((len(q), 1, CELLS), np.int64)], axis=1)
            out.append((side[:, ::2, :, None] + side[:, 1::2, None, :]).reshape(len(q), -1, CELLS * CELLS))
        return out[0], out[1]

    def bounds(self, q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that a row of each approximation can have, anchor by row."""
        sides = []
        for table in self.tables(q):
            if table.size and np.abs(table).max(axis=(0, 2)).sum() < 1 << 31:
                table = table.astype(np.int32)
            out = np.zeros((len(q), len(codes)), table.dtype)
            for p in range(codes.shape[1]):
                out += table[:, p].take(codes[:, p], axis=1)
            sides.append(out)
        return sides[0], sides[1]


@dataclass
class Windows:
    """Searches over one pass: for an anchor, the best rows whose score lies in [low, high]. Windows stand in the order of their anchors."""

    ids: np.ndarray  # of the anchors
    labels: np.ndarray
    q: np.ndarray
    anchor: np.ndarray  # of each window
    low: np.ndarray
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of another
    best: int

    def fits(self, ids: np.ndarray, labels: np.ndarray, a: int, b: int) -> np.ndarray:
        """Whether a row may be found for an anchor a..b at all."""
        alike = self.labels[a:b, None] == labels[None, :]
        return alike & (self.ids[a:b, None] != ids[None, :]) if self.same else ~alike


class Found:
    """The best rows of every window so far, and the score below which no further row can be among them."""

    def __init__(self, windows: Windows, floor: np.ndarray | None = None):
        n = len(windows.anchor)
        self.windows, self.floor = windows, windows.low.copy() if floor is None else np.maximum(floor, windows.low)
        self.score, self.id = np.full((n, windows.best), LEAST), np.full((n, windows.best), MOST)
        self.scored = 0

    def raise_floor(self, w: np.ndarray, sure: np.ndarray) -> None:
        """sure: scores, window by row, that rows in the window reach at least (LEAST for other rows)."""
        k = self.windows.best
        if sure.shape[1] >= k:
            self.floor[w] = np.maximum(self.floor[w], np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k])

    def add(self, w: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Take rows with their exact scores into their windows."""
        if not len(w):
            return
        k, touched = self.windows.best, np.unique(w)
        all_w = np.concatenate([w, np.repeat(touched, k)])
        all_s, all_i = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([id_, self.id[touched].ravel()])
        order = np.lexsort((all_i, -np.maximum(all_s, LEAST + 1), all_w))
        all_w, all_s, all_i = all_w[order], all_s[order], all_i[order]
        rank = np.arange(len(all_w)) - np.searchsorted(all_w, all_w, "left")
        keep = rank < k
        self.score[all_w[keep], rank[keep]], self.id[all_w[keep], rank[keep]] = all_s[keep], all_i[keep]
        self.floor[touched] = np.maximum(self.floor[touched], self.score[touched, k - 1])

    def scan(self, cells: Cells, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray, x: np.ndarray) -> None:
        """Look rows up for all windows: bounds from the approximations, then exact scores of the rows that may enter a window."""
        v = self.windows
        edges = np.searchsorted(v.anchor, np.arange(0, len(v.ids) + ANCHORS, ANCHORS))
        for at, (first, last) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if first == last:
                continue
            a, b = at * ANCHORS, min(len(v.ids), (at + 1) * ANCHORS)
            lower, upper = cells.bounds(v.q[a:b], codes)
            fits = v.fits(ids, labels, a, b)
            w = np.arange(first, last)
            of = v.anchor[w] - a
            low, high = lower[of], upper[of]
            sure = fits[of] & (low >= v.low[w, None]) & (high <= v.high[w, None])
            self.raise_floor(w, np.where(sure, low, LEAST))
            may = fits[of] & (high >= self.floor[w, None]) & (low <= v.high[w, None])
            any_, starts = np.zeros(lower.shape, bool), np.flatnonzero(np.diff(of, prepend=-1))
            any_[of[starts]] = np.logical_or.reduceat(may, starts, axis=0)
            i, j = np.nonzero(any_)
            score = np.full(lower.shape, LEAST)
            for part in range(0, len(i), 1 << 16):
                p, r = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                score[p, r] = np.einsum("ij,ij->i", v.q[a + p], x[r])
            self.scored += len(i)
            s = score[of]
            hit, row = np.nonzero(may & (s >= self.floor[w, None]) & (s <= v.high[w, None]))
            self.add(w[hit], s[hit, row], ids[row])

    def rows(self) -> pa.RecordBatch:
        w, k = np.nonzero((self.score > LEAST) & (self.score >= self.floor[:, None]))
        return pa.RecordBatch.from_pydict({"w": pa.array(w, pa.int64()), "id": pa.array(self.id[w, k], pa.int64()), "score": pa.array(self.score[w, k], pa.int64())})


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    e = F.col("embedding")
    rows = embeddings.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(e) & (F.size(e) > 0))
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), flipped.cast("bigint").alias("label"), whole(e).alias("v")).distinct()


def first_copies(rows: DataFrame, longest: int) -> DataFrame:
    """The rows that can be in a list: those of one vector and label tie everywhere, so only the first of them by vec_id can.

    That is one more than the longest list, for the anchor may be among them. Spark takes the first of each group before it
    shuffles, so a group of copies of any size costs as much as a few rows.
    """
    nth = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= longest + 1).drop("nth")


def _search(rows: DataFrame, windows: Windows, cells: Cells, d: int, floor: np.ndarray) -> DataFrame:
    """w, id, score, r: the best rows of every window. A task sends on no more than those."""
    shared = rows.sparkSession.sparkContext.broadcast((windows, floor))  # at most BLOCK anchors and their windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found.scan(cells, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), common.fixed(part.column("cells"), (d + 1) // 2), ints(part.column("v"), d).astype(np.int64))
        yield found.rows()

    top = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    return rows.mapInArrow(run, "w bigint, id bigint, score bigint").withColumn("r", F.row_number().over(top)).where(F.col("r") <= windows.best)


def _floor(windows: Windows, cells: Cells, sample: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What the best rows of a bounded sample reach in every window: the rows found reach no less."""
    found, (ids, labels, x) = Found(windows), sample
    for at in range(0, len(ids), ROWS):
        s = slice(at, at + ROWS)
        found.scan(cells, ids[s], labels[s], cells.codes(x[s]), x[s])
    return np.maximum(windows.low, found.score[:, -1])


def mine(embeddings: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which is_anchor holds (vec_id divisible by 100 by default); a row's score is its integer inner
    product with the anchor over components floor(256 x), kept within yinyang.LIMIT; higher scores first, ties by smaller vec_id.
    Positives are the first rows of the anchor's label with another vec_id; for each, negatives are the first rows of other labels
    with share * positive_score <= 100 * negative_score <= 100 * positive_score. Null ids, labels and vectors, empty vectors and
    those with null or non-finite components take no part; repeated rows count once; rows of one id that differ are rows each;
    only rows of the anchor's length are compared with it. An empty table, or one without anchors, gives no rows.

    The approximation file (half a byte a component) stands beside the vectors. Every task looks up bounds for its rows and a
    block of anchors, scores exactly the rows that may enter a window, and sends on at most a window's length for each.
    """
    spark = embeddings.sparkSession
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    all_rows = common.saved(usable(embeddings), "va-vectors")
    sizes = [r["d"] for r in all_rows.where(is_anchor).select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    out = spark.createDataFrame([], SCHEMA)
    for d in sizes:
        alike = all_rows.where(F.size("v") == d)
        n = alike.count()
        ends = alike.agg(*[f(F.col("v")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(d)]).first()
        least, greatest = (np.array([ends[f"{f}{i}"] for i in range(d)], np.int64) for f in ("min", "max"))
        some = _sample(alike, n, SAMPLE)
        cells = Cells.of(some[2], least, greatest)

        def approximate(batches: Iterator[pa.RecordBatch], cells: Cells = cells, d: int = d) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = cells.codes(ints(batch.column("v"), d)) if batch.num_rows else np.zeros((0, (d + 1) // 2), np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "cells"])

        first = first_copies(alike, max(positives, negatives))
        rows = common.saved(first.repartition(max(1, -(-n // TASK))).mapInArrow(approximate, "vec_id bigint, label bigint, v array<int>, cells binary"), "va-file")
        sample = tuple(v[:FLOORS] for v in _sample(rows, n, FLOORS))
        anchors = alike.where(is_anchor)
        blocks = -(-anchors.count() // BLOCK)
        for block in range(blocks):
            few = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == block).select("vec_id", "label", "v").toArrow()
            if few.num_rows:
                found = _block(rows, few["vec_id"].to_numpy(), few["label"].to_numpy(), ints(few["v"].combine_chunks(), d).astype(np.int64), cells, d, sample, positives, negatives, share)
                out = out.unionByName(found)
    return out


def _sample(rows: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_id, label and vector of about `size` rows, chosen by hash."""
    few = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < int(min(1.0, size / max(n, 1)) * (1 << 20)) + 1).select("vec_id", "label", "v").limit(2 * size).toArrow()
    if not few.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.int64)
    v = few["v"].combine_chunks()
    return few["vec_id"].to_numpy(), few["label"].to_numpy(), ints(v, len(v) and len(v.flatten()) // len(v)).astype(np.int64)


def _block(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, cells: Cells, d: int, sample: tuple, positives: int, negatives: int, share: int) -> DataFrame:
    """The result for one block of anchors; their positives, a few each, pass the driver to become the windows of the second search."""
    spark = rows.sparkSession
    wide = Windows(ids, labels, q, np.arange(len(ids)), np.full(len(ids), LEAST + 1), np.full(len(ids), MOST), True, positives)
    near = _search(rows, wide, cells, d, _floor(wide, cells, sample)).toArrow().sort_by([("w", "ascending"), ("r", "ascending")])
    anchor, score, id_ = (near[c].to_numpy() for c in ("w", "score", "id"))
    windows = Windows(ids, labels, q, anchor, -(-share * score // 100), score.copy(), False, negatives)
    windows.high[score < 0] = LEAST + 1  # a share of a negative score lies above it: no row fits
    windows.low[score < 0] = MOST
    found = _search(rows, windows, cells, d, _floor(windows, cells, sample))
    names = spark.createDataFrame(pa.table({"w": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": id_, "positive_score": score})) if len(anchor) else None
    if names is None:
        return spark.createDataFrame([], SCHEMA)
    named = found.join(F.broadcast(names), "w")  # at most BLOCK * positives rows
    return common.saved(named.select("anchor_id", "positive_id", F.col("r").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "va-negatives")
