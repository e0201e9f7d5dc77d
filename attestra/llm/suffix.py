"""Removal of long repeated byte strings by a run-length index of their candidates.

Every window of bytes is anchored at the least k-gram hash of its middle, and goes to the bucket of the bytes around its anchor,
so equal windows share a bucket. The runs of windows of one bucket ("segments") whose bucket recurs are indexed: the
Burrows-Wheeler transform of a batch of buckets, kept as runs, with text positions and match lengths sampled at both ends of
each run. Each segment is then streamed through the runs by LF steps from its end to its start; the samples that it meets give the
length of its longest match elsewhere at every byte, and matches as long as a window are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Bytes of a window, of the hashed k-grams within it, and of what is compared on each side of an anchor.
WINDOW, GRAM, AROUND = 400, 16, 32
#: Bytes of segments that are indexed together, and of different segments in a bucket beyond which these are trimmed and then cut.
BATCH, MOST_BYTES = 1 << 17, 2 << 20
#: Bytes by which what is compared around a window's anchor grows, coarse to fine; 0 stands for the whole window.
STEPS = (64, 8, 0)
#: Keys of windows that are counted together before they are sent on.
COUNTED = 1 << 20


def _rolled(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive bytes."""
    n = len(data)
    up, down = words.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return words.mix((total[width:] - total[:-width]) * down[: n - width + 1])


def _around(window: int) -> int:
    return AROUND if window >= 2 * AROUND + GRAM else 0


def _anchors(data: np.ndarray, window: int) -> np.ndarray:
    """The anchor of every window: the leftmost least hash of the k-grams that stand AROUND bytes or more from its ends."""
    around, gram = _around(window), min(GRAM, window)
    ranks = (_rolled(data, gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - gram + 1, dtype=np.uint64)
    return (_slid(ranks[around:], window - gram - 2 * around + 1, np.minimum, np.iinfo(np.uint64).max)[: len(data) - window + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_keys(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte within the text, byte length and key of each segment of each text, and whether it may repeat itself.

    A window's key is the hash of its anchor with AROUND bytes on each side. Equal windows have their anchors at equal places, so their keys are equal. A
    segment is a maximal run of windows of one key; only one of several anchors may hold two equal windows.
    """
    n = len(data)
    around, gram = _around(window), min(GRAM, window)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    if n < window:
        return none
    starts = n - window + 1
    anchor = _anchors(data, window)
    left = np.repeat(offsets[1:], np.diff(offsets))[:starts] - np.arange(starts)
    whole = left >= window
    moved = np.ones(starts, bool)
    moved[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    inner = offsets[1:-1]
    moved[inner[inner < starts]] = True
    at = np.flatnonzero(moved & whole)
    if not len(at):
        return none
    key = _rolled(data, gram + 2 * around)[anchor[at] - around]
    run = np.add.reduceat(whole.astype(np.int64), at)
    owner = np.searchsorted(offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    parts = np.diff(np.append(first, len(at)))
    return owner[first], at[first] - offsets[owner[first]], np.add.reduceat(run, first) + window - 1, key[first], parts > 1


def _slid(values: np.ndarray, width: int, of: np.ufunc, end: int) -> np.ndarray:
    """of (minimum or maximum) of every `width` consecutive values, by running values from both sides of blocks of that width."""
    padded = np.full(-(-len(values) // width) * width, end, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).ravel()
    behind = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    many = len(values) - width + 1
    return of(behind[:many], ahead[width - 1 : width - 1 + many])


def _segments(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    data, offsets = common.strings(column)
    for a, b in common.slices(offsets):
        owner, first, length, key, twice = window_keys(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
        yield owner + a, first, length, key.view(np.int64), twice, data, offsets


class RunIndex:
    """The run-compressed transform of some texts.

    Kept are, of each run, its head, its first row and the row that its first row comes from by an LF step; and at the edges
    between runs the bytes that the suffixes on both sides have in common, if those are `least` bytes or more (else 0). Each text
    ends in a terminator of its own, so that no match reaches beyond a text.
    """

    def __init__(self, texts: list[bytes], least: int = WINDOW) -> None:
        sizes = np.array([len(t) + 1 for t in texts], np.int32)
        self.ends = np.cumsum(sizes, dtype=np.int32) - np.int32(1)
        n = int(sizes.sum())
        self.length = n
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
        symbols[self.ends] = 0
        order = self._suffixes(symbols)
        heads = symbols[order - 1]
        edge = np.flatnonzero((heads[1:] != heads[:-1]) | (heads[1:] == 0)) + 1  # terminators all differ
        self.starts = np.concatenate(([0], edge))
        self.heads = heads[self.starts]
        sizes = np.diff(np.append(self.starts, n))
        by = np.lexsort((self.starts, self.heads))
        self.from_ = np.empty(len(by), np.int64)  # an LF step takes rows of one symbol, in their order, to consecutive rows
        self.from_[by] = np.cumsum(sizes[by]) - sizes[by]
        self.entry = np.empty(len(texts), np.int64)  # the row of each text's terminator
        top = order[: len(texts)]
        self.entry[self.text[top]] = np.arange(len(texts))
        first_at, last_at = order[edge], order[edge - 1]
        del order
        self.match = self._common(symbols, last_at, first_at, least)  # of a run's last row with the next run's first
        self._compare(symbols, last_at, first_at, least)

    def _left(self) -> np.ndarray:
        """Bytes from each position to its text's end."""
        return self.ends[self.text] - np.arange(self.length, dtype=np.int32)

    def _suffixes(self, symbols: np.ndarray) -> np.ndarray:
        """The suffix array, by prefix doubling; settled suffixes are not sorted again."""
        n, left = self.length, self._left()
        packed = np.zeros(n, np.int64)
        for j in range(7):
            packed <<= 9
            packed[: n - j] |= np.where(left[: n - j] >= j, symbols[j:], np.uint16(0))
        order = np.argsort(packed)
        short = np.flatnonzero(left[order] < 7)  # equal ones differ by their terminators
        some = order[short]
        order[short] = some[np.lexsort((self.text[some], packed[some]))]
        order = order.astype(np.int32)
        new = np.ones(n, bool)
        new[1:] = (packed[order[1:]] != packed[order[:-1]]) | (left[order[1:]] < 7)
        del packed, left
        start = np.flatnonzero(new).astype(np.int32)
        sizes = np.diff(np.append(start, np.int32(n)))
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(start, sizes)
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes)).astype(np.int32)
        h = 7
        while len(open_):
            at = order[open_]
            key = rank[at] * np.int64(n + 1) + rank[np.minimum(at + np.int32(h), np.int32(n - 1))] + 1
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[open_] = at
            fresh = np.ones(len(at), bool)
            fresh[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(fresh)
            sizes = np.diff(np.append(start, len(at)))
            rank[at] = np.repeat(open_[start], sizes)
            open_ = open_[np.repeat(sizes > 1, sizes)]
            h *= 2
        return order

    def _common(self, symbols: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
        """Bytes that the suffixes at x and y have in common, 0 if fewer than `least`, by bisection over prefix hashes; powers count from each text's start."""
        first = np.concatenate(([0], self.ends[:-1] + 1)).astype(np.int32)
        up, down = words.powers(int((self.ends - first).max(initial=0)) + 2)
        total = np.zeros(self.length + 1, np.uint64)
        place = np.arange(self.length, dtype=np.int32) - first[self.text]
        np.cumsum(symbols * up[place], out=total[1:])
        end = lambda p: self.ends[self.text[p]] - p
        same = lambda p, q, n: (total[p + n] - total[p]) * down[place[p]] == (total[q + n] - total[q]) * down[place[q]]
        most = np.minimum(end(x), end(y))
        out = np.zeros(len(x), np.int32)
        some = np.flatnonzero(most >= least)
        some = some[same(x[some], y[some], np.int32(least))]
        x, y, low, high = x[some], y[some], np.full(len(some), least, np.int32), most[some]
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = same(x, y, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        out[some] = low
        return out

    def _compare(self, symbols: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> None:
        """Compare the bytes of matches of `least` and more; prefix hashes only said that they are equal."""
        long = np.flatnonzero(self.match >= least)
        for at in range(0, len(long), 2048):
            some = long[at : at + 2048]
            step = np.arange(least)
            differ = symbols[x[some][:, None] + step] != symbols[y[some][:, None] + step]
            wrong = differ.any(axis=1)
            self.match[some[wrong]] = differ[wrong].argmax(axis=1)

    def matching_statistics(self) -> np.ndarray:
        """For each position, terminators too, the length of its longest match that starts elsewhere, if it is `least` bytes or more.

        All texts are streamed side by side, from their ends to their starts: the row of a position is that of the next one taken
        back by an LF step. Where a row is the first or last of its run, the common length with its neighbour there is a sample;
        any other position has with its neighbours one byte less in common than the position before it, so samples are
        carried on over the text, once for each neighbour.
        """
        sizes = np.diff(np.append(-1, self.ends))
        by = np.argsort(-sizes, kind="stable")
        active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(1, int(sizes.max()) + 1), "left")  # texts with as many positions
        row, ends, starts = self.entry[by], self.ends[by].astype(np.int64), self.starts
        upper, lower = np.full(self.length, -1, np.int32), np.full(self.length, -1, np.int32)
        long = np.diff(np.append(starts, self.length))
        samples = np.concatenate(([0], self.match, [0])).astype(np.int32)
        runs, within = np.empty(self.length, np.int32), np.empty(self.length, np.int32)
        for step, many in enumerate(active.tolist()):
            row, at = row[:many], ends[:many] - step
            run = starts.searchsorted(row, "right") - 1
            inner = row - starts[run]
            runs[at], within[at] = run, inner
            row = self.from_[run] + inner
        is_first, is_last = np.flatnonzero(within == 0), np.flatnonzero(within + 1 == long[runs])
        upper[is_first], lower[is_last] = samples[runs[is_first]], samples[runs[is_last] + 1]
        place = np.arange(self.length, dtype=np.int32)
        out = np.zeros(self.length, np.int32)
        for sampled in (upper, lower):
            source = np.maximum.accumulate(np.where(sampled >= 0, place, 0))
            np.maximum(out, sampled[source] + source - place, out=out)
        return out


def marked(texts: list[bytes], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Of each text the byte ranges covered by windows that also start elsewhere in these texts."""
    if not texts:
        return []
    index = RunIndex(texts, window)
    hit = np.flatnonzero(index.matching_statistics() >= window)
    owner = index.text[hit]
    at = hit - np.concatenate(([0], index.ends[:-1] + 1))[owner]
    return [spans(at[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")], window) for i in range(len(texts))]


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The union of the ranges start..start + window, starts ascending."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return list(zip(starts[np.concatenate(([0], gap + 1))].tolist(), (starts[np.concatenate((gap, [len(starts) - 1]))] + window).tolist(), strict=True))


def distinct_texts(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """tid and text of each different text once. copies: the tids that occur more than once; only those texts are shuffled."""
    filter_ = common.bit_filter(copies, "tid")
    rows = texts.where("tid is not null").select("tid", "text")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["tid", "text"]).filter(pa.array(~common.may_hold(filter_, batch.column("place").to_numpy())))

    alone = rows.withColumn("place", F.xxhash64("tid")).mapInArrow(single, rows.schema)
    return alone.unionByName(common.keep_likely(rows, "tid", filter_).dropDuplicates(["tid"]))


def _indexed(rows: pa.Table, starts: np.ndarray, window: int) -> pa.Table:
    """key, digest, first, last of the marked ranges of each segment of some whole buckets."""
    many, twice, size = rows["n"].to_numpy(), rows["twice"].to_numpy(), rows["size"].to_numpy()
    bare = rows["body"].is_null().to_numpy()
    found: list[tuple[int, int, int]] = [(i, 0, int(size[i])) for i in np.flatnonzero(many > 1)]
    batch: list[int] = []

    def flush() -> None:
        bodies = rows["body"].take(pa.array(batch, pa.int64())).to_pylist()
        for i, ranges in zip(batch, marked(bodies, window), strict=True):
            if many[i] == 1:
                found.extend((i, a, b) for a, b in ranges)
        batch.clear()

    held = 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if (b - a > 1 or twice[a]) and (many[a:b] == 1).any() and not bare[a:b].any():
            batch += range(a, b)
            held += int(size[a:b].sum())
            if held >= BATCH:
                flush()
                held = 0
    flush()
    take = pa.array([i for i, _, _ in found], pa.int64())
    return pa.table({"key": rows["key"].take(take), "digest": rows["digest"].take(take), "first": pa.array([a for _, a, _ in found], pa.int64()), "last": pa.array([b for _, _, b in found], pa.int64())})


#: A segment: its text, first byte, key of its bucket, digest, whether it may repeat itself, length, and bytes.
SEGMENT = "tid binary, at bigint, key bigint, digest binary, twice boolean, size bigint, body binary"


def _pieces(data: np.ndarray, window: int, steps: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By each of the steps: first byte, length and key of each piece of a segment, and whether it may repeat itself.

    Without a step (0) a piece is a single window. Else a window's key is the hash of its anchor and of as many whole steps of bytes on
    either side as it has, which leaves out fewer than two steps in all; a piece is a maximal run of windows of one key.
    """
    starts, gram = len(data) - window + 1, min(GRAM, window)
    first, out = np.arange(starts), []
    up, down = words.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    if any(steps):
        anchor = _anchors(data, window)
        other = np.append(False, anchor[1:] != anchor[:-1])
    for step in steps:
        if not step:
            out.append((first, np.full(starts, window), words.mix((total[window:] - total[:-window]) * down[:starts]).view(np.int64), np.zeros(starts, bool)))
            continue
        left, right = (anchor - first) // step * step, (first + window - gram - anchor) // step * step
        key = words.mix((total[anchor + gram + right] - total[anchor - left]) * down[anchor - left] + words.mix((left << 32 | right).astype(np.uint64)))
        new = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(new)
        out.append((at, np.diff(np.append(at, starts)) + window - 1, key[at].view(np.int64), np.logical_or.reduceat(other & ~new, at)))
    return out


def _counted(batches: Iterator[pa.RecordBatch], window: int, step: int, filters: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The keys of the pieces of different segments that have a window which may recur, and how often each stands there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, inverse, np.concatenate([m for _, m in held]))
        held.clear()
        return pa.RecordBatch.from_pydict({"key": pa.array(keys), "n": pa.array(n)})

    many = 0
    for batch in batches:
        for body, n in zip(batch.column("body"), batch.column("n").to_pylist(), strict=True):
            data = np.frombuffer(body.as_py(), np.uint8)
            cuts = _pieces(data, window, (*(s for s, _ in filters), step))
            first, _, key, twice = cuts.pop()
            some = np.logical_or.reduceat(_may_recur(len(data) - window + 1, cuts, filters), first)
            held.append((key[some], n * (1 + twice[some].astype(np.int64))))
            many += len(held[-1][0])
            if many >= COUNTED:
                yield flush()
                many = 0
    if held:
        yield flush()


def _may_recur(starts: int, cuts: list[tuple[np.ndarray, ...]], filters: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Which windows of a segment have, by all filters, a key that occurs more than once; those that do occur again all have."""
    out = np.ones(starts, bool)
    for (first, _, key, _), (_, filter_) in zip(cuts, filters, strict=True):
        out &= np.repeat(common.may_hold(filter_, key), np.diff(np.append(first, starts)))
    return out


#: A piece: bucket and digest of the segment that it is of, its first byte there, how many such segments there are, and what a segment has.
PIECE = "own_key bigint, own_digest binary, at bigint, n bigint, key bigint, digest binary, twice boolean, size bigint, body binary"


def _split(batches: Iterator[pa.RecordBatch], window: int, step: int | None, filters: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The pieces of different segments that may recur, single windows without their bytes. Without a step the runs of windows that may recur, in their old bucket."""
    for batch in batches:
        for i in range(batch.num_rows):
            body, n = batch.column("body")[i].as_py(), batch.column("n")[i].as_py()
            cuts = _pieces(np.frombuffer(body, np.uint8), window, tuple(s for s, _ in filters))
            if step is None:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], _may_recur(len(body) - window + 1, cuts, filters), [False])).astype(np.int8)))
                first, length = edge[::2], edge[1::2] - edge[::2] + window - 1
                key, twice = np.full(len(first), batch.column("key")[i].as_py(), np.int64), np.full(len(first), batch.column("twice")[i].as_py())
            else:
                first, length, key, twice = cuts[0]
                kept = common.may_hold(filters[0][1], key)
                first, length, key, twice = first[kept], length[kept], key[kept], twice[kept]
            for part in (slice(a, a + 4096) for a in range(0, len(first), 4096)):
                bodies = [body[a : a + m] for a, m in zip(first[part].tolist(), length[part].tolist(), strict=True)]
                prints = [hashlib.blake2b(x, digest_size=16).digest() for x in bodies]
                owner = pa.array(np.full(len(bodies), i))
                yield pa.RecordBatch.from_pydict({"own_key": batch.column("key").take(owner), "own_digest": batch.column("digest").take(owner), "at": pa.array(first[part]), "n": pa.array(np.full(len(bodies), n)), "key": pa.array(key[part]), "digest": pa.array(prints, pa.binary()), "twice": pa.array(twice[part]), "size": pa.array(length[part]), "body": pa.array([None] * len(bodies) if step == 0 else bodies, pa.binary())})


#: The marked ranges of different segments, one row each.
LISTED = "key bigint, digest binary, ranges array<struct<first:bigint,last:bigint>>"


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LISTED with ranges that touch or overlap made one."""
    for batch in batches:
        lists = batch.column("ranges")
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
        by = np.lexsort((first, owner))
        apart = owner[by] * (last.max(initial=0) + 1)
        first, last = first[by] + apart, np.maximum.accumulate(last[by] + apart)
        at = np.flatnonzero(np.append(True, first[1:] > last[:-1])[: len(first)])
        ends = np.append(at[1:], len(first))[: len(at)] - 1
        ranges = pa.StructArray.from_arrays([pa.array(first[at] - apart[at]), pa.array(last[ends] - apart[ends])], ["first", "last"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[by][at], minlength=len(sizes)))))
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "digest": batch.column("digest"), "ranges": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ranges)})


def _contents(rows: DataFrame, n: Column) -> DataFrame:
    """Different segments, each with how often it occurs."""
    return rows.groupBy("key", "digest", "twice", "size").agg(n.alias("n"), F.first("body").alias("body")).select("key", "digest", "n", "twice", "size", "body")


def _large(rows: DataFrame) -> DataFrame:
    """The keys of buckets with more than MOST_BYTES of different segments."""
    return common.saved(rows.select("key", "digest", "size").distinct().groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > MOST_BYTES).select("key"), "suffix-large")


def _listed(segments: DataFrame, n: Column, window: int, steps: tuple[int | None, ...] = (None, *STEPS)) -> DataFrame:
    """LISTED: the different segments that have marked ranges, one row each; n says how often a row of segments counts.

    The different segments of a large bucket lose the windows that can't recur, by keys that are only counted: what flanks a common
    passage goes, so that few different ones are left. Those of buckets still large are cut by the next of the steps into pieces, in
    buckets of their own. A segment that occurs twice is marked whole; the others get the united ranges of their pieces.
    """
    indexed = lambda some: common.map_groups(_contents(some, n), ["key"], lambda rows, starts: _indexed(rows, starts, window), "key bigint, digest binary, first bigint, last bigint").groupBy("key", "digest").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    large = _large(segments) if steps else None
    if large is None or large.isEmpty():
        return indexed(segments)
    wide = common.saved(_contents(segments.join(large, "key", "left_semi"), n), "suffix-wide")
    filters: list[tuple[int, np.ndarray]] = []
    for step in STEPS if steps[0] is None else steps[:1]:
        keys = wide.mapInArrow(lambda batches, step=step, known=tuple(filters): _counted(batches, window, step, known), "key bigint, n bigint")
        filters.append((step, common.repeated_filter(keys, "key", "n", "suffix-pieces")))
    pieces = common.saved(wide.mapInArrow(lambda batches: _split(batches, window, steps[0], filters), PIECE), "suffix-split")
    marks = pieces.where("n = 1").select("own_key", "own_digest", "at", "key", "digest").join(_listed(pieces, F.sum("n"), window, steps[1:]), ["key", "digest"])
    moved = F.transform("ranges", lambda r: F.struct((F.col("at") + r["first"]).alias("first"), (F.col("at") + r["last"]).alias("last")))
    parts = marks.select(F.col("own_key").alias("key"), F.col("own_digest").alias("digest"), moved.alias("ranges")).groupBy("key", "digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges")).mapInArrow(_united, LISTED)
    whole = wide.where("n > 1").select("key", "digest", F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("size").alias("last"))).alias("ranges"))
    return indexed(segments.join(large, "key", "left_anti")).unionByName(whole).unionByName(parts)


def repeated_ranges(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """tid, first, last: byte ranges of different texts (tid, text) covered by windows that start elsewhere in them too; ranges may overlap.

    Of a bucket with more than MOST_BYTES of different segments these are trimmed or cut, see _listed; a segment's row meets one row of marks.
    """
    counted = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"key": pa.array(s[3]), "n": pa.array(1 + s[4].astype(np.int64))}) for b in batches for s in _segments(b.column("text"), window)), "key bigint, n bigint")
    filter_ = common.repeated_filter(counted, "key", "n", "suffix-keys")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, first, length, key, twice, data, offsets in _segments(batch.column("text"), window):
                keep = common.may_hold(filter_, key)
                owner, first, length, key, twice = owner[keep], first[keep], length[keep], key[keep], twice[keep]
                at = offsets[owner] + first
                bodies = [data[x : x + n].tobytes() for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                prints = [hashlib.blake2b(x, digest_size=16).digest() for x in bodies]
                yield pa.RecordBatch.from_pydict({"tid": batch.column("tid").take(pa.array(owner)), "at": pa.array(first), "key": pa.array(key), "digest": pa.array(prints, pa.binary()), "twice": pa.array(twice), "size": pa.array(length), "body": pa.array(bodies, pa.binary())})

    segments = common.saved(texts.mapInArrow(likely, SEGMENT), "suffix-segments")
    marks = segments.select("tid", "at", "key", "digest").join(_listed(segments, F.count(F.lit(1)), window), ["key", "digest"])
    return marks.select("tid", "at", F.explode("ranges").alias("r")).select("tid", (F.col("at") + F.col("r.first")).alias("first"), (F.col("at") + F.col("r.last")).alias("last"))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and tid, the text's digest).

    Every byte covered by a string of `window` bytes that also starts anywhere else in the input, the same document included,
    is removed; n_spans counts maximal removed runs. Texts are UTF-8 bytes, null counts as empty; matches never cross
    documents. Equal documents, repeated rows too, are each other's matches and go whole if they have `window` bytes.
    """
    texts = common.texts_of(documents)
    known = common.saved(texts.where("tid is not null").groupBy("tid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("tid"), "suffix-copies")
    different = distinct_texts(texts, known)
    ranges = repeated_ranges(different, window).groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = distinct_texts(texts, known).join(ranges, "tid", "left").join(known.withColumn("copied", F.lit(True)), "tid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.strings(batch.column("text"))
            copied = batch.column("copied").is_valid().to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                if copied[i] and len(raw) >= window:
                    out.append((len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()))
                    continue
                keep, n_spans = np.ones(len(raw), bool), 0
                if batch.column("ranges")[i].is_valid:
                    change = np.zeros(len(raw) + 1, np.int64)
                    pairs = batch.column("ranges")[i].values
                    np.add.at(change, pairs.field("first").to_numpy(), 1)
                    np.add.at(change, pairs.field("last").to_numpy(), -1)
                    keep = np.cumsum(change[:-1]) == 0
                    gone = ~keep
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int((~keep).sum()), n_spans, hashlib.sha256(raw[keep].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_pydict({"tid": batch.column("tid"), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})

    results = joined.select("tid", "text", "ranges", "copied").mapInArrow(cut, "tid binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    zero = F.lit(0).cast("bigint")
    return (
        documents.select("doc_id", common.text_id(F.col("text")).alias("tid"))
        .join(results, "tid", "left")
        .select("doc_id", *(F.coalesce(c, zero).alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.coalesce("kept_sha256", F.sha2(F.lit(b""), 256)).alias("kept_sha256"), "tid")
    )
