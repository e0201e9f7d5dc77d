"""Line dedup by content-defined chunks of lines, and by line pairs where a passage covers no whole chunk."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: A line may end a chunk if the hash of it and the line before is 0 modulo this.
DIVISOR = 2
#: Least lines of a chunk that may be removed.
LEAST_LINES = 2


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, end without the newline and text number of each line; a line holds its newline."""
    breaks = data == 10
    last = np.unique(np.concatenate((np.flatnonzero(breaks), offsets[1:][offsets[1:] > offsets[:-1]] - 1)))
    ends = last + 1
    starts = np.concatenate(([0], ends[:-1]))
    return starts, ends, np.where(breaks[last], last, ends), np.searchsorted(offsets, starts, "right") - 1


def chunk_spans(data: np.ndarray, offsets: np.ndarray, divisor: int = DIVISOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, text number and lines of each chunk of each text.

    A line holds its newline. A chunk ends after a line where the rolling hash of the last two line hashes hits the divisor and
    did not hit it one line before, so boundaries depend on three lines only and stand at the same lines in shifted copies, two
    lines apart at least. A single line left at the end joins the chunk before.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    starts, ends, bare, owner = line_spans(data, offsets)
    h = words.span_hashes(data, starts, bare)
    same = np.zeros(len(h), bool)
    same[1:] = owner[1:] == owner[:-1]
    rolled = np.zeros(len(h), np.uint64)
    rolled[1:] = words.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
    hit = same & (rolled % np.uint64(divisor) == 0)
    cut = hit.copy()
    cut[1:] &= ~(hit[:-1] & same[1:])
    final = np.append(~same[1:], True)
    before_final = np.append(final[1:] & same[1:], False)
    cut = (cut & ~before_final) | final
    at = np.flatnonzero(cut)
    first = np.concatenate(([0], at[:-1] + 1))
    return starts[first], ends[at], owner[at], at - first + 1


def _chunks(batch: pa.RecordBatch, wanted: np.ndarray | None) -> pa.RecordBatch:
    """doc_id, tid, number, chunk (hash) of each chunk of two lines or more; with its bytes and place if wanted tells which may matter."""
    data, offsets = common.strings(batch.column("text"))
    parts: list[tuple] = []
    for a, b in common.slices(offsets):
        piece = data[offsets[a] : offsets[b]]
        starts, ends, owner, lines = chunk_spans(piece, offsets[a : b + 1] - offsets[a])
        if not len(starts):
            continue
        bare = ends - (piece[ends - 1] == 10)
        number = np.arange(len(starts)) - np.searchsorted(owner, owner, "left")
        h = words.span_hashes(piece, starts, np.maximum(bare, starts)).view(np.int64)
        keep = lines >= LEAST_LINES
        if wanted is not None:
            keep &= common.may_hold(wanted, h)
        base = offsets[a]
        parts.append((owner[keep] + a, number[keep], h[keep], starts[keep] + base, ends[keep] + base, bare[keep] + base, lines[keep]))
    joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7
    row, number, h, start, end, bare, lines = joined
    take = pa.array(row)
    columns = {"doc_id": batch.column("doc_id").take(take), "tid": batch.column("tid").take(take), "number": pa.array(number), "chunk": pa.array(h)}
    if wanted is not None:
        first = offsets[row]
        columns |= {"first": pa.array(start - first), "last": pa.array(end - first), "lines": pa.array(lines), "body": pa.array([data[x:y].tobytes() for x, y in zip(start, bare, strict=True)], pa.binary())}
    return pa.RecordBatch.from_pydict(columns)


def _pairs(data: np.ndarray, offsets: np.ndarray, repeated: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, end without the newline, text number and hash of each two successive lines that are not blank, with what is between.

    Those inside one chunk that the bitmap of repeated chunks may hold are left out.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 5
    starts, ends, bare, owner = line_spans(data, offsets)
    inked = np.concatenate(([0], np.cumsum(data > 32)))
    full = np.flatnonzero(inked[bare] > inked[starts])
    a, b = full[:-1], full[1:]
    keep = owner[a] == owner[b]
    if repeated is not None:
        first, end, _, lines = chunk_spans(data, offsets)
        h = words.span_hashes(data, first, np.maximum(end - (data[end - 1] == 10), first)).view(np.int64)
        known = (lines >= LEAST_LINES) & common.may_hold(repeated, h)
        chunk = np.searchsorted(first, starts, "right") - 1
        keep &= ~((chunk[a] == chunk[b]) & known[chunk[a]])
    a, b = a[keep], b[keep]
    return starts[a], ends[b], bare[b], owner[a], words.span_hashes(data, starts[a], bare[b]).view(np.int64)


def _pair_rows(batch: pa.RecordBatch, column: str, repeated: np.ndarray | None, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """pair (hash) of each line pair of a column of texts or chunks; if wanted tells which may matter, also doc_id, tid, first, last and digest."""
    data, offsets = common.strings(batch.column(column))
    for lo, hi in common.slices(offsets):
        piece = data[offsets[lo] : offsets[hi]]
        start, end, bare, owner, h = _pairs(piece, offsets[lo : hi + 1] - offsets[lo], repeated)
        if wanted is None:
            yield pa.RecordBatch.from_pydict({"pair": pa.array(h, pa.int64())})
            continue
        keep = common.may_hold(wanted, h)
        start, end, bare, row, h = start[keep], end[keep], bare[keep], owner[keep] + lo, h[keep]
        digest = [hashlib.sha256(piece[x:y]).digest() for x, y in zip(start, bare, strict=True)]
        base = offsets[row] - offsets[lo]
        first, last = start - base, end - base
        if "first" in batch.schema.names:  # a chunk without its last newline
            at, to = (batch.column(x).to_numpy(zero_copy_only=False)[row] for x in ("first", "last"))
            first, last = first + at, last + at + ((bare == end) & (to - at > (offsets[1:] - offsets[:-1])[row]))
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(take), "tid": batch.column("tid").take(take), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64()), "pair": pa.array(h, pa.int64()), "digest": pa.array(digest, pa.binary())})


def _chunk_rows(documents: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The chunks that may be repeated, with bytes, digest and rank, and the bitmap that tells which those are."""
    texts = common.texts_of(documents).where("tid is not null")
    narrow = texts.mapInArrow(lambda batches: (_chunks(b, None) for b in batches), "doc_id bigint, tid binary, number bigint, chunk bigint")
    wanted = common.repeated_filter(narrow, "chunk", None, "line-hashes")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield _chunks(batch.slice(at, 1000), wanted)

    rows = common.saved(
        texts.mapInArrow(bodies, "doc_id bigint, tid binary, number bigint, chunk bigint, first bigint, last bigint, lines bigint, body binary")
        .withColumn("digest", F.unhex(F.sha2("body", 256)))
        .withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid", "number")),
        "line-chunks",
    )
    return rows, wanted


def _later(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.drop("body").join(known.where("n > 1").select("chunk", "digest", "origin"), ["chunk", "digest"]).where(~F.col("rank").eqNullSafe(F.col("origin"))).select("doc_id", "tid", "first", "last")


def repeated_chunks(documents: DataFrame) -> DataFrame:
    """doc_id, tid, first, last (bytes) of each chunk of two lines or more that stands earlier in the corpus too.

    Chunk hashes are counted over all documents; the bytes of chunks whose hash repeats are then compared by grouping on them.
    Earlier is by doc_id (nulls last), then text digest, then chunk number. Rows equal in doc_id and text are one document.
    """
    rows, _ = _chunk_rows(documents)
    return _later(rows, rows.groupBy("chunk", "body", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("origin")))


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, tid, first, last (bytes) of each repeated chunk and of each two successive lines, blank ones aside, that stand earlier too.

    So a passage of two lines or more goes whole, wherever the cuts of its chunks fall. Pairs inside a repeated chunk are taken
    from its first occurrence only, as the others go anyway; pairs are compared by SHA-256. A pair that overlaps the one it
    repeats, as in three equal lines, stays.
    """
    rows, repeated = _chunk_rows(documents)
    known = common.saved(rows.groupBy("chunk", "body", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("origin"), F.min(F.struct("rank", "first", "last")).alias("least")), "line-bodies")
    inner = known.select("least.rank.doc_id", "least.rank.tid", "least.first", "least.last", "body")
    texts = common.texts_of(documents).where("tid is not null")

    def pairs(wanted: np.ndarray | None, schema: str) -> DataFrame:
        def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _pair_rows(batch, "text", repeated, wanted)

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _pair_rows(batch, "body", None, wanted)

        return texts.mapInArrow(loose, schema).unionByName(inner.mapInArrow(within, schema))

    wanted = common.repeated_filter(pairs(None, "pair bigint"), "pair", None, "line-pair-hashes")
    found = common.saved(
        pairs(wanted, "doc_id bigint, tid binary, first bigint, last bigint, pair bigint, digest binary").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid", "first", "last")),
        "line-pairs",
    )
    origins = found.groupBy("pair", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("origin")).where("n > 1").select("pair", "digest", "origin")
    same = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("tid") == F.col("origin.tid"))
    later = found.join(origins, ["pair", "digest"]).where(~(same & (F.col("first") < F.col("origin.last")))).select("doc_id", "tid", "first", "last")
    return _later(rows, known).unionByName(later)


def drop_repeated_chunks(documents: DataFrame) -> DataFrame:
    """The documents, their text without chunks that stand earlier in the corpus, and n_removed_chunks, n_removed_lines.

    The first occurrence stays, by doc_id. Single lines are never removed. Null text stays null, empty stays empty; other
    columns pass through, those named like the two added ones are replaced.
    """
    return _without(documents, repeated_chunks(documents))


def drop_repeated_passages(documents: DataFrame) -> DataFrame:
    """As drop_repeated_chunks, but without all lines of repeated_passages; spans that overlap count as one chunk."""
    return _without(documents, repeated_passages(documents))


def _without(documents: DataFrame, found: DataFrame) -> DataFrame:
    added = ("n_removed_chunks", "n_removed_lines")
    source = documents.drop(*added)
    spans = (
        found.dropDuplicates(["doc_id", "tid", "first", "last"])
        .groupBy("doc_id", "tid")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__spans"))
        .select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid"), "__spans")
    )
    keyed = source.withColumn("__id", common.text_id(F.col("text")))
    joined = keyed.join(spans, keyed.doc_id.eqNullSafe(spans["__doc"]) & (keyed["__id"] == spans["__tid"]), "left")
    wide = joined.select(*source.columns, *(F.lit(0).cast("bigint").alias(x) for x in added), "__spans")
    names = [*source.columns, *added]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans_ = batch.column("text"), batch.column("__spans")
            out = texts.to_pylist()
            counts = np.zeros((2, batch.num_rows), np.int64)
            for i in np.flatnonzero(spans_.is_valid().to_numpy(zero_copy_only=False)):
                raw, merged = out[i].encode(), []
                for s in spans_[int(i)].as_py():
                    if merged and s["first"] < merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["last"])
                    else:
                        merged.append([s["first"], s["last"]])
                counts[:, i] = len(merged), sum(raw.count(b"\n", x, y) + (raw[y - 1] != 10) for x, y in merged)
                out[i] = b"".join(raw[x:y] for x, y in zip([0, *(y for _, y in merged)], [*(x for x, _ in merged), len(raw)], strict=True)).decode()
            new = {"text": pa.array(out, texts.type), added[0]: pa.array(counts[0]), added[1]: pa.array(counts[1])}
            yield pa.RecordBatch.from_arrays([new[x] if x in new else batch.column(x) for x in names], names=names)

    return wide.mapInArrow(cut, wide.drop("__spans").schema)
