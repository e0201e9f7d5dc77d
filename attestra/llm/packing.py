"""Packing of tokenized documents into fixed windows, planned by non-negative least squares over a length histogram."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Tokens of a window, and of a length bin (lengths count as the next multiple when combinations are planned).
WINDOW, UNIT = 1024, 8
#: Most lengths of an enumerated combination.
DEPTH = 3
#: Id set after each document, and the vocabulary's one special token.
END, SPECIAL = 0, {"<|endoftext|>": 50256}
#: Rows of a bin that one task numbers; each bin is dealt to so many salts that a salt has about this many.
SALT_ROWS = 1 << 14


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def default_vocabulary() -> tuple[str, str]:
    """Path and word pattern of the byte-level BPE of 50k ids, as ranks: the same vocabulary and ids as its tokenizers file, several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(documents: DataFrame, window: int = WINDOW, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: whole windows from a document's start on, then the rest.

    Where a document is cut depends on it alone, so tokens are made once and never stored. Null text counts as empty.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                ids = np.append(np.asarray(encoding.encode_to_numpy(text or "", allowed_special="all"), "<u4"), np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every descending combination of at most depth lengths that fills `units` exactly."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, head[-1] if head else left), 0, -1):
                if x * (depth - len(head)) >= left:
                    extend((*head, x), left - x)

    extend((), units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |ax - b| (the active-set method of Lawson and Hanson, on the normal equations)."""
    gram, goal = a.T @ a, a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(goal).max(initial=0)))
    for _ in range(4 * a.shape[0]):
        gain = np.where(passive, -np.inf, goal - gram @ x)
        j = int(gain.argmax())
        if gain[j] <= tolerance * scale:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), goal[at])
            low = s <= 0
            if not low.any():
                break
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            gone = at[low & (x[at] <= 1e-12 * scale)]
            passive[gone if len(gone) else at[low]] = False
            x[~passive] = 0
        x[:] = 0
        x[at] = s
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination of bins, repeats) that use each bin just as often as the histogram has it.

    histogram[b] pieces have a length of b units. Repeat counts of the enumerated combinations come from non-negative least
    squares, rounded down and held to what is there; the rest is packed greedily, the largest bin that fits first, many equal
    windows at a time. Work and result depend on the number of bins only, not on the number of pieces.
    """
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = [((units,), int(left[units]))] if left[units] else []
    left[units] = 0
    options = combinations(units, depth)[1:] if units > 1 else []
    if options and left.sum():
        a = np.zeros((units + 1, len(options)))
        for j, combination in enumerate(options):
            np.add.at(a[:, j], list(combination), 1)
        x = nnls(a, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            need = a[:, j].astype(np.int64)
            used = need > 0
            n = min(int(x[j] + 1e-6), int((left[used] // need[used]).min()))
            if n > 0:
                left -= n * need
                out.append((options[j], n))
    while left.sum():
        space, chosen, rest = units, [], left.copy()
        for b in range(units, 0, -1):
            n = min(int(rest[b]), space // b)
            chosen += [b] * n
            space -= n * b
        need = np.bincount(chosen, minlength=units + 1)
        used = need > 0
        n = int((left[used] // need[used]).min())
        left -= n * need
        out.append((tuple(chosen), n))
    return out


def pack(documents: DataFrame, window: int = WINDOW, unit: int = UNIT, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each token of each document is in exactly one piece; the pieces of a sequence lie side by side from offset 0 and have
    `window` tokens at most. Null and empty texts have one token (the end id). Repeated rows are packed each; rows with null
    doc_id too. An empty table gives no rows. The pieces, narrow rows, are written once; the driver sees a histogram of
    window/unit bins and plans combinations of bins, which is all that is sent to tasks.
    """
    units = window // unit
    binned = common.saved(pieces(documents, window, vocabulary).withColumn("bin", F.ceil(F.col("length") / unit).cast("int")), "packing-pieces")
    histogram = np.zeros(units + 1, np.int64)
    for r in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["bin"]] = r["n"]
    salts = F.element_at(F.array(*(F.lit(1 + int(n) // SALT_ROWS) for n in histogram)), F.col("bin") + 1)
    rows = binned.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts))
    counts = common.saved(rows.groupBy("bin", "salt").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base, used = 0, np.zeros(units + 1, np.int64)
    for combination, repeats in plan(histogram):
        for slot, b in enumerate(combination):
            slots.setdefault(b, []).append((int(used[b]), repeats, base, slot))
            used[b] += repeats
        base += repeats
    tables = {b: np.array(x, np.int64) for b, x in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            bins, rank = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                at = np.flatnonzero(bins == b)
                table = tables[int(b)]
                found = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                sequence[at] = found[:, 2] + rank[at] - found[:, 0]
                slot[at] = found[:, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    before = counts.select("bin", "salt", (F.sum("n").over(Window.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    ranked = rows.withColumn("number", F.row_number().over(order) - 1).join(before, ["bin", "salt"]).withColumn("rank", F.col("before") + F.col("number"))
    placed = ranked.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")
