"""N-gram Jaccard join by MinHash banding, verified on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Words of a shingle, least similarity, chance to find a pair of just that similarity, and most hash functions.
SHINGLE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 1 - 1e-6, 128
#: A bucket of more members is compared block by block, so that no task holds more than two blocks.
BLOCK = 768
#: From this many members on, a group is compared by matrix products.
DENSE = 24


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) that reach the recall with at most `most` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _signatures(column: pa.Array, bands: int, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of each text (uint64, text x band), and its number of distinct shingles' upper bound (0: no words)."""
    data, offsets = common.strings(column)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    many = np.zeros(len(offsets) - 1, np.int64)
    rng = np.random.default_rng(20240607)
    factor = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, np.uint32)
    for a, b in common.slices(offsets):
        h, counts = words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        s, n = words.shingles(h, counts, k)
        many[a:b] = n
        full = np.flatnonzero(n)
        if not len(full):
            continue
        starts = (np.cumsum(n) - n)[full]
        low = (s >> np.uint64(32)).astype(np.uint32)
        held, buffer = np.zeros((len(full), bands), np.uint64), np.empty_like(low)
        for j in range(bands * rows):
            np.multiply(low, factor[j], out=buffer)
            np.add(buffer, shift[j], out=buffer)
            held[:, j // rows] = held[:, j // rows] * np.uint64(0x100000001B3) + np.minimum.reduceat(buffer, starts)
        out[a + full] = words.mix(held + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out, many


def signatures(texts: DataFrame, bands: int, rows: int, k: int = SHINGLE) -> DataFrame:
    """doc_id, tid and sig (the band hashes as 8-byte numbers; null where a text has no words) of each row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, many = _signatures(batch.column("text"), bands, rows, k)
            raw = sig.tobytes()
            width = 8 * bands
            column = pa.array([raw[i * width : (i + 1) * width] if many[i] else None for i in range(len(many))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), column], names=["doc_id", "tid", "sig"])

    return texts.where("tid is not null").mapInArrow(run, "doc_id bigint, tid binary, sig binary")


def _first_shared(rows: pa.Table, starts: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose first common band is the group's own, so that each pair counts in one bucket only.

    Where a bucket was cut into blocks, pairs within a block belong to the block's own group.
    """
    sig = common.fixed(rows["sig"], 8 * bands).view(np.uint64)
    band, block = rows["band"].to_numpy(), rows["block"].to_numpy()
    mixed = (rows["left"].to_numpy() != rows["right"].to_numpy())[starts[:-1]]
    sizes = np.diff(starts)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), 1 << 16):
            p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
            ok = (sig[p] == sig[q]).argmax(axis=1) == band[p]
            found.append((p[ok], q[ok]))

    small = np.flatnonzero((sizes < DENSE) & (sizes > 1))
    for d in range(1, int(sizes[small].max()) if len(small) else 0):
        some = small[sizes[small] > d]
        x = _ranges(starts[some], sizes[some] - d)
        y = x + d
        ok = ~np.repeat(mixed[some], sizes[some] - d) | (block[x] != block[y])
        take(x[ok], y[ok])
    for g in np.flatnonzero(sizes >= DENSE):
        x, y = np.triu_indices(sizes[g], 1)
        x, y = x + starts[g], y + starts[g]
        if mixed[g]:
            ok = block[x] != block[y]
            x, y = x[ok], y[ok]
        take(x, y)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] of them), then those of first[1], and so on."""
    return np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, ascending, and how many each has; made from about a megabyte of texts at a time."""
    data, offsets = common.strings(column)
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in common.slices(offsets):
        s, many = words.shingles(*words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k)
        owner = np.repeat(np.arange(b - a), many)
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        parts.append(s[new])
        sizes.append(np.bincount(owner[new], minlength=b - a))
    return np.concatenate(parts), np.concatenate(sizes)


def _verified(rows: pa.Table, starts: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Which pairs of rows have the similarity, by their full shingle sets."""
    s, size = _sets(rows["text"], k)
    owner = np.repeat(np.arange(len(size)), size)
    first = np.concatenate(([0], np.cumsum(size)))
    group = np.searchsorted(starts, x, "right") - 1
    by_group = np.argsort(group, kind="stable")
    sorted_ = group[by_group]
    common_ = np.zeros(len(x), np.int64)
    for g in np.unique(group):
        at = by_group[np.searchsorted(sorted_, g) : np.searchsorted(sorted_, g, "right")]
        a, b = int(starts[g]), int(starts[g + 1])
        if len(at) < 64:
            sets: dict[int, set] = {}
            for i in at:
                p, q = int(x[i]), int(y[i])
                for r in (p, q):
                    if r not in sets:
                        sets[r] = set(s[first[r] : first[r + 1]].tolist())
                common_[i] = len(sets[p] & sets[q])
        else:
            vocabulary, place, times = np.unique(s[first[a] : first[b]], return_inverse=True, return_counts=True)
            row, keep = owner[first[a] : first[b]] - a, times[place] > 1
            place, row = (np.cumsum(times > 1) - 1)[place[keep]], row[keep]
            by_place = np.argsort(place, kind="stable")
            place, row = place[by_place], row[by_place]
            shared = np.zeros((b - a, b - a), np.float32)
            for at_column in range(0, int((times > 1).sum()), 2048):
                lo, hi = np.searchsorted(place, (at_column, at_column + 2048))
                dense = np.zeros((b - a, 2048), np.float32)
                dense[row[lo:hi], place[lo:hi] - at_column] = 1
                shared += dense @ dense.T
            common_[at] = shared[x[at] - a, y[at] - a].astype(np.int64)
    return common_ >= threshold * (size[x] + size[y] - common_) - 1e-9


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(documents: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, edges, counts): the distinct texts, edges that connect just the texts that similar pairs connect, and each text's number of similar other texts.

    Distinct texts get MinHash signatures; those that share a band's hash meet in a bucket, whatever its size (large ones in
    pairs of blocks of BLOCK members, dealt to different tasks). A pair is verified in the bucket of its first common band only.
    """
    bands, rows_ = band_shape(threshold, recall)
    texts = common.texts_of(documents)
    copies = common.saved(
        signatures(texts, bands, rows_, k).groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig")),
        "jaccard-texts",
    )
    eight = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(F.col("sig"), i * 8 + 1, F.lit(8)), i).alias("bucket")))
    members = copies.where("sig is not null").select("tid", F.explode(eight).alias("b")).select("tid", "b.band", "b.bucket")
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = common.saved(members.join(full, "bucket"), "jaccard-buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        shared.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("tid", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "band", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "tid")
    )
    keys = ["bucket", "left", "right"]
    kept = "bucket bigint, left int, right int, band int, block int, tid binary"

    def meeting(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        used = np.unique(np.concatenate(_first_shared(rows, starts, bands)))
        return rows.select(["bucket", "left", "right", "band", "block", "tid"]).take(pa.array(used))

    needed = common.saved(common.map_groups(dealt.join(copies.select("tid", "sig"), "tid"), keys, meeting, kept), "jaccard-meetings")
    common.discard(shared)
    likely = common.keep_likely(texts, "tid", common.bit_filter(needed.select("tid").distinct(), "tid"))
    one = likely.join(copies.select("tid", "rep", "sig").join(needed.select("tid").distinct(), "tid", "left_semi"), "tid").where("doc_id <=> rep").select("tid", "sig", "text").dropDuplicates(["tid"])

    def verified(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y = _first_shared(rows, starts, bands)
        ok = _verified(rows, starts, x, y, k, threshold)
        x, y = x[ok], y[ok]
        n = np.bincount(x, minlength=rows.num_rows) + np.bincount(y, minlength=rows.num_rows)
        top = _forest(rows.num_rows, x, y)
        out = np.flatnonzero(n)
        return pa.table({"tid": rows["tid"].take(pa.array(out)), "top": rows["tid"].take(pa.array(top[out])), "n": pa.array(n[out], pa.int64())})

    found = common.saved(common.map_groups(needed.join(one, "tid"), keys, verified, "tid binary, top binary, n bigint"), "jaccard-links")
    common.discard(needed)
    counts = found.groupBy("tid").agg(F.sum("n").alias("n_links"))
    edges = found.where("tid <> top").select(F.col("tid").alias("a"), F.col("top").alias("b")).distinct()
    return copies, edges, counts


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (a, b) with the least node that it is connected with.

    Each round takes the least label among neighbours, then the label of that label, so that long chains halve; every round is
    written to the shared folder.
    """
    both = common.saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null"), "components-edges")
    labels = table = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "components")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        new = common.saved(step.join(jump, "root", "left").select("node", "was", F.least("root", "beyond").alias("root")), "components")
        done = new.where("root <> was").isEmpty()
        common.discard(table)
        labels, table = new.select("node", "root"), new
        if done:
            common.discard(both)
            return labels


def jaccard_groups(documents: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies (and tid, the text's digest).

    class_id is the least doc_id of all documents connected by equal texts or by pairs of Jaccard similarity >= threshold on
    sets of k-word shingles; n_links counts the different texts linked to this one directly, n_copies the rows of equal text.
    Null text: a class of its own (class_id = doc_id), no links, n_copies 1. Empty or wordless texts: copies only. Fewer than
    k words: one shingle of all words. Repeated rows each get a row. A null doc_id never names a class that has others.
    """
    copies, edges, counts = links(documents, k, threshold, recall)
    roots = components(edges)
    joined = copies.join(roots, copies.tid == roots.node, "left").select("tid", "rep", "n_copies", F.coalesce("root", "tid").alias("root"))
    tops = joined.groupBy("root").agg(F.min("rep").alias("class_id"))
    labelled = common.saved(joined.join(tops, "root").join(counts, "tid", "left").select("tid", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "jaccard-classes")
    return (
        documents.select("doc_id", common.text_id(F.col("text")).alias("tid"))
        .join(labelled, "tid", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "tid")
    )


def drop_near_copies(documents: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those whose class has a smaller doc_id; of rows with equal doc_id and text one stays."""
    columns = documents.columns
    classes = jaccard_groups(documents, k, threshold).where("doc_id <=> class_id").select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid")).distinct()
    keyed = documents.withColumn("__id", common.text_id(F.col("text")))
    kept = keyed.join(classes, (keyed.doc_id.eqNullSafe(classes["__doc"])) & (keyed["__id"].eqNullSafe(classes["__tid"])), "left_semi")
    return kept.dropDuplicates(["doc_id", "__id"]).select(*columns)
