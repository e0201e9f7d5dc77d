"""Quality of documents: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Words are told apart by a hash to so many ids. A parameter of the model, the same for every corpus: the table of word vectors has
#: one size whatever the vocabulary, every word of every text counts, and words that share an id share a vector.
IDS = 1 << 16
#: Length of a vector, entries of an index vector that are not 0, and words to either side that make a word's context.
LENGTH, ENTRIES, SIDE = 64, 4, 2
#: Labelled texts that the network is fitted on at most, and the share of them that only calibrates.
SAMPLE, CALIBRATE = 20000, 0.2
#: Units of the hidden layer, passes over the sample, rows of a step, and the score from which a text counts as good.
HIDDEN, PASSES, STEP, GOOD = 32, 40, 64, 0.7
#: Bytes of text taken at a time, words taken at a time, and ids to a row of the shuffled table.
PIECE, WORDS, PART = 1 << 20, 1 << 17, 256
SEED = 13
#: What follows the pooled vectors in an input: norm of the mean, share of distinct ids, logarithm of the number of words.
EXTRAS = 3
INPUTS = 2 * LENGTH + EXTRAS

_KIND = np.full(256, 2, np.uint8)  # punctuation
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id of each word in order, and the number of words of each text.

    A word is a run of letters, digits and characters outside ASCII, or a run of other characters but blanks; case counts. Texts
    are taken PIECE bytes at a time, so a very long one needs little more than its words' ids.
    """
    kind = _KIND[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)
    ids = np.empty(len(starts), np.int32)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        a, b = starts[first], ends[last - 1]
        ids[first:last] = words.span_hashes(data[a:b], starts[first:last] - a, ends[first:last] - a) % np.uint64(IDS)
        first = last
    return ids, counts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each id: the places and signs of its index vector's entries, by hash; two on one place add up."""
    h = words.mix(np.arange(IDS * ENTRIES, dtype=np.uint64) + np.uint64(SEED << 32)).reshape(IDS, ENTRIES)
    return (h % np.uint64(LENGTH)).astype(np.int32), np.where((h >> np.uint64(32)) & np.uint64(1), 1, -1).astype(np.int32)


def contexts(ids: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """Add to total (id by place) the index vectors of the SIDE words before and after every word of the same text."""
    place, sign = index_vectors()
    owner = np.repeat(np.arange(len(counts)), counts)
    for step in range(1, SIDE + 1):
        for first in range(0, len(ids) - step, WORDS):
            a = np.arange(first, min(first + WORDS, len(ids) - step))
            a = a[owner[a] == owner[a + step]]
            for word, other in ((ids[a], ids[a + step]), (ids[a + step], ids[a])):
                pair, n = np.unique(word.astype(np.int64) * IDS + other, return_counts=True)
                word, other = pair // IDS, pair % IDS
                flat = (word[:, None] * LENGTH + place[other]).ravel()
                order = np.argsort(flat, kind="stable")
                flat, value = flat[order], (sign[other] * n[:, None]).ravel()[order]
                starts = np.flatnonzero(np.diff(flat, prepend=-1))
                if len(starts):
                    total.reshape(-1)[flat[starts]] += np.add.reduceat(value, starts)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The unit vector of every id (zeros if it has no context), from all texts: a table of IDS x LENGTH floats, 16 MB.

    A task adds up its texts and sends on one row for each PART ids that it has met; rows of one part meet in one task, which adds
    them as they come.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((IDS, LENGTH), np.int64), False
        for batch in batches:
            data, offsets = common.strings(batch.column("text"))
            for a, b in common.slices(offsets, 4 * PIECE):
                contexts(*word_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), total)
                any_ = True
        if any_:
            parts = total.reshape(-1, PART * LENGTH)
            for part in np.flatnonzero((parts != 0).any(1)):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([parts[part].tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                now = np.frombuffer(raw.as_py(), np.int64)
                sums[part] = sums[part] + now if part in sums else now
        for part, now in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([now.tobytes()], pa.binary())})

    schema = "part int, sums binary"
    found = documents.select("text").where(F.col("text").isNotNull()).mapInArrow(gather, schema).repartition("part").mapInArrow(add, schema)
    table = np.zeros((IDS // PART, PART * LENGTH), np.float32)
    for row in found.toLocalIterator():  # IDS / PART rows
        table[row["part"]] = np.frombuffer(row["sums"], np.int64)
    table = table.reshape(IDS, LENGTH)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One input row a text: mean and spread of its words' vectors, and the EXTRAS; zeros for a text without words."""
    out = np.zeros((len(counts), INPUTS))
    ends = np.cumsum(counts)
    for i in np.flatnonzero(counts):
        own = ids[ends[i] - counts[i] : ends[i]]
        seen, n = np.unique(own, return_counts=True)
        share = n / len(own)
        mean, square = np.zeros(LENGTH), np.zeros(LENGTH)
        for a in range(0, len(seen), WORDS):
            v = vectors[seen[a : a + WORDS]].astype(np.float64)
            mean += share[a : a + WORDS] @ v
            square += share[a : a + WORDS] @ (v * v)
        out[i, :LENGTH], out[i, LENGTH : 2 * LENGTH] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        out[i, 2 * LENGTH :] = np.linalg.norm(mean), len(seen) / len(own), np.log1p(len(own))
    return out


def features(documents: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and x, the pooled input of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.strings(batch.column("text"))
            for a, b in common.slices(offsets, 4 * PIECE):
                x = pooled(shared.value, *word_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, x binary")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text is 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """Inputs are centred and scaled, pass one hidden layer, and give a logit that the temperature divides."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(np.column_stack([z, np.ones(len(z))]) @ self.first)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.hidden(x), np.ones(len(x))]) @ self.second

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean cross-entropy of the labels."""
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on all but the last CALIBRATE of the rows by Adam, then set the temperature on those. One label alone gives a constant."""
    n = len(x) - int(len(x) * CALIBRATE)
    rng = np.random.default_rng(SEED)
    centre, scale = x.mean(0), x.std(0)
    net = Network(centre, np.where(scale > 1e-6, scale, 1), rng.normal(size=(x.shape[1] + 1, HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN + 1))
    net.second[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if not 0 < y.mean() < 1:
        return net
    z = np.column_stack([np.clip((x - net.centre) / net.scale, -8, 8), np.ones(len(x))])
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (net.first, net.second)]
    t = 0
    for epoch in range(PASSES):
        rate = 3e-3 * (1 - epoch / PASSES)
        for rows in np.array_split(rng.permutation(n), max(1, n // STEP)):
            t += 1
            h = np.column_stack([np.tanh(z[rows] @ net.first), np.ones(len(rows))])
            wrong = (1 / (1 + np.exp(-h @ net.second)) - y[rows]) / len(rows)
            back = np.outer(wrong, net.second[:-1]) * (1 - h[:, :-1] ** 2)
            for w, g, (m, v) in zip((net.first, net.second), (z[rows].T @ back + 1e-4 * net.first, h.T @ wrong + 1e-4 * net.second), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if n < len(x):
        logits, steps = net.logits(x[n:]), np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        net.temperature = float(min(steps, key=lambda s: loss(logits / s, y[n:])))
    return net


def fit(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network of at most `sample` labelled documents that are not held out, chosen by a hash of their ids; None if there are none.

    A document with several labels counts with their mean; labels that are null, or not between 0 and 1, don't count.
    """
    fine = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(F.col("y").between(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = common.saved(fine.groupBy("doc_id").agg(F.avg("y").alias("y")), "quality-labels")
    place, share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)), min(1.0, 2 * sample / max(known.count(), 1))
    few = known.where(place < int(share * (1 << 30)) + 1)  # about twice the sample, so that the sort below has little to do
    rows = found.join(few, "doc_id").orderBy(place, "doc_id", "x").limit(sample).toArrow()
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, INPUTS).astype(np.float64)
    return train(x, rows["y"].to_numpy())


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= GOOD, else 0) of every row of documents.

    Only texts are read for a score, whole. Null and empty texts have the score of an input of zeros; repeated rows and ids are
    scored row by row; a null id is not held out. Without usable labels every score is 0.5. An empty table gives no rows.
    """
    vectors = word_vectors(documents)
    found = common.saved(features(documents, vectors), "quality-inputs")
    net = fit(found, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, INPUTS).astype(np.float64)
            s = net.score(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= GOOD).astype(np.int32))})

    return found.mapInArrow(run, "doc_id bigint, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")
