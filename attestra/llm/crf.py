"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

#: Buckets of hashed features.
FEATURES = 1 << 16
#: Training takes at most this many different labelled texts, shared by the languages but LEAST_SAMPLE for each, chosen by hash, and
#: from each up to WINDOWS runs of LENGTH words.
SAMPLE, LEAST_SAMPLE, WINDOWS, LENGTH = 3000, 300, 3, 24
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.3, 11
#: Words of a block of the forward-backward pass.
BLOCK = 32
UNKNOWN = "und"


@dataclass
class Model:
    """Labels, weights (feature x label) and transitions (label x label, log potentials)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def features(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed features (word x 8: lexicon entry, prefixes and suffixes), trigram features of every byte, and each word's first trigram."""
    length = ends - starts
    fixed = np.empty((len(starts), 8), np.int64)
    fixed[:, 0] = (words.span_hashes(folded, starts, ends) >> np.uint64(48)).astype(np.int64)
    wide = folded.astype(np.uint64)
    head, tail = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    last = np.uint64(48)
    for k in range(4):
        inside = length > k
        tail = tail * np.uint64(257) + np.where(inside, wide[np.maximum(ends - 1 - k, starts)], np.uint64(0)) + np.uint64(1)
        fixed[:, 4 + k] = (words.mix(tail * np.uint64(8) + np.uint64(4 + k)) >> last).astype(np.int64)
        if k < 3:
            head = head * np.uint64(257) + np.where(inside, wide[np.minimum(starts + k, ends - 1)], np.uint64(0)) + np.uint64(1)
            fixed[:, 1 + k] = (words.mix(head * np.uint64(8) + np.uint64(k)) >> last).astype(np.int64)
    at = np.flatnonzero(folded)
    left, right = np.zeros(len(folded), np.uint64), np.zeros(len(folded), np.uint64)
    left[1:], right[:-1] = wide[:-1], wide[1:]
    left[starts], right[ends - 1] = 0, 0
    grams = words.mix(((left[at] << np.uint64(16)) | (wide[at] << np.uint64(8)) | right[at]) * np.uint64(8) + np.uint64(3))
    return fixed, (grams >> last).astype(np.int64), np.cumsum(length) - length


def emissions(weights: np.ndarray, fixed: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The score of each label for each word."""
    if not len(first):
        return np.zeros((0, weights.shape[1]), np.float32)
    out = np.add.reduceat(weights[grams], first, axis=0)
    for k in range(fixed.shape[1]):
        out += weights[fixed[:, k]]
    return out


def marginals(e: np.ndarray, transitions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exact forward-backward marginals of each word, for many chains at once.

    Chains are cut into blocks of BLOCK words. Block products of the step matrices are made for all blocks together and chained
    per document, then every block runs forward and backward from its true entry and exit vectors.
    """
    n_labels = e.shape[1]
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    pot = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    first_block, first_word = np.cumsum(blocks) - blocks, np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(e)) - first_word[owner]
    slot = (first_block[owner] + place // BLOCK) * BLOCK + place % BLOCK
    p = np.zeros((total * BLOCK, n_labels), np.float32)
    p[slot] = pot
    real = np.zeros(total * BLOCK, bool)
    real[slot] = True
    p, real = p.reshape(total, BLOCK, n_labels), real.reshape(total, BLOCK)
    product = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (total, n_labels, n_labels)).copy()
    for t in range(BLOCK):
        some = np.flatnonzero(real[:, t])
        if not len(some):
            break
        new = (product[some].reshape(-1, n_labels) @ step).reshape(len(some), n_labels, n_labels) * p[some, t, None, :]
        product[some] = new / np.maximum(new.max(axis=(1, 2), keepdims=True), 1e-30)
    enter, leave = np.full((total, n_labels), 1 / n_labels, np.float32), np.full((total, n_labels), 1.0, np.float32)
    for j in range(1, int(blocks.max()) if len(blocks) else 0):
        at = first_block[blocks > j] + j
        v = np.matmul(enter[at - 1][:, None, :], product[at - 1])[:, 0, :]
        enter[at] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-30)
        at = (first_block + blocks - 1 - j)[blocks > j]
        v = np.matmul(product[at + 1], leave[at + 1][:, :, None])[:, :, 0]
        leave[at] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-30)
    forward = np.empty_like(p)
    a = enter
    for t in range(BLOCK):
        new = (a @ step) * p[:, t]
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-30)
        a = np.where(real[:, t, None], new, a)
        forward[:, t] = a
    b = leave
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= b
        new = (p[:, t] * b) @ step.T
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-30)
        b = np.where(real[:, t, None], new, b)
    out = forward.reshape(-1, n_labels)[slot]
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of LENGTH words from places of each text that its hash (seed) chooses, as bytes of words joined by spaces."""
    for batch in batches:
        data, offsets = common.strings(batch.column("text"))
        folded, starts, ends, owner = words.word_spans(data, offsets)
        label, body = [], []
        seeds = batch.column("seed").to_numpy().view(np.uint64).tolist()
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            lo, hi = np.searchsorted(owner, (i, i + 1))
            rng = np.random.default_rng([SEED, seeds[i]])
            for at in sorted(set(rng.integers(lo, max(lo, hi - LENGTH) + 1, WINDOWS).tolist())) if hi > lo else []:
                label.append(lang)
                body.append(b" ".join(folded[starts[w] : ends[w]].tobytes() for w in range(at, min(hi, at + LENGTH))))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(label, pa.string()), "body": pa.array(body, pa.binary())})


def train(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit the field on a bounded sample of labelled documents: different texts of each language, the least by hash.

    documents: text and lang; rows without either teach nothing, and copies of a text teach once. The bound is `sample` texts,
    shared evenly by the languages, but LEAST_SAMPLE of each, so that rare languages are learned too. Which texts and which runs
    of theirs are taken depends on the texts alone. Half of the chains are a run of one language; half are two runs of different
    languages set together, so that the transitions learn how languages switch. None without labels.
    """
    labelled = documents.where("text is not null and lang is not null").select("text", "lang").withColumn("seed", F.xxhash64("text"))
    known = labelled.groupBy("lang").agg(F.approx_count_distinct("seed").alias("n")).collect()  # one row a language
    if not known:
        return None
    most = max(LEAST_SAMPLE, sample // len(known))
    share = F.create_map(*(x for r in known for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.3 * most / max(1, r["n"]))))))
    place = F.pmod(F.xxhash64("seed", F.lit(SEED)), F.lit(1 << 30))
    likely = labelled.where(place < F.try_element_at(share, F.col("lang")) * (1 << 30)).groupBy("lang", "seed").agg(F.min("text").alias("text"))
    chosen = likely.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy(place, "seed"))).where(F.col("__n") <= most).drop("__n")
    rows = chosen.select("text", "lang", "seed").mapInArrow(_windows, "lang string, body binary").toArrow()
    runs = sorted(zip(rows["lang"].to_pylist(), rows["body"].to_pylist(), strict=True))
    if not runs:
        return None
    labels = sorted({lang for lang, _ in runs})
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(runs))
    chains: list[tuple[list[bytes], list[int]]] = []
    for i in range(len(order)):
        x, y = runs[order[i]], runs[order[i - 1]]
        a, b = x[1].split(b" "), y[1].split(b" ")
        if i % 2 and x[0] != y[0]:
            k = max(1, min(len(a), LENGTH // 2)) if len(a) > 1 else 1
            a, b = a[:k], b[: LENGTH - k]
            chains.append((a + b, [labels.index(x[0])] * len(a) + [labels.index(y[0])] * len(b)))
        else:
            chains.append((a, [labels.index(x[0])] * len(a)))
    return _fit(labels, chains, rng)


def _fit(labels: list[str], chains: list[tuple[list[bytes], list[int]]], rng: np.random.Generator) -> Model:
    """Gradient ascent (Adagrad) on the conditional log-likelihood, its expectations by forward-backward."""
    n_labels = len(labels)
    weights, trans = np.zeros((FEATURES, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32)
    squares, trans_squares = np.full_like(weights, 1e-3), np.full_like(trans, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), BATCH):
            batch = [chains[i] for i in order[at : at + BATCH]]
            data = np.frombuffer(b" ".join(w for c, _ in batch for w in c), np.uint8)
            folded, starts, ends, _ = words.word_spans(data, np.array([0, len(data)]))
            gold = np.array([y for _, ys in batch for y in ys])
            counts = np.array([len(c) for c, _ in batch])
            fixed, grams, first = features(folded, starts, ends)
            e = emissions(weights, fixed, grams, first)
            error = -marginals(e, trans, counts)
            pairs = _pair_expectations(e, trans, counts)
            error[np.arange(len(gold)), gold] += 1
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(counts) - counts] = False
            seen = np.zeros_like(trans)
            np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
            trans_grad = (seen - pairs) / len(batch)
            grad = np.zeros_like(weights)
            spread = np.repeat(error, ends - starts, axis=0)
            for k in range(n_labels):
                grad[:, k] = np.bincount(grams, spread[:, k], FEATURES)
                for j in range(fixed.shape[1]):
                    grad[:, k] += np.bincount(fixed[:, j], error[:, k], FEATURES)
            grad = grad / len(batch) - 1e-6 * weights
            squares += grad**2
            trans_squares += trans_grad**2
            weights += RATE * 0.5 * grad / np.sqrt(squares)
            trans += RATE * 0.2 * trans_grad / np.sqrt(trans_squares)
    return Model(labels, weights, trans)


def _pair_expectations(e: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected counts of each pair of neighbouring labels, summed over chains (short ones, padded to the longest)."""
    step = np.exp(trans - trans.max())
    n, longest, n_labels = len(counts), int(counts.max()), e.shape[1]
    p, real = np.ones((n, longest, n_labels)), np.zeros((n, longest), bool)
    owner = np.repeat(np.arange(n), counts)
    place = np.arange(len(e)) - (np.cumsum(counts) - counts)[owner]
    p[owner, place] = np.exp(e - e.max(axis=1, keepdims=True))
    real[owner, place] = True
    a, forward = np.full((n, n_labels), 1 / n_labels), []
    for t in range(longest):
        new = (a @ step) * p[:, t]
        a = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), a)
        forward.append(a)
    b, total = np.ones((n, n_labels)), np.zeros((n_labels, n_labels))
    for t in range(longest - 1, 0, -1):
        joint = forward[t - 1][:, :, None] * step[None] * (p[:, t] * b)[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        total += joint[real[:, t]].sum(axis=0)
        new = (p[:, t] * b) @ step.T
        b = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), b)
    return total


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred and score: the label of the greatest mean marginal over all words, and that mean.

    Null texts and texts without a letter are `und` with score 0, as is every text if there is no model. Columns of these two
    names are replaced; others pass through.
    """
    source = documents.drop("lang_pred", "score")
    if model is None:
        return source.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    keyed = source.withColumn("__lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = source.columns
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES x labels: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = common.strings(batch.column("text"))
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for a, b in common.slices(offsets):
                folded, starts, ends, owner = words.word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts = np.bincount(owner, minlength=b - a)
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                p = marginals(emissions(m.weights, *features(folded, starts, ends)), m.transitions, counts[full])
                mean = np.add.reduceat(p, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64) / counts[full][:, None]
                best[a + full], score[a + full] = mean.argmax(axis=1), mean.max(axis=1)
            lettered = batch.column("__lettered").to_numpy(zero_copy_only=False) & (best >= 0)
            label = pa.array([m.labels[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], pa.string())
            value = pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), label, value], names=[*names, "lang_pred", "score"])

    schema = source.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return keyed.mapInArrow(run, schema)


def label_words(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and words: of each word of the text its place in UTF-8 bytes (first, last), the most likely label and its marginal.

    So code-switched texts show where their language changes. Null and wordless texts have no words; other columns play no part.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = "struct<first:int,last:int,lang:string,score:float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array(m.labels, object)
        for batch in batches:
            data, offsets = common.strings(batch.column("text"))
            for a, b in common.slices(offsets):
                folded, starts, ends, owner = words.word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts = np.bincount(owner, minlength=b - a)
                p = marginals(emissions(m.weights, *features(folded, starts, ends)), m.transitions, counts[counts > 0])
                base = offsets[owner + a] - offsets[a]
                best = p.argmax(axis=1)
                fields = [pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), pa.array(labels[best], pa.string()), pa.array(p.max(axis=1).astype(np.float32))]
                column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["first", "last", "lang", "score"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), column], names=["doc_id", "words"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, words array<{kind}>")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text is 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Where between an even chance and certainty the mean marginal of a text in a learned language lies at least. Texts of languages
#: that were not learned mostly score less (see the README), held-out texts of learned ones do not.
LEAST_EXCESS = 0.15


def least_score(model: Model | None) -> float:
    """The score from which a text counts as being in its predicted language."""
    n = len(model.labels) if model else 1
    return 1 / n + LEAST_EXCESS * (1 - 1 / n)


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the documents that are not held out; rows with a null doc_id teach nothing."""
    return train(documents.where(F.col("doc_id").isNotNull() & ~held_out()), sample)


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents with held_out, lang_pred and score, learned from the documents that are not held out.

    Rows with a null doc_id are predicted but teach nothing. An empty table gives no rows; if nothing teaches, all are `und`.
    Of labels with equal mean marginals the first in order wins. Texts of any length are read whole; columns named like the three
    added ones are replaced.
    """
    return predict(documents.withColumn("held_out", held_out()), fit(documents, sample))
