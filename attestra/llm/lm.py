"""Document scores by masked pseudo-likelihood: a window network predicts every word from the words on both sides.

Words are counted exactly over the whole corpus. A word's code is a path of 32-way choices (the commonest words take one choice,
the others as many as the size of the vocabulary calls for, so that a leaf holds few words), and the network says
how far the context of two words on each side raises or lowers the share that each choice has in the corpus. Every word of every
document is a training target once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Choices of a level; of the first level's, how many are single words (the commonest) and how many are groups of the others.
FAN, FREQUENT = 32, 24
GROUPS = FAN - FREQUENT
#: Words aimed at in a leaf, of those that occur OFTEN (of others a context can't be learned), and most levels.
LEAF, OFTEN, MOST_LEVELS = 64, 8, 5
#: Most words that are told apart exactly; the rest share buckets, with the mean count of a bucket's words.
MOST_WORDS, MOST_BUCKETS = 1 << 18, 1 << 16
#: Words on each side, input rows of their own and by hash, and width of the hidden layer.
SIDE, OWN_ROWS, HASHED_ROWS, HIDDEN = 2, 1024, 1024, 16
ROWS = OWN_ROWS + HASHED_ROWS + 1
OFFSETS = [d for d in range(-SIDE, SIDE + 1) if d]
#: Bytes of text of a training group, most groups of a round, words of a step (products of so few rows are left to one thread),
#: rounds, and step sizes of input rows and of the rest.
GROUP_BYTES, MOST_GROUPS, STEP, ROUNDS, RATE_ROWS, RATE, SEED = 8 << 20, 1 << 14, 512, 2, 0.1, 0.5, 3


@dataclass
class Network:
    """All weights in one vector, and views of it: input rows by offset, their bias, steps taken, and outputs by level."""

    flat: np.ndarray

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(len(OFFSETS), ROWS, HIDDEN), (HIDDEN,), (MOST_LEVELS, FAN, HIDDEN), (MOST_LEVELS, HIDDEN, FAN)]

    @classmethod
    def new(cls) -> Network:
        rng = np.random.default_rng(SEED)
        scale = [0.3, 0.0, 0.3, 0.0]  # outputs of 0: at the start every choice has its share in the corpus
        return cls(np.concatenate([(rng.normal(size=s) * k).ravel() for s, k in zip(cls.shapes(), scale, strict=True)]).astype(np.float32))

    def views(self) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes():
            n = int(np.prod(s))
            out.append(self.flat[at : at + n].reshape(s))
            at += n
        return out


@dataclass
class Vocabulary:
    """The exactly known words by hash, ascending; for those and the buckets of the rest the input row, code and log-share of the leaf.

    A code is the choices of all levels, -1 behind the last. shares has for each level the log-share of each choice, given the
    number of what was chosen before.
    """

    known: np.ndarray
    row: np.ndarray
    code: np.ndarray
    log_share: np.ndarray
    shares: list[np.ndarray]

    @property
    def levels(self) -> int:
        return len(self.shares)

    def __post_init__(self) -> None:
        self.bits = max(1, int(len(self.known)).bit_length())
        head = (self.known >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(head, np.arange(1 << self.bits))
        self.longest = int(np.bincount(head, minlength=1).max()) if len(head) else 0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word: its own, or behind those its bucket's."""
        n = len(self.known)
        buckets = len(self.row) - n
        out = n + (hashes & np.uint64(buckets - 1)).astype(np.int64)
        if not n:
            return out
        at = self.start[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = np.arange(len(hashes))
        for _ in range(self.longest):
            here = np.minimum(at, n - 1)
            same = self.known[here] == hashes[open_]
            out[open_[same]] = here[same]
            more = ~same
            open_, at = open_[more], at[more] + 1
            if not len(open_):
                break
        return out


def _hashes(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, words' hashes and words of each text, about `size` bytes of texts at a time."""
    data, offsets = common.strings(column)
    for a, b in common.slices(offsets, size):
        h, counts = words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, h, counts


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), n of every different word of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, _ in _hashes(batch.column("text"), 4 << 20):
                word, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(n)})

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def codes(hashes: np.ndarray, rank: np.ndarray, levels: int) -> np.ndarray:
    """The choices of each word: its rank for the FREQUENT commonest, else a group and then choices by hash."""
    out = np.full((len(hashes), levels), -1, np.int16)
    mixed = words.mix(hashes)
    out[:, 0] = FREQUENT + (mixed % np.uint64(GROUPS)).astype(np.int64)
    for level in range(1, levels):
        out[:, level] = ((mixed >> np.uint64(8 + 5 * level)) % np.uint64(FAN)).astype(np.int64)
    common_ = rank < FREQUENT
    out[common_, 0] = rank[common_]
    out[common_, 1:] = -1
    return out


def vocabulary(texts: DataFrame) -> Vocabulary:
    """Count every word of every text; the driver gets MOST_WORDS and MOST_BUCKETS counts at most.

    The number of levels follows from the number of different words that occur OFTEN. A bucket stands for the words beyond MOST_WORDS with
    that hash, each with their mean count; a word that the corpus has not counts as half an occurrence.
    """
    counts = common.saved(word_counts(texts), "lm-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(MOST_WORDS).toArrow()
    known = top["word"].to_numpy().view(np.uint64)
    n = top["n"].to_numpy().astype(np.float64)
    rank = np.arange(len(known))
    different = counts.where(F.col("n") >= OFTEN).count()
    buckets = 1
    rest_n, rest_many = np.zeros(1), np.zeros(1)
    if len(known) == MOST_WORDS:
        least = (int(n[-1]), int(top["word"][-1].as_py()))
        rest = counts.where((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("word") > least[1])))
        buckets = MOST_BUCKETS
        held = rest.groupBy((F.col("word").bitwiseAND(F.lit(buckets - 1))).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("many")).toArrow()
        rest_n, rest_many = np.zeros(buckets), np.zeros(buckets)
        rest_n[held["bucket"].to_numpy()], rest_many[held["bucket"].to_numpy()] = held["n"].to_numpy(), held["many"].to_numpy()
    common.discard(counts)
    levels = 2
    while levels < MOST_LEVELS and GROUPS * FAN ** (levels - 1) * LEAF < different:
        levels += 1
    by = np.argsort(known)
    names = np.concatenate((known[by], np.arange(buckets, dtype=np.uint64)))  # a bucket's own number stands for its words
    code = codes(names, np.concatenate((rank[by], np.full(buckets, 1 << 40))), levels)
    row = np.concatenate((np.where(rank[by] < OWN_ROWS, rank[by], OWN_ROWS + (words.mix(known[by]) % np.uint64(HASHED_ROWS)).astype(np.int64)), OWN_ROWS + np.arange(buckets) % HASHED_ROWS))
    one = np.concatenate((n[by], np.where(rest_many > 0, rest_n / np.maximum(rest_many, 1), 0.5)))
    many = np.concatenate((np.ones(len(known)), np.maximum(rest_many, 1)))
    weight, parent, shares = one * many, np.zeros(len(names), np.int64), []
    for level in range(levels):
        here = np.flatnonzero(code[:, level] >= 0)
        chosen = parent[here] * FAN + code[here, level]
        total = np.bincount(chosen, weight[here], (GROUPS * FAN ** (level - 1) if level else 1) * FAN).reshape(-1, FAN) + 1e-3
        shares.append(np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32))
        parent[here] = _child(parent[here], code[here, level], level)
    parent[code[:, -1] < 0] = parent.max(initial=0) + 1 + code[code[:, -1] < 0, 0]  # words that are leaves of the first level
    _, leaf = np.unique(parent, return_inverse=True)
    return Vocabulary(known[by], row.astype(np.int32), code, np.log(one / np.bincount(leaf, weight)[leaf]), shares)


def _child(parent: np.ndarray, choice: np.ndarray, level: int) -> np.ndarray:
    """The number of what has been chosen with this level's choice; of the first level only groups have numbers."""
    return parent * FAN + choice if level else np.maximum(choice.astype(np.int64) - FREQUENT, 0)


def _context_rows(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Input rows of the words around each word, offset by offset; words of other texts are none (the last row)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.full((len(OFFSETS), len(rows)), ROWS - 1, np.int32)
    for j, d in enumerate(OFFSETS):
        if abs(d) >= len(rows):
            continue
        to, of = (slice(0, -d), slice(d, None)) if d > 0 else (slice(-d, None), slice(0, d))
        out[j, to] = np.where(owner[to] == owner[of], rows[of], ROWS - 1)
    return out


#: Words that are scored side by side.
SCORED = 1 << 13
#: Units of a whole number in exact products, and what hidden layers and weights are held under: sums of HIDDEN such products stay below 2^53.
UNITS, MOST_HIDDEN, MOST_WEIGHT = 1 << 16, 1 << 10, 1 << 7


def _exact(hidden: np.ndarray, out: np.ndarray) -> np.ndarray:
    """hidden @ out in whole units, which a double holds exactly in any order of the sum: a row comes out alike whatever stands beside it."""
    whole = np.minimum(hidden, np.float32(MOST_HIDDEN))  # no hidden layer is negative
    whole *= np.float32(UNITS)
    weights = np.rint(np.clip(out, -MOST_WEIGHT, MOST_WEIGHT) * np.float32(UNITS)).astype(np.float64) / UNITS**2
    return (np.rint(whole, out=whole).astype(np.float64) @ weights).astype(np.float32)


def _levels(net: list[np.ndarray], rows: np.ndarray, code: np.ndarray, shares: list[np.ndarray], product: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.matmul) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Level, the words that have it, their hidden layers and the logits of its choices, for words in their contexts (rows: offset x word)."""
    tables, bias, steps, outs = net
    before = bias + tables[0].take(rows[0], axis=0)
    for j in range(1, len(OFFSETS)):
        before += tables[j].take(rows[j], axis=0)
    some, parent = np.arange(rows.shape[1]), np.zeros(rows.shape[1], np.int64)
    for level, share in enumerate(shares):
        hidden = before
        if level:
            if level == 1:  # a code has one choice or all
                some = np.flatnonzero(code[:, 1] >= 0)
                before, parent = before.take(some, axis=0), parent[some]
            if not len(some):
                return
            hidden = before + steps[level].take(code[some, level - 1], axis=0)
        hidden = np.maximum(hidden, 0)
        logits = product(hidden, outs[level])
        logits += share.take(parent, axis=0) if level else share
        yield level, some, hidden, np.minimum(logits, 60, out=logits)  # so that no exponential overflows
        parent = _child(parent, code[some, level], level)


def log_probabilities(net: list[np.ndarray], rows: np.ndarray, code: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
    """The log-probability of each word's code in its context, the same to the bit in whatever company."""
    score = np.zeros(rows.shape[1])
    for level, some, _, logits in _levels(net, rows, code, shares, _exact):
        chosen = logits[np.arange(len(some)), code[some, level]]
        score[some] += chosen - np.log(np.exp(logits, out=logits).sum(axis=1))
    return score


_ONES, _CHOICES = np.ones(FAN, np.float32), np.arange(FAN, dtype=np.int16)[:, None]


def _learn(net: list[np.ndarray], rows: np.ndarray, code: np.ndarray, shares: list[np.ndarray]) -> None:
    """One step of gradient ascent on the log-probability of the words' codes.

    Outputs move by the mean gradient, rows of tables by their summed gradient over the root of how often they occur.
    """
    tables, bias, steps, outs = net
    n = rows.shape[1]
    back, deeper, moves = np.zeros((n, HIDDEN), np.float32), None, []
    for level, some, hidden, p in _levels(net, rows, code, shares):
        chosen = code[:, level] if len(some) == n else code[:, level].take(some)
        np.exp(p, out=p)
        p *= (1 / (p @ _ONES))[:, None]
        p.reshape(-1)[np.arange(0, p.size, FAN) + chosen] -= 1
        inner = p @ outs[level].T
        inner *= hidden > 0
        moves.append((level, hidden.T @ p))
        if not level:
            back = inner
            continue
        deeper = inner if deeper is None else deeper + inner
        before = code[:, level - 1].take(some)
        hot = (_CHOICES == before).astype(np.float32)
        steps[level] -= RATE_ROWS * (hot @ inner) / np.sqrt(np.maximum(np.bincount(before, minlength=FAN), 1)).astype(np.float32)[:, None]
    if deeper is not None:
        back[some] += deeper
    for level, out in moves:
        outs[level] -= RATE / n * out
    bias -= RATE / n * back.sum(axis=0)
    flat = (rows + np.arange(0, len(OFFSETS) * ROWS, ROWS, dtype=np.int32)[:, None]).ravel()
    by = np.argsort(flat.astype(np.int16), kind="stable")  # few enough rows for it, see ROWS
    at, moved = flat.take(by), back.take(by % n, axis=0)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    times = np.diff(np.append(first, len(at)))
    grad, often = moved.take(first, axis=0), times > 1  # most rows occur once
    if often.any():
        some = times[often]
        grad[often] = np.add.reduceat(moved.take(np.flatnonzero(np.repeat(often, times)), axis=0), np.cumsum(some) - some, axis=0)
    grad *= (RATE_ROWS / np.sqrt(times)).astype(np.float32)[:, None]
    every, at = tables.reshape(-1, HIDDEN), at.take(first)
    every[at] = every.take(at, axis=0) - grad


def _train(dealt: DataFrame, v: Vocabulary, start: Network) -> Network:
    """The mean, weighted by words, of what each group's documents, in the order of their hashes, make of the same start.

    dealt: group, text, sorted by group within partitions; a group is in one partition and is streamed.
    """
    shared = dealt.sparkSession.sparkContext.broadcast((v, start.flat))  # bounded by MOST_WORDS, MOST_BUCKETS and the network's size
    block = 1 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = shared.value
        total, seen = np.zeros(len(flat)), 0
        group, net, views, n = None, None, None, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def step(least: int) -> None:
            nonlocal held
            if not held:
                return
            rows, place = np.concatenate([r for r, _ in held], axis=1), np.concatenate([p for _, p in held])
            whole = len(place) // STEP * STEP if least else len(place)
            for a in range(0, whole, STEP):
                _learn(views, rows[:, a : a + STEP], v.code[place[a : a + STEP]], v.shares)
            held = [(rows[:, whole:], place[whole:])] if whole < len(place) else []

        def close() -> None:
            nonlocal total, seen
            if group is not None:
                step(0)
                total, seen = total + net.flat.astype(np.float64) * n, seen + n

        for batch in batches:
            ids = batch.column("group").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if ids[a] != group:
                    close()
                    group, net, n = ids[a], Network(flat.copy()), 0
                    views = net.views()
                for _, h, counts in _hashes(batch.column("text").slice(a, b - a)):
                    place = v.places(h)
                    held.append((_context_rows(v.row[place], counts), place))
                    n += len(h)
                    if sum(len(p) for _, p in held) >= 16 * STEP:
                        step(STEP)
        close()
        if seen:
            for first in range(0, len(total), block):
                yield pa.RecordBatch.from_pydict({"block": pa.array([first // block], pa.int32()), "w": pa.array([total[first : first + block].tolist()], pa.list_(pa.float64())), "n": pa.array([seen], pa.int64())})

    def added(rows: pa.Table) -> pa.Table:
        parts = np.stack(sorted((np.asarray(w) for w in rows["w"].to_pylist()), key=lambda w: w.tobytes()))
        return pa.table({"block": rows["block"].slice(0, 1), "w": pa.array([(parts.sum(axis=0) / sum(rows["n"].to_pylist())).tolist()], pa.list_(pa.float64()))})

    # one vector a partition, in blocks
    rows = dealt.mapInArrow(run, "block int, w array<double>, n bigint").groupBy("block").applyInArrow(added, "block int, w array<double>").toArrow()
    flat = start.flat.copy()
    for number, w in zip(rows["block"].to_pylist(), rows["w"].to_pylist(), strict=True):
        flat[number * block : number * block + len(w)] = w
    return Network(flat)


def fit(documents: DataFrame) -> tuple[Vocabulary, Network]:
    """Word counts and network weights of all documents' texts.

    Documents are dealt by a hash of doc_id and text to rounds, and within a round to groups of about GROUP_BYTES, each read in
    the order of that hash. So the result does not depend on how the table is laid out, but for the rounding of sums.
    """
    texts = documents.select("doc_id", "text").where("text is not null")
    v, net = vocabulary(texts), Network.new()
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = int(min(MOST_GROUPS, max(1, size // ROUNDS // GROUP_BYTES)))
    keyed = texts.withColumn("__h", F.xxhash64("doc_id", "text"))
    for k in range(ROUNDS):
        own = keyed.where(F.pmod("__h", F.lit(ROUNDS)) == k).select(F.pmod(F.floor(F.col("__h") / ROUNDS), F.lit(groups)).cast("int").alias("group"), "__h", "text")
        net = _train(own.repartition("group").sortWithinPartitions("group", "__h", "text").select("group", "text"), v, net)
    return v, net


def pseudo_likelihood(documents: DataFrame, model: tuple[Vocabulary, Network] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, log_likelihood (the sum of every word's conditional log-probability), mean_log_likelihood.

    The probability of a word is that of its code given two words on each side, times its count's share of its leaf; counts
    and weights come from all documents. Null, empty and wordless texts have 0 words, a sum of 0 and a null mean. Texts of any
    length are scored whole; repeated rows each get a row, and teach as often as they occur. Missing neighbours at the ends
    count as no word; other columns play no part. An empty table gives no rows.
    """
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast((model[0], model[1].flat))  # bounded as in _train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = shared.value
        net = Network(flat).views()
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, h, counts in _hashes(batch.column("text")):
                n[a : a + len(counts)] = counts
                if not len(h):
                    continue
                place = v.places(h)
                rows = _context_rows(v.row[place], counts)
                score = np.empty(len(h))
                for first in range(0, len(h), SCORED):
                    part = slice(first, first + SCORED)
                    score[part] = log_probabilities(net, rows[:, part], v.code[place[part]], v.shares)
                score += v.log_share[place]
                full = np.flatnonzero(counts)
                total[a + full] = np.add.reduceat(score, (np.cumsum(counts) - counts)[full])
            mean = pa.array(np.divide(total, n, out=np.zeros_like(total), where=n > 0), mask=n == 0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n), "log_likelihood": pa.array(total), "mean_log_likelihood": mean})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, log_likelihood double, mean_log_likelihood double")
