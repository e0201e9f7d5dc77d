"""The advisory matcher of near-duplicate reports, and complete-link grouping."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..sources.tables import saved
from .tiles import PAIRS, by_groups, haversine

# Weights of the five signals, gates and thresholds.
WEIGHTS = {"char": 0.35, "word": 0.30, "edit": 0.15, "geo": 0.10, "time": 0.10}
GATE_KM, GATE_MIN, TEXT_GATE, COMBINED_GATE = 1.0, 15.0, 0.55, 0.70


def char_grams(key: str) -> np.ndarray:
    """The overlapping runs of three characters of a text key, each as its code points in one integer; none of a shorter key."""
    c = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def word_terms(key: str) -> np.ndarray:
    """64-bit hashes of the words of a text key."""
    return np.array([int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in key.split(" ") if w], np.int64)


def terms(keys: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, kind, h, tf: the different terms of text keys in ascending order, character n-grams (kind 0) and words (1), and how often each stands in its key."""
    parts = []
    for row, key in enumerate(keys):
        for kind, of in enumerate((char_grams, word_terms)):
            h, tf = np.unique(of(key or ""), return_counts=True)
            parts.append((np.full(len(h), row), np.full(len(h), kind), h, tf))
    row, kind, h, tf = (np.concatenate(v).astype(np.int64) for v in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    return row, kind, h, tf


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, h, n: the terms of text keys (key) and in how many keys of a batch each stands."""
    for batch in batches:
        _, kind, h, _ = terms(batch.column("key").to_pylist())
        for k in (0, 1):
            each, n = np.unique(h[kind == k], return_counts=True)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(each), k), pa.int32()), "h": pa.array(each), "n": pa.array(n.astype(np.int64))})


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, kind, h: the different terms of the text keys of each part (part, key); one that two batches have comes twice."""
    for batch in batches:
        row, kind, h, _ = terms(batch.column("key").to_pylist())
        part = batch.column("part").to_numpy()[row]
        by = np.lexsort((h, kind, part))
        part, kind, h = part[by], kind[by], h[by]
        new = np.ones(len(h), bool)
        new[1:] = (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]) | (h[1:] != h[:-1])
        yield pa.RecordBatch.from_pydict({"part": pa.array(part[new], pa.int64()), "kind": pa.array(kind[new], pa.int32()), "h": pa.array(h[new])})


class Vectors:
    """The weights of the terms of texts, every vector of length 1: (1 + ln tf) x (ln((1 + N) / (1 + df)) + 1), with the numbers of texts df that a table of terms (h ascending) has."""

    def __init__(self, texts: int, row: np.ndarray, h: np.ndarray, tf: np.ndarray, table: np.ndarray, df: np.ndarray, n: int):
        self.term, self.width = np.searchsorted(table, h), max(1, len(table))
        w = (1 + np.log(tf)) * (np.log((1 + n) / (1 + df[self.term])) + 1)
        self.w = w / np.sqrt(np.bincount(row, w * w, minlength=texts))[row]
        self.first = np.searchsorted(row, np.arange(texts + 1))

    def _rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' terms, (row of at, term), in ascending order, and their weights."""
        n = self.first[at + 1] - self.first[at]
        flat = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(at)), n) * self.width + self.term[flat], self.w[flat]

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of texts the sum of products over the terms that both have."""
        (x, v), (y, w) = self._rows(a), self._rows(b)
        place, weight = np.concatenate([x, y]), np.concatenate([v, w])
        order = np.argsort(place, kind="stable")
        place, weight = place[order], weight[order]
        both = np.flatnonzero(place[1:] == place[:-1])
        return np.bincount(place[both] // self.width, weight[both] * weight[both + 1], minlength=len(a)).astype(float)  # of nothing it makes integers


def edits(a: str, b: str, state: tuple[int, int, int] | None = None) -> int:
    """The Levenshtein distance, a row of the table at a time as the bits of two integers (Myers 1999, Hyyro 2003); b may be the rest behind a state."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, found = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = full, 0  # where the column grows and falls by one
    if state:
        more, less, found = state[0] & full, state[1] & full, state[2]
    for c in b:
        same = places.get(c, 0)
        down = same | less
        across = ((same & more) + more ^ more) | same
        up, fall = less | (full & ~(across | more)), more & across
        found += bool(up & last) - bool(fall & last)
        up, fall = (up << 1 | 1) & full, fall << 1 & full
        more, less = fall | (full & ~(down | up)), up & down
    return found


#: Bytes of tables of places that are held at once, how alike in blocks of 64 characters pairs that go side by side are, and the least number of them for a block.
TABLES, ALIKE, LEAST = 32 << 20, 0.7, 10


def all_edits(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The Levenshtein distance of each pair: pairs of like lengths side by side, where there are enough for it, others one by one."""
    out = np.zeros(len(pairs), np.int64)
    longer, shorter = zip(*((a, b) if len(a) >= len(b) else (b, a) for a, b in pairs), strict=True) if pairs else ((), ())
    blocks, steps = np.array([-(-len(a) // 64) for a in longer], np.int64), np.array([len(b) for b in shorter], np.int64)
    by = np.lexsort((-steps, -blocks))
    at = 0
    while at < len(by):
        most = int(blocks[by[at]])
        end = at + int(np.count_nonzero(blocks[by[at:]] >= max(1, ALIKE * most)))
        some = by[at : max(end, at + 1)]
        at += len(some)
        if len(some) < LEAST * most or not most:
            out[some] = [edits(longer[i], shorter[i]) for i in some.tolist()]
            continue
        some = some[np.argsort(-steps[some], kind="stable")]
        _, codes = np.unique(np.frombuffer("".join([*(longer[i] for i in some), *(shorter[i] for i in some)]).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        sizes = np.array([len(longer[i]) for i in some], np.int64)
        rows, columns = np.split(codes, [int(sizes.sum())])
        row, column = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(steps[some]))
        letters = int(codes.max()) + 1
        many = max(1, TABLES // (8 * letters * most))
        for a in range(0, len(some), many):
            b = min(a + many, len(some))
            least = min(LEAST * most, b - a)  # the few of the most steps are ended one by one
            stop = int(steps[some[a + least - 1]])
            found, more, less = _side_by_side(rows[row[a] : row[b]], sizes[a:b], columns[column[a] : column[b]], steps[some[a:b]], letters, stop)
            out[some[a:b]] = found
            for i, k in enumerate(some[a : a + least].tolist()):
                if steps[k] > stop:
                    whole = lambda v, i=i: int.from_bytes(v[:, i].tobytes(), "little")
                    out[k] = edits(longer[k], shorter[k][stop:], (whole(more), whole(less), int(found[i])))
    return out


def _side_by_side(rows: np.ndarray, sizes: np.ndarray, columns: np.ndarray, steps: np.ndarray, letters: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """edits of pairs of strings of numbers under `letters`, end to end, after `stop` steps, and where columns grow and fall, in blocks of 64 bits; steps descend."""
    n, blocks, one, top = len(sizes), -(-int(sizes.max()) // 64), np.uint64(1), np.uint64(63)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.zeros(blocks * n * letters, np.uint64)
    np.bitwise_or.at(places, (place // 64 * n + owner) * letters + rows, one << (place % 64).astype(np.uint64))
    places = places.reshape(blocks, n * letters)
    text = np.zeros((int(steps[0]), n), np.int64)
    owner = np.repeat(np.arange(n), steps)
    text[np.arange(len(columns)) - np.repeat(np.cumsum(steps) - steps, steps), owner] = columns + owner * letters
    active = n - np.searchsorted(steps[::-1], np.arange(len(text)), "right")
    more, less = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    ups, falls = np.zeros((blocks, n), np.uint64), np.zeros((blocks, n), np.uint64)
    last, bit, every, found = (sizes - 1) // 64, ((sizes - 1) % 64).astype(np.uint64), np.arange(n), sizes.copy()
    for step, m in enumerate(active[:stop].tolist()):
        at = text[step, :m]
        carried_up, carried_down = np.ones(m, np.uint64), np.zeros(m, np.uint64)
        for k in range(blocks):
            p, q, same = more[k, :m], less[k, :m], places[k].take(at)
            down = same | q
            same |= carried_down
            across = ((same & p) + p ^ p) | same
            up, fall = q | ~(across | p), p & across
            ups[k, :m], falls[k, :m] = up, fall
            next_up, next_down = up >> top, fall >> top
            up = up << one | carried_up
            more[k, :m] = (fall << one | carried_down) | ~(down | up)
            less[k, :m] = up & down
            carried_up, carried_down = next_up, next_down
        found[:m] += (ups[last[:m], every[:m]] >> bit[:m] & one).astype(np.int64) - (falls[last[:m], every[:m]] >> bit[:m] & one).astype(np.int64)
    return found, more, less


#: Pairs that meet with their texts in one group, and pairs whose terms meet at once.
TOGETHER, AT_ONCE = 8192, 1024
#: What a row of a group is: a pair, a text, or a term by its kind.
PAIR, TEXT, TERM = range(3)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, km, minutes; saved) with char and word, the cosines of their texts' vectors (0 without a common term), edit, the
    edit similarity of the keys of texts (id, key; saved), and said, whether both have a key that is not empty. A pair without a text goes.

    Pairs next to each other by their ids are a group. A text goes once to each group that needs it, and a group asks for each of its
    terms once; vectors are made and compared within the group, so none of them is shuffled.
    """
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * parts, -(-pairs.count() // TOGETHER))
    grouped = saved(pairs.repartitionByRange(groups, "a", "b").withColumn("part", F.spark_partition_id().cast("bigint")), "grouped")
    needs = grouped.select("part", F.explode(F.array("a", "b")).alias("id")).distinct()
    placed = saved(texts.join(needs, "id").select("part", "id", "key").repartition(parts, "part").sortWithinPartitions("part"), "placed")
    n = texts.count()
    df = texts.select("key").mapInArrow(counted, "kind int, h bigint, n bigint").groupBy("kind", "h").agg(F.sum("n").alias("df"))
    known = placed.select("part", "key").mapInArrow(asked, "part bigint, kind int, h bigint").join(df, ["kind", "h"])
    none = lambda kind: F.lit(None).cast(kind)
    rows = grouped.select("part", F.lit(PAIR).alias("what"), F.col("a").alias("i"), F.col("b").alias("j"), "km", "minutes", none("string").alias("key"))
    rows = rows.unionByName(placed.select("part", F.lit(TEXT).alias("what"), F.col("id").alias("i"), none("bigint").alias("j"), none("double").alias("km"), none("double").alias("minutes"), "key"))
    rows = rows.unionByName(known.select("part", (F.col("kind") + TERM).alias("what"), F.col("h").alias("i"), F.col("df").alias("j"), none("double").alias("km"), none("double").alias("minutes"), none("string").alias("key")))

    def group(rows: pa.Table) -> pa.Table:
        of = lambda what: rows.filter(pc.equal(rows["what"], what))
        t, p = of(TEXT), of(PAIR)
        by = np.argsort(t["i"].to_numpy())
        ids, keys = t["i"].to_numpy()[by], [k or "" for k in t["key"].take(pa.array(by)).to_pylist()]
        a, b = (np.searchsorted(ids, p[c].to_numpy()) for c in ("i", "j"))
        there = np.append(ids, 0)
        ok = (a < len(ids)) & (b < len(ids)) & (there[a] == p["i"].to_numpy()) & (there[b] == p["j"].to_numpy())
        p, a, b = p.filter(pa.array(ok)), a[ok], b[ok]
        row, kind, h, tf = terms(keys)
        scores = []
        for k in (0, 1):
            table = of(TERM + k)
            order = np.argsort(table["i"].to_numpy())
            v = Vectors(len(ids), row[kind == k], h[kind == k], tf[kind == k], table["i"].to_numpy()[order], table["j"].to_numpy()[order], n)
            scores.append(np.concatenate([v.dots(a[i : i + AT_ONCE], b[i : i + AT_ONCE]) for i in range(0, len(a), AT_ONCE)] or [np.zeros(0)]))
        both = [(keys[x], keys[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        edit = [1 - d / max(len(x), len(y), 1) for d, (x, y) in zip(all_edits(both).tolist(), both, strict=True)]
        said = [bool(x and y) for x, y in both]
        return pa.table({"a": p["i"], "b": p["j"], "km": p["km"], "minutes": p["minutes"], "char": scores[0], "word": scores[1], "edit": pa.array(edit, pa.float64()), "said": pa.array(said, pa.bool_())})

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        return pa.concat_tables([group(rows.slice(x, y - x)) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])

    return by_groups(rows, ["part"], work, "a bigint, b bigint, km double, minutes double, char double, word double, edit double, said boolean")


def proximity(value: Column, gate: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - value / gate)


def matched_pairs(pairs: DataFrame, texts: DataFrame, gate_km: float = GATE_KM, gate_min: float = GATE_MIN) -> DataFrame:
    """Candidate pairs (a, b, km, minutes) within the gates, scored over texts (id, text): text_score, combined, duplicate.

    A duplicate reaches both thresholds; an empty text never does.
    """
    close = pairs.where((F.col("km") <= gate_km) & (F.col("minutes") <= gate_min) & F.col("a").isNotNull() & F.col("b").isNotNull())
    close = saved(close.select(*(F.col(c).cast(t).alias(c) for c, t in (("a", "bigint"), ("b", "bigint"), ("km", "double"), ("minutes", "double")))), "close")
    ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: texts are dearer to count than their bytes tell
    used = saved(texts.join(ids, "id", "left_semi").select(F.col("id").cast("bigint").alias("id"), text_key(F.col("text")).alias("key")).repartition(parts, "id"), "texts")
    rows = compared(close, used)
    w = WEIGHTS
    text_part = w["char"] * F.col("char") + w["word"] * F.col("word") + w["edit"] * F.col("edit")
    scored = rows.withColumn("text_score", text_part / (w["char"] + w["word"] + w["edit"])).withColumn("combined", text_part + w["geo"] * proximity(F.col("km"), gate_km) + w["time"] * proximity(F.col("minutes"), gate_min))
    ok = (F.col("text_score") >= TEXT_GATE) & (F.col("combined") >= COMBINED_GATE) & F.col("said")
    return scored.select("a", "b", "text_score", "combined", ok.alias("duplicate"))


def swept(order: list[int], near: dict[int, set[int]]) -> dict[int, int]:
    """The group of each row: rows come in order, each meets the later ones that it fits, and two groups are joined if every pair of their members fits."""
    rank = {r: n for n, r in enumerate(order)}
    group, members, common = {r: r for r in order}, {r: {r} for r in order}, {r: near[r] for r in order}
    for i in order:
        for j in sorted((j for j in near[i] if rank[j] > rank[i]), key=rank.__getitem__):
            x, y = group[i], group[j]
            if x != y and members[y] <= common[x]:
                low, high = (x, y) if len(members[x]) >= len(members[y]) else (y, x)
                for k in members[high]:
                    group[k] = low
                members[low] |= members.pop(high)
                common[low] = common[low] & common.pop(high)
    return group


def complete_link(reports: DataFrame, km: float = 5.0, minutes: float = 180.0) -> DataFrame:
    """id, group of reports (id, at_s, lat, lng, kind, block): a sweep in time order that joins two groups only if every pair of members is compatible.

    The rule depends on the order of joins, so each block (a component of compatible reports, which no group leaves) is swept by
    one task; blocks run in parallel, and the pairs that fit are found for many blocks at once. Compatible means within km and
    minutes, and of one kind or without a kind. A null block is a report that fits no other.
    """

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        id_, at, lat, lng = (rows[c].to_numpy() for c in ("id", "at_s", "lat", "lng"))
        kind = rows["kind"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        by = np.lexsort((id_, at, block))
        id_, at, lat, lng, kind = (v[by] for v in (id_, at, lat, lng, kind))
        end = np.minimum(np.searchsorted(block * (1 << 40) + at, block * (1 << 40) + at + int(minutes * 60), "right"), starts[1:][block])
        near: dict[int, set[int]] = {i: set() for i in range(len(id_))}
        many, first = end - np.arange(len(id_)) - 1, 0
        total = np.cumsum(many)
        while first < len(id_):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
            m = many[first:last]
            i = np.repeat(np.arange(first, last), m)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            fits = ((kind[i] == kind[j]) | (kind[i] < 0) | (kind[j] < 0)) & (haversine(lat, lng, i, j) <= km)
            for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
                near[x].add(y)
                near[y].add(x)
            first = last
        group = np.array([g for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for _, g in sorted(swept(list(range(a, b)), near).items())], np.int64)
        least = np.full(len(id_), np.iinfo(np.int64).max)
        np.minimum.at(least, group, id_)
        return pa.table({"id": id_, "group": least[group]})

    schema = "id bigint, group bigint"
    rows = reports.select(F.col("id").cast("bigint").alias("id"), F.col("at_s").cast("bigint").alias("at_s"), "lat", "lng", "kind", "block")
    return by_groups(rows.where("block is not null"), ["block"], work, schema).unionByName(rows.where("block is null").select("id", F.col("id").alias("group")))
