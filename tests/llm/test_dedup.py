"""Suffix index, line chunks and Jaccard join against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import common, jaccard, lines, suffix, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_documents(seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ".\n"]) for _ in range(n))
    base = [make(rng.randint(3, 400)) for _ in range(40)]
    near = []
    for i in range(12):
        w = base[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    passage = make(120)
    mixed = [make(30) + passage + make(30) for _ in range(6)]
    odd = [None, "", "...", "a", "b c", "x" * 399, "x" * 400, "ab" * 900, "Ünï çödé " * 80, "\n" * 50, base[0], base[0], base[1].upper(), make(4000)]
    return [(i, t, "en", "s", 0) for i, t in enumerate(base + near + mixed + odd)] + [(7, base[7], "en", "s", 0), (None, base[3], None, None, None), (None, None, None, None, None)]


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_words_match_the_pattern():
    texts = ["Hello, World É9", "", None, "a-b", "ABC", "x"]
    import pyarrow as pa

    data, offsets = common.strings(pa.array(texts))
    folded, starts, ends, owner = words.word_spans(data, offsets)
    got = [(int(o), folded[a:b].tobytes().decode()) for o, a, b in zip(owner, starts, ends, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall((t or "").translate(FOLD))]


@pytest.mark.parametrize("most", [suffix.MOST_BYTES, 1500])
def test_suffix_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_BYTES", most)
    docs = [(d, t) for d, t, *_ in edge_documents(1)]
    got = suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").withColumn("tid", F.lit(1))).collect()
    bodies = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + 400] for _, b in bodies for i in range(len(b) - 399))
    want = []
    for d, b in bodies:
        ranges = suffix.spans(np.array([i for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1]), 400)
        gone = sum(y - x for x, y in ranges)
        kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in ranges)], [*(x for x, _ in ranges), len(b)], strict=True))
        want.append((d is None, d or 0, len(b), gone, len(ranges), hashlib.sha256(kept).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert sum(w[3] for w in want) > 5000


def test_near_copies_are_not_cut_into_a_row_a_byte(spark, monkeypatch):
    """op1: the rows of a group of near copies grow with its segments; a large bucket once gave a row for every byte of every copy."""
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(500))
    near = [text[:at] + f"<{i}>" + text[at + 3 :] for i, at in enumerate(rng.randrange(len(text) - 3) for _ in range(60))]
    docs = [(i, t) for i, t in enumerate([*near, *near[:10], "ab" * 900, text[:1500]])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(suffix, "MOST_BYTES", 5000)
    different = frame.select("text").distinct().select(F.encode("text", "utf-8").alias("tid"), "text")
    assert suffix.repeated_ranges(different).count() < len(near) * len(text) / 20
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(frame).collect()}
    seen = Counter(t[i : i + 400] for _, t in docs for i in range(len(t) - 399))
    for d, t in docs:
        ranges = suffix.spans(np.array([i for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1]), 400)
        assert got[d] == (sum(b - a for a, b in ranges), len(ranges))


@pytest.mark.parametrize("most", [40_000, 2000])
def test_a_segment_of_a_large_bucket_has_united_ranges(spark, monkeypatch, most):
    """op1: a passage between flanks of its own in every document; each piece of a segment once gave rows of ranges of its own."""
    rng = random.Random(29)
    letters = lambda n: "".join(rng.choices("abcd", k=n))
    passage = letters(900)
    docs = [(i, letters(rng.randint(150, 250)) + passage + letters(rng.randint(150, 250))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(suffix, "MOST_BYTES", most)
    ranges = suffix.repeated_ranges(frame.select(F.encode("text", "utf-8").alias("tid"), "text")).toPandas()
    segments = Counter(docs[i][1] for owner, *_ in suffix._segments(pa.array([t for _, t in docs]), 400) for i in owner.tolist())
    assert all(n <= segments[t] for t, n in Counter(bytes(x).decode() for x in ranges["tid"]).items())
    seen = Counter(t[i : i + 400] for _, t in docs for i in range(len(t) - 399))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(frame).collect()}
    for d, t in docs:
        want = suffix.spans(np.array([i for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1]), 400)
        assert got[d] == (sum(b - a for a, b in want), len(want))


def test_ranges_are_united_within_their_segment():
    """op1: ranges that touch or overlap become one; empty lists and the first ranges of the next segment are left apart."""
    lists = [[(5, 9), (0, 3), (3, 4), (6, 7)], [], [(0, 9), (2, 20), (21, 22)], [(0, 1)]]
    rows = pa.array([[{"first": a, "last": b} for a, b in x] for x in lists], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(4)), "digest": pa.array([b"x"] * 4), "ranges": rows})
    (got,) = suffix._united([batch])
    assert [[(r["first"], r["last"]) for r in x] for x in got.column("ranges").to_pylist()] == [[(0, 4), (5, 9)], [], [(0, 20), (21, 22)], [(0, 1)]]


def test_run_index_marks_what_brute_force_marks():
    rng = random.Random(3)
    for _ in range(60):
        w, letters = rng.choice([3, 5, 8]), rng.choice(["ab", "abc", "abcdefgh"])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).encode() for _ in range(rng.randint(1, 6))]
        texts += [texts[0] + b"x" + texts[-1]]
        seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
        want = [suffix.spans(np.array([i for i in range(len(t) - w + 1) if seen[t[i : i + w]] > 1]), w) for t in texts]
        assert suffix.marked(texts, w) == want


def test_line_chunks_resist_shifts_and_cover():
    rng = random.Random(5)
    for _ in range(50):
        body = "".join(rng.choice(["a\n", "bb\n", "ccc\n", "\n", "dd"]) for _ in range(rng.randint(0, 60))).encode()
        starts, ends, owner, n = lines.chunk_spans(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
        if body:
            assert starts[0] == 0 and ends[-1] == len(body) and (starts[1:] == ends[:-1]).all()
            assert n.sum() == body.count(b"\n") + (not body.endswith(b"\n"))
    many = [f"line {rng.random()}\n".encode() for _ in range(200)]
    cut = lambda ls: {b"".join(ls)[a:b] for a, b, *_ in zip(*lines.chunk_spans(np.frombuffer(b"".join(ls), np.uint8), np.array([0, sum(map(len, ls))])), strict=True)}
    assert len(cut(many) & cut([b"new\n", *many])) > 0.9 * len(cut(many))


def test_line_dedup_matches_brute_force(spark):
    docs = edge_documents(2)
    df = spark.createDataFrame(docs, SCHEMA).withColumn("n_removed_lines", F.lit("clash"))
    got = lines.drop_repeated_chunks(df).collect()
    order = sorted({(d is None, d or 0, hashlib.md5(t.encode()).digest(), t) for d, t, *_ in docs if t is not None})
    known, want = set(), {}
    for none, d, _, t in order:
        raw, out = t.encode(), []
        for a, b, _, n in zip(*lines.chunk_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), strict=True):
            body = raw[a:b]
            key = body.removesuffix(b"\n")
            if n < 2 or key not in known:
                out.append(body)
                if n >= 2:
                    known.add(key)
        want[none, d, t] = b"".join(out).decode()
    texts = Counter((d is None, d or 0, t) for d, t, *_ in docs)
    assert len(got) == len(docs)
    expect = Counter()
    for (none, d, t), n in texts.items():
        expect[none, d, None if t is None else want[none, d, t]] += n
    assert Counter((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == expect


def brute_passages(docs):
    """Lines of each document, and the numbers of those in a pair of successive lines (blank ones aside) that stands earlier too."""
    rows = {d: (t or "").split("\n") for d, t in docs}
    seen, gone = {}, {d: set() for d, _ in docs}
    for d, _ in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        full = [i for i, x in enumerate(rows[d]) if x.strip()]
        for i, j in zip(full, full[1:], strict=False):
            e, at = seen.setdefault(tuple(rows[d][i : j + 1]), (d, i))
            if e != d or at + j - i < i:
                gone[d] |= set(range(i, j + 1))
    return rows, gone


def test_line_passages_match_brute_force_over_pairs(spark):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(12))
    planted = [[line() for _ in range(n)] for n in (2, 3, 4, 5, 6) for _ in range(12)]
    docs = [(d, "\n".join(x for p in rng.sample(planted, 6) for x in [*(line() for _ in range(rng.randint(1, 3))), *p, *[""] * rng.randint(0, 1)])) for d in range(60)]
    docs += [(60, "a\na\na"), (61, "b\na\na\na\n"), (62, docs[0][1]), (63, docs[1][1] + "\n"), (64, docs[0][1].replace(line(), "")), (None, docs[2][1]), (65, "\n\n\n"), (66, "é\n\nü\n\n"), (67, "x\né\n\nü"), (68, None), (69, "")]
    got = {r.doc_id: r for r in lines.drop_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    rows, gone = brute_passages(docs)
    for d, t in docs:
        kept = lambda ls: [x for x in ls if x]
        assert kept((got[d].text or "").split("\n")) == kept([x for i, x in enumerate(rows[d]) if i not in gone[d]]), d
        assert got[d].n_removed_lines >= len(gone[d]) and (got[d].text is None) == (t is None)
    assert len([1 for d in range(60) if gone[d]]) > 50 and gone[62] and got[67].text == "x\n" and got[60].n_removed_lines == 0


def brute_classes(docs, threshold=0.8):
    sets = [shingle_set(t) for _, t, *_ in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = defaultdict(set)
    for i in range(len(docs)):
        for j in range(i):
            a, b = docs[i][1], docs[j][1]
            both = len(sets[i] & sets[j])
            near = both and both >= threshold * len(sets[i] | sets[j]) - 1e-9
            if a is not None and b is not None and (a == b or near):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
                if a != b:
                    links[i].add(b)
                    links[j].add(a)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[top(i)].append(i)
    least = {g: min((docs[i][0] for i in m if docs[i][0] is not None), default=None) for g, m in groups.items()}
    return [(docs[i][0], least[top(i)], len(links[i])) for i in range(len(docs))]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DENSE", 4)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    crowd = []
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{i}"
        crowd.append((1000 + i, " ".join(w), "en", "s", 0))
    docs = edge_documents(4) + crowd
    got = jaccard.jaccard_groups(spark.createDataFrame(docs, SCHEMA)).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(brute_classes(docs), key=key)


def test_jaccard_keeps_one_of_each_group(spark):
    docs = edge_documents(4)
    kept = jaccard.drop_near_copies(spark.createDataFrame(docs, SCHEMA)).collect()
    classes = {c for _, c, _ in brute_classes(docs) if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(classes)


def test_band_shape_reaches_its_recall():
    for threshold, recall in ((0.8, 1 - 1e-6), (0.5, 0.99)):
        bands, rows = jaccard.band_shape(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.MOST_HASHES


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix.remove_repeats(empty).count() == 0
    assert lines.drop_repeated_chunks(empty).count() == 0
    assert jaccard.jaccard_groups(empty).count() == 0
    assert jaccard.drop_near_copies(empty).count() == 0


def test_a_passage_in_ten_thousand_documents(spark):
    """Its edge buckets hold thousands of different segments; flanks that happen to be equal beside it go too."""
    rng = random.Random(17)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = letters(900)
    flanks = [(letters(rng.randint(150, 250)), letters(rng.randint(150, 250))) for _ in range(10_000)]
    rows = [(i, a + passage + b) for i, (a, b) in enumerate(flanks)]

    def longest(words_):
        order = sorted(range(len(words_)), key=lambda i: words_[i])
        out = [0] * len(words_)
        for x, y in zip(order, order[1:]):
            n = next((k for k, (p, q) in enumerate(zip(words_[x], words_[y])) if p != q), 0)
            out[x], out[y] = max(out[x], n), max(out[y], n)
        return out

    left, right = longest([a[::-1] for a, _ in flanks]), longest([b for _, b in flanks])
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {i: (900 + left[i] + right[i], 1) for i in range(len(rows))}


def test_passages_of_fifty_words_go_by_their_bytes(spark):
    """Passages of just over 50 words that many documents share: they go if and only if they have 400 bytes."""
    rng = random.Random(23)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    own = lambda: " ".join(word(rng.randint(3, 9)) for _ in range(60)) + "\n"
    planted = {k: "#" + " ".join(word(k) for _ in range(56)) + "#\n" for k in (4, 5, 6, 7, 8)}
    rows = [(i, own() + (planted[4 + i % 6] if i % 6 < 5 else "") + own()) for i in range(120)]
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        body = planted.get(4 + i % 6, "")
        assert (got[i] > 0) == (len(body) >= 400)
        assert got[i] == 0 or len(body) - 1 <= got[i] <= len(body) + 6  # equal bytes beside it belong to the match
