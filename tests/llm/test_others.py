"""The other corpus operators: brute force, exact round trips and held-out accuracy, and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import ann, crf, lm, packing, queries, shards, warc, winnowing, words
from tests.compare import of_duckdb, of_spark
from tests.llm.test_dedup import FOLD, SCHEMA, WORD, edge_documents


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert of_spark(queries.queries()[name](spark, sf_dir)) == of_duckdb(sf_dir, queries.oracle_sql()[name])


def test_winnowing_matches_brute_force(spark):
    docs = edge_documents(6)
    text = [t for _, t, *_ in docs]
    w = text[20].split()
    items = [(1, " ".join(w[3:40])), (2, "b c"), (3, None), (4, "..."), (None, " ".join(text[21].split()[:15])), (10, "a"), (1, "B, C"), (5, text[60][:300])]
    got = winnowing.decontaminate(spark.createDataFrame(docs, SCHEMA).withColumn("prints", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    tokens = lambda t: WORD.findall((t or "").translate(FOLD))
    windows = {}
    for item, t in items:
        v = tokens(t)
        k = min(10, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            windows.setdefault((k, tuple(v[i : i + k])), set()).add(item)
    want = []
    for d, t, *_ in docs:
        v, hit, found = tokens(t), set(), set()
        for k in {k for k, _ in windows}:
            for i in range(len(v) - k + 1):
                if (k, tuple(v[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[k, tuple(v[i : i + k])]
        ids = sorted(str(i) for i in found if i is not None)
        want.append((d is None, d or 0, len(v), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)


def test_winnowing_without_items(spark):
    docs = spark.createDataFrame(edge_documents(6), SCHEMA)
    got = winnowing.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)


def test_marginals_match_a_plain_chain():
    rng = np.random.default_rng(0)
    trans, counts = rng.normal(size=(3, 3)), np.array([1, 40, 5, 33, 70])
    e = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    got, at = crf.marginals(e, trans.astype(np.float32), counts), 0
    for n in counts:
        p, a, forward = np.exp(e[at : at + n].astype(float)), np.full(3, 1 / 3), []
        for t in range(n):
            a = (a @ np.exp(trans)) * p[t]
            a /= a.sum()
            forward.append(a)
        b = np.ones(3)
        for t in range(n - 1, -1, -1):
            m = forward[t] * b
            assert np.allclose(m / m.sum(), got[at + t], atol=1e-5)
            b = np.exp(trans) @ (p[t] * b)
            b /= b.sum()
        at += n


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = crf.identify(docs).where("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(bool(r.h) == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs.select("doc_id", crf.held_out().alias("h")).collect())


def test_language_edges(spark):
    docs = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate([None, "", "123 456", "the cat and the dog", "a", "日本語"] * 3)] + [(None, "the end", "en", "s", 0)]
    got = crf.identify(spark.createDataFrame(docs, SCHEMA).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == len(docs)
    assert all((r.lang_pred == "und") == (r.text in (None, "", "123 456")) for r in got)
    none = crf.identify(spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert crf.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_fit_does_not_depend_on_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in crf.identify(d).collect()} for d in (docs, docs.repartition(9)))
    assert one.keys() == two.keys()
    assert all(one[k][0] == two[k][0] and abs(one[k][1] - two[k][1]) < 1e-4 for k in one)


def test_language_sample_is_bounded_and_leaves_no_language_out(spark):
    rng = random.Random(9)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(40))
    hot = make("abcd")
    docs = [(i, hot, "hot") for i in range(3000)] + [(i, make("efgh"), "big") for i in range(3000, 5000)] + [(i, make("ijkl"), "rare") for i in range(5000, 5004)]
    model = crf.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), 100)
    assert model.labels == ["big", "hot", "rare"]


def test_texts_in_an_unlearned_script_are_rejected(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(2)
    greek = [(1_000_000 + i, " ".join("".join(rng.choices("αβγδεζηθικλμνξοπρστυφχψω", k=rng.randint(2, 8))) for _ in range(80)), None, "s", 0) for i in range(30)]
    both = docs.unionByName(spark.createDataFrame(greek, SCHEMA).select(*docs.columns))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, sf_dir).collect()}
    assert not any(d >= 1_000_000 for d in kept)
    assert len(kept) > 0.97 * docs.where("text is not null").count()


def test_words_of_code_switched_texts_are_labelled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = crf.fit(docs)
    long = docs.where("length(text) > 400")
    de, en = (long.where(F.col("lang") == x).orderBy("doc_id").first()["text"][:300] for x in ("de", "en"))
    probe = spark.createDataFrame([(1, de + " " + en), (2, None), (3, "..."), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r["words"] for r in crf.label_words(probe, model).collect()}
    assert got[2] == got[3] == got[4] == []
    raw, edge = (de + " " + en).encode(), len(de.encode())
    right = [w.lang == ("de" if w.first < edge else "en") for w in got[1]]
    assert np.mean(right) > 0.85 and [raw[w.first : w.last].decode().lower() for w in got[1]] == WORD.findall((de + " " + en).translate(FOLD))


def test_language_of_very_long_texts(spark):
    docs = [(i, "the end of it " * 3, "en") for i in range(20)] + [(i, "que lo de la " * 3, "es") for i in range(20, 40)] + [(99, "the end of it " * 100_000, None)]
    got = {r.doc_id: r.lang_pred for r in crf.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[99] == "en"


def test_code_switched_chain_labels_words():
    runs = {"a": [b"thing", b"other", b"with", b"then"], "b": [b"qui", b"que", b"eau", b"oui"]}
    rng = np.random.default_rng(1)
    chains = []
    for i in range(300):
        x, y = ("a", "b") if i % 2 else ("b", "a")
        pick = lambda k, n: [runs[k][j] for j in rng.integers(0, 4, n)]
        chains.append((pick(x, 6) + pick(y, 6), ["ab".index(x)] * 6 + ["ab".index(y)] * 6))
    model = crf._fit(["a", "b"], chains, rng)
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]
    data = np.frombuffer(b"thing other with qui eau oui", np.uint8)
    folded, starts, ends, _ = crf.words.word_spans(data, np.array([0, len(data)]))
    p = crf.marginals(crf.emissions(model.weights, *crf.features(folded, starts, ends)), model.transitions, np.array([6]))
    assert p.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1]


def test_packing_is_whole_and_gapless(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = [(d, t) for d, t, *_ in edge_documents(7)] + [(500, "a <|endoftext|> b\u0085 c\r\n\t 12345 don't ’s 漢字🙂" * 9)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").withColumn("bin", F.lit("clash"))).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            want.append((d is None, d or 0, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    rows = [(r.doc_id != r.doc_id or r.doc_id is None, 0 if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()]
    assert sorted(rows) == sorted(want)
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert g.groupby("sequence_id").length.sum().max() <= 1024


def test_packing_wastes_little_and_takes_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = packing.pack(docs).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("sequences")).first()
    assert n.tokens / (1024 * n.sequences) > 0.97
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_uses_each_bin_exactly():
    rng = np.random.default_rng(2)
    for units in (1, 2, 7, 32, 128):
        h = rng.integers(0, 500, units + 1)
        h[0] = 0
        used = np.zeros(units + 1, np.int64)
        for combination, n in packing.plan(h):
            assert sum(combination) <= units and n > 0
            np.add.at(used, list(combination), n)
        assert (used == h).all()
    h = np.zeros(129, np.int64)
    h[[30, 98, 64, 20, 44]] = [100, 100, 200, 50, 50]
    plan = packing.plan(h)
    assert sum(n for _, n in plan) * 128 <= 1.02 * (h * np.arange(129)).sum() + 128


def test_nnls_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.random(8)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-5 and np.abs(gain[x > 1e-9]).max(initial=0) < 1e-5


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>x"), (2, "http://b", "<p>x"), (3, None, None), (4, "u", ""), (None, "v", "only"), (None, "w", "<p>x"), (5, "z", "é" * 50000), (2, "http://b", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = str(tmp_path / "w")
    index = warc.write(df, folder)
    back = warc.read(index, folder).collect()
    want = []
    for p, _, h in pages:
        body = (h or "").encode()
        same = [q for q, _, g in pages if (g or "") == (h or "") and q is not None]
        top = max(same, default=None)
        want.append((p is None, p or 0, len(body), warc.digest(body), "response" if p == top else "revisit", None if p == top else top))
    assert sorted(map(str, ((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back))) == sorted(map(str, want))
    assert {bytes(r.payload).decode() for r in back if r.payload is not None} == {h or "" for _, _, h in pages}
    one = warc.read(index, folder, F.col("page_id") == 5).collect()
    assert [r.page_id for r in one] == [5]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    small = warc.read(warc.write(df, folder, least_revisit=100), folder).where("record_type = 'revisit'")
    assert small.count() == 0


def test_warc_notices_damage():
    member = bytearray(warc.record(1, "u", b"payload", None))
    assert warc.parse(bytes(member))["payload"] == b"payload"
    import gzip

    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(bytes(member)).replace(b"payload\r", b"pAyload\r")))


def test_shards_keep_every_row(spark, tmp_path):
    docs = spark.createDataFrame(edge_documents(8), SCHEMA)
    store = shards.arrive(docs, str(tmp_path / "s"), arrivals=7)
    got = store.read().drop("shard")
    assert got.exceptAll(docs).count() == 0 and docs.exceptAll(got).count() == 0
    assert len(store.shards()) < 7 and not shards.merges(store.shards())
    version = store.versions()[-1]
    with pytest.raises(shards.Conflict):
        store.commit([], version)
    before = store.shards()
    store.append(docs.limit(1))
    assert store.shards(version) == before and store.read(version).count() == docs.count()
    empty = shards.arrive(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert empty.read().count() == 0


def test_only_a_version_that_exists_is_a_conflict_and_young_versions_stay(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 0) for i in range(20)], SCHEMA).coalesce(1)
    store = shards.ShardStore(spark, str(tmp_path / "s"), docs.schema)
    for _ in range(3):
        store.append(docs)
    with monkeypatch.context() as patch:
        patch.setattr(store, "_manifest", lambda version: f"{store.folder}/nowhere/v{version:08d}.json")
        with pytest.raises(Exception) as error:
            store.commit([], 9)
        assert not isinstance(error.value, shards.Conflict)
    store._swap({store.shards()[0].path}, [])
    assert store.vacuum() == 0 and store.read(1).count() == 20  # a reader of version 1 goes on
    assert store.vacuum(older_than=0) == 1 and store.versions() == [4] and store.read().count() == 40


@pytest.mark.parametrize("name", ["with space", "per%20cent 100%", "ü-ß", "plus+and&"])
def test_store_in_odd_folders_keeps_every_row(spark, tmp_path, name):
    rows = [(i, f"text {i}", "x", i % 3, None) for i in range(1000)] + [(1, "text 1", "x", 1, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, __run int, __file string").repartition(3)
    store = shards.arrive(docs, str(tmp_path / name), arrivals=6)
    got = store.read()
    assert len(store.shards()) < 18 and got.columns == [*docs.columns, "shard_"]
    got = got.drop("shard_")
    assert got.exceptAll(docs).count() == 0 and docs.exceptAll(got).count() == 0


def test_writers_side_by_side_and_orphans(spark, tmp_path, monkeypatch):
    one = spark.range(50).select(F.col("id").alias("doc_id"))
    store = shards.ShardStore(spark, str(tmp_path / "s"), one.schema)
    other = shards.ShardStore(spark, str(tmp_path / "s"), one.schema)
    commit, once = store.commit, []

    def late(files, version):
        if not once:  # another writer commits first
            once.append(other.append(one))
        commit(files, version)

    monkeypatch.setattr(store, "commit", late)
    store.append(one)
    assert store.read().count() == 100 and store.versions() == [1, 2]
    one.write.parquet(str(tmp_path / "s" / "data" / "left-behind"))
    assert store.sweep() == 0 and store.sweep(-60) > 0 and store.sweep(-60) == 0
    assert store.read().count() == 100
    with pytest.raises(ValueError):
        shards.ShardStore(spark, str(tmp_path / "a[b]"), one.schema)


def test_merges_are_size_tiered():
    mb = 1 << 20
    some = [shards.Shard(f"s{i}", mb) for i in range(10)] + [shards.Shard("big", 40 * mb), shards.Shard("mid", 9 * mb)]
    groups = shards.merges(some, target=4 * mb * 2)
    assert all(sum(s.size for s in g) <= 8 * mb and len(g) > 1 for g in groups)
    assert {s.path for g in groups for s in g} <= {f"s{i}" for i in range(10)}
    assert shards.merges(some[:3]) == []


def chain_texts(seed, n, words_=400):
    """Texts in which each word allows only few next words, though all words are about as common."""
    rng = random.Random(seed)
    names = [f"w{i:03d}x" for i in range(words_)]
    out = []
    for _ in range(n):
        i, text = rng.randrange(words_), []
        for _ in range(120):
            text.append(names[i])
            i = (i * 7 + rng.choice((1, 5))) % words_
        out.append(" ".join(text))
    return out


def test_pseudo_likelihood_uses_the_order_of_rare_words(spark):
    """On held-out text the context must beat the words' own shares, and real order the same words shuffled."""
    train = spark.createDataFrame(list(enumerate(chain_texts(1, 1500))), "doc_id long, text string")
    model = lm.fit(train)
    held = chain_texts(2, 60)
    rng = random.Random(3)
    mixed = [" ".join(rng.sample(t.split(), 120)) for t in held]
    probe = spark.createDataFrame([(i, t) for i, t in enumerate(held + mixed)], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in lm.pseudo_likelihood(probe, model).collect()}
    real, shuffled = (sum(got[i] for i in ids) / 60 for ids in (range(60), range(60, 120)))
    assert real > -np.log(400) + 0.5 and real > shuffled + 0.5
    assert sum(got[i] > got[i + 60] for i in range(60)) >= 57


def test_pseudo_likelihood_does_not_depend_on_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row", F.lit(1)).withColumn("group", F.lit("x"))
    one, two = ({r.doc_id: r.log_likelihood for r in lm.pseudo_likelihood(d).collect()} for d in (docs, docs.repartition(13)))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) / (1 + abs(one[k])) for k in one) < 1e-4


def test_a_step_of_training_is_the_plain_gradient():
    """op4: a step moves the weights as sums taken word by word do."""
    rng = np.random.default_rng(5)
    n, levels = 300, 3
    rows = rng.integers(0, lm.ROWS, (len(lm.OFFSETS), n)).astype(np.int32)
    rows[:, ::3] = rows[0, 0]
    code = rng.integers(0, lm.FAN, (n, levels)).astype(np.int16)
    code[:, 0] = rng.integers(0, lm.FAN, n)
    code[code[:, 0] < lm.FREQUENT, 1:] = -1
    shares = [rng.normal(size=(k, lm.FAN)).astype(np.float32) for k in (1, lm.GROUPS, lm.GROUPS * lm.FAN)]
    start = lm.Network(lm.Network.new().flat + rng.normal(size=lm.Network.new().flat.shape).astype(np.float32) * np.float32(0.1))
    got = lm.Network(start.flat.copy())
    lm._learn(got.views(), rows, code, shares)
    want = lm.Network(start.flat.astype(np.float64))
    tables, bias, steps, outs = want.views()
    first = [v.copy() for v in want.views()]
    back, out, step, times = np.zeros((n, lm.HIDDEN)), np.zeros_like(outs), np.zeros_like(steps), np.zeros(steps.shape[:2])
    for i in range(n):
        before, parent = first[1] + sum(first[0][j, rows[j, i]] for j in range(len(lm.OFFSETS))), 0
        for level in range(levels if code[i, 1] >= 0 else 1):
            last = code[i, level - 1]
            hidden = np.maximum(before + (first[2][level, last] if level else 0), 0)
            p = np.exp(np.minimum(hidden @ first[3][level] + shares[level][parent], 60))
            p /= p.sum()
            p[code[i, level]] -= 1
            inner = first[3][level] @ p * (hidden > 0)
            back[i] += inner
            out[level] += np.outer(hidden, p)
            if level:
                step[level, last] += inner
                times[level, last] += 1
            parent = parent * lm.FAN + code[i, level] if level else max(int(code[i, level]) - lm.FREQUENT, 0)
    outs -= lm.RATE / n * out
    bias -= lm.RATE / n * back.sum(axis=0)
    steps -= lm.RATE_ROWS * step / np.sqrt(np.maximum(times, 1))[:, :, None]
    for j in range(len(lm.OFFSETS)):
        for r in np.unique(rows[j]):
            some = rows[j] == r
            tables[j, r] -= lm.RATE_ROWS * back[some].sum(axis=0) / np.sqrt(some.sum())
    np.testing.assert_allclose(got.flat, want.flat, atol=2e-4)


def test_pseudo_likelihood_is_the_sum_over_words(spark):
    """One document's sum, word by word from the weights, and the edge cases."""
    docs = [(i, t) for i, t in enumerate(chain_texts(5, 200, 120))]
    docs += [(0, docs[0][1]), (None, docs[1][1]), (900, None), (901, ""), (902, "!!"), (903, "one"), (904, "W001X w001x " * 60_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    v, net = lm.fit(frame)
    got = lm.pseudo_likelihood(frame.withColumn("n_words", F.lit("clash")).withColumn("h", F.lit(0)), (v, net)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)
    by = {r.doc_id: r for r in got}
    assert [(by[i].n_words, by[i].log_likelihood, by[i].mean_log_likelihood) for i in (900, 901, 902)] == [(0, 0.0, None)] * 3
    assert by[904].n_words == 120_000 and by[904].log_likelihood < 0
    assert len({r.log_likelihood for r in got if r.doc_id == 0}) == 1
    tables, bias, steps, outs = (x.astype(float) for x in net.views())
    for doc in (3, 903):
        tokens = WORD.findall(dict(docs)[doc].translate(FOLD))
        place = [int(v.places(words.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0]) for w in tokens]
        total = 0.0
        for i, p in enumerate(place):
            base = bias.copy()
            for j, d in enumerate(lm.OFFSETS):
                base += tables[j][v.row[place[i + d]] if 0 <= i + d < len(place) else lm.ROWS - 1]
            parent = 0
            for level, share in enumerate(v.shares):
                choice = int(v.code[p, level])
                if choice < 0:
                    break
                logits = np.maximum(base + (steps[level][v.code[p, level - 1]] if level else 0), 0) @ outs[level] + share[parent]
                total += logits[choice] - np.log(np.exp(logits).sum())
                parent = parent * lm.FAN + choice if level else max(choice - lm.FREQUENT, 0)
            total += v.log_share[p]
        assert by[doc].log_likelihood == pytest.approx(total, rel=1e-4)
    assert lm.pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pseudo_likelihood_of_all_words_sums_to_one(spark):
    texts = chain_texts(7, 60, 90)
    v, net = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    place = np.arange(len(v.known))
    rows = np.repeat(np.array([[3], [5], [7], [lm.ROWS - 1]]), len(place), axis=1)
    p = np.exp(lm.log_probabilities(net.views(), rows, v.code[place], v.shares) + v.log_share[place])
    assert 0.98 < p.sum() < 1.001  # the rest belongs to words that the corpus has not


def test_search_recall_and_order(spark, sf_dir):
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = ann.search(embeddings).collect()
    rows = embeddings.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:], strict=False))
        assert all(np.isclose(s, x[ids == v][0] @ x[q]) for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(best.tolist()))
        total += min(20, len(ids) - 1)
    assert hit / total >= 0.9


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (40, None)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1))).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_gives_all_candidates_and_meets_its_target(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(3000)]
    schema, all_ids = "vec_id long, embedding array<float>", F.col("vec_id") < 20
    few = ann.search(spark.createDataFrame([*vectors[:20], (3, vectors[40][1])], schema), all_ids).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(a, b) for a in range(20) for b in range(20) if a != b]
    monkeypatch.setattr(ann, "MOST_PROBES", 2)
    got = ann.search(spark.createDataFrame(vectors, schema)).collect()
    x, hit = np.array([v for _, v in vectors], np.float32).astype(float), 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 150 * 20 and hit / len(got) >= 0.9


def test_search_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0 + float(rng.random()) * 1e-3, *map(float, rng.random(3) * 1e-3)]) for i in range(200)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = np.array([v for _, v in rows], np.float32).astype(float)
    for q in range(0, 200, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.lexsort((np.arange(200), -score))[:20].tolist()


def test_pipeline_matches_brute_force(spark, sf_dir):
    import corpus_pipeline
    from tests.llm.test_dedup import brute_classes, brute_passages

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf_dir).toPandas(), docs.schema)
        assert now.columns == docs.columns
        frames[name] = {r.doc_id: r.text for r in now.collect()}
    named = {r.doc_id: (r.lang_pred, r.score) for r in crf.predict(docs, crf.fit(docs)).collect()}
    assert set(frames["language"]) == {d for d, (lang, score) in named.items() if lang != "und" and score >= crf.least_score(crf.fit(docs))}
    lines_, gone = brute_passages(sorted(frames["language"].items()))
    for d, text in frames["language"].items():
        want = [x for i, x in enumerate(lines_[d]) if i not in gone[d] and x]
        assert [x for x in frames["line dedup"].get(d, "").split("\n") if x] == want
        assert d in frames["line dedup"] or (gone[d] and not want)
    rows = [(d, t) for d, t in sorted(frames["line dedup"].items())]
    assert set(frames["near copies"]) == {c for _, c, _ in brute_classes(rows)}
    tokens = lambda t: WORD.findall((t or "").translate(FOLD))
    bad = {tuple(v[i : i + 10]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for v in [tokens(r.text)] for i in range(len(v) - 9)}
    clean = {d for d, t in frames["near copies"].items() if not any(tuple(v[i : i + 10]) in bad for v in [tokens(t)] for i in range(len(v) - 9))}
    assert set(frames["decontaminate"]) == clean
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == clean
