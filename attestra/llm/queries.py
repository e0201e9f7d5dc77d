"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, crf, jaccard, lines, lm, packing, quality, shards, suffix, vafile, warc, winnowing, yinyang


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, of each document without its repeated 400-byte strings."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("tid")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what is kept), n_removed_chunks, n_removed_lines."""
    return lines.drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the file that holds the document once all arrivals are merged, and its text's SHA-256."""
    store = shards.arrive(table(spark, sf_dir, "documents"))
    return store.read().select("doc_id", "shard", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the masked log-probabilities of each document's words, and how many words those are."""
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, of each document against the benchmark's windows."""
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tid")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return crf.identify(documents).select("doc_id", "held_out", "lang_pred", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (its group's least), n_links (similar other texts), n_copies (documents with its text)."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).drop("tid")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, of each piece of each document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: each query's 20 nearest found by inner product."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


def op12_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return vafile.mine(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_run_index, op2_line_dedup, op3_size_tiers, op4_pseudo_likelihood, op5_decontaminate, op6_language_id, op7_jaccard_join, op8_packing, op9_warc, op10_multiprobe, op11_yinyang, op12_va_file, op13_quality)}


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win
), occ AS (
  SELECT rid, d.k, i, item_id
  FROM (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS span FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, ks WHERE len(w) >= k)) d
  JOIN win ON win.k = d.k AND win.span = d.span
), hit AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT rid, k, i FROM occ)) GROUP BY rid
), its AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM occ GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT rid, unnest(generate_series(0, length(h) // 2 - 400)) AS i, h FROM d WHERE length(h) >= 800
), k AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, 800)) AS v FROM w
), r AS (SELECT rid, i FROM k JOIN (SELECT v FROM k GROUP BY 1 HAVING count(*) > 1) USING (v)
), g AS (SELECT rid, i, sum(CASE WHEN i <= p + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) AS p FROM r)
), s AS (SELECT rid, n, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2
), e AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS kept_from FROM s
), t AS (SELECT rid, sum(b - a) AS removed, count(*) AS spans, max(b) AS tail, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS head FROM e JOIN d USING (rid) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(tail, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, md5(text) AS t FROM documents
), c AS (SELECT t, min(doc_id) AS rep, count(*) AS n_copies, any_value(text) AS text FROM d WHERE text IS NOT NULL GROUP BY 1
), w AS (SELECT t, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM c
), s AS MATERIALIZED (SELECT DISTINCT t, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT t, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
), z AS (SELECT t, count(*) AS n FROM s GROUP BY 1
), p AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT a.t AS a, b.t AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.t <> b.t GROUP BY 1, 2) x JOIN z y ON y.t = x.a JOIN z v ON v.t = x.b WHERE x.m >= 0.8 * (y.n + v.n - x.m) - 1e-9
), r(a, b) AS (SELECT t, t FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), k AS (SELECT r.a AS t, min(c.rep) AS class_id FROM r JOIN c ON c.t = r.b GROUP BY 1
), l AS (SELECT a AS t, count(*) AS n FROM p GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(l.n, 0) AS n_links, coalesce(n_copies, 1) AS n_copies FROM d LEFT JOIN k USING (t) LEFT JOIN c USING (t) LEFT JOIN l USING (t)
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, h, octet_length(encode(body)) AS n, max(page_id) OVER (PARTITION BY h) AS top,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST(concat('0x', substr(h, 1 + (i // 4) * 5, 5)) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31), 1)), '') AS d
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM b
"""


#: A vector as its integer components.
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def op11_sql() -> str:
    """The rounds written out: nearest is each vector's centroid, then the centroids are moved."""
    nearest = """n{0} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT rid, c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{0} m) GROUP BY rid
)"""
    moved = """c{1} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
  FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM n{0} JOIN v USING (rid), generate_series(1, 64) t(i) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, x FROM c{0} WHERE c NOT IN (SELECT c FROM n{0})
)"""
    rounds = ", ".join(f"{nearest.format(r)}, {moved.format(r, r + 1)}" for r in range(5))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_WHOLE} AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), x) - 1 AS c, x FROM v QUALIFY c < 40
), {rounds}, {nearest.format(5)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM n5 JOIN v USING (rid) JOIN c5 USING (c)
"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE} AND len(embedding) > 0
), a AS MATERIALIZED (SELECT row_number() OVER () AS aid, * FROM v WHERE vec_id % 100 = 0
), s AS MATERIALIZED (
  SELECT aid, a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS alike, CAST(list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM a JOIN v ON len(a.x) = len(v.x)
), p AS (SELECT aid, anchor_id, id, score, row_number() OVER (PARTITION BY aid ORDER BY score DESC, id) AS r FROM s WHERE alike AND id <> anchor_id QUALIFY r <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.aid, p.r ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.aid = p.aid AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_run_index": OP1_SQL, "op5_decontaminate": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op9_warc": OP9_SQL, "op11_yinyang": op11_sql(), "op12_va_file": OP12_SQL}
