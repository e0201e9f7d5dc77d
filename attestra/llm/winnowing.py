"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of the k-gram hashes of every window of words the least is kept. Two equal windows keep the same one, so a join of kept hashes
finds every document that shares a whole window; hits are then extended to the exact windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window, and of the hashed k-grams within it.
WINDOW, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is not in a word, once A-Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, which an expression used within a lambda is not."""
    return F.transform(F.array(value), body)[0]


def slid(values: Column, width: int, body: Callable[[Column], Column]) -> Column:
    """body of every `width` consecutive values; none of fewer."""

    def each(v: Column) -> Column:
        n = F.size(v)
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: body(F.slice(v, i, width)))).otherwise(F.array().cast("array<bigint>"))

    return let(values, each)


def gram_hashes(words_: Column, k: int) -> Column:
    """The hash of every k consecutive words."""
    return slid(words_, k, F.xxhash64)


def kept(hashes: Column, width: int) -> Column:
    """The least of every `width` consecutive hashes."""
    return slid(hashes, width, F.array_min)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """length, span (the window's words, joined by a space), items (sorted ids) of each different window of the benchmark."""
    def windows(w: Column) -> Column:
        length = F.least(F.size(w), F.lit(window))
        at = F.sequence(F.lit(1), F.size(w) - length + 1)
        return F.when(length > 0, F.array_distinct(F.transform(at, lambda i: F.struct(length.alias("length"), F.array_join(F.slice(w, i, length), " ").alias("span")))))

    rows = benchmark.select("item_id", F.explode(let(words(F.col("text")), windows)).alias("x")).select("item_id", "x.length", "x.span")
    return rows.groupBy("length", "span").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and tid, the text's digest).

    A document word is hit if it lies in an occurrence of `window` consecutive words of an item, or of a whole shorter item.
    n_items counts the different non-null item_ids with such a window; items_sha256 is the SHA-256 of those ids, sorted as
    strings and joined by commas (of the empty string if there are none). Null or wordless texts have no words and no hits;
    null or wordless items have no windows; a null item_id still hits words. Repeated documents each get a row.
    """
    named = common.saved(item_windows(benchmark, window).withColumn("span_id", F.xxhash64("length", "span")), "winnowing-items")
    spans = named.select("length", "span", "span_id")
    lengths = sorted(r[0] for r in spans.select("length").distinct().collect())  # at most `window` values
    texts = common.texts_of(documents)
    base = documents.select("doc_id", common.text_id(F.col("text")).alias("tid"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    if not lengths:
        found = base.select("tid").limit(0).select("tid", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("ids"))
    else:
        hits = common.saved(_occurrences(texts, spans, lengths), "winnowing-places")
        covered = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1))))
        n_hit = hits.groupBy("tid").agg(F.size(covered).cast("bigint").alias("n_hit"))
        items = named.select("span_id", F.explode(F.transform("items", lambda i: i.cast("string"))).alias("item"))
        held = hits.select("tid", "span_id").distinct().join(items, "span_id").groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("ids"))
        found = common.saved(n_hit.join(held, "tid", "left"), "winnowing-found")
    out = base.join(found, "tid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "tid",
    )


def _shape(length: int) -> tuple[int, int]:
    """Words of the hashed grams of a window of `length` words, and grams of a window."""
    k = min(GRAM, (length + 1) // 2)
    return k, length - k + 1


def _occurrences(texts: DataFrame, spans: DataFrame, lengths: list[int]) -> DataFrame:
    """tid, at (word number), length, span_id of every occurrence of the windows; rows may repeat.

    All lengths are sought in one pass over the texts, and the texts that share a kept hash are read once more.
    """

    def prints(v: Column, length: int) -> Column:
        k, width = _shape(length)
        return kept(gram_hashes(v, k), width)

    def tagged(v: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.array_distinct(prints(v, n)), lambda p: F.struct(F.lit(n).alias("length"), p.alias("print")))

        each = [of(n) for n in lengths]
        return each[0] if len(each) == 1 else F.concat(*each)

    own = [spans.where(F.col("length") == n).select("length", F.array_min(gram_hashes(F.split("span", " "), _shape(n)[0])).alias("print")) for n in lengths]
    wanted = own[0]
    for other in own[1:]:
        wanted = wanted.unionByName(other)
    wanted = common.saved(wanted.distinct(), "winnowing-prints")
    each = texts.where("tid is not null").select("tid", F.explode(let(words(F.col("text")), tagged)).alias("x")).select("tid", "x.length", "x.print")
    likely = common.saved(each.join(wanted, ["length", "print"]).groupBy("tid").agg(F.collect_set(F.struct("length", "print")).alias("found")), "winnowing-hits")

    def places(v: Column) -> Column:
        def of(n: int) -> Column:
            mine = F.transform(F.filter("found", lambda x: x["length"] == n), lambda x: x["print"])
            at = let(prints(v, n), lambda least: F.filter(F.sequence(F.lit(1), F.size(least)), lambda i: F.array_contains(mine, F.element_at(least, i))))
            here = F.transform(at, lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("length"), F.array_join(F.slice(v, i, n), " ").alias("span")))
            return F.when(F.size(mine) > 0, here).otherwise(F.array().cast("array<struct<at:int,length:int,span:string>>"))

        return F.concat(*(of(n) for n in lengths)) if len(lengths) > 1 else of(lengths[0])

    windows = texts.join(likely, "tid").select("tid", F.explode(let(words(F.col("text")), places)).alias("x")).select("tid", "x.at", "x.length", "x.span")
    return windows.join(spans, ["length", "span"]).select("tid", "at", "length", "span_id")
