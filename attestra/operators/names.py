"""Names of a gazetteer in texts: longest prefixes, and similar names by shared pieces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_similarity, text_key


def prefixes(text: Column, most: int = 4) -> Column:
    """(n, k) of the first 1 to `most` words of a text, as a text key."""
    t = F.split(text_key(text), " ")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(t), F.lit(most))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(t, 1, n), " ").alias("k")))


def grams(text: Column, most: int = 3) -> Column:
    """Every different run of 1 to `most` words of a text, as text keys."""
    t = F.split(text_key(text), " ")
    runs = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(runs))


def longest_prefix(texts: DataFrame, key: str, text: str, names: DataFrame, most: int = 4) -> DataFrame:
    """key and name: the name (of names: name, k) that is the longest prefix of a text in words; the smaller on a tie."""
    each = texts.select(key, F.inline(prefixes(F.col(text), most)))
    return each.join(names.select("name", "k"), "k").groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("m")).select(key, "m.name")


def similar(left: DataFrame, key: str, text: str, names: DataFrame, least: float, longest: int = 64) -> DataFrame:
    """key, name, similarity of texts (of left: key, text) and names (name, k) whose edit similarity is `least` or more.

    A name is cut into one piece more than the edits it may have, so one piece at least stands unchanged in a similar text, near
    its place. Pieces meet by equality; texts and names of more than `longest` characters are not compared.
    """
    shapes = []  # of each length of a name: its edits, and start and length of each piece
    for n in range(1, longest + 1):
        edits = math.floor((1 - least) * n / least + 1e-9)
        pieces = min(n, edits + 1)
        shapes.append((n, edits, [(n * i // pieces, n * (i + 1) // pieces - n * i // pieces) for i in range(pieces)]))
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(d).alias("d"), F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(w).alias("w")) for i, (a, w) in enumerate(p))).alias("p")) for n, d, p in shapes))
    named = names.where(F.length("k").between(1, longest)).select("name", "k", F.length("k").alias("n"))
    own = F.transform(F.element_at(table, F.col("n"))["p"], lambda p: F.struct(p["i"].alias("i"), F.substring(F.col("k"), p["a"] + 1, p["w"]).alias("piece")))
    right = named.select("name", "k", "n", F.inline(own))
    x = F.col("x")
    fits = F.filter(table, lambda s: F.abs(s["n"] - F.length(x)) <= s["d"])

    def of(s: Column) -> Column:
        def at(p: Column) -> Column:
            first, last = F.greatest(F.lit(0), p["a"] - s["d"]), F.least(p["a"] + s["d"], F.length(x) - p["w"])
            there = F.transform(F.sequence(first, last), lambda o: F.struct(s["n"].alias("n"), p["i"].alias("i"), F.substring(x, o + 1, p["w"]).alias("piece")))
            return F.when(first <= last, there).otherwise(F.array().cast("array<struct<n:int,i:int,piece:string>>"))

        return F.flatten(F.transform(s["p"], at))

    looked = left.select(key, text_key(F.col(text)).alias("x")).where(F.length("x").between(1, longest))
    each = looked.select(key, "x", F.inline(F.array_distinct(F.flatten(F.transform(fits, of)))))
    pairs = each.join(right, ["n", "i", "piece"]).select(key, "x", "name", "k").distinct()
    return pairs.withColumn("similarity", edit_similarity(F.col("x"), F.col("k"))).where(F.col("similarity") >= least).select(key, "name", "similarity")


def best_similar(left: DataFrame, key: str, text: str, names: DataFrame, least: float) -> DataFrame:
    """key, name: the most similar name; the smaller on a tie."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("similarity", 9)), "name")
    return similar(left, key, text, names, least).withColumn("n", F.row_number().over(w)).where("n = 1").select(key, "name")
