"""Many patterns looked up in one pass over a text (Aho and Corasick 1975)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..sources.tables import saved
from .names import grams

#: Characters of all names together up to which they are shipped as one automaton; beyond, word runs meet the names in a join.
MOST_CHARACTERS = 1 << 24
#: Words of a name that the join looks for at most.
WORDS = 4


def machine(patterns: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """An automaton whose matches yield (last place, (length, values)); patterns may repeat and share beginnings."""
    values: dict[str, list] = {}
    for pattern, value in patterns:
        if pattern:
            values.setdefault(pattern, []).append(value)
    out = ahocorasick.Automaton()
    for pattern, found in values.items():
        out.add_word(pattern, (len(pattern), tuple(found)))
    if values:
        out.make_automaton()
    return out


def matches(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, tuple]]:
    """(first place, values) of every occurrence, overlapping ones too."""
    if len(automaton):
        for last, (length, values) in automaton.iter(text):
            yield last - length + 1, values


def names_in(texts: DataFrame, key: str, text: str, names: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """key, k: the different names k (text keys) that stand as whole words in each text, taken as a text key. Null and empty ones are in none.

    Up to `most` characters of names go to every task as one automaton, so a text is read once whatever the number of names. More
    names than that meet the texts' runs of up to WORDS words by equality instead, which finds the same names of up to so many words.
    """
    known = saved(names.where(F.col("k") != "").select("k").distinct(), "names")
    if (known.agg(F.sum(F.length("k"))).first()[0] or 0) > most:
        return texts.select(key, F.explode(grams(F.col(text), WORDS)).alias("k")).join(known, "k").select(key, "k")
    shared = texts.sparkSession.sparkContext.broadcast(known.toArrow()["k"].to_pylist())
    rows = texts.select(key, text_key(F.col(text)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = machine((f" {k} ", k) for k in shared.value)
        for batch in batches:
            at, found = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                here = {k for _, values in matches(automaton, f" {t} ") for k in values} if t else ()
                at += [row] * len(here)
                found += sorted(here)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, "k"])

    return rows.mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, k string")
