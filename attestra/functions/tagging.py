"""Hazard tagging of report texts by a lexicon, with negation, tense and measured values."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Cue stems of each hazard (our own list, English and romanised Hindi), words of negation and tense, plausible ranges.
CUES = {
    "URBAN_FLOOD": ("flood", "waterlog", "inundat", "submerg", "jalbharav", "baadh"),
    "RIVER_BREACH": ("breach", "embankment", "overflow", "dam burst"),
    "LANDSLIDE": ("landslide", "mudslide", "rockfall", "bhuskhalan"),
    "CLOUDBURST": ("cloudburst", "badal phat"),
    "RAINFALL": ("rain", "downpour", "barish", "shower"),
    "CYCLONE": ("cyclone", "toofan"),
    "DUST_STORM": ("dust storm", "sandstorm", "aandhi"),
    "HAILSTORM": ("hail", "ole"),
    "LIGHTNING": ("lightning", "bijli gir"),
    "THUNDERSTORM": ("thunder",),
    "STRONG_WIND": ("strong wind", "gale", "gust", "squall"),
    "HEATWAVE": ("heatwave", "heat wave", "loo lag", "scorching"),
    "COLD_WAVE": ("cold wave", "coldwave", "sheetlahar"),
    "FOG": ("fog", "kohra", "mist"),
}
#: All cues as one automaton, so that a text is read once whatever their number; made by each worker when it first tags.
_machines: list = []
NEGATIONS = frozenset(("no", "not", "never", "without", "nahi", "nahin", "isn't", "wasn't"))
PAST = re.compile(r"\b(last (?:week|month|year)|years? ago|yesterday|throwback)\b")
FORECAST = re.compile(r"\b(forecast|expected|likely|warning|will|may|alert)\b")
OBSERVED = re.compile(r"\b(right now|currently|happening|abhi|is rising|are stuck)\b")
OCCURRED = re.compile(r"\b(occurred|happened|hit|struck)\b")
RANGES = {"temperature_c": (-15, 55), "wind_kmh": (0, 250), "rain_mm": (0, 1000), "visibility_m": (0, 10_000), "depth_cm": (0, 1000)}
VALUES = {
    "temperature_c": re.compile(r"(-?\d+(?:\.\d+)?)\s*(?:°\s*c|deg(?:rees)?(?: c)?|celsius)\b"),
    "wind_kmh": re.compile(r"(\d+(?:\.\d+)?)\s*(?:km/?h|kmph|kph)\b"),
    "rain_mm": re.compile(r"(\d+(?:\.\d+)?)\s*mm\b"),
    "visibility_m": re.compile(r"visibility[^.\d]{0,20}(\d+)\s*m\b"),
}
DEPTH = re.compile(r"(\d+(?:\.\d+)?)\s*(cm|feet|foot|ft|m|metres?|meters?)\b(?=[^.]{0,30}(?:water|deep|paani|flood))|(?:water|paani)[^.]{0,30}?(\d+(?:\.\d+)?)\s*(cm|feet|foot|ft|m|metres?|meters?)\b")
BODY = {"ankle": 15.0, "knee": 50.0, "waist": 100.0, "chest": 130.0, "neck": 150.0}
CM = {"cm": 1.0, "f": 30.48, "m": 100.0}

SCHEMA = StructType([StructField("hazards", ArrayType(StringType())), StructField("negated", ArrayType(StringType())), StructField("tense", StringType()), StructField("depth_cm", DoubleType()), StructField("implausible", ArrayType(StringType())), *(StructField(k, DoubleType()) for k in VALUES)])


def tense(text: str) -> str:
    """past, forecast or now: past beats forecast, an observation cancels both, an occurrence cancels a forecast only."""
    if OBSERVED.search(text):
        return "now"
    if PAST.search(text):
        return "past"
    return "forecast" if FORECAST.search(text) and not OCCURRED.search(text) else "now"


def depth_cm(text: str) -> float | None:
    """The greatest water depth that a text states by a measure or a body part."""
    found = [float(a or c) * CM.get((b or d)[0] if (b or d) != "cm" else "cm", 1.0) for a, b, c, d in DEPTH.findall(text)]
    found += [cm for part, cm in BODY.items() if re.search(rf"\b{part}[ -]?(?:deep|high|level)", text)]
    return max(found, default=None)


def cued(joined: str, starts: list[int]) -> dict[str, list[int]]:
    """The words, by their number, at which cues of each hazard begin; a cue begins a word or follows an apostrophe."""
    if not _machines:
        from ..operators.automaton import machine

        _machines.append(machine((cue, hazard) for hazard, cues in CUES.items() for cue in cues))
    found: dict[str, list[int]] = {hazard: [] for hazard in CUES}
    for last, (length, hazards) in _machines[0].iter(joined):
        first = last - length + 1
        if first == 0 or joined[first - 1] in " '":
            for hazard in hazards:
                found[hazard].append(bisect_right(starts, first) - 1)
    return found


def tag(text: str | None) -> dict:
    """Hazards and negated hazards in table order, tense, values, and the names of implausible values."""
    low = re.sub(r"#(\w+)", r"\1", (text or "").lower())
    tokens = re.findall(r"[\w']+", low)
    joined = " ".join(tokens)
    starts = list(accumulate((len(t) + 1 for t in tokens[:-1]), initial=0))
    negated = [t in NEGATIONS for t in tokens]
    yes, no = [], []
    for hazard, places in cued(joined, starts).items():
        if places:
            (yes if any(not any(negated[max(0, k - 3) : k] + negated[k + 1 : k + 4]) for k in places) else no).append(hazard)
    values = {k: (float(m[1]) if (m := p.search(low)) else None) for k, p in VALUES.items()}
    depth = depth_cm(low)
    bad = [k for k, v in (*values.items(), ("depth_cm", depth)) if v is not None and not RANGES[k][0] <= v <= RANGES[k][1]]
    fine = {k: None if k in bad else v for k, v in values.items()}
    named = {"HEATWAVE": (fine["temperature_c"] or 0) >= 40, "FOG": fine["visibility_m"] is not None and fine["visibility_m"] < 1000 and "DUST_STORM" not in yes, "STRONG_WIND": (fine["wind_kmh"] or 0) >= 39}
    named["COLD_WAVE"] = fine["temperature_c"] is not None and fine["temperature_c"] <= 5 and "cold" in tokens
    yes = [h for h in CUES if h in yes or (named.get(h) and h not in no)]
    return {"hazards": yes, "negated": no, "tense": tense(low), "depth_cm": None if "depth_cm" in bad else depth, "implausible": bad, **fine}


@F.pandas_udf(SCHEMA)
def tags(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """tag() of a column of texts; equal texts of a batch are tagged once."""
    for part in parts:
        known = {t: tag(t) for t in part.unique()}
        yield pd.DataFrame([known[t] for t in part], columns=[f.name for f in SCHEMA.fields])
