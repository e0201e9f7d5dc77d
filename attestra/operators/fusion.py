"""The receipt: a weighted mean of the evidence that is there, its verdict, and where the event goes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor weights, source priors, gates.
WEIGHTS = {"weather": 0.20, "official": 0.10, "density": 0.20, "coherence": 0.15, "vision": 0.15, "reliability": 0.15, "anomaly": 0.05}
PRIORS = {"OFFICIAL_DISPATCH": 1.00, "CWC_GAUGE": 0.95, "AWS_SENSOR": 0.90, "CITIZEN_APP": 0.60, "NEWS_MEDIA": 0.55, "TWITTER_IMD": 0.50, "SOCIAL_MEDIA": 0.50}
CORROBORATED, REVIEW, PUBLISH = 0.6, 0.60, 0.90
SEVERITIES = ("LOW", "MODERATE", "HIGH", "CRITICAL")
WARNING_SCORES = {"Extreme": 1.0, "Severe": 0.85, "Moderate": 0.6, "Minor": 0.3, "Unknown": 0.3}


def lookup(table: dict[str, float], key: Column) -> Column:
    """The value of a key, null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def receipt(scores: dict[str, Column]) -> Column:
    """struct(confidence, coverage, mean): the mean, to four decimals and as it is, over the factors that have a score, each contribution rounded first.

    A null score is a factor that is offline: it is out of the mean, which is not the same as a score of 0. All offline gives 0.
    Parts have four decimals, so a mean halfway between two is one but for the noise of doubles; it is rounded up.
    """
    present = {k: (w, scores[k]) for k, w in WEIGHTS.items() if k in scores}
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    online = add([F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for w, s in present.values()])
    total = add([F.coalesce(F.round(w * F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 4), F.lit(0.0)) for w, s in present.values()])
    return F.struct(F.when(online == 0, 0.0).otherwise(F.round(total / online + 1e-9, 4)).alias("confidence"), F.round(online, 2).alias("coverage"), F.when(online == 0, 0.0).otherwise(total / online).alias("mean"))


def verdict(contradictions: Column, official: Column, weather: Column) -> Column:
    """CONTRADICTED beats all; else CORROBORATED from either score at the gate; else UNCONFIRMED."""
    enough = (F.coalesce(official, F.lit(0.0)) >= CORROBORATED) | (F.coalesce(weather, F.lit(0.0)) >= CORROBORATED)
    return F.when(contradictions > 0, "CONTRADICTED").when(enough, "CORROBORATED").otherwise("UNCONFIRMED")


def is_high(severity: Column) -> Column:
    return F.coalesce(severity.isin("HIGH", "CRITICAL"), F.lit(False))


def review_status(confidence: Column, severity: Column, capped: Column) -> Column:
    """Published from the upper gate on unless capped; serious claims are never quarantined."""
    return (
        F.when((confidence >= PUBLISH) & ~capped, "AUTO_PUBLISHED")
        .when((confidence >= REVIEW) | is_high(severity), "PENDING_HUMAN_REVIEW")
        .otherwise("QUARANTINED")
    )


def quadrant(confidence: Column, severity: Column, approved: Column) -> Column:
    """By severity and confidence; by severity alone once a human has approved; an unknown severity is a threat."""
    minor = severity.isin("LOW", "ADVISORY", "MODERATE")
    return (
        F.when(is_high(severity), F.when(approved | (confidence >= PUBLISH), "CRITICAL_VERIFIED").otherwise("UNVERIFIED_THREAT"))
        .when(minor, F.when(approved | (confidence >= REVIEW), "CONFIRMED_MINOR").otherwise("NOISE"))
        .otherwise("UNVERIFIED_THREAT")
    )


def ordinal(value: Column, cuts: tuple[float, float, float], falling: bool = False) -> Column:
    """0 to 3 by the cuts of MODERATE, HIGH and CRITICAL; null counts as 0."""
    test = (lambda c: value <= c) if falling else (lambda c: value >= c)
    return F.when(value.isNull(), 0).when(test(cuts[2]), 3).when(test(cuts[1]), 2).when(test(cuts[0]), 1).otherwise(0)
