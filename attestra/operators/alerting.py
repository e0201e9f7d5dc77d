"""Alerts: how long they live, and what a new version of their event does to them."""

from __future__ import annotations

from dataclasses import astuple, dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that an alert lives without an update.
TTL_S = 3600
# Seconds after an alert's end in which it is not raised again, the rise of confidence that escalates, and the change
# of confidence that makes a version an update.
COOLDOWN_S, CONFIDENCE_STEP, VERSION_STEP = 300, 0.10, 0.05
ELIGIBLE = ("AUTO_PUBLISHED", "HUMAN_APPROVED")
ACTIVE, RESOLVED, EXPIRED = ("ACTIVE", "ESCALATED", "ACKNOWLEDGED"), "RESOLVED", "EXPIRED"


def expired(updated_s: Column, as_of: int) -> Column:
    """Whether an alert's time is over at the clock; never for one that was not updated."""
    return F.coalesce(updated_s + TTL_S <= as_of, F.lit(False))


@dataclass(frozen=True)
class Alert:
    """The latest alert of an event (status null: none yet), and how many there were."""

    status: str | None = None
    severity: int | None = None
    confidence: float | None = None
    sources: int | None = None
    updated_s: int | None = None
    expires_s: int | None = None
    alerts: int = 0

    def values(self) -> tuple:
        return astuple(self)

    def expires(self, now: int) -> bool:
        return self.status in ACTIVE and self.expires_s <= now

    def ended(self, status: str, at: int) -> Alert:
        return replace(self, status=status, updated_s=at)


def classified(last: tuple | None, version: Any) -> str:
    """Whether a version is new, an update of the last one acted on (severity, confidence, sources), or was seen."""
    if last is None:
        return "new"
    severity, confidence, sources = last
    changed = version.severity != severity or round(abs(version.confidence - confidence), 6) >= VERSION_STEP or version.sources > sources
    return "updated" if changed else "seen"


def decided(alert: Alert, version: Any, now: int) -> str:
    """What a version does to its event's alert: as alerts.decision, for one row and a clock."""
    if version.rule is None:
        return "RESOLVE" if alert.status in ACTIVE else "NO_ACTION"
    if alert.status is None:
        return "CREATE"
    if alert.status not in ACTIVE:
        return "CREATE" if now - alert.updated_s > COOLDOWN_S else "NO_ACTION"
    if round(version.confidence - alert.confidence, 6) >= CONFIDENCE_STEP:
        return "ESCALATE_LEVEL_2"
    if version.severity > alert.severity:
        return "ESCALATE_LEVEL_1"
    return "UPDATE" if version.sources > alert.sources or version.confidence != alert.confidence else "NO_ACTION"


def after(alert: Alert, action: str, version: Any, now: int) -> Alert:
    """The alert once the action was taken. An update keeps status and severity and lengthens its life; an escalation does not."""
    if action == "CREATE":
        return Alert("ACTIVE", version.severity, version.confidence, version.sources, now, now + TTL_S, alert.alerts + 1)
    if action == "UPDATE":
        return replace(alert, confidence=version.confidence, sources=version.sources, updated_s=now, expires_s=now + TTL_S)
    if action.startswith("ESCALATE"):
        return replace(alert, status="ESCALATED", severity=version.severity, confidence=version.confidence, sources=version.sources, updated_s=now)
    return alert.ended(RESOLVED, now) if action == "RESOLVE" else alert
