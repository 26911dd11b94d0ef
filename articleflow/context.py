"""Run context: the scalar inputs of a pipeline run. Time enters the plans only through ``now``."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

from articleflow.schemas import BACKFILL_MAX_DAYS, UNKNOWN


def new_run_id(now: datetime | None = None) -> str:
    """``run_<yyyymmdd_HHMMSS>_<8 hex>``; one value per run, made on the driver."""
    now = now or datetime.now(UTC)
    return f"run_{now.strftime('%Y%m%d_%H%M%S')}_{secrets.token_hex(4)}"


def _utc(ts: datetime) -> datetime:
    return ts.replace(tzinfo=UTC) if ts.tzinfo is None else ts.astimezone(UTC)


@dataclass(frozen=True)
class RunContext:
    run_date: datetime
    backfill_days: int = 0
    run_id: str | None = None
    now: datetime = field(default_factory=lambda: datetime.now(UTC))
    floor_to_day: bool = False  # documented meaning of backfill 0 ("today"); off = exact instant cutoff

    def __post_init__(self):
        if not 0 <= int(self.backfill_days) <= BACKFILL_MAX_DAYS * 1000:
            raise ValueError(f"backfill_days out of range: {self.backfill_days}")
        object.__setattr__(self, "run_date", _utc(self.run_date))
        object.__setattr__(self, "now", _utc(self.now))

    @property
    def cutoff(self) -> datetime:
        start = self.run_date - timedelta(days=int(self.backfill_days))
        if self.floor_to_day:
            start = start.replace(hour=0, minute=0, second=0, microsecond=0)
        return start

    @property
    def effective_run_id(self) -> str:
        return self.run_id or UNKNOWN

    def with_run_id(self) -> "RunContext":
        return self if self.run_id else replace(self, run_id=new_run_id(self.now))


def validate_backfill(days: int) -> int:
    """API bound of the run trigger: 0..30 days."""
    if not isinstance(days, int) or not 0 <= days <= BACKFILL_MAX_DAYS:
        raise ValueError(f"backfill_days must be within 0..{BACKFILL_MAX_DAYS}, got {days!r}")
    return days
