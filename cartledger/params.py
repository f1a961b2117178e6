"""Settings that change results or plans, in one immutable place."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

# The defaults of the retail data set this engine is made for.
DEFAULT_LAPSED_AFTER_DAYS = 180
DEFAULT_WINDOW_START = "2009-12-01 00:00:00"
DEFAULT_WINDOW_END = "2011-12-31 23:59:59"


@dataclass(frozen=True)
class Params:
    window_start: str = DEFAULT_WINDOW_START
    window_end: str = DEFAULT_WINDOW_END
    lapsed_after_days: int = DEFAULT_LAPSED_AFTER_DAYS
    quiet_days: int = 60
    order_value_cap: int = 1000
    histogram_bins: int = 40
    density_points: int = 200

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Params":
        """The names of the settings."""
        env = os.environ if env is None else env
        return cls(
            window_start=env.get("DATASET_START_DATE", DEFAULT_WINDOW_START),
            window_end=env.get("DATASET_END_DATE", DEFAULT_WINDOW_END),
            lapsed_after_days=int(env.get("LAPSED_THRESHOLD_DAYS", DEFAULT_LAPSED_AFTER_DAYS)),
        )

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    def months(self) -> list[str]:
        """Every ``yyyy-MM`` of the accepted date window, in order."""
        first, last = (
            int(edge[:4]) * 12 + int(edge[5:7]) - 1 for edge in (self.window_start, self.window_end)
        )
        return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]
