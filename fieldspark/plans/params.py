"""Planning parameters with their defaults and clamps."""
from __future__ import annotations

import math
from dataclasses import dataclass, fields

# fixed values: default, least, greatest
RANGES = {"capacity_hours": (140, 1, 10000), "speed_kmh": (45, 1, 200), "detour": (1.3, 1, 3), "areas": (0, 0, 500), "outlier_km": (0, 0, 5000), "work_days": (20, 1, 31)}


@dataclass(frozen=True)
class Params:
    capacity_hours: float = 140
    speed_kmh: float = 45
    detour: float = 1.3
    areas: float = 0
    outlier_km: float = 0
    work_days: float = 20

    def __post_init__(self):
        for f in fields(self):
            default, low, high = RANGES[f.name]
            v = getattr(self, f.name)
            good = isinstance(v, (int, float)) and math.isfinite(v)
            object.__setattr__(self, f.name, min(max(v, low), high) if good else default)
