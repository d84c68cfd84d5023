"""What one job reads: a region, a date window, a volume vintage, a postcode level."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from roadlens import fixed


@dataclass(frozen=True)
class Job:
    """Arguments of a report. `None` means no restriction on that axis."""

    region: str | None = None
    first_date: date | None = None
    last_date: date | None = None
    vintage_year: int | None = None
    postcode_level: str = "sector"

    def __post_init__(self):
        if self.postcode_level not in fixed.POSTCODE_PATTERNS:
            raise ValueError(
                f"Unknown postcode level '{self.postcode_level}'. "
                f"Choose one of {', '.join(fixed.POSTCODE_PATTERNS)}.")
        if self.first_date and self.last_date and self.first_date > self.last_date:
            raise ValueError(f"The window ends ({self.last_date}) before it starts "
                             f"({self.first_date}).")


@dataclass(frozen=True)
class Box:
    """West, south, east, north in degrees; numbers, or columns such as a scalar subquery."""

    west: object
    south: object
    east: object
    north: object

    @classmethod
    def around(cls, lon, lat, half_width: float, half_height: float) -> "Box":
        return cls(lon - half_width, lat - half_height, lon + half_width, lat + half_height)
