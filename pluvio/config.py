"""Defaults of the engine."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bounds:
    """A box in degrees; both ends of each axis belong to it."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


@dataclass(frozen=True)
class Grid:
    """An analysis grid: row 0 in the north, column 0 in the west."""

    bounds: Bounds = Bounds(-35.201, -32.201, 149.709, 152.709)
    width: int = 64
    height: int = 64

    @property
    def km_per_row(self) -> float:
        return (self.bounds.lat_max - self.bounds.lat_min) * 111.0 / self.height

    @property
    def km_per_col(self) -> float:
        middle = math.radians((self.bounds.lat_min + self.bounds.lat_max) / 2)
        return (self.bounds.lon_max - self.bounds.lon_min) * 111.0 * math.cos(middle) / self.width

    @property
    def km_per_px(self) -> float:
        return (self.km_per_row + self.km_per_col) / 2


@dataclass(frozen=True)
class Detector:
    """Settings of segmentation, tracking and arrival."""

    grid: Grid = field(default_factory=Grid)
    intensity: float = 0.1
    min_area: int = 1
    min_frames: int = 2
    max_angular_variance: float = 0.5
    max_speed_kmh: float = 120.0
    proximity_km: float = 5.0
    lookahead_s: int = 1800
    step_s: int = 60
    bypass_intensity: float = 0.2
    bypass_frames: int = 3
    min_confidence: float = 0.35
    edge_min_closing_km: float = 10.0
    centroid_min_closing_km: float = 20.0
    recent_frames: int = 2
    frame_s: int = 600
    match_share: float = 0.25
    accelerate: bool = False

    @property
    def max_match_px(self) -> float:
        return max(self.grid.width, self.grid.height) * self.match_share

    @property
    def farthest_km(self) -> float:
        """From where a cell within the speed limit can still arrive by closing in."""
        return self.proximity_km + self.max_speed_kmh * self.lookahead_s / 3600

    @property
    def proximity_px(self) -> float:
        return self.proximity_km / self.grid.km_per_px


@dataclass(frozen=True)
class Quality:
    """Settings of the confidence factors."""

    kernel: int = 5
    texture_low: float = 0.05
    texture_high: float = 0.15
    echo: float = 0.01
    temporal_frames: int = 3
    texture_weight: float = 0.45
    temporal_weight: float = 0.35
    clutter_weight: float = 0.20
    speed_weight: float = 0.15
    motion_weight: float = 0.10
    decay: float = 0.99966
    mature_updates: float = 2016.0
    speed_low: float = 3.0
    speed_high: float = 130.0
    coherent: float = 0.4
