"""Model parameters, in one place so that no two definitions can drift apart."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    #: Waiting: share of riders who time their arrival, and how long those wait.
    sync_share_max: float = 0.5
    sync_wait_minutes: float = 2.0
    sync_headway_from: int = 5
    sync_headway_full: int = 11
    sync_share_grid: tuple[float, ...] = (0.0, 0.25, 0.5, 0.6)
    #: Gaps of this length or more end a service and are no headway.
    max_gap_seconds: int = 3 * 3600
    #: Exposure weights of an hour in tree shade and under a shelter.
    tree_transmissivity: float = 0.03
    shelter_exposure_factor: float = 0.5
    shelter_factor_grid: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0, 1.2)
    #: Hours of a day that are studied, both included.
    first_hour: int = 13
    last_hour: int = 19
    #: Matching stops of two id spaces: by reference, and by nearness.
    ref_metres: float = 200.0
    near_metres: float = 30.0
    max_unmatched_share: float = 0.12
    #: Trees that count as standing at a stop, and which trees are usable.
    tree_metres: float = 20.0
    tree_height: tuple[float, float] = (1.0, 45.0)
    tree_crown: tuple[float, float] = (0.5, 30.0)
    crown_base: float = 1.0 / 3.0
    #: Shadow march, in metres of the raster.
    step_metres: float = 10.0

    @property
    def hours(self) -> range:
        return range(self.first_hour, self.last_hour + 1)

    def quoted(self) -> dict[str, float]:
        """The parameters that a map page quotes in its text."""
        own = ("sync_share_max", "sync_wait_minutes", "sync_headway_from", "sync_headway_full", "tree_transmissivity", "shelter_exposure_factor")
        return {k: getattr(self, k) for k in own} | {"shelter_factor_min": min(self.shelter_factor_grid), "shelter_factor_max": max(self.shelter_factor_grid)}


DEFAULTS = Params()
