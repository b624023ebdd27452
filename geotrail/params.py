"""Parameter objects and the argument checks made before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

OUTSIDE = "outside"
"""Region name of the points that no region of the model holds."""


def require_positive(**values) -> None:
    """ValueError unless every named value is above zero."""
    for name, value in values.items():
        if value is None or value <= 0:
            raise ValueError(f"{name} must be above zero, got {value}")


def require_text(**values) -> None:
    """ValueError if a named path or name is missing or blank."""
    for name, value in values.items():
        if value is None or not str(value).strip():
            raise ValueError(f"{name} must be given")


@dataclass(frozen=True)
class Bounds:
    """Half-open rectangle ``[min_x, max_x) x [min_y, max_y)`` that a model tiles."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def __post_init__(self):
        if not (self.min_x < self.max_x and self.min_y < self.max_y):
            raise ValueError(f"bounds are empty: {self}")

    @property
    def width(self) -> float:
        return float(self.max_x - self.min_x)

    @property
    def height(self) -> float:
        return float(self.max_y - self.min_y)

    @property
    def pad(self) -> float:
        """Margin added to region boxes when pruning.

        A cell number and a box edge can differ by one rounding if the bounds are not
        powers of two; the margin makes pruning over-select, never under-select.
        """
        return 1e-9 * max(self.width, self.height)


@dataclass(frozen=True)
class PartitionParams:
    """What the partitioning of a data set depends on; without ``max_depth`` the data decide it."""

    bounds: Bounds
    time_window: int
    node_capacity: int
    sample_size: int
    max_depth: int | None = None

    def __post_init__(self):
        require_positive(
            time_window=self.time_window,
            node_capacity=self.node_capacity,
            sample_size=self.sample_size,
            max_depth=1 if self.max_depth is None else self.max_depth,
        )
        if self.max_depth is not None and self.max_depth > 20:
            raise ValueError("max_depth must not be above 20")


@dataclass(frozen=True)
class CircleQuery:
    """Closed disc and closed time interval."""

    x: float
    y: float
    r: float
    ta: int
    tb: int
    query_id: int = 1


@dataclass(frozen=True)
class BoxQuery:
    """Closed rectangle and closed time interval."""

    x0: float
    y0: float
    x1: float
    y1: float
    ta: int
    tb: int
    query_id: int = 1
